"""Tables that a step writes to the shared folder and reads back: lineage is cut, and any executor may be lost."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this process has written and not deleted yet, with the session that wrote it.
_KEPT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, kind: str = "veriframe") -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back. The table goes with discard, or when the process ends."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    _KEPT[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _KEPT.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote, when nothing will read them again."""
    for df in tables:
        _delete(df.sparkSession, df.written_to)


class Scratch:
    """The tables of one operator: keep() writes one, finish() writes the result and deletes all others."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        out = materialize(df)
        self.tables.append(out)
        return out

    def finish(self, df: DataFrame) -> DataFrame:
        out = materialize(df)
        discard(*self.tables)
        self.tables = []
        return out


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_KEPT.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            _KEPT.pop(path, None)
