"""Declared rows from files, with one error list per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.functions.text import FALSE_WORDS, NUMBER, TRUE_WORDS, commodity_of, presence, strip
from veriframe.operators import scan
from veriframe.tables import materialize

ROW_ERROR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("message", T.StringType())])


def read_declared_csv(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = True) -> DataFrame:
    """A CSV with a header, every value a string, malformed rows kept in _corrupt, with the file's path and each row's place for row_numbers.

    With multi_line, line ends inside quotes are part of a value, and a file is read by one task; without, large files are split and have none.
    The rows are parsed once and written to the shared folder, so that places stay as they are and errors can be asked for alone."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_corrupt"]])
    df = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=False, multiLine=multi_line, escape='"')
    return materialize(df.withColumns({"file": F.col("_metadata.file_path"), "place": F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))}))


def column_errors(columns: Sequence[str], required: Sequence[str], optional: Sequence[str]) -> list[tuple[str, str]]:
    missing = [("missing_column", c) for c in required if c not in columns]
    return missing + [("unknown_column", c) for c in columns if c not in {*required, *optional}]


def error(when: Column, kind: str, message: str) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(message).alias("message")))


def err_required(col: str) -> Column:
    return error(presence(F.col(col)).isNull(), "missing_value", f"{col} is required")


def err_enum(col: str, allowed: Sequence[str]) -> Column:
    c = presence(F.lower(F.col(col)))
    return error(c.isNotNull() & ~c.isin(*allowed), "invalid_value", f"{col} must be one of {', '.join(allowed)}")


def err_percent(col: str) -> Column:
    c = presence(F.col(col))
    number = F.when(c.rlike(NUMBER), c.try_cast("double"))
    return F.coalesce(error(c.isNotNull() & number.isNull(), "invalid_value", f"{col} must be a number"), error((number < 0) | (number >= 100), "invalid_value", f"{col} must be between 0 and 100"))


def err_boolean(col: str) -> Column:
    c = presence(F.lower(F.col(col)))
    return error(c.isNotNull() & ~c.isin(*TRUE_WORDS, *FALSE_WORDS), "invalid_value", f"{col} must be true or false")


def err_year(col: str) -> Column:
    c = presence(F.col(col))
    year = F.when(c.rlike(r"^\d{4}$"), c.try_cast("int"))
    return error(c.isNotNull() & (year.isNull() | (year <= 1900) | (year > 2100)), "invalid_value", f"{col} must be a year")


def err_conditional(flag: Column, col: str) -> Column:
    return error(flag & presence(F.col(col)).isNull(), "missing_value", f"{col} is required here")


def row_errors(*errors: Column) -> Column:
    return F.filter(F.array(*errors), lambda e: e.isNotNull())


def split_valid(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, one row per error)."""
    e = df.withColumn("errors", errors)
    return e.filter(F.size("errors") == 0).drop("errors"), e.withColumn("error", F.explode("errors")).drop("errors").select("*", "error.*").drop("error")


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda x: x != "")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records: (serial, images without blanks); records that cannot be read keep their text in _corrupt."""
    df = spark.read.json(path, multiLine=True, schema="ttbId string, images array<string>, _corrupt string", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return df.select(F.col("ttbId").alias("serial"), F.filter("images", lambda x: F.trim(x) != "").alias("images"), "_corrupt")


def manifest_errors(texts: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """(file, kind, message) of manifests, whole texts of one file a row, that are no JSON array of records."""
    got = F.from_json(text_col, "array<struct<_x:string>>")
    shape = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    why = F.when(~shape.startswith("["), "not_array").when(got.isNull(), "unreadable")
    message = F.when(why == "not_array", "Manifest must be a JSON array").otherwise("Manifest is not valid JSON")
    return texts.select(F.col(file_col).alias("file"), why.alias("kind"), message.alias("message")).filter("kind is not null")


def parse_word_tsv(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Words of TSV lines of 12 fields: level 5 with a text; a negative confidence is null, short and odd lines are passed over."""
    f = F.split(text_col, "\t", -1)
    part = lines.select("*", f.alias("f")).filter(F.size("f") >= 12)
    num = lambda k: F.get("f", F.lit(k)).try_cast("int")
    conf = F.get("f", F.lit(10)).try_cast("double")
    words = part.filter((num(0) == 5) & (F.trim(F.get("f", F.lit(11))) != ""))
    return words.select(*[c for c in lines.columns if c != text_col], num(1).alias("page"), num(5).alias("pos"), F.get("f", F.lit(11)).alias("text"), num(6).alias("x"), num(7).alias("y"), num(8).alias("width"), num(9).alias("height"), F.when(conf >= 0, conf).alias("confidence"))


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Results as CSV with a header, or JSON; Spark's partitions are the files."""
    (df.write.mode("overwrite").csv(path, header=True) if fmt == "csv" else df.write.mode("overwrite").json(path))


def append_history(df: DataFrame, path: str, day_col: str) -> None:
    df.write.mode("append").partitionBy(day_col).parquet(path)


#: Columns of the declared table and of the sample export.
REQUIRED = ("serial_number", "beverage_type", "brand_name", "applicant_name_address", "net_contents", "image_filename")
SAMPLE_REQUIRED = ("filename", "brand_name", "class_type", "bottler_address")
NET_CONTENTS_SENTINEL = "Not stated on application"
FLAG_COLUMNS = ("contains_fd_c_yellow_5", "contains_cochineal_carmine", "contains_sulfites_10ppm", "contains_saccharin", "contains_aspartame", "contains_added_coloring")


def detect_layout(columns: Sequence[str]) -> str:
    """sample (an export with file names and at least one more of its columns) or generic; of the header alone."""
    names = {c.strip().lower() for c in columns}
    return "sample" if "filename" in names and len(names & set(SAMPLE_REQUIRED)) >= 2 else "generic"


def csv_file_errors(rows: DataFrame, file_col: str = "file", corrupt_col: str = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """(rows of the sound files, one error for each file with a row that could not be read): a malformed file gives no rows at all."""
    bad = rows.groupBy(file_col).agg(F.count(corrupt_col).alias("_n")).filter("_n > 0").select(file_col)
    errors = bad.select(file_col, F.lit("malformed_csv").alias("kind"), F.lit("The file could not be read as CSV").alias("message"))
    return rows.join(bad, file_col, "left_anti").drop(corrupt_col), errors


def row_numbers(rows: DataFrame, file_col: str = "file", order: str = "place") -> DataFrame:
    """rows with row_number as a spreadsheet shows records: the first one below the header is 2. order: the place within the file; a file of any size is numbered by a prefix scan."""
    numbered = scan.running(scan.blocks(rows, [file_col], [order]), [file_col], [order], row_number=("sum", F.lit(1)))
    return numbered.withColumn("row_number", (F.col("row_number") + 1).cast("int")).drop("block")


def err_image_pair(front: str = "image_filename", back: str = "back_image_filename") -> Column:
    f, b = presence(F.col(front)), presence(F.col(back))
    return F.coalesce(error(f == b, "invalid_value", f"{back} must be different from {front}"), error(b.isNotNull() & f.rlike(r"(?i)\.pdf$"), "invalid_value", f"{back} cannot accompany PDF artwork"))


sample_commodity = commodity_of


def err_sample_row() -> Column:
    """array of errors of a sample row: columns that lack, a class of no commodity, alcohol that is no number (of any size)."""
    abv = presence(F.col("alcohol_content"))
    return row_errors(*[error(presence(F.col(c)).isNull(), "missing_value", f"{c} is required") for c in SAMPLE_REQUIRED],
                      error(sample_commodity(F.col("class_type")).isNull(), "invalid_value", "class_type could not be mapped to malt, wine, or spirits"),
                      error(abv.isNotNull() & ~abv.rlike(NUMBER), "invalid_value", "alcohol_content must be a number"))


def _unescape(c: Column) -> Column:
    """The character references that addresses have."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def build_rows(df: DataFrame) -> DataFrame:
    """Typed declared rows of checked text rows; blank is null, imported is false unless said, varietals are parted by semicolons."""
    from veriframe.functions.text import tri_bool

    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    text, number = (lambda c: presence(have(c))), (lambda c: presence(have(c)).try_cast("double"))
    cols = {c: strip(F.col(c)) for c in REQUIRED} | {"beverage_type": F.lower(strip(F.col("beverage_type"))), "imported": F.coalesce(tri_bool(have("imported")), F.lit(False)), "varietals": split_list(have("varietals")),
            "alcohol_content": number("alcohol_content"), "actual_alcohol_content": number("actual_alcohol_content"), "vintage_year": presence(have("vintage_year")).try_cast("int")}
    cols |= {c: text(c) for c in ("back_image_filename", "fanciful_name", "country_of_origin", "container_embossed_info", "appellation", "declared_class_type")} | {c: tri_bool(have(c)) for c in FLAG_COLUMNS}
    return df.select(*[c for c in df.columns if c not in cols], *[v.alias(c) for c, v in cols.items()])


def build_sample_rows(df: DataFrame) -> DataFrame:
    """Declared rows of a sample export: imported is that a country is there, net contents are a sentinel where none are stated, nothing else is declared."""
    country = strip(F.regexp_replace(presence(F.col("country_of_origin")), r"(?i)^product\s+of\s+", ""))
    return df.select(strip(F.col("filename")).alias("serial_number"), sample_commodity(F.col("class_type")).alias("beverage_type"), presence(F.col("country_of_origin")).isNotNull().alias("imported"), strip(F.col("brand_name")).alias("brand_name"),
                     presence(F.col("fanciful_name")).alias("fanciful_name"), _unescape(strip(F.col("bottler_address"))).alias("applicant_name_address"), presence(F.col("alcohol_content")).try_cast("double").alias("alcohol_content"),
                     F.coalesce(presence(F.col("net_contents")), F.lit(NET_CONTENTS_SENTINEL)).alias("net_contents"), country.alias("country_of_origin"), presence(F.col("class_type")).alias("declared_class_type"))


def union_errors(*errors: DataFrame) -> DataFrame:
    """One stream of errors: columns that one lacks are null in it."""
    out = errors[0]
    for e in errors[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    return out
