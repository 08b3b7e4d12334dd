"""Every registered query runs; those with SQL agree with DuckDB."""

import glob
import os
import random

import duckdb
import pytest

from veriframe.plans import review_queries, rule_queries  # noqa: F401
from veriframe.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(str([plain(v) for v in r]) for r in df.select(*cols).collect())
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in cur.fetchall())


def agrees(spark, name, folder, lines, kind, options="row_group_size 122880"):
    """The query on a lineitem of these rows gives what one thread of DuckDB gives."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create table lineitem ({kind})")
    con.execute(f"insert into lineitem values {', '.join(map(str, lines))}")
    con.execute(f"copy lineitem to '{folder}/lineitem.parquet' (format parquet, {options})")
    df = QUERIES[name](spark, str(folder))
    cur = con.execute(SQL[name])
    at = [[x[0] for x in cur.description].index(x) for x in df.columns]
    want = sorted(str([plain(r[i]) for i in at]) for r in cur.fetchall())
    assert want and sorted(str([plain(v) for v in r]) for r in df.collect()) == want


def test_keyed_lines_with_many_parts(spark, tmp_path):
    # 1 * 100000 + 150000 is more than 2 * 100000 + 7; the two lines of orders 2 and 3 are equal, so the first row counts
    lines = [(1, 1, 150000, "A"), (1, 2, 7, "A"), (2, 1, 100001, "R"), (2, 2, 1, "R"), (3, 2, 1, "R"), (3, 1, 100001, "R"), (3, 1, 5, "N")]
    agrees(spark, "keyed_lines", tmp_path, lines, "l_orderkey bigint, l_linenumber integer, l_partkey bigint, l_returnflag varchar")


def test_weak_orders_read_by_many_tasks(spark, tmp_path):
    # the mean of each order is just 0.6, above or below by the order of adding up; its lines are dealt over several row groups and tasks
    rng = random.Random(3)
    lines = [(k, "R", float(q)) for k in range(1200) for a in rng.sample(range(1, 21), 3) for q in (30 - a, 30 + a)]
    rng.shuffle(lines)
    sizes = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        agrees(spark, "weak_orders", tmp_path, lines, "l_orderkey bigint, l_returnflag varchar, l_quantity double", "row_group_size 2048")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
