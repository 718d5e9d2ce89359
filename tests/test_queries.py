"""Every query outside the optional subpackage against its DuckDB twin, on the smallest tables."""

from __future__ import annotations

import math
import os
import re

import duckdb
import pytest

from corpusloom import catalog

DATA = os.environ.get("CORPUSLOOM_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int | float):
        return f"{value:.6g}"
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'").fetchall()
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = df.collect()
    assert df.columns
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    sql = catalog.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, [tuple(r) for r in got]) == rows(names, cur.fetchall())


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() > 0


@pytest.mark.parametrize("name, columns", [("byte_tokenize_offsets", {"doc_id", "text", "source"}), ("last_write_wins", {"event_id", "ts", "user_id", "event_type", "value", "props"}), ("pricing_summary", {"l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"})])
def test_scans_read_only_what_is_needed(spark, name, columns):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert {c.split(":")[0] for c in schema.split(",")} <= columns


def test_filters_reach_the_scan(spark):
    plan = catalog.queries()["pricing_summary"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan
