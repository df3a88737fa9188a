"""Every registered query with SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import os
import re

import duckdb
import pytest

from plumbline.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(values):
    def plain(v):
        if v is None or v != v:
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(plain, r)) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert columns == sorted(want.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    got, expected = rows(df.select(*columns).collect()), rows(duck.sql(f"SELECT {listed} FROM ({SQL[name]})").fetchall())
    assert got == expected


def test_queries_without_sql_are_tested_otherwise():
    assert set(QUERIES) - set(SQL) == {"self_intersection", "assemble_traverse", "nms", "greedy_match", "anchor_candidates", "tm_project", "bearing_between"}


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(QUERIES) <= set(names)


def test_projection_is_exact(spark):
    assert QUERIES["tm_project"](spark, DATA).agg({"error": "max"}).first()[0] < 1e-8


def test_joins_have_keys(spark):
    """No query falls back to comparing all rows with all."""
    for name in ("region_match", "tolerance_join", "shared_edge", "nearest_edge", "radius_topk", "point_in_polygon", "sheet_division", "evidence_anti", "word_subset_dedupe"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def same_on(spark, name, folder, table, df):
    df.write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    listed = ", ".join(got.columns)
    want = con.sql(f"SELECT {listed} FROM ({SQL[name]})").fetchall()
    got = got.collect()
    assert rows(got) == rows(want)
    return got


def test_house_numbers_of_five_digits_read_as_zip_codes(spark, tmp_path):
    got = same_on(spark, "geocode_cascade", tmp_path, "customer", spark.range(9990, 10014).withColumnRenamed("id", "c_custkey"))
    assert {r["region"] for r in got if r["c_custkey"] % 6 < 2} == {"Nevada", "Ontario"}


def test_points_on_a_slanting_edge_are_covered(spark, tmp_path):
    """Points between (10, 10) and (60, 12), where rounding says on which side of the edge they are."""
    ids = []
    for n in range(200):
        x, y = (1000 + 25 * n + 12) * pow(7919, -1, 10007) % 10007, (1000 + n) * pow(104729, -1, 10009) % 10009
        ids.append((x + 10007 * ((y - x) * pow(10007, -1, 10009) % 10009),))
    got = same_on(spark, "point_in_polygon", tmp_path, "events", spark.createDataFrame(ids, "event_id long"))
    assert {r["polygon_id"]: r["n"] for r in got}[1] == 200


def test_sets_with_null_items_and_wide_sets(spark, tmp_path):
    """Sets of up to 40 items, copies of rows, nulls on both sides: an order with an unknown supplier is in no other."""
    sets = {g: {(g * 7 + k * k) % (5 + g % 40) for k in range(1 + g % 23)} for g in range(120)}
    sets |= {200: set(range(40)), 201: set(range(30)), 202: {None, 1}, 203: {None}, 204: {None, *range(20)}, 205: {1}, None: {1, 2, None}}
    data = [(g, i) for g, x in sets.items() for i in x for _ in range(2)]
    got = same_on(spark, "sheet_division", tmp_path, "lineitem", spark.createDataFrame(data, "l_orderkey long, l_suppkey long"))
    found = {(r["inner_group"], r["outer_group"]) for r in got}
    assert len(got) == len(found) and {(201, 200), (205, 202), (205, 200)} <= found and not {a for a, _ in found} & {202, 203, 204}


def test_sets_meet_by_two_items(spark):
    """Sets that share one item only are not compared."""
    plan = QUERIES["sheet_division"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[x#\d+L, y#\d+L\], \[x#\d+L, y#\d+L\]", plan)
