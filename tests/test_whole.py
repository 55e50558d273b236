"""Queries and relations take whole tables."""

import duckdb
import pytest

from strandline.operators import ingest, traverse
from strandline.plans import catalogue
from strandline.sources.star import RELATIONS, TABLES, relation

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_no_relation_or_query_keeps_a_part_by_id():
    for text in [*RELATIONS.values(), *catalogue.SQL.values()]:
        for part in ("orderkey % 50 = 0", "orderkey % 10 = 0", "orderkey % 5 = 0", "_id < 500", "_orderkey < 500", "custkey < 50"):
            assert part not in text


def test_closure_follows_long_chains_cycles_and_joining_paths(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(1, 40), (40, 2), (50, 51), (51, 50)]
    got = {(r["v"], r["upper"]): r["steps"] for r in traverse.closure(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got[1, 30] == 29 and got[1, 2] == 1 and got[50, 51] == got[51, 50] == 1 and got[50, 50] == 0
    assert len(got) == 30 * 31 // 2 + 1 + 30 + 4  # 40 reaches itself and 2 to 30, and 1 reaches 40


def test_places_are_consecutive_over_many_partitions(spark):
    e = spark.range(0, 3000, 1, 7).selectExpr("id AS row_index", "id * 37 % 500 AS ms")
    merged = ingest.merged_stream({"b": e, "a": e.where("row_index % 3 = 0")})
    got = [(r["ms"], r["source"], r["row_index"]) for r in merged.orderBy("place").collect()]
    assert got == sorted(got) and len(got) == 4000
    assert merged.selectExpr("min(place)", "max(place)", "count(DISTINCT place)").first() == (1, 4000, 4000)


def test_knows_has_every_pair(spark, duck):
    orders, lines = (duck.execute(f"SELECT * FROM {t}").fetchall() for t in ("(SELECT o_orderkey, o_custkey FROM orders)", "(SELECT l_orderkey, l_suppkey FROM lineitem)"))
    of = dict(orders)
    want = {(of[o], s) for o, s in lines if o in of and of[o] != s}
    assert {(r["src"], r["dst"]) for r in relation(spark, SF, "knows").collect()} == want
