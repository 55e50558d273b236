"""Bulk and incremental ingest, and the pieces of a workload: samples, point reads, latencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.versions import EDGE
from strandline.sources.shared import numbered

#: The record kinds of update lines and their fields, in order.
UPDATE_FIELDS = {"N": ["vid", "property", "value"], "E": ["src", "dst", "edge_type", "is_out", "property", "value"]}


def implicit_edges(tables: dict[str, DataFrame], rules: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(relation, src, dst) from foreign keys; ``rules``: relation -> (table, key, foreign key). Null keys make no edge."""
    parts = [tables[t].where(F.col(fk).isNotNull()).select(F.lit(name).alias("relation"), F.col(key).cast("long").alias("src"), F.col(fk).cast("long").alias("dst")) for name, (t, key, fk) in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def stub_nodes(endpoints: DataFrame, known: DataFrame) -> DataFrame:
    """Endpoints (vid) that no node row has; they become nodes with empty properties."""
    return endpoints.select("vid").distinct().join(known, "vid", "left_anti")


def skipped_edges(edges: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """How many edges are skipped because an endpoint is unknown, and how many are kept."""
    marked = edges.join(known.select(F.col("vid").alias(column)).distinct().withColumn("_known", F.lit(True)), column, "left")
    return marked.agg(F.count_if(F.col("_known").isNull()).alias("skipped"), F.count("_known").alias("kept"))


def known_edges(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The edges (src, dst) both of whose ends are known."""
    for end in ("src", "dst"):
        edges = edges.join(known.select(F.col("vid").alias(end)), end, "left_semi")
    return edges


def merged_stream(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows (row_index, ms) of all sources in the order of time, then source, then row, with their place from 1.

    Rows are range-partitioned and sorted by this order; only a count per partition meets in one task."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("source"), "row_index", "ms") for name, df in sources.items()])
    return numbered(rows.orderBy("ms", "source", "row_index"), 1, "place")


def sampled(df: DataFrame, index: str, mod: int, rem: int, rest: bool = False) -> DataFrame:
    """The rows whose index leaves ``rem``, or all others."""
    hit = F.col(index) % mod == rem
    return df.where(~hit if rest else hit)


def reservoir(df: DataFrame, key: str, n: int, seed: int = 20260624) -> DataFrame:
    """``n`` rows, the same for the same seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def weighted_mix(hot: DataFrame, cold: DataFrame, key: str, n: int, hot_share: int = 10, cold_share: int = 1) -> DataFrame:
    """About ``n`` requests, hot to cold as the shares are."""
    n_hot = n * hot_share // (hot_share + cold_share)
    return reservoir(hot, key, n_hot).withColumn("class", F.lit("hot")).unionByName(reservoir(cold, key, n - n_hot).withColumn("class", F.lit("cold")))


def point_reads(asked: DataFrame, group: DataFrame) -> DataFrame:
    """Every request (src, dst) with the newest seq of its edge, null if there is none."""
    newest = group.groupBy("src", "dst").agg(F.max("seq").alias("seq"))
    return asked.join(newest, ["src", "dst"], "left")


def latency_summary(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Interpolated percentiles; they and the mean are rounded to six digits, as the last bits depend on the order of sums."""
    exact = lambda q: F.round(F.percentile(column, F.lit(q)), 6)
    return df.groupBy(*by).agg(F.round(F.avg(column), 6).alias("mean"), exact(0.9).alias("p90"), exact(0.95).alias("p95"), exact(0.99).alias("p99"), F.max(column).alias("most"))


def parse_updates(lines: DataFrame) -> DataFrame:
    """Update lines ``N|vid|property|value`` and ``E|src|dst|type|is_out|property|value`` as rows; others are left out."""
    f = F.split("value", r"\|", -1)
    kind = f[0]
    node = lines.where(kind == "N").select(F.lit("node").alias("kind"), f[1].cast("long").alias("src"), f[1].cast("long").alias("dst"), F.lit(True).alias("is_out"), F.lit(0).cast("short").alias("edge_type"), f[2].alias("property"), F.get(f, F.lit(3)).alias("value"))
    edge = lines.where(kind == "E").select(F.lit("edge").alias("kind"), f[1].cast("long").alias("src"), f[2].cast("long").alias("dst"), f[4].isin("1", "true").alias("is_out"), f[3].cast("short").alias("edge_type"), f[5].alias("property"), F.get(f, F.lit(6)).alias("value"))
    return node.unionByName(edge).select("kind", *EDGE, "property", "value")
