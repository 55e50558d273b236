"""Traversals, batched over parameter rows: every frontier row carries the ``pid`` it belongs to.

Edges have (src, dst, ts, amount, seq). A hop keeps edges in the closed window [t0, t1] of its
parameter row and then, for each source, the first ``lim`` of them by time (0: all); further
predicates come after that. Parallel edges count one by one, vertices are made distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.shared import materialise


def hop(frontier: DataFrame, edges: DataFrame, params: DataFrame | None = None, reverse: bool = False, at_least: Column | None = None) -> DataFrame:
    """(pid, v, other, ts, amount, seq) for every edge out of (or into) the frontier's (pid, v).

    ``params`` has (pid, t0, t1, lim, latest_first); without it the relation is not temporal."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    temporal = params is not None
    kept = [c for c in ("ts", "amount", "seq") if c in edges.columns]
    out = frontier.join(edges.withColumnsRenamed({here: "v", there: "other"}).select("v", "other", *kept), "v")
    if temporal:
        out = out.join(F.broadcast(params.select("pid", "t0", "t1", "lim", "latest_first")), "pid").where("ts between t0 and t1")
        order = [F.when(F.col("latest_first"), -F.col("ts")).otherwise(F.col("ts")), F.col("other"), *(F.col(c) for c in ("amount", "seq") if c in kept)]
        out = out.withColumn("place", F.row_number().over(Window.partitionBy("pid", "v").orderBy(*order))).where("lim = 0 or place <= lim")
    if at_least is not None:
        out = out.where(at_least)
    return out.select("pid", "v", "other", *kept)


def bounded_bfs(start: DataFrame, edge_sets: list[DataFrame], params: DataFrame | None, depth: int, reverse: bool = False, at_least: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """All hops of ``depth`` levels and all vertices reached (with the start, at depth 0), as (pid, v, depth).

    Each relation is truncated by itself. Only vertices not seen before are expanded. A level's hops are
    written before the next level reads them, so each level scans the edges once."""
    frontier = start.select("pid", "v").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    hops: list[DataFrame] = []
    for level in range(1, depth + 1):
        out = materialise(reduce(DataFrame.unionByName, [hop(frontier, e, params, reverse, at_least) for e in edge_sets]))
        hops.append(out.withColumn("level", F.lit(level)))
        frontier = out.select("pid", F.col("other").alias("v")).distinct().join(seen, ["pid", "v"], "left_anti")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(level)))
    return reduce(DataFrame.unionByName, hops), seen


def shortest_distance(pairs: DataFrame, edges: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """(pid, distance) for every (pid, a, b): the number of edges of a shortest directed path, -1 without one.

    A level per round until all targets are found or no vertex is new; levels are written between rounds."""
    same = pairs.where("a = b").select("pid", F.lit(0).alias("distance"))
    open_pairs = materialise(pairs.where("a <> b"))
    frontier = open_pairs.select("pid", F.col("a").alias("v"))
    seen, found, level = frontier, [same], 0
    while not frontier.isEmpty():
        level += 1
        reached = hop(frontier, edges, params).select("pid", F.col("other").alias("v")).distinct().join(seen, ["pid", "v"], "left_anti")
        reached = materialise(reached)
        hit = materialise(open_pairs.join(reached, (open_pairs["pid"] == reached["pid"]) & (open_pairs["b"] == reached["v"])).select(open_pairs["pid"]))
        found.append(hit.withColumn("distance", F.lit(level)))
        open_pairs = open_pairs.join(hit, "pid", "left_anti")
        frontier = reached.join(hit, "pid", "left_anti")
        seen = seen.unionByName(reached)
    known = reduce(DataFrame.unionByName, found)
    return pairs.select("pid").join(known, "pid", "left").select("pid", F.coalesce("distance", F.lit(-1)).alias("distance"))


def distance_layers(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pid, v, depth) from each a up to the level at which b is found; nothing for pairs without a path."""
    frontier = pairs.select("pid", F.col("a").alias("v"))
    layers = seen = frontier.withColumn("depth", F.lit(0))
    targets = pairs.select("pid", F.col("b").alias("v"))
    level = 0
    while not frontier.isEmpty():
        level += 1
        done = frontier.join(targets, ["pid", "v"], "left_semi").select("pid")
        grown = frontier.join(done, "pid", "left_anti")
        reached = hop(grown, edges).select("pid", F.col("other").alias("v")).distinct().join(seen, ["pid", "v"], "left_anti")
        frontier = materialise(reached)
        layers = seen = seen.unionByName(frontier.withColumn("depth", F.lit(level)))
    return layers.join(layers.join(targets, ["pid", "v"], "left_semi").select("pid"), "pid", "left_semi")


def all_shortest_paths(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pid, path) for every shortest path from a to b as an array of vertices; [a] where a = b."""
    layers = materialise(distance_layers(pairs, edges.select("src", "dst").distinct()))
    ends = pairs.select("pid", F.col("b").alias("v")).join(layers, ["pid", "v"]).withColumn("path", F.array("v"))
    done = []
    links = edges.select("src", "dst").distinct()
    while not ends.isEmpty():
        done.append(ends.where("depth = 0").select("pid", "path"))
        back = ends.where("depth > 0").join(links, F.col("v") == F.col("dst"))
        upper = layers.select("pid", F.col("v").alias("src"), F.col("depth").alias("up"))
        ends = materialise(back.join(upper, ["pid", "src"]).where("up = depth - 1").select("pid", F.col("src").alias("v"), F.col("up").alias("depth"), F.concat(F.array("src"), "path").alias("path")))
    return reduce(DataFrame.unionByName, done) if done else ends.select("pid", "path")


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(v, upper, steps): every vertex with itself and all that the edges (src, dst) lead to, within ``most`` of them if given.

    Each level goes on from the pairs that were new in the one before, so cycles and joining paths end."""
    edges = edges.select("src", "dst")
    ends = edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()
    level, known, steps = materialise(ends.select("v", F.col("v").alias("upper"), F.lit(0).alias("steps"))), None, 0
    while not level.isEmpty() and (most is None or steps < most):
        known, steps = level if known is None else known.unionByName(level), steps + 1
        further = level.join(edges, F.col("upper") == F.col("src")).select("v", F.col("dst").alias("upper"), F.lit(steps).alias("steps")).distinct()
        level = materialise(further.join(known.select("v", "upper"), ["v", "upper"], "left_anti").select("v", "upper", "steps"))
    return level if known is None else known.unionByName(level)
