"""Connected components of a table of links, by hooking and pointer doubling; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Scratch


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _jumped(hooks: DataFrame) -> DataFrame:
    """(v, c, root) from (v, c): two steps up from v, and three."""
    step = lambda x, y: hooks.select(F.col("v").alias(x), F.col("c").alias(y))
    return step("v", "c1").join(step("c1", "c"), "c1").join(step("c", "root"), "c").select("v", "c", "root")


def _hooks(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c"))


def rough_components(edges: DataFrame) -> DataFrame:
    """(v, c) for every vertex of a link: vertices with one c are connected, though not all that are connected have one."""
    return _jumped(_hooks(edges)).select("v", F.col("root").alias("c"))


def components(spark: SparkSession, edges: DataFrame, owner: Scratch | None = None) -> DataFrame:
    """(v, c) for every vertex of a link (a, b), of any ordered type: c is the smallest vertex of its component.

    Each round hooks every vertex to its smallest neighbour if that is smaller, follows the hooks to
    their roots, and replaces vertices by roots; links within a tree go. Each round at least halves
    the vertices that still have links, and a step cuts chains of hooks to a third. Only the result's
    table stays, for ``owner`` to drop."""
    scratch = Scratch(spark)
    edges = scratch.write(_canonical(edges))
    labels = None
    while not edges.isEmpty():
        hooks = scratch.write(_hooks(edges))
        while True:
            jumped = scratch.write(_jumped(hooks))
            moved = not jumped.where("c <> root").isEmpty()
            hooks = jumped.select("v", F.col("root").alias("c"))
            if not moved:
                break
        upper = hooks.select(F.col("v").alias("c"), F.col("c").alias("root"))
        # the labels of earlier rounds follow the new roots
        labels = scratch.write(hooks if labels is None else labels.join(upper, "c", "left").select("v", F.coalesce("root", "c").alias("c")))
        a, b = (hooks.select(F.col("v").alias(x), F.col("c").alias(f"{x}_root")) for x in "ab")
        edges = scratch.write(_canonical(edges.join(a, "a").join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))))
    if labels is None:
        labels = scratch.write(edges.select(F.col("a").alias("v"), F.col("b").alias("c")))
    scratch.keep_only(labels)
    if owner:
        owner.tables += scratch.tables
    return labels
