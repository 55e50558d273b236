"""Reading versioned edges: groups of property columns over one key, tombstones, updates laid over versions.

A group has the key (src, dst, is_out, edge_type, seq), ``deleted`` and its properties as strings. All
versions are kept; (dst, seq) tells parallel edges apart. A tombstone hides every version of its edge
up to its own seq. An update belongs to one version (base_seq) and the newest commit wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["src", "dst", "is_out", "edge_type"]
KEY = [*EDGE, "seq"]


def routes(groups: dict[str, DataFrame], names: list[str]) -> dict[str, list[str]]:
    """The groups that hold the named properties; repeated and empty names are dropped, unknown ones refused."""
    wanted = [n for n in dict.fromkeys(names) if n]
    owner = {c: g for g, df in groups.items() for c in df.columns if c not in (*KEY, "deleted")}
    if not wanted or (unknown := [n for n in wanted if n not in owner]):
        raise ValueError(f"no such properties: {unknown if wanted else names}")
    return {g: mine for g in groups if (mine := [n for n in wanted if owner[n] == g])}


def visible(group: DataFrame, as_of: int | None = None) -> DataFrame:
    """The versions up to ``as_of`` that no tombstone hides."""
    rows = group if as_of is None else group.where(F.col("seq") <= as_of)
    dead = rows.where("deleted").groupBy(*EDGE).agg(F.max("seq").alias("dead"))
    return rows.where("not deleted").join(dead, EDGE, "left").where("dead is null or seq > dead").drop("dead", "deleted")


def newest(group: DataFrame, as_of: int | None = None) -> DataFrame:
    """The newest record of every edge; it may be a tombstone."""
    rows = group if as_of is None else group.where(F.col("seq") <= as_of)
    rest = [c for c in rows.columns if c not in EDGE]
    return rows.groupBy(*EDGE).agg(F.max_by(F.struct(*rest), "seq").alias("_newest")).select(*EDGE, "_newest.*")


def latest_updates(updates: DataFrame, as_of_commit: int | None = None) -> DataFrame:
    """The newest committed value of every version's property: (key, property, value, commit_seq)."""
    rows = updates if as_of_commit is None else updates.where(F.col("commit_seq") <= as_of_commit)
    best = rows.groupBy(*EDGE, F.col("base_seq").alias("seq"), "property").agg(F.max_by("value", "commit_seq").alias("value"), F.max("commit_seq").alias("commit_seq"))
    return best


def overlay(rows: DataFrame, updates: DataFrame, names: list[str], as_of_commit: int | None = None) -> DataFrame:
    """``rows`` with the named properties replaced by the updates bound to their versions."""
    values = latest_updates(updates.where(F.col("property").isin(names)), as_of_commit)
    wide = values.groupBy(*KEY).agg(*(F.max(F.when(F.col("property") == n, F.col("value"))).alias(f"_new_{n}") for n in names))
    out = rows.join(wide, KEY, "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns))


def scan_edges(groups: dict[str, DataFrame], updates: DataFrame | None, names: list[str], edge_type: int | None = None, is_out: bool | None = True, sources: DataFrame | None = None, as_of: int | None = None) -> DataFrame:
    """All versions that have every named property: an inner join of just the groups that hold them."""
    parts = []
    for g, mine in routes(groups, names).items():
        rows = groups[g]
        if edge_type is not None:
            rows = rows.where(F.col("edge_type") == edge_type)
        if is_out is not None:
            rows = rows.where(F.col("is_out") == is_out)
        if sources is not None:
            rows = rows.join(sources.select("src"), "src", "left_semi")
        parts.append(visible(rows.select(*KEY, "deleted", *mine), as_of))
    out = reduce(lambda a, b: a.join(b, KEY), parts)
    names = [n for n in dict.fromkeys(names) if n]
    return (out if updates is None else overlay(out, updates, names)).select(*KEY, *names)


def get_edges(groups: dict[str, DataFrame], updates: DataFrame | None, names: list[str], keys: DataFrame | None = None) -> DataFrame:
    """The newest version of each edge with a ``status``: ok, deleted (a tombstone is newest in a group) or
    not_found (a group has no version); values only if ok. ``keys`` limits the edges and shows missing ones."""
    parts = []
    for k, (g, mine) in enumerate(routes(groups, names).items()):
        rows = groups[g].select(*KEY, "deleted", *mine)
        rows = newest(rows if keys is None else rows.join(keys, EDGE, "left_semi"))
        shown = (rows if updates is None else overlay(rows, updates, mine)).select(*EDGE, F.col("deleted").alias(f"_deleted_{k}"), *mine)
        parts.append(shown)
    out = reduce(lambda a, b: a.join(b, EDGE, "full"), parts)
    if keys is not None:
        out = keys.select(*EDGE).join(out, EDGE, "left")
    gone = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"_deleted_{k}"), F.lit(False)) for k in range(len(parts))))
    missing = reduce(lambda a, b: a | b, (F.col(f"_deleted_{k}").isNull() for k in range(len(parts))))
    status = F.when(gone, "deleted").when(missing, "not_found").otherwise("ok")
    names = [n for n in dict.fromkeys(names) if n]
    return out.withColumn("status", status).select(*EDGE, "status", *(F.when(F.col("status") == "ok", F.col(n)).alias(n) for n in names))


def compacted(group: DataFrame, updates: DataFrame) -> DataFrame:
    """The group as compaction rewrites it: hidden versions gone, updates merged, sorted by key within partitions."""
    names = [c for c in group.columns if c not in (*KEY, "deleted")]
    rows = overlay(visible(group), updates, names).withColumn("deleted", F.lit(False))
    return rows.repartitionByRange("src", "dst", F.desc("seq")).sortWithinPartitions("src", "dst", F.desc("seq"))


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge and its mirror (dst, src, not is_out), which has the same seq."""
    swapped = edges.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst").withColumn("is_out", ~F.col("is_out"))
    return edges.unionByName(swapped)
