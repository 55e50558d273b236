"""A property graph in Parquet folders: one table per property group, nodes, and a log of property updates.

Writes append; reads lay the newest committed updates over immutable versions. One call is one batch: its
edges get consecutive sequence numbers, its updates share a commit number. ``compact`` merges updates,
drops hidden versions and writes sorted files into a new folder, which one small manifest row publishes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalars import fixed_width, pipe_get
from strandline.model import GraphError, GraphSchema, Status, load_schema
from strandline.operators import versions
from strandline.operators.versions import EDGE
from strandline.sources.shared import materialise, numbered

UPDATES = "kind string, grp string, property string, src long, dst long, is_out boolean, edge_type short, base_seq long, commit_seq long, value string"
EPOCHS = "table string, epoch long"


class Graph:
    def __init__(self, spark: SparkSession, path: str, schema: GraphSchema) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    @staticmethod
    def open(spark: SparkSession, path: str, schema: GraphSchema | str) -> Graph:
        """``schema`` is a GraphSchema or the path of a schema file."""
        return Graph(spark, path, load_schema(schema) if isinstance(schema, str) else schema)

    # ------------------------------------------------------------ tables

    def _read(self, folder: str, schema) -> DataFrame:
        """The table in a folder, empty as long as the folder is not there; whatever else goes wrong is an error."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def _epoch(self, table: str) -> int:
        return self._read("manifest", EPOCHS).where(F.col("table") == table).agg(F.max("epoch")).first()[0] or 0

    def _table(self, table: str) -> str:
        return f"{table}/{self._epoch(table)}"

    def group(self, name: str) -> DataFrame:
        g = next(g for g in self.schema.groups if g.name == name)
        return self._read(self._table(f"edges/{name}"), self.schema.edge_type(g))

    @property
    def groups(self) -> dict[str, DataFrame]:
        return {g.name: self.group(g.name) for g in self.schema.groups}

    @property
    def nodes(self) -> DataFrame:
        return self._read(self._table("nodes"), self.schema.node_type())

    @property
    def updates(self) -> DataFrame:
        return self._read("updates", UPDATES)

    def _append(self, df: DataFrame, folder: str) -> None:
        df.write.mode("append").parquet(f"{self.path}/{folder}")

    # ------------------------------------------------------------ numbers

    def next_sequence(self) -> int:
        tables = [*(self.group(g.name).select("seq") for g in self.schema.groups), self.nodes.select("seq"), self._read("observed", "seq long")]
        return max((t.agg(F.max("seq")).first()[0] or 0) for t in tables) + 1

    def next_commit(self) -> int:
        return (self.updates.agg(F.max("commit_seq")).first()[0] or 0) + 1

    def observe_sequence(self, seq: int) -> None:
        """Later batches get numbers above ``seq``."""
        self._append(self.spark.createDataFrame([(seq,)], "seq long"), "observed")

    def numbered(self, df: DataFrame, first: int, name: str = "seq") -> DataFrame:
        return numbered(df, first, name)

    def new_vertices(self, n: int) -> DataFrame:
        """The next ``n`` dense ids."""
        first = (self._read("vertices", "vid long").agg(F.max("vid")).first()[0] or 0) + 1 if n else 0
        if first + n > self.schema.max_vertex_num + 1:
            raise GraphError(Status.INVALID_ARGUMENT, "max_vertex_num is reached")
        ids = self.spark.range(first, first + n).select(F.col("id").alias("vid"))
        self._append(ids, "vertices")
        return ids

    def init_vertices_up_to(self, n: int) -> DataFrame:
        """The ids below ``n`` that were not there yet."""
        if n > self.schema.max_vertex_num:
            raise GraphError(Status.INVALID_ARGUMENT, "max_vertex_num is reached")
        new = self.spark.range(n).select(F.col("id").alias("vid")).join(self._read("vertices", "vid long"), "vid", "left_anti")
        new = materialise(new)
        self._append(new, "vertices")
        return new

    # ------------------------------------------------------------ writes

    def _cut(self, df: DataFrame, names: list[str]) -> list:
        """Missing properties are empty; values are cut to their length in bytes."""
        return [fixed_width(F.coalesce(F.col(n), F.lit("")), self.schema.length(n)).alias(n) if n in df.columns else F.lit("").alias(n) for n in names]

    def put_nodes(self, df: DataFrame) -> None:
        """A new version of whole rows (vid, properties); unknown columns are ignored, one known is needed."""
        if not set(df.columns) & set(self.schema.node.properties):
            raise GraphError(Status.INVALID_ARGUMENT, "no known node property")
        rows = self.numbered(df.select("vid", *self._cut(df, self.schema.node.properties)), self.next_sequence())
        self._append(rows.select("vid", "seq", *self.schema.node.properties), self._table("nodes"))

    def put_node_payload(self, df: DataFrame) -> None:
        """New versions from (vid, payload), the properties in the order of the schema joined by ``|``; none may be empty."""
        self.put_nodes(df.select("vid", *self._slots(df, self.schema.node.properties)))

    def put_edge_payload(self, df: DataFrame, group: str) -> None:
        """Records of one group from (src, dst, edge_type, payload; is_out and seq if given)."""
        g = next(g for g in self.schema.groups if g.name == group)
        self.put_edges(df.select(*(c for c in df.columns if c != "payload"), *self._slots(df, g.properties)))

    def _slots(self, df: DataFrame, names: list[str]) -> list:
        if not df.where("payload is null or payload = ''").isEmpty():
            raise GraphError(Status.INVALID_ARGUMENT, "empty payload")
        return [pipe_get("payload", i).alias(n) for i, n in enumerate(names)]

    def put_edges(self, df: DataFrame, bidirectional: bool = False) -> None:
        """New versions (src, dst, edge_type, properties; is_out defaults to true), a record in each group that has a column.

        A row may have its own ``seq``."""
        fixed = {"src", "dst", "is_out", "edge_type", "seq"}
        names = [c for c in df.columns if c not in fixed]
        known = {p for g in self.schema.groups for p in g.properties}
        if not names or set(names) - known:
            raise GraphError(Status.INVALID_ARGUMENT, f"unknown or no properties: {sorted(set(names) - known)}")
        self._put(df, names, False, bidirectional)

    def delete_edges(self, df: DataFrame, bidirectional: bool = False) -> None:
        """Tombstones for (src, dst, edge_type) in every group."""
        self._put(df, [p for g in self.schema.groups for p in g.properties], True, bidirectional)

    def _put(self, df: DataFrame, names: list[str], deleted: bool, bidirectional: bool) -> None:
        is_out = F.coalesce(F.col("is_out"), F.lit(True)) if "is_out" in df.columns else F.lit(True)
        kept = [c for c in names if c in df.columns] + (["seq"] if "seq" in df.columns else [])
        rows = df.select(F.col("src").cast("long"), F.col("dst").cast("long"), is_out.alias("is_out"), F.col("edge_type").cast("short"), *kept)
        if "seq" not in df.columns:
            rows = materialise(self.numbered(rows, self.next_sequence()))
        rows = rows.withColumn("deleted", F.lit(deleted))
        rows = versions.both_directions(rows) if bidirectional else rows
        for g in self.schema.groups:
            if set(g.properties) & set(names):
                self._append(rows.select(*EDGE, "seq", "deleted", *self._cut(rows, g.properties)), self._table(f"edges/{g.name}"))

    def update_edges(self, df: DataFrame) -> DataFrame:
        """Set properties of the newest versions of (src, dst, is_out, edge_type); one batch, one commit.

        Returns the keys for which a touched group has no live version; their rows change nothing."""
        names = [c for c in df.columns if c not in EDGE]
        found = {g: df.select(*EDGE).join(versions.newest(self.group(g)), EDGE).where("not deleted").select(*EDGE, F.col("seq").alias("base_seq")) for g in versions.routes(self.groups, names)}
        usable = df
        for f in found.values():
            usable = usable.join(f, EDGE, "left_semi")
        commit, parts = self.next_commit(), []
        for g, mine in versions.routes(self.groups, names).items():
            bound = usable.join(found[g], EDGE)
            for n in mine:
                parts.append(bound.select(F.lit("edge").alias("kind"), F.lit(g).alias("grp"), F.lit(n).alias("property"), *EDGE, "base_seq", F.lit(commit).cast("long").alias("commit_seq"), fixed_width(n, self.schema.length(n)).alias("value")))
        missing = materialise(df.select(*EDGE).join(usable, EDGE, "left_anti"))
        batch = parts[0]
        for p in parts[1:]:
            batch = batch.unionByName(p)
        self._append(batch, "updates")
        return missing

    def update_nodes(self, df: DataFrame) -> DataFrame:
        """Set properties of the newest versions of (vid); returns the ids that have none."""
        names = [c for c in df.columns if c != "vid"]
        if not names or set(names) - set(self.schema.node.properties):
            raise GraphError(Status.INVALID_ARGUMENT, "unknown or no properties")
        bound = df.join(self.nodes.groupBy("vid").agg(F.max("seq").alias("base_seq")), "vid")
        missing, commit = materialise(df.select("vid").join(bound, "vid", "left_anti")), self.next_commit()
        key = [F.lit("node").alias("kind"), F.lit("").alias("grp"), F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(True).alias("is_out"), F.lit(0).cast("short").alias("edge_type"), "base_seq", F.lit(commit).cast("long").alias("commit_seq")]
        changes = F.explode(F.array(*(F.struct(F.lit(n).alias("property"), fixed_width(n, self.schema.length(n)).alias("value")) for n in names)))
        batch = bound.select(*key, changes.alias("change")).select("*", "change.property", "change.value").drop("change")
        self._append(batch.select(self.updates.columns), "updates")  # one write: the whole batch or nothing of it
        return missing

    # ------------------------------------------------------------ reads

    def get_nodes(self, names: list[str], ids: DataFrame | None = None) -> DataFrame:
        if not names or set(names) - set(self.schema.node.properties):
            raise GraphError(Status.INVALID_ARGUMENT, "unknown or no properties")
        rows = self.nodes if ids is None else self.nodes.join(ids, "vid", "left_semi")
        best = rows.groupBy("vid").agg(F.max_by(F.struct("seq", *names), "seq").alias("r")).select("vid", "r.*")
        keyed = best.select(F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(True).alias("is_out"), F.lit(0).cast("short").alias("edge_type"), "seq", *names)
        return versions.overlay(keyed, self.updates.where("kind = 'node'"), names).select(F.col("src").alias("vid"), *names)

    def _edge_updates(self) -> DataFrame:
        return self.updates.where("kind = 'edge'")

    def get_edges(self, names: list[str], keys: DataFrame | None = None) -> DataFrame:
        return versions.get_edges(self.groups, self._edge_updates(), names, keys)

    def scan_edges(self, names: list[str], edge_type: int | None = None, is_out: bool | None = True, sources: DataFrame | None = None, as_of: int | None = None) -> DataFrame:
        return versions.scan_edges(self.groups, self._edge_updates(), names, edge_type, is_out, sources, as_of)

    def for_each_edge(self, name: str, src: int, edge_type: int, is_out: bool = True) -> Iterator[Row]:
        """One property over one vertex's neighbours, by dst and then newest first; stop by leaving the loop."""
        one = self.spark.createDataFrame([(src,)], "src long")
        return self.scan_edges([name], edge_type, is_out, one).orderBy("dst", F.desc("seq")).toLocalIterator()

    def locate_edges(self, name: str, keys: DataFrame) -> DataFrame:
        """Which file holds the newest version, and its seq."""
        g = next(iter(versions.routes(self.groups, [name])))
        rows = self.group(g).select(*EDGE, "seq", "deleted", F.col("_metadata.file_path").alias("file"))
        return versions.newest(rows.join(keys, EDGE, "left_semi")).select(*EDGE, "seq", "file")

    def locate_nodes(self, ids: DataFrame) -> DataFrame:
        """Which file holds each node's newest version, and its seq."""
        rows = self.nodes.select("vid", "seq", F.col("_metadata.file_path").alias("file")).join(ids, "vid", "left_semi")
        return rows.groupBy("vid").agg(F.max("seq").alias("seq"), F.max_by("file", "seq").alias("file"))

    def flush_property_updates(self) -> int:
        """The newest commit that every later read sees; a write returns only when its files are there, so nothing waits."""
        return self.next_commit() - 1

    def update_stats(self) -> DataFrame:
        return self.updates.agg(F.count("*").alias("records"), F.countDistinct("commit_seq").alias("batches"), F.max("commit_seq").alias("last_commit"))

    # ------------------------------------------------------------ maintenance

    def compact(self) -> None:
        """Rewrite every group; readers move to the new files when the manifest row is there."""
        for g in self.schema.groups:
            table = f"edges/{g.name}"
            epoch = self._epoch(table)
            rows = versions.compacted(self.group(g.name), self._edge_updates())
            rows.select(*EDGE, "seq", "deleted", *g.properties).write.mode("overwrite").parquet(f"{self.path}/{table}/{epoch + 1}")
            self._append(self.spark.createDataFrame([(table, epoch + 1)], EPOCHS), "manifest")
