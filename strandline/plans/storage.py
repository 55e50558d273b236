"""Queries over versioned edges, traversal primitives, scalars and ingest, with their SQL.

The versions come from line items: the edge (l_suppkey % 20, l_partkey % 40) of type 7 has a version for
each (l_orderkey, l_linenumber); group g0 has property A and g1 has B and C, each for a part of the
versions; some versions are tombstones. Updates come from orders and belong to single versions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import ingest, traverse, workload
from strandline.operators import versions as V
from strandline.operators.traverse import bounded_bfs, closure, hop, shortest_distance
from strandline.plans import social
from strandline.plans.advisor import Access, advise, gain
from strandline.plans.financial_sql import COLUMNS, PARAMS, START
from strandline.plans.social_sql import BASE as SOCIAL_BASE
from strandline.plans import sql as text
from strandline.plans.sql import fresh, query, values
from strandline.sources.star import relation
from strandline.streaming import replay

SCHEMA = "pid int, a long, b long, amount1 long, amount2 long, t0 long, t1 long, lim int, latest_first boolean"

VERSION_SQL = """SELECT l_suppkey % 20 AS src, l_partkey % 40 AS dst, l_orderkey * 8 + l_linenumber AS seq, max(l_linenumber) AS line,
  max(l_orderkey) AS orderkey, max(l_partkey) AS part, max(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY 1, 2, 3"""
SPARK_VERSION_SQL = VERSION_SQL.replace("GROUP BY 1, 2, 3", "GROUP BY l_suppkey % 20, l_partkey % 40, l_orderkey * 8 + l_linenumber")
DEAD = "orderkey % 97 = 0 AND line = 1"
UPDATE_SQL = "SELECT src, dst, seq AS base_seq, property, commit_seq, value FROM ({v}) v, ({c}) c WHERE v.seq % 11 = 0 AND commit_seq % 3 <> v.seq % 3"
COMMITS = "SELECT 'A' AS property, 1 AS commit_seq, 'one' AS value UNION ALL SELECT 'A', 2, 'two' UNION ALL SELECT 'B', 3, 'three'"

CTES = {
    "versions": f"versions AS ({VERSION_SQL})",
    "g0": f"g0 AS (SELECT src, dst, seq, {DEAD} AS deleted, concat('a', part) AS A FROM versions WHERE line % 3 <> 0)",
    "g1": f"g1 AS (SELECT src, dst, seq, {DEAD} AS deleted, flag AS B, status AS C FROM versions WHERE line % 5 <> 0)",
    "updates": "updates AS (" + UPDATE_SQL.format(v="SELECT * FROM versions", c=COMMITS) + ")",
    "v0": "v0 AS (SELECT * FROM g0 WHERE NOT deleted AND seq > coalesce((SELECT max(t.seq) FROM g0 t WHERE t.deleted AND t.src = g0.src AND t.dst = g0.dst), -1))",
    "v1": "v1 AS (SELECT * FROM g1 WHERE NOT deleted AND seq > coalesce((SELECT max(t.seq) FROM g1 t WHERE t.deleted AND t.src = g1.src AND t.dst = g1.dst), -1))",
    "u": "u AS (SELECT src, dst, base_seq AS seq, property, arg_max(value, commit_seq) AS value FROM updates GROUP BY ALL)",
}


def _sql(select: str, *names: str) -> str:
    return query("", [CTES[n] for n in names], select)


def _groups(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    v = spark.sql(SPARK_VERSION_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    v = v.withColumns({"is_out": F.lit(True), "edge_type": F.lit(7).cast("short"), "deleted": F.expr(DEAD)})
    return {
        "g0": v.where("line % 3 <> 0").select(*V.KEY, "deleted", F.concat(F.lit("a"), F.col("part").cast("string")).alias("A")),
        "g1": v.where("line % 5 <> 0").select(*V.KEY, "deleted", F.col("flag").alias("B"), F.col("status").alias("C")),
    }


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = UPDATE_SQL.format(v=SPARK_VERSION_SQL.replace("FROM lineitem", "FROM {lineitem}"), c=COMMITS)
    return spark.sql(sql, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")).withColumns({"is_out": F.lit(True), "edge_type": F.lit(7).cast("short")})


def _params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARAMS, SCHEMA)


def _with_params(ctes: list[str], select: str, recursive: bool = False) -> str:
    return query(values("params", COLUMNS, PARAMS), ctes, select, recursive)


Q: dict = {}
SQL: dict[str, str] = {}


def _register(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- reads of versioned edges


@_register(_sql("SELECT src, dst, seq, A FROM v0", "versions", "g0", "v0"))
def scan_edges_1prop(spark, sf_dir):
    return V.scan_edges(_groups(spark, sf_dir), None, ["A", "A", ""], 7).select("src", "dst", "seq", "A")


@_register(_sql("SELECT src, dst, seq, A, C FROM v0 JOIN v1 USING (src, dst, seq)", "versions", "g0", "g1", "v0", "v1"))
def scan_edges_nprop(spark, sf_dir):
    return V.scan_edges(_groups(spark, sf_dir), None, ["A", "C"], 7).select("src", "dst", "seq", "A", "C")


@_register(_sql("SELECT dst AS src, src AS dst, seq, B FROM v1 WHERE dst = 7", "versions", "g1", "v1"))
def scan_in_edges(spark, sf_dir):
    both = {"g1": V.both_directions(_groups(spark, sf_dir)["g1"])}
    return V.scan_edges(both, None, ["B"], 7, is_out=False, sources=spark.createDataFrame([(7,)], "src long")).select("src", "dst", "seq", "B")


@_register(_sql("SELECT src, dst, seq, A FROM v0 WHERE src = 3 ORDER BY dst, seq DESC LIMIT 25", "versions", "g0", "v0"))
def foreach_edge_prefix(spark, sf_dir):
    one = spark.createDataFrame([(3,)], "src long")
    return V.scan_edges(_groups(spark, sf_dir), None, ["A"], 7, sources=one).orderBy("dst", F.desc("seq")).limit(25).select("src", "dst", "seq", "A")


@_register(_sql("SELECT src, dst, seq, A FROM g0 WHERE NOT deleted AND seq <= 5000 AND seq > coalesce((SELECT max(t.seq) FROM g0 t WHERE t.deleted AND t.seq <= 5000 AND t.src = g0.src AND t.dst = g0.dst), -1)", "versions", "g0"))
def snapshot_as_of_seq(spark, sf_dir):
    return V.scan_edges(_groups(spark, sf_dir), None, ["A"], 7, as_of=5000).select("src", "dst", "seq", "A")


LATEST = """SELECT src, dst, CASE WHEN x.deleted OR y.deleted THEN 'deleted' WHEN x.deleted IS NULL OR y.deleted IS NULL THEN 'not_found' ELSE 'ok' END AS status{more}
FROM (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY seq DESC) = 1) x
FULL JOIN (SELECT * FROM g1 QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY seq DESC) = 1) y USING (src, dst)"""


@_register(_sql("SELECT src, dst, status, CASE WHEN status = 'ok' THEN a END AS A, CASE WHEN status = 'ok' THEN b END AS B FROM (" + LATEST.format(more=", x.A AS a, y.B AS b") + ")", "versions", "g0", "g1"))
def get_edge_latest(spark, sf_dir):
    return V.get_edges(_groups(spark, sf_dir), None, ["A", "B"]).select("src", "dst", "status", "A", "B")


@_register(_sql("SELECT status, count(*) AS edges FROM (" + LATEST.format(more="") + ") GROUP BY status", "versions", "g0", "g1"))
def tombstone_point(spark, sf_dir):
    return V.get_edges(_groups(spark, sf_dir), None, ["A", "B"]).groupBy("status").agg(F.count("*").alias("edges"))


@_register(_sql("SELECT src, count(*) AS live, max(seq) AS newest FROM v1 GROUP BY src", "versions", "g1", "v1"))
def tombstone_scan(spark, sf_dir):
    return V.scan_edges(_groups(spark, sf_dir), None, ["B"], 7).groupBy("src").agg(F.count("*").alias("live"), F.max("seq").alias("newest"))


@_register(_sql("SELECT v0.src, v0.dst, v0.seq, coalesce(u.value, v0.A) AS A FROM v0 LEFT JOIN u ON u.src = v0.src AND u.dst = v0.dst AND u.seq = v0.seq AND u.property = 'A'", "versions", "g0", "v0", "updates", "u"))
def update_edge_overlay(spark, sf_dir):
    return V.scan_edges(_groups(spark, sf_dir), _updates(spark, sf_dir), ["A"], 7).select("src", "dst", "seq", "A")


@_register(_sql("SELECT v0.src, v0.dst, count(*) AS versions, count(u.value) AS updated FROM v0 LEFT JOIN u ON u.src = v0.src AND u.dst = v0.dst AND u.seq = v0.seq AND u.property = 'A' GROUP BY 1, 2", "versions", "g0", "v0", "updates", "u"))
def update_binds_to_version(spark, sf_dir):
    rows = V.scan_edges(_groups(spark, sf_dir), _updates(spark, sf_dir), ["A"], 7)
    return rows.groupBy("src", "dst").agg(F.count("*").alias("versions"), F.count(F.when(F.col("A").isin("one", "two"), 1)).alias("updated"))


@_register(_sql("SELECT src, dst, base_seq AS seq, property, arg_max(value, commit_seq) AS value FROM updates WHERE commit_seq <= 1 GROUP BY ALL", "versions", "updates"))
def update_as_of_commit(spark, sf_dir):
    return V.latest_updates(_updates(spark, sf_dir), 1).select("src", "dst", "seq", "property", "value")


@_register(_sql("SELECT src, dst, seq, coalesce((SELECT value FROM u WHERE u.src = v1.src AND u.dst = v1.dst AND u.seq = v1.seq AND property = 'B'), B) AS B, C FROM v1", "versions", "g1", "v1", "updates", "u"))
def compact_equivalence(spark, sf_dir):
    return V.compacted(_groups(spark, sf_dir)["g1"], _updates(spark, sf_dir)).select("src", "dst", "seq", "B", "C")


@_register(_sql("SELECT commit_seq, property, count(*) AS records FROM updates GROUP BY ALL", "versions", "updates"))
def update_batch_atomic(spark, sf_dir):
    return _updates(spark, sf_dir).groupBy("commit_seq", "property").agg(F.count("*").alias("records"))


@_register(_sql("SELECT src, dst, max(seq) AS seq FROM g0 GROUP BY src, dst", "versions", "g0"))
def locate_edge(spark, sf_dir):
    return V.newest(_groups(spark, sf_dir)["g0"]).select("src", "dst", "seq")


@_register(_sql("SELECT src, dst, true AS is_out, count(*) AS n FROM g1 GROUP BY 1, 2 UNION ALL SELECT dst, src, false, count(*) FROM g1 GROUP BY 1, 2", "versions", "g1"))
def put_bidirectional(spark, sf_dir):
    return V.both_directions(_groups(spark, sf_dir)["g1"]).groupBy("src", "dst", "is_out").agg(F.count("*").alias("n"))


@_register("SELECT c_custkey, arg_max(o_orderpriority, o_orderkey) AS priority, max(o_orderkey) AS seq FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def put_node_newest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("priority"), F.max("o_orderkey").alias("seq"))


def _nodes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"), F.lit(True).alias("is_out"), F.lit(0).cast("short").alias("edge_type"), F.col("o_orderkey").alias("seq"), F.lit(False).alias("deleted"), F.col("o_orderpriority").alias("N0"), F.col("o_orderstatus").alias("N1"))
    return V.newest(rows).drop("deleted")


@_register("SELECT o_custkey AS vid, o_orderpriority AS N0, o_orderstatus AS N1 FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def get_node(spark, sf_dir):
    return _nodes(spark, sf_dir).select(F.col("src").alias("vid"), "N0", "N1")


@_register("SELECT o_custkey AS vid, CASE WHEN o_orderkey % 3 = 0 THEN concat('new', o_orderkey) ELSE o_orderpriority END AS N0, o_orderstatus AS N1 FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def update_node_overlay(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 3 = 0")
    changes = orders.select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"), F.lit(True).alias("is_out"), F.lit(0).cast("short").alias("edge_type"), F.col("o_orderkey").alias("base_seq"), F.lit("N0").alias("property"), F.col("o_orderkey").alias("commit_seq"), F.concat(F.lit("new"), F.col("o_orderkey").cast("string")).alias("value"))
    return V.overlay(nodes, changes, ["N0", "N1"]).select(F.col("src").alias("vid"), "N0", "N1")


@_register("SELECT c_custkey, c_name[:10] AS name FROM customer")
def fixed_width_truncate(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", S.fixed_width("c_name", 10).alias("name"))


@_register(_sql("SELECT src, count(*) AS records, count(DISTINCT dst) AS neighbours FROM g0 GROUP BY src", "versions", "g0"))
def edge_distribution(spark, sf_dir):
    return _groups(spark, sf_dir)["g0"].groupBy("src").agg(F.count("*").alias("records"), F.countDistinct("dst").alias("neighbours"))


# ---------------------------------------------------------------- traversal


def _hops(name: str, lim: str, reverse: bool, latest: str) -> str:
    sql = _with_params([START, text.hop("h", "s0", "transfer", reverse=reverse)], "SELECT pid, v, other, ts, CAST(amount AS DOUBLE) AS amount, seq FROM h")
    return sql.replace("p.lim = 0 OR", f"{lim} = 0 OR").replace("<= p.lim", f"<= {lim}").replace("CASE WHEN p.latest_first", f"CASE WHEN {latest}")


def _hop_query(name: str, lim: int | None, reverse: bool, latest: bool) -> None:
    def run(spark, sf_dir):
        p = _params(spark).withColumns({"lim": F.lit(lim), "latest_first": F.lit(latest)})
        out = hop(p.select("pid", F.col("a").alias("v")), relation(spark, sf_dir, "transfer"), p, reverse)
        return out.withColumn("amount", F.col("amount").cast("double"))

    Q[name] = run
    SQL[name] = _hops(name, str(lim), reverse, str(latest).lower())


_hop_query("hop_out", 0, False, False)
_hop_query("hop_in", 0, True, False)
_hop_query("hop_truncated_asc", 7, False, False)
_hop_query("hop_truncated_desc", 7, True, True)


@_register(_with_params([START, *(x for k in (1, 2, 3) for x in (text.hop(f"h{k}", f"s{k - 1}", "transfer"), fresh(f"s{k}", f"h{k}", [f"s{i}" for i in range(k)])))], "SELECT pid, v, CAST(depth AS INTEGER) AS depth FROM (SELECT *, 0 AS depth FROM s0 UNION ALL SELECT *, 1 FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3)"))
def bfs_depth3(spark, sf_dir):
    p = _params(spark)
    return bounded_bfs(p.select("pid", F.col("a").alias("v")), [relation(spark, sf_dir, "transfer")], p, 3)[1]


@_register(_with_params(["reach(pid, v, d) AS (SELECT pid, a, 0 FROM params UNION SELECT r.pid, k.dst, r.d + 1 FROM reach r JOIN guarantee k ON k.src = r.v WHERE r.d < 12)"], "SELECT p.pid, coalesce(CAST(min(r.d) AS INTEGER), -1) AS distance FROM params p LEFT JOIN reach r ON r.pid = p.pid AND r.v = p.b GROUP BY p.pid", recursive=True))
def shortest_path(spark, sf_dir):
    return shortest_distance(_params(spark).select("pid", "a", "b"), relation(spark, sf_dir, "guarantee"))


def _social(spark, sf_dir, *names):
    return {n: relation(spark, sf_dir, n) for n in names}


@_register(query("", [SOCIAL_BASE["class_of"]], "SELECT DISTINCT tag, tag_class FROM class_of", recursive=True))
def tag_closure(spark, sf_dir):
    return social.tag_closure(_social(spark, sf_dir, "tag", "tag_class"))


@_register(query("", [SOCIAL_BASE["chain"], SOCIAL_BASE["country_of"]], "SELECT place, country FROM country_of", recursive=True))
def country_of_place(spark, sf_dir):
    return social.country_of_place(_social(spark, sf_dir, "place"))


@_register(query("", [SOCIAL_BASE["weights"]], "SELECT x, y, weight FROM weights"))
def interaction_weight(spark, sf_dir):
    return social.interaction_weights(_social(spark, sf_dir, "post", "comment"))


@_register(query("params(pid, a, b) AS (VALUES (1, 10, 77), (2, 21, 98), (3, 5, 5))", [
    SOCIAL_BASE["reach"], SOCIAL_BASE["nearest"],
    "paths(pid, v, d, path) AS (SELECT pid, a, 0, [a::BIGINT] FROM params UNION SELECT r.pid, k.dst, r.d + 1, list_append(r.path, k.dst) FROM paths r JOIN knows k ON k.src = r.v JOIN params p ON p.pid = r.pid JOIN nearest n ON n.pid = r.pid AND n.v = k.dst AND n.depth = r.d + 1 JOIN nearest e ON e.pid = r.pid AND e.v = p.b AND r.d < e.depth)",
], "SELECT p.pid, array_to_string(path, ';') AS path FROM paths p JOIN params q ON q.pid = p.pid AND q.b = p.v", recursive=True))
def all_shortest_paths(spark, sf_dir):
    pairs = spark.createDataFrame([(1, 10, 77), (2, 21, 98), (3, 5, 5)], "pid int, a long, b long")
    return traverse.all_shortest_paths(pairs, relation(spark, sf_dir, "knows")).select("pid", F.array_join(F.col("path").cast("array<string>"), ";").alias("path"))


@_register(query("params(pid, a) AS (VALUES (1, 10), (2, 21))", [SOCIAL_BASE["friends"], SOCIAL_BASE["foaf"]], "SELECT pid, friend FROM foaf"))
def friends_and_foaf(spark, sf_dir):
    return social.friends_and_foaf(_social(spark, sf_dir, "knows"), spark.createDataFrame([(1, 10), (2, 21)], "pid int, a long"))


# ---------------------------------------------------------------- scalars


@_register("SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS ms, epoch_us(o_orderdate) // 1000 AS from_digits, CAST(0 AS BIGINT) AS bad FROM orders")
def parse_time_millis(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", S.time_millis(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'")).alias("ms"), S.time_millis(ms.cast("string")).alias("from_digits"), S.time_millis("o_orderpriority").alias("bad"))


@_register("SELECT event_id, strftime(ts, '%Y%m') AS month, CAST(dayofweek(ts) AS INTEGER) AS weekday FROM events")
def event_month_dow(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", S.event_month(ms).alias("month"), S.event_weekday(ms).alias("weekday"))


@_register("SELECT p_partkey, CAST(CASE WHEN p_size * 5 < 40 THEN 0 WHEN p_size * 5 < 80 THEN 1 WHEN p_size * 5 < 160 THEN 2 ELSE 3 END AS INTEGER) AS bucket, lpad(CAST(p_size AS VARCHAR), 2, '0') AS code FROM part")
def length_bucket(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", S.length_bucket(F.col("p_size") * 5).alias("bucket"), S.edge_type_code("p_size").alias("code"))


@_register("SELECT o_orderkey, 1 + xor(o_orderkey, o_custkey) % 100 AS weight FROM orders")
def edge_weight_xor(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", S.edge_weight("o_orderkey", "o_custkey").alias("weight"))


@_register("SELECT p_partkey, concat(split_part(p_name, ' ', 1), '+', split_part(p_name, ' ', 2)) AS items, CAST(2 AS INTEGER) AS n, p_brand AS val FROM part")
def split_lists(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    items = S.split_list(F.concat(F.lit(" ;-1; "), F.regexp_replace("p_name", " ", " ; "), F.lit(";")))
    return p.select("p_partkey", F.array_join(items, "+").alias("items"), F.size(items).alias("n"), S.split_pairs(F.concat_ws(",", "p_type", "p_brand"))[0]["val"].alias("val"))


@_register("SELECT c_custkey, c_name AS got, concat(c_mktsegment, '|new|', c_name) AS changed, concat('x|', '', '|', c_name) AS widened FROM customer")
def pipe_slots(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    row = F.concat_ws("|", "c_mktsegment", F.lit("old"), "c_name")
    return c.select("c_custkey", S.pipe_get(row, 2).alias("got"), S.pipe_set(row, 1, F.lit("new")).alias("changed"), S.pipe_set(F.lit("x"), 2, "c_name").alias("widened"))


# ---------------------------------------------------------------- ingest and workload


@_register("""SELECT 'order_customer' AS relation, count(*) AS edges FROM orders UNION ALL SELECT 'customer_nation', count(*) FROM customer
UNION ALL SELECT 'nation_region', count(*) FROM nation""")
def implicit_edges(spark, sf_dir):
    rules = {"order_customer": ("orders", "o_orderkey", "o_custkey"), "customer_nation": ("customer", "c_custkey", "c_nationkey"), "nation_region": ("nation", "n_nationkey", "n_regionkey")}
    return ingest.implicit_edges({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t, _, _ in rules.values()}, rules).groupBy("relation").agg(F.count("*").alias("edges"))


@_register("SELECT DISTINCT l_orderkey AS vid FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def incremental_stub_nodes(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("vid"))
    return ingest.stub_nodes(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("vid")), known)


@_register("SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS skipped, count(o_orderkey) AS kept FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey")
def skipped_edges_count(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("vid"))
    return ingest.skipped_edges(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("src")), known, "src")


@_register("SELECT source, row_index, ms, CAST(row_number() OVER (ORDER BY ms, source, row_index) AS INTEGER) AS place FROM (SELECT 'events' AS source, event_id AS row_index, epoch_us(ts) // 1000 - 820454400000 AS ms FROM events UNION ALL SELECT 'orders', o_orderkey, epoch_us(o_orderdate) // 1000 FROM orders)")
def update_stream_merge(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("row_index"), (F.unix_millis(F.col("ts").cast("timestamp")) - 820454400000).alias("ms"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("row_index"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))
    return ingest.merged_stream({"events": e, "orders": o}).withColumn("place", F.col("place").cast("int"))


@_register("SELECT event_id % 20 = 3 AS sampled, count(*) AS rows FROM events GROUP BY 1")
def workload_sample(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    both = ingest.sampled(e, "event_id", 20, 3).select(F.lit(True).alias("sampled")).unionByName(ingest.sampled(e, "event_id", 20, 3, rest=True).select(F.lit(False).alias("sampled")))
    return both.groupBy("sampled").agg(F.count("*").alias("rows"))


@_register(_sql("SELECT CAST(e.event_id % 20 AS BIGINT) AS src, count(*) AS reads, count(x.seq) AS found, count(*) - count(x.seq) AS missed FROM events e LEFT JOIN (SELECT src, dst, max(seq) AS seq FROM g0 GROUP BY 1, 2) x ON x.src = e.event_id % 20 AND x.dst = e.user_id GROUP BY 1", "versions", "g0"))
def single_edge_reads(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 20).alias("src"), F.col("user_id").alias("dst"))
    return ingest.point_reads(asked, _groups(spark, sf_dir)["g0"]).groupBy("src").agg(F.count("*").alias("reads"), F.count("seq").alias("found"), F.count_if(F.col("seq").isNull()).alias("missed"))


@_register("SELECT CAST(done AS BIGINT) AS done, q AS query, CAST(floor(done * n / 1000) AS BIGINT) AS due FROM range(0, 1001, 100) t(done), (VALUES ('fq01', 9994), ('fq06', 878), ('fq12', 2753)) w(q, n)")
def mixed_due_tasks(spark, sf_dir):
    plan = spark.createDataFrame([("fq01", 9994), ("fq06", 878), ("fq12", 2753)], "query string, n long")
    return replay.due_tasks(spark.range(0, 1001, 100).select(F.col("id").alias("done")), plan, 1000)


@_register("SELECT event_type, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.9), 6) AS p90, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99, max(ms) AS most FROM (SELECT event_type, CAST(event_id % 1000 AS DOUBLE) AS ms FROM events) GROUP BY event_type")
def write_latency_percentiles(spark, sf_dir):
    return ingest.latency_summary(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", (F.col("event_id") % 1000).cast("double").alias("ms")), "ms", "event_type")


def _incremental(spark, sf_dir):
    """Own-account, loan and repayment records made from customers and orders, as nodes and edges."""
    customers, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    own = customers.selectExpr("c_nationkey AS personId", "c_custkey AS accountId", "'2020-01-02' AS createTime", "c_mktsegment AS accountType", "'true' AS accountBlocked")
    loan = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("personId"), F.col("o_orderkey").alias("loanId"), day.alias("createTime"), F.col("o_totalprice").cast("decimal(18,2)").alias("loanAmount"))
    repay = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("loanId"), day.alias("createTime"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    parts = [workload.financial_writes(own, 4), workload.financial_writes(loan, 6), workload.financial_writes(repay, 14)]
    return [p[0] for p in parts], [p[1] for p in parts]


@_register("""SELECT 'PersonOwnAccount' AS relation, CAST(c_nationkey AS VARCHAR) AS src, CAST(c_custkey AS VARCHAR) AS dst, epoch_ms(TIMESTAMP '2020-01-02') AS at, CAST(NULL AS VARCHAR) AS amount FROM customer
UNION ALL SELECT 'PersonApplyLoan', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)), CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'AccountRepayLoan', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)), CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM orders WHERE o_orderstatus = 'F'""")
def incremental_edges(spark, sf_dir):
    edges = reduce(DataFrame.unionByName, _incremental(spark, sf_dir)[1])
    return edges.select("relation", "src", "dst", "at", F.coalesce(F.col("properties")["amount"], F.col("properties")["loanAmount"]).alias("amount"))


@_register("""SELECT 'Account' AS kind, CAST(c_custkey AS VARCHAR) AS raw_id, c_mktsegment AS account_type, false AS stub FROM customer
UNION ALL SELECT 'Loan', CAST(o_orderkey AS VARCHAR), NULL, false FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'Loan', CAST(o_orderkey AS VARCHAR), NULL, true FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus = 'F'
UNION ALL SELECT 'Person', CAST(p AS VARCHAR), NULL, true FROM (SELECT c_nationkey AS p FROM customer UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT DISTINCT 'Account', CAST(o_custkey AS VARCHAR), NULL, true FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def incremental_nodes(spark, sf_dir):
    nodes, edges = (reduce(DataFrame.unionByName, x) for x in _incremental(spark, sf_dir))
    new = workload.stubs(nodes, edges, nodes.where("false"))
    every = nodes.withColumn("stub", F.lit(False)).unionByName(new.withColumn("stub", F.lit(True)))
    return every.select("kind", "raw_id", F.col("properties")["accountType"].alias("account_type"), "stub")


def _social_lines(spark, sf_dir):
    customers, orders, events = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "events"))
    person = customers.selectExpr("concat_ws('|', '7', '0', '1', c_custkey, c_mktsegment, c_name, 'male', '', '9', '', '', c_custkey % 75, '', '', concat(c_nationkey, ';-1;', 30 + c_nationkey), concat(c_nationkey, ',2001'), '') AS value")
    post = orders.selectExpr("concat_ws('|', '8', '0', '6', o_orderkey, '', '5', '', '', '', o_comment_, length(o_orderpriority) * 10, o_custkey, o_orderkey % 50, '-1', o_orderkey % 25, '') AS value".replace("o_comment_", "o_orderpriority"))
    rest = events.selectExpr("concat_ws('|', event_id, '0', 2 + event_id % 7, user_id, event_id % 100, 'day') AS value").where("split(value, '[|]')[2] in ('2', '3', '5', '8')")
    return person.unionByName(post).unionByName(rest)


@_register("""WITH e AS (SELECT CAST(event_id % 7 AS INTEGER) + 2 AS op, CAST(user_id AS VARCHAR) AS src, CAST(event_id % 100 AS VARCHAR) AS dst FROM events)
SELECT CASE op WHEN 2 THEN 'likesPost' WHEN 3 THEN 'likesComment' WHEN 5 THEN 'hasMember' ELSE 'knows' END AS relation, src, dst, CASE WHEN op = 5 THEN 'day' END AS joined, CAST(NULL AS VARCHAR) AS detail FROM e WHERE op IN (2, 3, 5, 8)
UNION ALL SELECT 'personLocation', CAST(c_custkey AS VARCHAR), CAST(c_custkey % 75 AS VARCHAR), NULL, NULL FROM customer
UNION ALL SELECT 'hasInterest', CAST(c_custkey AS VARCHAR), CAST(t AS VARCHAR), NULL, CAST(1 + xor(CAST(c_custkey AS BIGINT), CAST(t AS BIGINT)) % 100 AS VARCHAR) FROM (SELECT c_custkey, unnest([c_nationkey, 30 + c_nationkey]) AS t FROM customer)
UNION ALL SELECT 'studyAt', CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR), NULL, '2001' FROM customer
UNION ALL SELECT 'postCreator', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), NULL, NULL FROM orders
UNION ALL SELECT 'postContainer', CAST(o_orderkey AS VARCHAR), CAST(o_orderkey % 50 AS VARCHAR), NULL, NULL FROM orders
UNION ALL SELECT 'postHasTag', CAST(o_orderkey AS VARCHAR), CAST(o_orderkey % 25 AS VARCHAR), NULL, CASE WHEN length(o_orderpriority) < 4 THEN '0' WHEN length(o_orderpriority) < 8 THEN '1' WHEN length(o_orderpriority) < 16 THEN '2' ELSE '3' END FROM orders""")
def social_update_edges(spark, sf_dir):
    p = F.col("properties")
    return workload.social_writes(_social_lines(spark, sf_dir))[1].select("relation", "src", "dst", p["joinDate"].alias("joined"), F.coalesce(p["edgeWeight"], p["classYear"], p["messageLengthBucket"]).alias("detail"))


@_register("""SELECT 'Person' AS kind, CAST(c_custkey AS VARCHAR) AS raw_id, CAST(7 AS BIGINT) AS at, c_name AS name FROM customer
UNION ALL SELECT 'Post', CAST(o_orderkey AS VARCHAR), 8, o_orderpriority FROM orders""")
def social_update_nodes(spark, sf_dir):
    p = F.col("properties")
    return workload.social_writes(_social_lines(spark, sf_dir))[0].select("kind", "raw_id", "at", F.coalesce(p["lastName"], p["content"]).alias("name"))


@_register("""SELECT e.event_id, o.o_orderpriority AS N0, o.o_orderkey AS seq FROM events e LEFT JOIN
(SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) o ON o.o_custkey = e.user_id""")
def single_node_reads(spark, sf_dir):
    nodes = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS vid", "o_orderkey AS seq", "o_orderpriority AS N0")
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id AS vid")
    return workload.node_reads(asked, nodes, "N0").select("event_id", "N0", "seq")


@_register(_sql("SELECT src, dst, max(seq) AS seq FROM g1 JOIN (SELECT src, min(dst) AS dst FROM g1 GROUP BY src) USING (src, dst) GROUP BY src, dst", "versions", "g1"))
def first_match(spark, sf_dir):
    return workload.first_match(_groups(spark, sf_dir)["g1"])


READS = [Access(frozenset(p), f) for p, f in (("ab", 900), ("bc", 40), ("d", 500), ("cd", 20))]
WRITES = [Access(frozenset(p), f) for p, f in (("ab", 100_000), ("c", 500_000), ("cd", 30_000))]
SIZES = {"a": 8, "b": 12, "c": 64, "d": 4}


@_register("SELECT * FROM (VALUES ('a', 'b', 1877), ('a', 'c', -39016), ('a', 'd', -2348), ('b', 'c', -46740), ('b', 'd', -2788), ('c', 'd', -7015)) t(x, y, gain)")
def attr_grouping_round1_gain(spark, sf_dir):
    rows = [(x, y, gain(frozenset(x), frozenset(y), READS, WRITES, SIZES)) for k, x in enumerate("abcd") for y in "abcd"[k + 1 :]]
    return spark.createDataFrame(rows, "x string, y string, gain int")


@_register("SELECT * FROM (VALUES ('a,b'), ('c'), ('d')) t(grp)")
def attr_grouping_final(spark, sf_dir):
    return spark.createDataFrame([(",".join(sorted(g)),) for g in advise(list("abcd"), READS, WRITES, SIZES)], "grp string")
