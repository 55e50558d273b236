"""The storage contract on a small graph, schema checks, traversal on a micro graph, ingest and streams."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.model import GraphError, Status, load_schema, parse_schema
from strandline.operators import ingest, workload
from strandline.operators.traverse import all_shortest_paths, bounded_bfs, hop, shortest_distance
from strandline.sources import files
from strandline.sources.shared import materialise
from strandline.store import Graph
from strandline.streaming.replay import applied_once, replay

SCHEMA = """
max_vertex_num: 128          # vertices
max_property_length: 10
edge_shards:
  - name: edge_Db0
    properties: [A]
  - name: edge_Db1
    properties: ["B", C]
    is_csr: false
node_db:
  name: nodes
  properties: [N0, N1]
"""
EDGES = [(1, 2, 10, 100, 1), (1, 2, 12, 50, 2), (2, 3, 9, 70, 3), (2, 4, 15, 80, 4), (3, 1, 20, 60, 5), (4, 5, 16, 10, 6), (5, 6, 14, 90, 7), (1, 1, 11, 5, 8)]
PARAMS = "pid int, t0 long, t1 long, lim int, latest_first boolean"


@pytest.fixture()
def graph(spark, tmp_path):
    g = Graph.open(spark, str(tmp_path / "g"), parse_schema(SCHEMA))
    g.put_nodes(spark.createDataFrame([(1, "alice", "beijing", "?")], "vid long, N0 string, N1 string, other string"))
    g.put_edges(spark.createDataFrame([(1, 2, 7, "a12", "b12", "c12")], "src long, dst long, edge_type int, A string, B string, C string"))
    g.put_edges(spark.createDataFrame([(1, 3, 7, "b13", "c13")], "src long, dst long, edge_type int, B string, C string"))
    return g


def keys(spark, *pairs):
    return spark.createDataFrame([(a, b, True, 7) for a, b in pairs], "src long, dst long, is_out boolean, edge_type short")


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_reads_across_groups(spark, graph):
    assert values(graph.get_nodes(["N0", "N1"]), "vid", "N0", "N1") == [(1, "alice", "beijing")]
    got = graph.get_edges(["A", "C"], keys(spark, (1, 2), (1, 3), (9, 9)))
    assert values(got.fillna(""), "dst", "status", "A", "C") == [(2, "ok", "a12", "c12"), (3, "not_found", "", ""), (9, "not_found", "", "")]
    assert values(graph.scan_edges(["B", "C"], 7), "dst", "B") == [(2, "b12"), (3, "b13")]
    assert values(graph.scan_edges(["A", "C"], 7), "dst") == [(2,)]
    assert [r["dst"] for r in graph.for_each_edge("B", 1, 7)] == [2, 3]
    with pytest.raises(ValueError):
        graph.get_edges(["nothing"])
    with pytest.raises(GraphError):
        graph.put_edges(spark.createDataFrame([(1, 2, 7, "x")], "src long, dst long, edge_type int, Z string"))


def test_updates_versions_and_compaction(spark, graph):
    missing = graph.update_edges(keys(spark, (1, 2), (1, 9)).withColumns({"A": F.lit("a12-v2"), "B": F.lit("b12-v2")}))
    assert values(missing, "dst") == [(9,)]
    assert graph.update_nodes(spark.createDataFrame([(1, "alice-v2"), (5, "x")], "vid long, N0 string")).count() == 1
    assert graph.updates.select("commit_seq").distinct().count() == 2
    assert values(graph.get_nodes(["N0", "N1"]), "N0", "N1") == [("alice-v2", "beijing")]
    before = values(graph.scan_edges(["A", "B", "C"], 7), "dst", "seq", "A", "B", "C")
    assert before[0][2:] == ("a12-v2", "b12-v2", "c12")
    graph.compact()
    again = Graph.open(spark, graph.path, graph.schema)
    assert values(again.scan_edges(["A", "B", "C"], 7), "dst", "seq", "A", "B", "C") == before
    again.put_edges(spark.createDataFrame([(1, 2, 7, "a12-v5")], "src long, dst long, edge_type int, A string"))
    assert values(again.get_edges(["A"], keys(spark, (1, 2))), "A") == [("a12-v5",)]
    assert [r[0] for r in values(again.scan_edges(["A"], 7), "A")] == ["a12-v2", "a12-v5"]
    again.delete_edges(spark.createDataFrame([(1, 2, 7)], "src long, dst long, edge_type int"))
    assert values(again.get_edges(["A"], keys(spark, (1, 2))), "status") == [("deleted",)]
    assert again.scan_edges(["A"], 7).count() == 0
    again.compact()
    assert again.group("edge_Db0").count() == 0


def test_versions_never_go_backwards(spark, tmp_path):
    g = Graph.open(spark, str(tmp_path / "v"), parse_schema("max_vertex_num: 9\nedge_shards:\n  - name: g\n    properties: [value]\n"))
    seen = []
    for k in range(4):
        g.put_edges(spark.createDataFrame([(0, 1, 7, str(k))], "src long, dst long, edge_type int, value string"), bidirectional=True)
        if k % 2:
            g.compact()
        seen.append(int(g.get_edges(["value"], keys(spark, (0, 1))).first()["value"]))
    assert seen == [0, 1, 2, 3]
    assert g.scan_edges(["value"], 7, is_out=False).select("src").distinct().first()[0] == 1


def test_schema_errors(tmp_path):
    with pytest.raises(GraphError) as e:
        parse_schema("max_vertex_num: 1\nedge_shards:\n  - name: g\n    wrong: 2\n")
    assert e.value.status is Status.INVALID_ARGUMENT and "line 4" in str(e.value)
    for text in ("edge_shards:\n  - name: g\n    properties: [A]\n", "max_vertex_num: 1\n", "max_vertex_num: 1\nedge_shards:\n  - name: g\n    properties: [A]\n  - name: h\n    properties: [A]\n"):
        with pytest.raises(GraphError):
            parse_schema(text)
    with pytest.raises(GraphError) as e:
        load_schema(str(tmp_path / "none.yaml"))
    assert e.value.status is Status.IO_ERROR


def test_fixed_width(spark):
    df = spark.createDataFrame([("a",), ("BBBBBBBBBB",), ("123456789ABCDE",)], "x string")
    assert [r[0] for r in df.select(S.fixed_width("x", 10)).collect()] == ["a", "BBBBBBBBBB", "123456789A"]


def brute_hop(edges, v, t0, t1, lim, latest):
    out = sorted((e for e in edges if e[0] == v and t0 <= e[2] <= t1), key=lambda e: (-e[2] if latest else e[2], e[1], e[3], e[4]))
    return out[:lim] if lim else out


def test_random_hops_and_search_against_a_walker(spark):
    rng = random.Random(4)
    edges = EDGES + [(rng.randrange(12), rng.randrange(12), rng.randrange(30), rng.randrange(5), 100 + i) for i in range(60)]
    frame = spark.createDataFrame(edges, "src long, dst long, ts long, amount long, seq long")
    rows = [(k, rng.randrange(10), 10 + rng.randrange(20), rng.choice([0, 1, 3]), bool(k % 2)) for k in range(8)]
    params, starts = spark.createDataFrame(rows, PARAMS), [(k, k % 6) for k in range(8)]
    got = values(hop(spark.createDataFrame(starts, "pid int, v long"), frame, params), "pid", "seq")
    want = sorted((k, e[4]) for (k, t0, t1, lim, late), (_, v) in zip(rows, starts) for e in brute_hop(edges, v, t0, t1, lim, late))
    assert got == want
    depth = {}
    for (k, t0, t1, lim, late), (_, a) in zip(rows, starts):
        level, seen, d = {a}, {a: 0}, 0
        while level:
            d += 1
            level = {e[1] for v in level for e in brute_hop(edges, v, t0, t1, lim, late)} - set(seen)
            seen |= dict.fromkeys(level, d)
        depth[k] = seen
    pairs = [(k, a, b) for (k, a) in starts for b in [(a + 5) % 12]]
    got = dict(values(shortest_distance(spark.createDataFrame(pairs, "pid int, a long, b long"), frame, params), "pid", "distance"))
    assert got == {k: depth[k].get(b, -1) for k, a, b in pairs}
    _, reached = bounded_bfs(spark.createDataFrame(starts, "pid int, v long"), [frame], params, 2)
    assert values(reached, "pid", "v", "depth") == sorted((k, v, d) for k, s in depth.items() for v, d in s.items() if d <= 2)


def test_all_shortest_paths(spark):
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 2)], "src long, dst long")
    pairs = spark.createDataFrame([(1, 1, 5), (2, 5, 1), (3, 2, 2)], "pid int, a long, b long")
    assert values(all_shortest_paths(pairs, links), "pid", "path") == [(1, [1, 2, 4, 5]), (1, [1, 3, 4, 5]), (3, [2])]


def test_files_and_ingest(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id|name\n1|a\n2|\n")
    assert values(files.read_delimited(spark, str(tmp_path / "x.csv"), ["id", "name", "more"]), "id", "name", "more") == [("1", "a", ""), ("2", "", "")]
    rows = [("query", 1, 2, k, 10 * k, ["p", str(k)]) for k in range(3)]
    files.write_chunks(spark.createDataFrame(rows, files.CHUNK), str(tmp_path / "chunks"))
    chunk = files.read_chunks(spark, str(tmp_path / "chunks"), "query")
    assert values(files.fields_as(chunk, ["x", "y", "z"]), "row_index", "y", "z") == [(0, "0", ""), (1, "1", ""), (2, "2", "")]
    lines = spark.createDataFrame([("N|4|p|v",), ("E|1|2|7|1|q|w",), ("?",)], "value string")
    assert values(ingest.parse_updates(lines), "kind", "src", "dst", "property", "value") == [("edge", 1, 2, "q", "w"), ("node", 4, 4, "p", "v")]


def test_replay_applies_each_batch_once(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, 10 * k)], "row_index long, ms long").write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    sink = applied_once(str(tmp_path / "log"), lambda batch, n: seen.extend((n, r["row_index"]) for r in batch.collect()))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    replay(spark, str(tmp_path / "in"), schema, sink, str(tmp_path / "ck")).awaitTermination()
    replay(spark, str(tmp_path / "in"), schema, sink, str(tmp_path / "ck2")).awaitTermination()
    assert sorted(r for _, r in seen) == [0, 1, 2]


def test_writes_reach_the_graph_by_their_raw_ids(spark, tmp_path):
    schema = parse_schema("max_vertex_num: 99\nmax_property_length: 20\nedge_shards:\n  - name: hot\n    properties: [createTime, amount]\n  - name: cold\n    properties: [comment]\nnode_db:\n  name: n\n  properties: [rawId, isBlocked, loanAmount]\n")
    g = Graph.open(spark, str(tmp_path / "w"), schema)
    own = spark.createDataFrame([("p1", "a1", "2020-01-02 00:00:01", "true", "hi")], "personId string, accountId string, createTime string, accountBlocked string, comment string")
    repay = spark.createDataFrame([("a1", "l1", "5", "9.5"), ("a2", "l9", "6", "1")], "account string, loanId string, createTime string, amount string")
    loan = spark.createDataFrame([("p1", "l1", "4", "100")], "personId string, loanId string, createTime string, loanAmount string")
    parts = [workload.financial_writes(own, 4), workload.financial_writes(loan, 6), workload.financial_writes(repay, 14)]
    nodes, edges = (parts[0][i].unionByName(parts[1][i]).unionByName(parts[2][i]) for i in (0, 1))
    new = workload.stubs(nodes, edges, nodes)
    assert values(new, "kind", "raw_id", "at") == [("Account", "a2", 6), ("Loan", "l9", 6), ("Person", "p1", 4)]
    nodes = nodes.unionByName(new.where("raw_id <> 'l9'"))
    ids = materialise(workload.vertex_ids(nodes))
    assert sorted(r["vid"] for r in ids.collect()) == [1, 2, 3, 4]
    left = workload.import_writes(g, nodes, edges, ids, {n: v[0] for n, v in workload.FINANCIAL.items()})
    assert values(left, "src", "dst") == [("a2", "l9")]
    of = {r["raw_id"]: r["vid"] for r in ids.collect()}
    got = {(r["src"], r["dst"], r["edge_type"]): (r["createTime"], r["amount"], r["comment"]) for r in g.scan_edges(["createTime", "amount", "comment"]).collect()}
    assert got == {(of["p1"], of["a1"], 25): ("1577923201000", "", "hi"), (of["p1"], of["l1"], 19): ("4", "", ""), (of["a1"], of["l1"], 5): ("5", "9.5", "")}
    assert {r["rawId"]: (r["isBlocked"], r["loanAmount"]) for r in g.get_nodes(["rawId", "isBlocked", "loanAmount"]).collect()} == {"p1": ("", ""), "a1": ("true", ""), "l1": ("", "100"), "a2": ("", "")}
    added = workload.financial_writes(spark.createDataFrame([("c1", "x")], "companyId string, companyName string"), 2)
    assert values(added[0], "kind", "raw_id") == [("Company", "c1")] and added[1].count() == 0


def test_social_update_lines(spark):
    wide = "|".join(["01", "202001", "3", "4", "5", "6", "7", "8", "9", "55", "2"])
    lines = ["3|0|4|f1|Forum|d|p1|t1;t2|2", f"4|0|2|p1|m1|d|{wide}", "5|0|7|c1|d||||200|p1|-1|m1|-1|t3|", "6|0|1|", "x"]
    nodes, edges = workload.social_writes(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert values(nodes, "kind", "raw_id", "at") == [("Comment", "c1", 5), ("Forum", "f1", 3)]
    got = {(r["relation"], r["src"], r["dst"]): r["properties"] for r in edges.collect()}
    assert set(got) == {("moderator", "f1", "p1"), ("forumHasTag", "f1", "t1"), ("forumHasTag", "f1", "t2"), ("likesPost", "p1", "m1"), ("commentCreator", "c1", "p1"), ("replyOfPost", "c1", "m1"), ("commentHasTag", "c1", "t3")}
    assert got["likesPost", "p1", "m1"]["messageLengthBucket"] == "2" and got["likesPost", "p1", "m1"]["edgeWeight"] == "55"
    assert got["replyOfPost", "c1", "m1"] == {"edgeExists": "1", "creationDate": "d", "messageLengthBucket": "3"}
    assert got["forumHasTag", "f1", "t1"] == {"edgeExists": "1", "srcActivityBucket": "2"}


def test_payloads_places_and_checksums(spark, graph):
    graph.put_node_payload(spark.createDataFrame([(2, "bob|rome"), (3, "eve")], "vid long, payload string"))
    assert values(graph.get_nodes(["N0", "N1"]), "vid", "N0", "N1") == [(1, "alice", "beijing"), (2, "bob", "rome"), (3, "eve", "")]
    with pytest.raises(GraphError):
        graph.put_node_payload(spark.createDataFrame([(2, "")], "vid long, payload string"))
    graph.put_edge_payload(spark.createDataFrame([(4, 5, 7, "b|c", 90)], "src long, dst long, edge_type int, payload string, seq long"), "edge_Db1")
    assert values(graph.get_edges(["B", "C"], keys(spark, (4, 5))), "B", "C") == [("b", "c")]
    assert values(graph.locate_nodes(spark.createDataFrame([(2,), (7,)], "vid long")), "vid") == [(2,)]
    assert graph.flush_property_updates() == 0
    assert graph.init_vertices_up_to(3).count() == 3 and graph.init_vertices_up_to(5).count() == 2
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "y"), (1, "x")], "k int, v string")
    assert workload.checksum(a).first() == workload.checksum(b).first()
    assert workload.checksum(a.withColumn("n", F.col("k")), "n").first() != workload.checksum(a.withColumn("n", 3 - F.col("k")), "n").first()
