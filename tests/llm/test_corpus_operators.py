"""Joins, searches, models and the pipeline against brute force or held-out rows."""

import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from strandline.llm import binary_search, components, jaccard_join, language_mixture, learned_partitions, passage_quality, shingles
from strandline.llm.common import Scratch, materialise

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text2 string"


def words(text):
    out, word = [], []
    for c in (text or "") + " ":
        if c == " " or "\t" <= c <= "\r":
            out += ["".join(word)] if word else []
            word = []
        else:
            word.append(chr(ord(c) + 32) if "A" <= c <= "Z" else c)
    return out


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components_by_hand(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [len(s) for s in sets], [least.get(find(i)) if sets[i] else rows[i][0] for i in range(len(rows))]


def near_copies(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([30, 60, 120]))] for _ in range(6)]
    rows = [None, "", " \t", "one", "One", "one two", "\x1cone"]
    for b in base:
        for _ in range(25):
            w = list(b)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w).replace("w1", "W1"))
    return rows + rows[10:14]


@pytest.mark.parametrize(("n", "percent", "short", "tile"), [(3, 90, 8, 256), (5, 80, 2, 4)])
def test_join_equals_brute_force(spark, monkeypatch, n, percent, short, tile):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = [(3 * k + 1, t) for k, t in enumerate(near_copies())] + [(None, "one two")]
    df = spark.createDataFrame([(k, t, None, None, None, "clash") for k, t in rows], DOCS)
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_join.link_documents(spark, df, n, percent).collect())
    sizes, comps = components_by_hand(rows, n, percent)
    assert got == sorted((k or -1, s, c) for (k, _), s, c in zip(rows, sizes, comps))
    kept = jaccard_join.keep_first(spark, df, n, percent)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(k or -1 for (k, _), c in zip(rows, comps) if k is None or k == c)


def test_join_of_an_empty_table(spark):
    assert jaccard_join.link_documents(spark, spark.createDataFrame([], DOCS), 3, 90).count() == 0


def test_shingle_hashes_equal_sets():
    texts = [t or "" for t in near_copies()]
    for n in (3, 5):
        got = shingles.shingle_sets([t.encode() for t in texts], n, shingles.WordHashes())
        for i in range(0, len(texts), 5):
            for j in range(0, len(texts), 7):
                assert len(np.intersect1d(got[i], got[j])) == len(shingle_set(texts[i], n) & shingle_set(texts[j], n))


def test_hashes_tell_apart_words_that_polynomials_confuse():
    one, other = "a", "b"
    for _ in range(10):
        one, other = one + other, other + one
    x, y = shingles.shingle_sets([f"start {one} end".encode(), f"start {other} end".encode()], 3, shingles.WordHashes())
    assert len(x) == len(y) == 1 and x[0] != y[0]


def test_hashes_of_a_long_text_equal_those_of_its_words(monkeypatch):
    monkeypatch.setattr(shingles, "WINDOW", 16)
    text = b"One\ttwo three " + b"x" * 50 + b"\x0b\nfour  five " * 9
    hashes = shingles.WordHashes()
    assert hashes.of(text).tolist() == [hashes[w] for w in text.lower().split()]


def test_keep_first_decides_by_row(spark):
    """A repeated id loses its copy, not its unique text; columns with any names stay."""
    words = [f"w{k}" for k in range(40)]
    t, u = " ".join(words), " ".join(words[::-1])
    near = " ".join([*words[:-1], "other"])
    rows = [(3, t, "a"), (5, t, "b"), (5, u, "c"), (9, near, "d"), (9, near, "e"), (1, "", "f"), (7, u + " x", "g"), (7, u + " x", "g"), (None, t, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _place string").selectExpr("*", "_place AS class", "1 AS key", "2 AS c")
    kept = jaccard_join.keep_first(spark, df, 5, 80)
    assert kept.columns == df.columns
    assert sorted(r["_place"] for r in kept.collect()) == ["a", "c", "f", "h"]
    twice = spark.createDataFrame([*rows[:1] * 3, rows[2]], "doc_id long, text string, _place string")
    assert sorted(r["_place"] for r in jaccard_join.keep_first(spark, twice, 5, 80).collect()) == ["a", "c"]


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(20, 1, -1)] + [(100, k) for k in range(101, 130)] + [(5, 5)]
    got = {r["v"]: r["c"] for r in components.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 2 for k in range(2, 22)} | {k: 100 for k in range(100, 130)}


def vectors():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 64))
    rows = [(k, (centre[k % 6] + rng.normal(size=64)).tolist()) for k in range(900)]
    rows += [(1000 + k, rows[50][1]) for k in range(30)]  # one common vector
    bad = [None, [0.0] * 64, [None] * 64, [float("nan")] * 64, [float("inf")] * 64]
    return rows, rows + [(2000 + 50 * k, v) for k, v in enumerate(bad)] + [rows[3]]


def test_neighbours_have_recall_and_exact_scores(spark):
    good, rows = vectors()
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, label int")
    got = learned_partitions.search(spark, df, "vec_id % 50 = 0", 5).toPandas()
    ids, x = np.array([k for k, _ in good]), np.array([v for _, v in good], np.float32).astype(float)
    hits = 0
    for q in ids[ids % 50 == 0]:
        own = x[ids == q][0]
        cos = (x * own).sum(1) / np.sqrt((x * x).sum(1)) / np.sqrt((own * own).sum())
        cos[ids == q] = -9
        best = np.lexsort((ids, -cos))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, [cos[ids == v][0] for v in mine.vec_id], atol=1e-12)
        assert list(zip(-mine.score, mine.vec_id)) == sorted(zip(-mine.score, mine.vec_id))
        hits += len(set(ids[best]) & set(mine.vec_id))
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()
    assert set(got.query_id) == set(ids[ids % 50 == 0])
    few = learned_partitions.search(spark, df.where("vec_id in (0, 1, 2)"), "vec_id % 50 = 0", 5)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2]
    assert learned_partitions.search(spark, df.where("false"), "vec_id % 50 = 0", 5).count() == 0


def test_routing_saves_comparisons_at_a_recall_of_nine_tenths(spark):
    """On the isotropic vectors of the tables, and with far fewer parts probed where vectors are clustered."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32))
    clustered = spark.createDataFrame([(k, (centres[k % 40] + 0.3 * rng.normal(size=32)).tolist()) for k in range(4000)], "vec_id long, embedding array<double>")
    for df, most in ((spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 0.75), (clustered, 0.15)):
        got = learned_partitions.search(spark, df, "vec_id % 50 = 0", 5).toPandas()
        rows = df.toPandas()
        ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q = np.flatnonzero(ids % 50 == 0)
        cos = x[q] @ x.T
        cos[np.arange(len(q)), q] = -9
        best = {int(ids[i]): set(ids[np.argsort(-c)[:5]].tolist()) for i, c in zip(q, cos)}
        assert sum(v in best[k] for k, v in zip(got.query_id, got.vec_id)) >= 0.9 * 5 * len(q)
        placed, routed = learned_partitions.placed_and_routed(spark, df, "vec_id % 50 = 0", 5)
        sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
        work = sum(sizes.get(p, 0) for r in routed.collect() for p in r["probed"])
        assert work <= most * len(q) * len(ids), work / len(q) / len(ids)


def test_vectors_of_other_lengths_are_searched_exactly(spark):
    rows = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(300)] + [(1000 + 10 * k, [1.0, float(k)]) for k in range(8)]
    got = learned_partitions.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0", 3).toPandas()
    assert got[got.query_id == 1000].vec_id.tolist() == [1010, 1020, 1030]
    assert got[got.query_id == 1050].vec_id.tolist() == [1060, 1040, 1070]
    assert (got[got.query_id < 1000].vec_id < 1000).all()


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(640, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = learned_partitions.neighbour_graph(x, 10)
    part = learned_partitions.balanced_parts(near, 16)
    assert np.bincount(part).tolist() == [40] * 16
    assert (part[near] == part[:, None]).mean() > 2 / 16


def test_binary_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(binary_search, "BLOCK", 200)
    good, rows = vectors()
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, code int")
    got = binary_search.search(spark, df, "vec_id % 20 = 0", 10).toPandas()
    ids, bits = np.array([k for k, _ in good]), np.array([v for _, v in good]) > 0
    for q in ids[ids % 20 == 0]:
        far = (bits != bits[ids == q][0]).sum(1)
        far[ids == q] = 999
        best = np.lexsort((ids, far))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == ids[best].tolist() and mine.distance.tolist() == far[best].tolist()
    assert binary_search.search(spark, df.where("false"), "vec_id % 20 = 0", 10).count() == 0


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op8_binary_codes", "op10_url_filter"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()[want.columns]
    rows = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = entry.queries()["op6_language_id"](spark, SF).join(docs, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()
    model = language_mixture.learn(language_mixture.training_rows(docs))
    odd = spark.createDataFrame([(1, None, "de"), (2, "", None), (3, "12 !!", "x"), (None, "½", ""), (5, "日本", None), (5, "the and of is", None)], "doc_id long, text string, lang string")
    rows = {(r["doc_id"], r["lang_pred"]) for r in language_mixture.predict(spark, odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "und")} <= rows and (5, "en") in rows
    nothing = language_mixture.learn(language_mixture.training_rows(odd.where("false")))
    assert {r["lang_pred"] for r in language_mixture.predict(spark, odd, nothing).collect()} == {"und"}
    assert language_mixture.identified(spark, docs).columns == docs.columns


def test_mixture_finds_both_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r["lang"]: r["text"] for r in docs.where("n_chars > 2000").select("lang", "text").collect()}
    both = spark.createDataFrame([(1, one["en"][:2000] + "\n" + one["de"][:2000])], "doc_id long, text string")
    row = language_mixture.predict(spark, both, language_mixture.learn(language_mixture.training_rows(docs))).first()
    assert {"en", "de"} <= {m["lang"] for m in row["mixture"]} and 0.3 < row["score"] < 0.7


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op9_quality"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    good, bad = held.score[held.quality == 1].values, held.score[held.quality == 0].values
    assert (good[:, None] > bad).mean() > 0.95 and (held.predicted == held.quality).mean() > 0.9
    assert (got.predicted == (got.score >= 0.7)).all()


def test_quality_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, "y" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = passage_quality.learn(docs, labels)
    assert {r["score"] for r in passage_quality.predict(spark, docs, model).collect()} == {0.5}
    assert passage_quality.predict(spark, docs.where("false"), model).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "secret scans", "packing"]
    spark.sparkContext.environment["PYTHONPATH"] = entry.HERE
    seen = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = materialise(spark, stage(spark, docs, SF))
        assert docs.columns == columns
        now = docs.toPandas()
        assert set(now.doc_id) <= set(seen.doc_id)
        if name == "n-gram Jaccard join":
            rows = list(zip(seen.doc_id, seen.text))
            _, comps = components_by_hand(rows, 5, 80)
            assert set(now.doc_id) == {k for (k, _), c in zip(rows, comps) if k == c}
        seen = now
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF).toPandas()
    assert set(pieces.doc_id) == set(seen.doc_id)
    assert docs.where(F.col("text").rlike("AKIA[A-Z0-9]{16,}")).count() == 0


def strangers():
    """Texts that share one rare phrase and, but for a pair of near copies, nothing else."""
    rng = random.Random(5)
    rows = [[f"a{k}b{rng.randrange(10**6)}" for _ in range(60)] for k in range(90)]
    rows[41] = [*rows[40][:-1], "other"]
    return [" ".join([*w, "one", "common", "phrase"]) for w in rows]


def test_texts_that_share_a_phrase_are_told_apart_without_their_sets(spark, monkeypatch):
    """Whole sets went to every list of their shingles, so disk grew much faster than the table."""
    monkeypatch.setattr(jaccard_join, "HOT", 0)  # all lists are read in rounds, as long ones are

    def none(self, opened):
        raise AssertionError(f"{opened.count()} whole sets")

    monkeypatch.setattr(jaccard_join.Join, "_with_sets", none)
    rows = list(enumerate(strangers()))
    got = jaccard_join.link_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == list(zip(range(90), *components_by_hand(rows, 3, 90)))


@pytest.mark.parametrize("dense", [0, 1])
def test_pieces_of_many_pairs_equal_brute_force(spark, monkeypatch, dense):
    for name, v in (("DENSE", dense), ("SHORT", 2), ("TILE", 8)):
        monkeypatch.setattr(jaccard_join, name, v)
    rows = [(3 * k + 1, t) for k, t in enumerate(near_copies(9) + strangers())]
    got = jaccard_join.link_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    sizes, comps = components_by_hand(rows, 3, 90)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((k, s, c) for (k, _), s, c in zip(rows, sizes, comps))


def test_large_sets_are_told_apart_without_their_texts(spark, monkeypatch):
    """Any two sets of some thousand shingles passed the profiles, and the texts of such pairs took more disk than the table."""
    rng, blocks, asked = random.Random(3), {}, set()
    for i in range(11):
        for j in range(i):  # each block of words is in two texts
            blocks[i, j] = blocks[j, i] = [f"w{rng.randrange(10**6)}" for _ in range(250)]
    rows = [" ".join(w for j in range(11) if j != i for w in blocks[i, j]) for i in range(11)]
    rows = list(enumerate([*rows, rows[0] + " other"]))
    texts = jaccard_join.Join._texts

    def noted(self, wanted, *more):
        asked.update(bytes(r["class"]) for r in wanted.select("class").collect())
        return texts(self, wanted, *more)

    monkeypatch.setattr(jaccard_join.Join, "_texts", noted)
    got = jaccard_join.link_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == list(zip(range(12), *components_by_hand(rows, 5, 80)))
    assert len(asked) == 2


def test_fine_profiles_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(4)
    for size, more in ((512, 700), (5000, 40), (20_000, 300), (70_000, 5)):
        x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        y = np.concatenate([x[more // 3 :], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
        p, q = jaccard_join.fine_profile(x), jaccard_join.fine_profile(y)
        assert 0 < jaccard_join._apart_finely(p, q) == jaccard_join._apart_finely(q, p) <= more // 3 + more
        assert len(p) <= jaccard_join.FINE_CELLS
    assert jaccard_join.fine_profile(x[:511]) is None


def test_index_and_texts_move_in_parts(spark, monkeypatch):
    """All of the index moved at once, and texts were counted, however long those of the pairs were."""
    rng, index, moved = random.Random(6), [], []
    long = [f"w{k}" for k in range(3000)]
    rows = [f"{k} " + " ".join(f"s{rng.randrange(10**6)}" for _ in range(10)) for k in range(300)]
    for k in range(12):
        w = list(long)
        w[rng.randrange(3000)] = f"other{k}"
        rows.append(" ".join(w))
    rows = list(enumerate(rows))
    lists, texts = jaccard_join.list_pairs, jaccard_join.Join._texts

    def listed(postings, percent):
        index.append(postings.count())
        return lists(postings, percent)

    def noted(self, asked, columns, *more):
        if "piece" in columns:
            moved.append(asked.count())
        return texts(self, asked, columns, *more)

    monkeypatch.setattr(jaccard_join, "list_pairs", listed)
    monkeypatch.setattr(jaccard_join.Join, "_texts", noted)
    got = jaccard_join.link_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == list(zip(range(312), *components_by_hand(rows, 5, 80)))
    assert max(index) < 0.4 * sum(index)
    assert max(moved) < 0.5 * sum(moved)


def test_shuffle_files_go_once_a_table_is_written(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    scratch, names = Scratch(spark), lambda: {f.getName() for f in map(disk.getAllFiles().apply, range(disk.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    before = names()
    table = scratch.write(spark.range(1000).repartition(3, "id"))
    end = time.time() + 10  # executors drop them a moment later
    while not names() <= before and time.time() < end:
        time.sleep(0.1)
    assert names() <= before and table.count() == 1000
