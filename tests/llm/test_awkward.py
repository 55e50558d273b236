"""Awkward rows: repeated, contradictory, null, empty and very long ones, and the pipeline as a whole."""

import numpy as np
import pyarrow as pa
import public_tokenizers

import corpus_pipeline
from strandline.llm import common, packing, passage_quality, token_counts, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_suffixes_are_those_that_rules_can_have():
    assert urls.suffixes("a.b.example.com", 11) == ["example.com", "com"]
    assert urls.suffixes("example.com", 11) == ["example.com", "com"]
    assert urls.suffixes("xexample.com", 11) == ["com"]
    assert urls.suffixes("a..com.", 20) == ["a..com.", ".com.", "com.", ""]
    assert len(urls.suffixes("." * 1_000_000, 11)) == 12  # 0 to 11 characters


def test_good_documents_without_labels_are_all(spark):
    docs = spark.createDataFrame([(k, "some text", "de", "s", 9) for k in range(3)], DOCS)
    for rows in ([], [(0, 1, 0), (1, 1, 0)]):
        assert passage_quality.good_documents(spark, docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).count() == 3


def test_labels_that_differ_count_as_their_mean(spark):
    docs = spark.createDataFrame([(0, "a b c", "de", "s", 5), (0, "a b d", "de", "s", 5), (1, "! ! !", "de", "s", 5), (3, "x", "de", "s", 1)], DOCS)
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    scores = [[r["score"] for r in passage_quality.predict(spark, docs, passage_quality.learn(docs, labels)).orderBy("doc_id").collect()] for _ in range(2)]
    assert scores[0] == scores[1] and len(scores[0]) == 4


def test_attention_equals_plain_python():
    rng = np.random.default_rng(4)
    h, g, f = passage_quality.HIDDEN, passage_quality.GATE, passage_quality.FEATURES
    w = {"W": rng.normal(size=(f, h)), "b": rng.normal(size=h), "V": rng.normal(size=(h, g)), "U": rng.normal(size=(h, g)), "a": rng.normal(size=g), "c": rng.normal(size=h), "d": np.array(0.3)}
    x, first = rng.normal(size=(7, f)), np.array([0, 3, 4])
    got = passage_quality._forward(w, x, first)["p"]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for k, (a, b) in enumerate([(0, 3), (3, 4), (4, 7)]):
        hidden = [np.tanh(row @ w["W"] + w["b"]) for row in x[a:b]]
        weight = np.exp([w["a"] @ (np.tanh(v @ w["V"]) * sigmoid(v @ w["U"])) for v in hidden])
        bag = sum(e / weight.sum() * v for e, v in zip(weight, hidden))
        assert abs(got[k] - sigmoid(bag @ w["c"] + w["d"])) < 1e-9


def test_memos_are_bounded_and_results_do_not_depend_on_them(monkeypatch):
    texts = [" ".join(f"w{k}x{i}" * (1 + i % 9) for k in range(30)) for i in range(200)] + ["z" * 5000]
    words, pieces = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    wide = [packing.ChunkIds(words).texts(texts), token_counts.PieceCounter(pieces).texts(texts)]
    monkeypatch.setattr(packing, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 20_000)
    ids, counts = packing.ChunkIds(words), token_counts.PieceCounter(pieces)
    assert [i for t in texts for i in ids.texts([t])] == wide[0] and ids.held <= 20_000
    assert [n for t in texts for n in counts.texts([t])] == wide[1] and counts.held <= 20_000


def test_pipeline_over_awkward_tables(spark, tmp_path):
    words = [f"wort{k}" for k in range(60)]
    good = " ".join(words)
    rows = [(1, good, "de", "s", 1), (2, good, "de", "s", 1), (None, good, "de", "s", 1), (3, None, None, None, None), (4, "", "de", "s", 0), (5, "... 123", "de", "s", 7), (6, " ".join(words[::-1]), None, None, None), (6, " ".join(words[::-1]), None, None, None)]
    for name, table, schema in (("documents", rows, DOCS + ", start long"), ("labels", [(1, 1, 0)], "doc_id long, quality int, toxic int")):
        for folder, some in (("full", table), ("empty", [])):
            some = [(*r, 7) for r in some] if name == "documents" else some
            spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    packed = corpus_pipeline.run(spark, f"{tmp_path}/full")
    assert sorted(str(r["doc_id"]) for r in packed.select("doc_id").distinct().collect()) == ["1", "6", "None"]
    whole = packed.groupBy("doc_id").sum("length").collect()
    once = packed.select("doc_id", "doc_tokens").distinct().collect()
    assert {r["doc_id"]: r[1] for r in whole} == {r["doc_id"]: r["doc_tokens"] for r in once}  # a repeated row is packed once


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], DOCS)
    assert token_counts.token_counts(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert packing.batch_ids(packing.chunk_ids(public_tokenizers.path("word_bpe_49k.json")), pa.array([], pa.string()), 2) is not None


def test_batches_are_bounded_in_bytes_and_smaller_bounds_stay(spark):
    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    try:
        common.bounded_batches(spark)
        assert [spark.conf.get(x) for x in names] == [str(common.BATCH_ROWS), str(common.BATCH_BYTES)]
        spark.conf.set(names[1], 1000)
        common.bounded_batches(spark)
        assert spark.conf.get(names[1]) == "1000"
    finally:
        for x in names:
            spark.conf.unset(x)


def test_packing_with_a_small_memo_gives_the_same_pieces(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i % 7}" for i in range(400)), "de", "s", 1) for k in range(30)], DOCS).coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [sorted(map(tuple, packing.pack_digests(docs, path, end=2, **memo).collect())) for memo in ({}, {"memo": 100})]
    assert rows[0] == rows[1] and len(rows[0]) >= 30
