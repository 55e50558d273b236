"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded: shares of character
classes, word lengths and repeated words, standardised, then a learned hidden layer h. A gate
tanh(V h) * sigmoid(U h) gives each passage an attention weight (a softmax over the document), and
the weighted sum of the h is scored by a logistic output. Only document labels are used.

The model is fitted on the driver, on at most about ``SAMPLE`` labelled documents (chosen by a hash
of their id, so by no property of the text) and all passages of each; where these are more than
``SAMPLE_PASSAGES``, on fewer documents. Only encoded passages are collected. Scoring takes every passage of every row, in a map over rows.

Defined results: null and empty text are one empty passage and have its score; without labelled rows
or with one label only, the score is the share of label 1 (0.5 without any); repeated rows and null
ids have a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import is_held_out, row_blocks, trimmed, utf8
from strandline.llm.shingles import word_hashes, words

PASSAGE = 512
SAMPLE = 4000
SAMPLE_PASSAGES = 256_000
HIDDEN, GATE = 16, 8
STEPS, RATE, DECAY = 300, 0.02, 1e-4
BLOCK = 1 << 20
THRESHOLD = 0.7

#: Character classes: marks of their own, then lower, upper, digit, space, line end, other ASCII, beyond ASCII.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[]_{|}~"
CLASS = np.full(256, len(MARKS) + 5, np.int64)
for _k, _c in enumerate(MARKS):
    CLASS[ord(_c)] = _k
for _k, _span in enumerate(((97, 123), (65, 91), (48, 58), (32, 33), (10, 11))):
    CLASS[slice(*_span)] = len(MARKS) + _k
CLASS[128:] = len(MARKS) + 6
CLASSES = len(MARKS) + 7
FEATURES = CLASSES + 4


def encode(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of every passage and the first passage of each row (one more entry than rows)."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = first[row] + (np.arange(len(raw)) - offsets[row]) // PASSAGE
    counts = np.bincount(at * CLASSES + CLASS[raw], minlength=int(first[-1]) * CLASSES).reshape(-1, CLASSES)
    length = counts.sum(1, keepdims=True)
    starts, ends, bounds = words(raw, offsets)
    out = np.zeros((len(counts), FEATURES), np.float32)
    out[:, :CLASSES] = np.sqrt(counts / np.maximum(length, 1))
    out[:, CLASSES] = np.log1p(length[:, 0])
    if len(starts):
        h = word_hashes(raw, starts, ends)
        place = at[starts]
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        inner = bounds[:-1][bounds[:-1] < len(h)]
        again[inner] = False
        of = lambda w=None: np.bincount(place, w, minlength=len(counts))
        total = np.maximum(of(), 1)
        out[:, CLASSES + 1] = of(again) / total
        out[:, CLASSES + 2] = np.log1p(of(ends - starts) / total)
        out[:, CLASSES + 3] = _distinct(place, h, len(counts)) / total
    return out, first


def _distinct(place: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Different words of each passage."""
    order = np.lexsort((h, place))
    p, v = place[order], h[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
    return np.bincount(p[new], minlength=n)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return _forward(self.weights, (x - self.mean) / self.scale, first[:-1])["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    n = np.diff(np.append(first, len(x)))
    h = np.tanh(x @ w["W"] + w["b"])
    v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (v * u) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
    weight = e / np.repeat(np.add.reduceat(e, first), n)
    z = np.add.reduceat(weight[:, None] * h, first, axis=0)
    p = 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))
    return {"h": h, "v": v, "u": u, "weight": weight, "z": z, "p": p, "n": n}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Gradient descent with moments on the mean log loss over all documents given."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(0), x.std(0) + 0.02
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    w = {"W": rng.normal(0, 0.2, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(())}
    m, s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for t in range(1, STEPS + 1):
        f = _forward(w, x, first)
        dp = (f["p"] - y) / len(y)
        dz = np.repeat(dp[:, None] * w["c"], f["n"], axis=0)
        along = (dz * f["h"]).sum(1)
        de = f["weight"] * (along - np.repeat(np.add.reduceat(f["weight"] * along, first), f["n"]))
        dg = de[:, None] * w["a"]
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["weight"][:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
        grad = {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "a": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ dp, "d": dp.sum()}
        for k in w:
            g = grad[k] + DECAY * w[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows that are not held out, about ``sample`` of them at most, and on whole texts.

    Rows are taken in the order of a hash of their id until ``SAMPLE_PASSAGES`` passages are reached, one id at least.
    Labels of one id that differ count as their mean; of rows with one id that whose text has the smallest hash is taken."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    parts = max(1, -(-labels.count() // sample))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0).groupBy("doc_id").agg(F.avg("y").alias("y"))  # of bounded size
    bags = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    bags = bags.groupBy("doc_id", "y").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("row")).select("doc_id", "row.text", "y")
    passages = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE))
    sizes = bags.groupBy(F.xxhash64("doc_id").alias("h")).agg(F.sum(passages).alias("n")).orderBy("h").collect()
    taken = max(1, int(np.searchsorted(np.cumsum([int(r["n"]) for r in sizes]), SAMPLE_PASSAGES, "right")))
    if taken < len(sizes):
        bags = bags.where(F.xxhash64("doc_id") <= sizes[taken - 1]["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            bags = []
            for a, b in row_blocks(offsets, BLOCK):
                x, first = encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                bags += [x[i:j].tobytes() for i, j in zip(first, first[1:])]
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(bags, pa.binary())], ["doc_id", "y", "bag"])

    rows = sorted(bags.mapInArrow(trimmed(run), "doc_id long, y double, bag binary").collect(), key=lambda r: (r["doc_id"], r["bag"]))
    bag = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    first = np.cumsum([0, *map(len, bag)])[:-1]
    return fit(np.concatenate(bag).astype(np.float64) if bag else np.zeros((0, FEATURES)), first, np.array([r["y"] for r in rows]))


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    raw, offsets = utf8(texts)
    out = [model.scores(*encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in row_blocks(offsets, BLOCK)]
    return np.concatenate([np.zeros(0), *out])


def predict(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score and predicted."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(shared.value, batch.column("text"))
            keys = batch.column("id")
            yield pa.record_batch([keys, pa.array(is_held_out(keys.to_pylist()), pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], ["id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more; all of them, if no labelled row or labels of one
    kind only are there to learn from. Null and empty text are scored as an empty passage; repeated rows and null
    ids are scored one by one."""
    model = learn(docs, labels)
    if model.constant is not None:
        return docs
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch.column("text")) >= threshold))

    return docs.mapInArrow(trimmed(run), docs.schema)
