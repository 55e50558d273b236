"""Language identification by inferring each document's mixture of languages.

Each language has a table of log-likelihoods of hashed byte trigrams, counted over all training
rows. A word's likelihood in a language is that of its trigrams; expectation-maximisation over a
document's words estimates the proportions of the languages. The set of languages is then chosen
among the nested sets of the largest proportions: each is fitted again, and the one with the highest
likelihood less ``PENALTY`` per language and log word counts. The prediction is the set's largest
language, the score its proportion.

Counts are summed inside partitions first, so a frequent language makes one row per partition; the
driver holds one table per language. Prediction is a map over rows with memory bounded by a block.

Defined results: null text, empty text and text without letters have ``und`` and score 0, as has all
text if there is no training row; ties go to the language first in order; repeated rows and null ids
have a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import is_held_out, row_blocks, strings, trimmed, utf8

BITS = 15
STEPS, REFITS = 8, 4
PENALTY = 1.0
SMOOTHING = 0.5
BLOCK = 1 << 20
EQUAL_CHANCES = -BITS * np.log(2)

#: A-Z as a-z, other ASCII that is no letter as space.
FOLD = np.full(256, 32, np.uint32)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed trigram around every letter, where words begin among them, and the first trigram of each row."""
    low = FOLD[raw]
    full = offsets[:-1] < offsets[1:]
    before, after = np.empty_like(low), np.empty_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[offsets[:-1][full]] = after[offsets[1:][full] - 1] = 32
    at = np.flatnonzero(low != 32)
    before = before[at]
    code = (before << np.uint32(16) | low[at] << np.uint32(8) | after[at]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    return code, np.flatnonzero(before == 32), np.searchsorted(at, offsets)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log-likelihood by trigram and language


def learn(docs: DataFrame) -> Model:
    """Fit on all rows of (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            names, which = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for a, b in row_blocks(offsets, BLOCK):
                code, _, rows = trigrams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lang = np.repeat(which[a:b], np.diff(rows))
                both = np.bincount(lang << BITS | code, minlength=len(names) << BITS).reshape(len(names), -1)
                for name, c in zip(names.tolist(), both):
                    sums[name] = sums.get(name, 0) + c
        yield written(sums)

    def written(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(sums.keys(), pa.string()), pa.array([x.astype(np.uint64).tobytes() for x in sums.values()], pa.binary())], ["lang", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, c in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist()):
                sums[name] = sums.get(name, 0) + np.frombuffer(c, np.uint64)
        yield written(sums)

    schema = "lang string, counts binary"
    found = docs.mapInArrow(trimmed(count), schema).repartition(8, "lang").mapInArrow(add, schema).collect()
    counts = {r["lang"]: np.frombuffer(r["counts"], np.uint64) + SMOOTHING for r in found}
    languages = sorted(counts)
    columns = [np.log(counts[k] / counts[k].sum()) for k in languages]
    return Model(languages, np.stack(columns, 1).astype(np.float32) if columns else np.zeros((1 << BITS, 0), np.float32))


def training_rows(docs: DataFrame) -> DataFrame:
    """(text, lang) of rows with a language that are not held out."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out, F.lit(False))).select("text", "lang")


def _fit(likely: np.ndarray, share: np.ndarray, rows: np.ndarray, first: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some steps, from ``share``, and each document's log-likelihood at them."""
    words = np.diff(np.append(first, len(rows)))[:, None]
    for step in range(steps + 1):
        joint = likely * share[rows]
        total = joint.sum(1)
        if step == steps:
            return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)), first)
        joint /= np.maximum(total, 1e-300)[:, None]
        share = np.add.reduceat(joint, first, axis=0) / words
    raise AssertionError


def mixtures(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The proportions of the chosen languages for every row; all 0 without letters."""
    return fitted_mixtures(model, raw, offsets)[0]


def fitted_mixtures(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The proportions, and the mean log-likelihood of a row's trigrams under them; minus infinity without letters."""
    code, words, rows = trigrams(raw, offsets)
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    mean = np.full(len(out), -np.inf)
    if not len(code) or not model.languages:
        return out, mean
    log = np.add.reduceat(model.table[code], words, axis=0, dtype=np.float64)
    top = log.max(1)
    likely = np.exp(log - top[:, None])
    begins = np.searchsorted(words, rows)
    full = np.flatnonzero(np.diff(begins))
    first = begins[:-1][full]
    n = np.diff(begins)[full]
    of = np.repeat(np.arange(len(full)), n)
    start = np.full((len(full), len(model.languages)), 1 / len(model.languages))
    share, _ = _fit(likely, start, of, first, STEPS)
    rank = np.argsort(np.argsort(-share, 1, kind="stable"), 1)
    best, chosen, reached = np.full(len(full), -np.inf), share, np.full(len(full), -np.inf)
    for k in range(1, len(model.languages) + 1):
        part = np.where(rank < k, np.maximum(share, 1e-12), 0)
        part, fit = _fit(likely, part / part.sum(1, keepdims=True), of, first, REFITS if k > 1 else 0)
        score = fit - PENALTY * k * np.log(n + 1)
        better = score > best
        best = np.where(better, score, best)
        chosen = np.where(better[:, None], part, chosen)
        reached = np.where(better, fit, reached)
    out[full] = chosen
    mean[full] = (reached + np.add.reduceat(top, first)) / np.diff(rows)[full]
    return out, mean


def predict(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score and the chosen languages with their proportions."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            texts, keys = strings(batch.column("text")), batch.column("id")
            for a, b in row_blocks(offsets, BLOCK):
                share = mixtures(model, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lettered = [any(map(str.isalpha, t)) for t in texts.slice(a, b - a).to_pylist()]
                known = share.any(1) & np.array(lettered, bool) if len(model.languages) else np.zeros(b - a, bool)
                top = share.argmax(1) if len(model.languages) else np.zeros(b - a, int)
                lang = [model.languages[k] if ok else "und" for k, ok in zip(top, known)]
                score = np.where(known, share.max(1, initial=0), 0.0)
                mix = [[{"lang": model.languages[k], "share": float(s[k])} for k in np.flatnonzero(s)] if ok else [] for s, ok in zip(share, known)]
                yield pa.record_batch(
                    [keys.slice(a, b - a), pa.array(is_held_out(keys.slice(a, b - a).to_pylist()), pa.bool_()), pa.array(lang, pa.string()), pa.array(score.clip(0, 1), pa.float64()), pa.array(mix, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                    ["id", "held_out", "lang_pred", "score", "mixture"],
                )

    schema = "id long, held_out boolean, lang_pred string, score double, mixture array<struct<lang string, share double>>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), schema).withColumnRenamed("id", id_col)


def identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the learned languages explain.

    A row stays if its text has letters and its chosen languages, however many and in whatever shares, make
    its trigrams likelier than equal chances for all of them do. Where no row has a language, none stays."""
    shared = spark.sparkContext.broadcast(learn(training_rows(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            texts = strings(batch.column("text"))
            for a, b in row_blocks(offsets, BLOCK):
                _, mean = fitted_mixtures(shared.value, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lettered = [any(map(str.isalpha, t)) for t in texts.slice(a, b - a).to_pylist()]
                yield batch.slice(a, b - a).filter(pa.array((mean > EQUAL_CHANCES) & np.array(lettered, bool)))

    return docs.mapInArrow(trimmed(run), docs.schema)
