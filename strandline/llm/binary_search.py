"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has a bit per component, set where it is above 0. Codes are cut into segments of
``SEGMENT`` bits, each with an index by value. A query probes, segment by segment, all values within
radius 0, then 1 and so on, and verifies the whole codes found. Once the first a + 1 segments have been
probed to radius r and the others to r - 1, every code within distance m * r + a of m segments has been
seen, since otherwise its segments' distances would add up to more; the search ends when the k-th
verified distance is within that. Where a step would probe more values than there are codes, the rest
of the codes is verified instead.

Rows with one code are one entry with their k + 1 smallest ids, which is all that an answer can use.
Codes are dealt out in blocks of about ``BLOCK`` and queries in blocks of ``QUERIES``, by hashes, each
pair of blocks is a task with its own index, and the k best of all blocks are kept.

Defined results: vectors that are null, zero or hold null or non-finite components, and null ids, take
no part; codes of different lengths are never compared; equal distances are ranked by the smaller
vec_id; a row is no answer to itself; of repeated rows with one id the smallest vector takes part; with fewer than k others
all are given; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialise
from strandline.llm.vectors import best_of_blocks, usable

SEGMENT = 16
BLOCK, QUERIES = 16_384, 1024
MOST_TASKS = 50_000
_MASKS: dict[int, np.ndarray] = {}


def masks(radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits."""
    if radius not in _MASKS:
        _MASKS[radius] = np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), radius)], np.int64)
    return _MASKS[radius]


class MultiIndex:
    """Indexes over distinct codes, given as rows of segment values."""

    def __init__(self, codes: np.ndarray) -> None:
        self.words = _words(codes)
        self.shape = codes.shape
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.starts = [np.searchsorted(c[o], np.arange((1 << SEGMENT) + 1)) for c, o in zip(codes.T, self.order)]

    def _within(self, segment: int, values: np.ndarray) -> np.ndarray:
        """The codes that have one of the values in the segment."""
        low = self.starts[segment][values]
        size = self.starts[segment][values + 1] - low
        low, size = low[size > 0], size[size > 0]
        run = np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)
        return self.order[segment][run]

    def nearest(self, code: np.ndarray, weight: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and their distances: all within the distance at which their weights first add up to ``enough``."""
        n, m = self.shape
        word, seen = _words(code[None])[0], np.zeros(n, bool)
        at, far, within = [], [], np.zeros(SEGMENT * m + 1)
        n_seen = 0
        for radius in range(SEGMENT + 1):
            for s in range(m):
                probes = masks(radius)
                if len(probes) * (m - s) > n:
                    new = np.flatnonzero(~seen)
                else:
                    new = self._within(s, probes ^ code[s])
                    new = new[~seen[new]]
                seen[new] = True
                distance = np.bitwise_count(self.words[new] ^ word).sum(1, dtype=np.int64)
                at.append(new)
                far.append(distance)
                within += np.bincount(distance, weight[new], len(within))
                n_seen += len(new)
                if n_seen == n or within[: m * radius + s + 1].sum() >= enough:
                    found, d = np.concatenate(at), np.concatenate(far)
                    keep = d <= np.searchsorted(np.cumsum(within), enough)
                    return found[keep], d[keep]
        return np.concatenate(at), np.concatenate(far)


def _words(codes: np.ndarray) -> np.ndarray:
    """The same bits, 64 in a word."""
    padded = np.zeros((len(codes), -(-codes.shape[1] // 4) * 4), "<u2")
    padded[:, : codes.shape[1]] = codes
    return padded.view("<u8")


def _segments(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), "<u2").reshape(len(codes), -1).astype(np.int64)


def search(spark: SparkSession, df: DataFrame, is_query: str, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance) for the rows for which ``is_query``, SQL over vec_id, holds."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for v in batch.column("vec"):
                bits = np.packbits(np.asarray(v.values) > 0, bitorder="little").tobytes()
                codes.append(bits + bytes(-len(bits) % (SEGMENT // 8)))
            yield pa.record_batch([batch.column("vec_id"), pa.array(codes, pa.binary()), batch.column("size")], ["vec_id", "code", "size"])

    rows = usable(df, id_col, vec_col).groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("size", F.size("vec"))
    coded = materialise(spark, rows.mapInArrow(encode, "vec_id long, code binary, size int"))
    of_code = Window.partitionBy("size", "code").orderBy("vec_id")
    entries = coded.withColumn("n", F.row_number().over(of_code)).where(F.col("n") <= k + 1).groupBy("size", "code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = materialise(spark, entries)
    queries = coded.where(is_query).select("size", "code", F.col("vec_id").alias("query_id"))
    blocks, q_blocks = max(1, -(-entries.count() // BLOCK)), max(1, -(-queries.count() // QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = entries.select("size", "code", "ids", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block"), each(q_blocks).alias("q_block"))
    asked = queries.select("size", "code", "query_id", each(blocks).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("q_block"))

    def answer(q: pa.Table, e: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if q.num_rows and e.num_rows:
            ids = e.column("ids").to_pylist()
            index, weight = MultiIndex(_segments(e.column("code").to_pylist())), np.array(list(map(len, ids)))
            for own, code in zip(q.column("query_id").to_pylist(), _segments(q.column("code").to_pylist())):
                at, far = index.nearest(code, weight, k + 1)
                near = sorted((d, i) for a, d in zip(at.tolist(), far.tolist()) for i in ids[a] if i != own)
                found += [(own, i, d) for d, i in near[:k]]
        cols = zip(*found) if found else ((), (), ())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "distance"), cols, (pa.int64(), pa.int64(), pa.int32()))})

    keys = ["size", "block", "q_block"]
    by_task = lambda rows: rows.repartition(min(MOST_TASKS, blocks * q_blocks), *keys).groupBy(*keys)
    found = by_task(asked).cogroup(by_task(dealt)).applyInArrow(answer, "query_id long, vec_id long, distance int")
    return best_of_blocks(found, k, ["distance"]).select("query_id", "rank", "vec_id", "distance")
