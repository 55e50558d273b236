"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` vectors at most, about, chosen by a hash of the id) the graph of
nearest neighbours is built and cut into equal parts: recursive bisection at the median of the
second eigenvector of its random walk, improved by exchanges across the cut. A small network learns,
from each sampled vector, how its neighbours are spread over the parts. It then places every row of
the table in its most probable part, and routes each query to its most probable parts, until their
probabilities add up to a mass (and further while these have too few rows), whose rows are reranked exactly.

The mass is the least with which the vectors of a part of the sample, left out of the fit, reach ``RECALL`` of
their neighbours in the sample: where neighbours gather in few parts, few are probed. Neighbours within
the whole table are nearer, so recall there is somewhat higher.

Vectors whose length is not the one most frequent in the sample make a part for each length, which only the
queries of that length go to: they are searched exactly. Parts travel in groups of ``GROUP``, so that a query is
sent once for a group; groups are split into blocks of about ``BLOCK`` rows and queries into blocks of ``QUERIES``,
by hashes of the ids, so a part that holds a third of all rows is many tasks. A block's answer is at most k rows per query. The sample and one count per part reach the driver.

Defined results: vectors that are null, zero or hold null or non-finite components, and null ids, take
no part; only vectors of one length are compared; equal scores are ranked by the smaller vec_id; of repeated
rows with one id the smallest vector takes part; with fewer than k candidates all are given; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import materialise
from strandline.llm.vectors import best_of_blocks, usable

SAMPLE = 8192
NEIGHBOURS = 10
PARTS, LEAST_PART, GROUP = 256, 2 * NEIGHBOURS, 16
RECALL = 0.95
HIDDEN, ROUNDS, BATCH, RATE = 64, 20, 512, 0.01
BLOCK, QUERIES, AT_ONCE = 8192, 8192, 256
MOST_TASKS = 50_000


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The places of the k nearest of every row of unit vectors, itself left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        near = x[a : a + 512] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + 512] = np.argpartition(-near, k - 1, 1)[:, :k] if k else 0
    return out


def _halves(nodes: np.ndarray, near: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """True for the ``share`` of nodes that go to the first side of a small cut."""
    place = np.full(len(near), -1)
    place[nodes] = np.arange(len(nodes))
    to = place[near[nodes]]
    inside = to >= 0
    a, b = np.repeat(np.arange(len(nodes)), inside.sum(1)), to[inside]
    degree = np.maximum(np.bincount(a, minlength=len(nodes)) + np.bincount(b, minlength=len(nodes)), 1)
    neighbours = lambda v: np.bincount(a, v[b], len(nodes)) + np.bincount(b, v[a], len(nodes))
    v = rng.normal(size=len(nodes))
    for _ in range(60):
        v = v - (v * degree).sum() / degree.sum()
        v = 0.5 * (v + neighbours(v) / degree)
        v /= np.linalg.norm(v) + 1e-30
    want = round(share * len(nodes))
    side = np.zeros(len(nodes), bool)
    side[np.argsort(v, kind="stable")[:want]] = True
    for _ in range(10):  # exchange the pairs of nodes that gain most
        pull = neighbours(np.where(side, 1.0, -1.0)) * np.where(side, -1, 1)
        out, into = np.flatnonzero(side), np.flatnonzero(~side)
        out, into = out[np.argsort(-pull[out], kind="stable")], into[np.argsort(-pull[into], kind="stable")]
        n = min(len(out), len(into))
        gain = pull[out[:n]] + pull[into[:n]] > 2
        swap = int(gain.sum() // 2) or int(gain.any())
        if not swap:
            break
        side[out[:swap]], side[into[:swap]] = False, True
    return side


def balanced_parts(near: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """The part of every node; parts differ by a node or so in size."""
    rng = np.random.default_rng(seed)
    out = np.zeros(len(near), np.int64)

    def cut(nodes: np.ndarray, first: int, n: int) -> None:
        if n == 1 or len(nodes) < 2:
            out[nodes] = first
            return
        left = n // 2
        side = _halves(nodes, near, left / n, rng)
        cut(nodes[side], first, left)
        cut(nodes[~side], first + left, n - left)

    cut(np.arange(len(near)), 0, parts)
    return out


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def learn_router(x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, seed: int = 5) -> Router:
    """Fit the network to the spread of each vector and its neighbours (places in ``part``) over the parts."""
    rng = np.random.default_rng(seed)
    spread = np.column_stack([part[: len(x)], *(part[near].T if near.size else ())])
    w = [rng.normal(0, x.shape[1] ** -0.5 * 2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
    m, s = [0 * v for v in w], [0 * v for v in w]
    every = -(-len(x) // BATCH)
    for t in range(1, ROUNDS * every + 1):
        if (t - 1) % every == 0:
            order = rng.permutation(len(x))
        rows = order[(t - 1) % every * BATCH :][:BATCH]
        target = np.zeros((len(rows), parts))
        np.add.at(target, (np.arange(len(rows))[:, None], spread[rows]), 1 / spread.shape[1])
        pre = x[rows] @ w[0] + w[1]
        h = np.maximum(pre, 0)
        dz = (Router(*w).probabilities(x[rows]) - target) / len(rows)
        dh = (dz @ w[2].T) * (pre > 0)
        rate = RATE * (1 - t / (ROUNDS * every + 1))
        for i, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*w)


def needed_mass(router: Router, asked: np.ndarray, near: np.ndarray, part: np.ndarray, recall: float) -> float:
    """The least mass of probed parts with which ``recall`` of all neighbours ``near`` of ``asked`` lie in them.

    A neighbour is found if the parts before its own, from the most probable down, have less than that mass."""
    if not near.size:
        return 1.0
    p = router.probabilities(asked)
    order = np.argsort(-p, 1, kind="stable")
    before = np.zeros_like(p)
    np.put_along_axis(before, order, np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1), 1)
    mass = np.take_along_axis(before, part[near], 1).ravel()
    return float(np.nextafter(np.sort(mass)[min(len(mass) - 1, int(np.ceil(recall * len(mass))) - 1)], 2))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest_in_block(ids: np.ndarray, x: np.ndarray, part: np.ndarray, query_ids: np.ndarray, q: np.ndarray, probed: list[np.ndarray], k: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, cosine) of the k nearest rows of a block within each query's parts; equal vectors have equal scores."""
    order = np.argsort(part, kind="stable")
    ids, x = ids[order], x[order]
    parts, starts = np.unique(part[order], return_index=True)
    norm, q_norm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    unit, out = (x / norm[:, None]).T, []
    for a in range(0, len(q), AT_ONCE):
        some = q[a : a + AT_ONCE] / q_norm[a : a + AT_ONCE, None]
        wanted = np.array([np.isin(parts, p) for p in probed[a : a + AT_ONCE]])
        rough = np.full((len(some), len(ids)), -np.inf)
        for asked, start, stop in zip(wanted.T, starts, [*starts[1:], len(ids)]):
            rough[asked, start:stop] = some[asked] @ unit[:, start:stop]
        for i, own in enumerate(query_ids[a : a + AT_ONCE]):
            near = rough[i]
            near[ids == own] = -np.inf
            least = np.partition(near, -k)[-k] if len(near) > k else -np.inf
            at = np.flatnonzero((near >= least - 1e-9) & (near > -np.inf))
            exact = (x[at] * q[a + i]).sum(1) / (norm[at] * q_norm[a + i])
            best = np.lexsort((ids[at], -exact))[:k]
            out += [(int(own), int(ids[at[j]]), float(exact[j])) for j in best]
    return out


def fit(vectors: list[list[float]], recall: float, parts: int) -> tuple[int, Router, float]:
    """The length of the vectors fitted, the router over them and the mass of parts to probe."""
    size = Counter(map(len, vectors)).most_common(1)[0][0] if vectors else 1
    x = np.array([v for v in vectors if len(v) == size] or [[1.0] * size])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts = max(1, min(parts, len(x) // LEAST_PART))
    near = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(near, parts)
    kept = len(x) - len(x) // 8
    router = learn_router(x[:kept], near[:kept], part, parts)
    placed = np.argmax(router.probabilities(x), 1)
    return size, router, needed_mass(router, x[kept:], near[kept:], placed, recall)


def search(spark: SparkSession, df: DataFrame, is_query: str, k: int, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which ``is_query``, SQL over vec_id, holds."""
    placed, routed = placed_and_routed(spark, df, is_query, k, id_col, vec_col, parts, recall)
    blocks = materialise(spark, placed.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    q_blocks = max(1, -(-placed.where(is_query).count() // QUERIES))
    groups = (blocks.agg(F.sum("blocks")).first()[0] or 1) * q_blocks
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asked = routed.join(blocks, "grp").select("query_id", "q", "probed", "grp", up_to(F.col("blocks")).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("q_block"))
    dealt = placed.join(blocks, "grp").select("vec_id", "vec", "part", "grp", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"), up_to(F.lit(q_blocks).cast("long")).alias("q_block"))

    def rerank(q: pa.Table, v: pa.Table) -> pa.Table:
        found = []
        if q.num_rows and v.num_rows:
            one = lambda t, c: t.column(c).combine_chunks()
            probed = [np.array(p) for p in q.column("probed").to_pylist()]
            found = nearest_in_block(one(v, "vec_id").to_numpy(), _matrix(one(v, "vec")), one(v, "part").to_numpy(), one(q, "query_id").to_numpy(), _matrix(one(q, "q")), probed, k)
        cols = zip(*found) if found else ((), (), ())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), cols, (pa.int64(), pa.int64(), pa.float64()))})

    keys = ["grp", "block", "q_block"]
    by_task = lambda rows: rows.repartition(min(MOST_TASKS, groups), *keys).groupBy(*keys)
    found = by_task(asked).cogroup(by_task(dealt)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    return best_of_blocks(found, k, [F.desc("score")]).select("query_id", "rank", "vec_id", "score")


def placed_and_routed(spark: SparkSession, df: DataFrame, is_query: str, k: int, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Every row (vec_id, vec, part, grp), and every query (query_id, q, grp, probed): once for each group of parts with parts that it probes."""
    rows = materialise(spark, usable(df, id_col, vec_col).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    every = max(1, -(-rows.count() // SAMPLE))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id")
    size, router, mass = fit([r["vec"] for r in sample.select("vec").collect()], recall, parts)
    model = spark.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            lengths = pc.list_value_length(vec).to_numpy()
            part, fitted = -lengths.astype(np.int32), lengths == size
            if fitted.any():
                part[fitted] = np.argmax(_probabilities(model.value, vec.filter(pa.array(fitted))), 1)
            grp = np.where(part < 0, part, part // GROUP).astype(np.int32)
            yield pa.record_batch([batch.column("vec_id"), vec, pa.array(part), pa.array(grp)], ["vec_id", "vec", "part", "grp"])

    placed = materialise(spark, rows.mapInArrow(place, "vec_id long, vec array<double>, part int, grp int"))
    counts = {r["part"]: r["n"] for r in placed.where("part >= 0").groupBy("part").agg(F.count("*").alias("n")).collect()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, own = batch.column("vec"), batch.column("part").to_numpy()
            at, grp, probed = list(np.flatnonzero(own < 0)), list(own[own < 0]), [[p] for p in own[own < 0]]
            fitted = np.flatnonzero(own >= 0)
            if len(fitted):
                for i, chosen in zip(fitted, probed_parts(_probabilities(model.value, vec.take(pa.array(fitted))), counts, mass, k)):
                    for g in np.unique(chosen // GROUP):
                        at.append(i)
                        grp.append(g)
                        probed.append(chosen[chosen // GROUP == g])
            taken = pa.array(np.array(at, np.int64))
            yield pa.record_batch([batch.column("vec_id").take(taken), vec.take(taken), pa.array(grp, pa.int32()), pa.array(probed, pa.list_(pa.int32()))], ["query_id", "q", "grp", "probed"])

    return placed, placed.where(is_query).mapInArrow(route, "query_id long, q array<double>, grp int, probed array<int>")


def _probabilities(router: Router, vec: pa.Array) -> np.ndarray:
    v = _matrix(vec)
    return router.probabilities(v / np.linalg.norm(v, axis=1, keepdims=True))


def probed_parts(p: np.ndarray, counts: dict[int, int], mass: float, k: int) -> Iterator[np.ndarray]:
    """For each row of probabilities, its parts from the most probable down, until they have the mass and more than k rows."""
    order = np.argsort(-p, 1, kind="stable")
    ordered = np.take_along_axis(p, order, 1)
    rows = np.array([counts.get(i, 0) for i in range(p.shape[1])])[order]
    going_on = (np.cumsum(ordered, 1) - ordered < mass) | (np.cumsum(rows, 1) - rows <= k)
    for parts, on, n in zip(order, going_on, rows):
        yield parts[on & (n > 0)]
