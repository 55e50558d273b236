"""Self-join of documents on the Jaccard similarity of their word shingles, by multiple global orders.

Every shingle has a place in several global orders of all shingles. In each order a document's
prefix is its first |s| - ceil(t|s|) + 1 shingles, and two documents of similarity t or more share a
prefix shingle in every one of them. The first order puts frequent shingles last (their counts come
from a sketch of fixed size over all rows) and hashes the others; its prefixes are indexed. A pair
found there becomes a candidate only if its sizes and profiles allow the similarity and it also shares
prefix shingles in both other orders; the rest is verified on whole sets.

Documents with equal sets form a class, named by the set's size and digest. The lists of the index are
read in the order of shingle and size: one of up to ``SHORT`` classes makes its pairs at once. Longer
lists, and those of shingles that the sketch counts as ``HOT``, go through rounds: each names one
leader, and only pairs of the leader with a class of another component are made, so a group of n near
copies makes n pairs, not n^2; lists within one component leave. What is open after the last round is
decided pair by pair: classes of different components whose sizes fit are dealt into tiles by size, and
pairs of tiles are compared in one piece, on profiles alone. Where few pairs of a piece are left, as among texts
that share no more than a phrase, each goes once, whatever the number of its lists, to the texts; only the
entries of a piece with many are dealt again with their whole sets. A profile counts a
set's shingles in each of ``CELLS`` cells modulo 256, so the differences add up to no more than the shingles
not shared. So few cells tell large sets apart from nothing; these have a fine profile too, whose cells grow with
the set, and pairs of them are compared on it before their texts move. What is left apart has been shown to be apart, so the components are those of all links.

Tables between the steps lie in the shared folder and go once their last reader is done. The index is dealt
out in ``LIST_PARTS`` parts by shingle, one after the other. The texts of candidates are read again and meet once
for each pair, about 1 / ``TEXT_PARTS`` of the table's length at a time.

Defined results: null text, empty text and text without words have an empty set, which is linked
with nothing; repeated rows are in one class and each has its row; a null doc_id has a row, and a
component is then named by its smallest id that is not null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, row_blocks, trimmed, utf8
from strandline.llm.components import components, rough_components
from strandline.llm.shingles import WordHashes, mix, shingle_sets

COUNTER_BITS = 20
SLICES = 64
HOT = 6  # a shingle counted 2^HOT times as often as the mean, or more
ROUNDS = 1
BROADCAST_ROWS = 1_000_000
BLOCK = 1 << 20
SHORT, TILE, TILE_SHINGLES, CELLS = 32, 1024, 1 << 20, 64
FINE, FINE_CELLS = 4, 1 << 14  # a large set's second profile has a cell for FINE to 2 * FINE shingles, but no more cells than these
LIST_PARTS = 4  # the index is dealt out in so many parts, one after the other
TEXT_PARTS = 4  # texts move to be verified as long as they are 1 / TEXT_PARTS of the table's, about
DENSE = 16  # pairs of a piece for each of its entries, from which whole sets are compared there
FAN = 64  # pairs of one class that are verified in one piece
SEEN = 100_000  # classes that a task remembers, to index a copy once
SIZE_BYTES, KEY_BYTES = 3, 16
LARGEST = (1 << 8 * SIZE_BYTES) - 1
SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)


def sets_of(texts: pa.Array, n: int, hashes: WordHashes) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The first row and the sets of blocks of rows."""
    raw, offsets = utf8(texts)
    for a, b in row_blocks(offsets, BLOCK):
        yield a, shingle_sets([raw[x:y].tobytes() for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist())], n, hashes)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def frequency_levels(docs: DataFrame, n: int) -> np.ndarray:
    """For each counter of the sketch, 1 + the power of two of its count over twice the mean count, 0 below that.

    Each partition counts all its rows, to 65,535 a counter; counts are summed by slices of the sketch,
    and its numbers reach the driver, whatever the size of the table."""
    counters = 1 << COUNTER_BITS
    width = counters // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(counters, np.uint32), WordHashes()
        for batch in batches:
            for _, sets in sets_of(batch.column("text"), n, hashes):
                total += np.bincount(_counter(np.concatenate(sets)), minlength=counters).astype(np.uint32)
        if total.any():
            least = np.minimum(total, 65_535).astype("<u2").reshape(SLICES, width)
            planes = [x.view(np.uint8).reshape(-1, 2).T.tobytes() for x in least]  # low bytes, then high ones, mostly 0
            yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array(planes, pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                low, high = np.frombuffer(c, np.uint8).reshape(2, width).astype(np.uint64)
                sums[k] = sums.get(k, 0) + low + (high << np.uint64(8))
        yield pa.record_batch([pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(trimmed(count), schema).repartition(SLICES // 4, "slice").mapInArrow(add, schema).collect()
    counts = np.zeros((SLICES, width), np.uint64)
    for r in rows:
        counts[r["slice"]] = np.frombuffer(r["counts"], np.uint64)
    counts = counts.reshape(-1)
    mean = max(1.0, float(counts.sum()) / counters)
    return np.log2(np.maximum(counts / (2 * mean), 0.5)).astype(np.int64).clip(-1, 14).astype(np.int8) + np.int8(1)


def further_orders(h: np.ndarray) -> list[np.ndarray]:
    return [mix(h ^ SEEDS[2]), mix(h + SEEDS[2])]


def further_prefixes(s: np.ndarray, percent: int) -> list[np.ndarray]:
    """The prefixes of a set in the two further orders, each sorted."""
    p = prefix_length(len(s), percent)
    return [np.sort(np.partition(o, p - 1)[:p]) for o in further_orders(s)]


def prefix_length(size: int, percent: int) -> int:
    return size - (percent * size + 99) // 100 + 1


def signatures(spark: SparkSession, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """A row per document: doc_id, key (a hash of the text), size n and the class.

    The first row of a class in a task also has its profiles and its prefix in the first order, split by ``HOT``."""
    levels = spark.sparkContext.broadcast(frequency_levels(docs, n))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, hashes, seen = levels.value, WordHashes(), set()
        for batch in batches:
            for at, sets in sets_of(batch.column("text"), n, hashes):
                sizes = [len(s) for s in sets]
                raw = [min(k, LARGEST).to_bytes(SIZE_BYTES, "big") + hashlib.blake2b(s.tobytes(), digest_size=KEY_BYTES - SIZE_BYTES).digest() for k, s in zip(sizes, sets)]
                flat = np.concatenate(sets)
                rare = level[_counter(flat)]
                first = (rare.astype(np.uint64) << np.uint64(60)) | (mix(flat ^ SEEDS[1]) >> np.uint64(4))
                place = mix(flat ^ SEEDS[0])
                cell = np.repeat(np.arange(len(sets)), sizes) * CELLS + (place % np.uint64(CELLS)).astype(np.int64)
                profiles = np.bincount(cell, minlength=len(sets) * CELLS).astype(np.uint8).reshape(-1, CELLS)
                own: list = []
                fine: list = []
                cold, hot = [], []
                stop = 0
                for i, (name, size) in enumerate(zip(raw, sizes)):
                    start, stop = stop, stop + size
                    if not size or name in seen:
                        own.append(None)
                        fine.append(None)
                        for out in (cold, hot):
                            out.append(flat[:0])
                        continue
                    if len(seen) < SEEN:
                        seen.add(name)
                    own.append(profiles[i].tobytes())
                    fine.append(fine_profile(place[start:stop]))
                    p = prefix_length(size, percent)
                    at1 = start + np.argpartition(first[start:stop], p - 1)[:p]
                    often = rare[at1] >= HOT
                    cold.append(flat[at1[~often]])
                    hot.append(flat[at1[often]])
                keys = [batch.column(c).slice(at, len(sets)) for c in ("doc_id", "key")]
                yield pa.record_batch([*keys, pa.array(sizes, pa.int64()), pa.array(raw, pa.binary()), pa.array(own, pa.binary()), pa.array(fine, pa.binary()), _lists(cold), _lists(hot)], ["doc_id", "key", "n", "class", "profile", "fine", "cold", "hot"])

    return docs.mapInArrow(trimmed(sign), "doc_id long, key long, n long, class binary, profile binary, fine binary, cold array<long>, hot array<long>")


def fine_profile(place: np.ndarray) -> bytes | None:
    """The counts modulo 256 of a set's shingles in cells as many as its size asks for, a power of two; None where ``CELLS`` are enough."""
    cells = min(FINE_CELLS, 1 << (len(place) // FINE).bit_length() - 1) if len(place) >= FINE else 0
    if cells <= CELLS:
        return None
    return np.bincount((place % np.uint64(cells)).astype(np.int64), minlength=cells).astype(np.uint8).tobytes()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype("u8").view("i8")))


def _raw(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal lengths as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _sizes(names: np.ndarray) -> np.ndarray:
    return names[:, :SIZE_BYTES].astype(np.int64) @ (256 ** np.arange(SIZE_BYTES - 1, -1, -1))


def _names(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def list_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(shingle, a, b) from (shingle, class): the fitting pairs of short lists, shingle null, and the entries a of long ones, b null.

    Rows come by shingle and class, so by size; a list that a batch ends in is carried on, ``SHORT`` entries of it at most."""

    short = SHORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, name = np.zeros(0, np.int64), np.zeros((0, KEY_BYTES), np.uint8)
        long: int | None = None  # the list that is carried on is a long one
        for batch in _then_none(batches):
            if batch is not None:
                shingle = np.concatenate([shingle, batch.column("shingle").to_numpy()])
                name = np.concatenate([name, _raw(batch.column("class"), KEY_BYTES)])
            if not len(shingle):
                continue
            new = np.ones(len(shingle), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (name[1:] != name[:-1]).any(1)
            shingle, name = shingle[new], name[new]
            starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
            ends = np.append(starts[1:], len(shingle))
            counts = ends - starts
            whole = len(starts) if batch is None else len(starts) - 1
            of = np.arange(len(starts))
            is_long = (counts > short) | (shingle[starts] == long if long is not None else False)
            listed = of[is_long & ((of < whole) | (batch is not None))]
            known = int(shingle[0] == long) if long is not None else 0  # the first entry was listed before
            at = np.concatenate([np.zeros(0, np.int64), *(np.arange(max(starts[i], known), ends[i]) for i in listed)])
            if len(at):
                yield _found(pa.array(shingle[at]), _names(name[at]), pa.nulls(len(at), pa.binary()))
            a, b = fitting_pairs(name, starts[:whole], np.where(is_long, 0, counts)[:whole], short, percent)
            if len(a):
                yield _found(pa.nulls(len(a), pa.int64()), _names(name[a]), _names(name[b]))
            if batch is not None:  # the last list may go on; of a long one its last entry tells repeated ones apart
                long = int(shingle[-1]) if is_long[-1] else None
                keep = len(shingle) - 1 if is_long[-1] else starts[-1]
                shingle, name = shingle[keep:], name[keep:]

    sorted_lists = postings.repartition("shingle").sortWithinPartitions("shingle", "class")
    return sorted_lists.mapInArrow(trimmed(run), "shingle long, a binary, b binary")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _found(shingle: pa.Array, a: pa.Array, b: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([shingle, a, b], ["shingle", "a", "b"])


def fitting_pairs(name: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs of lists of 2 to ``most`` entries, sorted by size, whose sizes allow the similarity."""
    size = _sizes(name)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, most):
        first = starts[counts > step]
        if not len(first):
            break
        n = counts[counts > step] - step
        a = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        fits = 100 * size[a] >= percent * size[a + step]
        left.append(a[fits])
        right.append(a[fits] + step)
    return np.concatenate(left), np.concatenate(right)


def most_different(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles two sets of these sizes may not share at the similarity; no bound is known for ``LARGEST`` sets."""
    total = x + y
    return np.where(np.maximum(x, y) < LARGEST, total - 2 * -(-percent * total // (100 + percent)), 1 << 40)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number of shingles not shared, from rows of profiles."""
    d = x - y
    return np.minimum(d, -d).sum(-1, dtype=np.int64)


def _apart_finely(x: bytes, y: bytes) -> int:
    """The same from two fine profiles; the cells of the longer one are added up to those of the other."""
    p, q = (np.frombuffer(z, np.uint8).reshape(-1, min(len(x), len(y))).sum(0, dtype=np.uint8) for z in (x, y))
    return int(_apart(p, q))


def _size(name: str) -> Column:
    return F.conv(F.hex(F.substring(name, 1, SIZE_BYTES)), 16, 10).cast("long")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys``, integers; one that a batch ends in is carried on."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        of = np.stack([held.column(k).to_numpy() for k in keys], 1)
        starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]).any(1)])).tolist()
        for x, y in zip(starts, starts[1:]):
            yield held.slice(x, y - x)
        held = held.slice(starts[-1])
    if held is not None:
        yield held


PIECE = ["shingle", "i_cell", "i_sub", "j_cell", "j_sub"]


def _pieces(lists: DataFrame, percent: int, *columns: str) -> DataFrame:
    """Pairs of tiles of (shingle, class, c, leader, ``columns``), named by ``PIECE``; ``left`` tells which of the two an entry is of.

    A list of more than ``TILE`` entries or ``TILE_SHINGLES`` shingles, if it has sets, is dealt into bands of size, in
    which neighbours alone can fit, and these by side, the leader's component or another, into tiles. Each pair of
    tiles is compared by itself, but never two of the leader's component, so what a few classes need to be told
    apart from many costs few tiles."""
    most = TILE, TILE_SHINGLES
    width = float(np.log(100 / percent)) * 1.000001  # sizes that just fit stay neighbours
    band = F.floor(F.log(_size("class").cast("double")) / width).cast("int")
    sided = lists.withColumn("band", band).withColumn("side", (F.col("c") == F.col("leader.c")).cast("int"))
    sided = sided.withColumn("cell", F.col("band") * 2 + F.col("side"))
    tiles = F.greatest(F.ceil(F.col("n") / most[0]), F.ceil(F.col("shingles") / most[1])).cast("int")
    shingles = F.sum(F.octet_length("set") / 8) if "set" in columns else F.lit(0.0)
    counts = sided.groupBy("shingle", "cell").agg(F.count("*").alias("n"), shingles.alias("shingles"))
    counts = counts.groupBy("shingle").agg(F.sum("n").alias("rows"), F.sum("shingles").alias("shingles"), F.map_from_entries(F.collect_list(F.struct("cell", tiles.alias("tiles")))).alias("tiles"))
    dealt, many = sided.join(counts, "shingle"), (F.col("rows") > most[0]) | (F.col("shingles") > most[1])
    place = lambda cell, sub: F.struct(cell.alias("cell"), sub.alias("sub"))

    def of_cell(cell: Column) -> Column:
        return F.coalesce(F.try_element_at("tiles", cell), F.lit(0))

    def beside(step: int, side: int) -> Column:
        cell = (F.col("band") + step) * 2 + side
        n = F.when((F.col("side") == 0) | F.lit(side == 0), of_cell(cell)).otherwise(0)
        return F.transform(F.filter(F.sequence(F.lit(0), n), lambda s: s < n), lambda s: place(cell, s))

    alone = place(F.lit(0), F.lit(0))
    dealt = dealt.withColumn("own", F.when(many, place(F.col("cell"), F.pmod(F.xxhash64("class"), of_cell(F.col("cell"))).cast("int"))).otherwise(alone))
    others = F.concat(*(beside(step, side) for step in (-1, 0, 1) for side in (0, 1)))
    dealt = dealt.withColumn("other", F.explode(F.when(many, others).otherwise(F.array(alone))))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = dealt.select("shingle", *(F.col(f"{x}.{y}").alias(f"{x}_{y}") for x in "ij" for y in ("cell", "sub")), (F.col("own") <= F.col("other")).alias("left"), "class", "c", *columns)
    return dealt.repartition(*PIECE).sortWithinPartitions(*PIECE)


def _left(run: pa.Table) -> np.ndarray | None:
    """Which entries of a piece are of its first tile; nothing if it is compared with itself."""
    same = all(run.column(f"i_{x}")[0] == run.column(f"j_{x}")[0] for x in ("cell", "sub"))
    return None if same else run.column("left").combine_chunks().to_numpy(zero_copy_only=False)


def _facing(bound: np.ndarray, left: np.ndarray | None, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each entry of a piece with those it meets whose sizes fit; of an entry and itself, or two that met, nothing."""
    x, y = (np.arange(len(bound)),) * 2 if left is None else (np.flatnonzero(left), np.flatnonzero(~left))
    y = y[np.argsort(bound[y], kind="stable")]
    x = y if left is None else x
    low = np.searchsorted(bound[y], -(-percent * bound[x] // 100))
    high = np.searchsorted(bound[y], 100 * bound[x] // percent, "right")
    if left is None:
        low = np.maximum(low, np.arange(1, len(x) + 1))
    return ((i, y[a:b]) for i, a, b in zip(x.tolist(), low.tolist(), high.tolist()) if a < b)


def _numbers(c: np.ndarray) -> np.ndarray:
    return np.unique(c, axis=0, return_inverse=True)[1].reshape(-1)


def near_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(shingle, a, b) from (shingle, class, c, leader, profile): the pairs of different components whose sizes and
    profiles allow the similarity, shingle null, and b null for the entries a that have such a pair in a piece with
    more than ``DENSE`` times as many pairs as entries."""
    dense = DENSE

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, PIECE):
            name, profile = (_raw(run.column(k).combine_chunks(), width) for k, width in (("class", KEY_BYTES), ("profile", CELLS)))
            c, bound, left = _numbers(_raw(run.column("c").combine_chunks(), KEY_BYTES)), _sizes(name), _left(run)
            met, a, b, n = np.zeros(len(name), bool), [], [], 0
            for i, near in _facing(bound, left, percent):
                near = near[c[near] != c[i]]
                near = near[_apart(profile[near], profile[i]) <= most_different(bound[near], bound[i], percent)]
                if not len(near):
                    continue
                met[i] = met[near] = True
                if (n := n + len(near)) <= dense * len(name):
                    a.append(np.full(len(near), i))
                    b.append(near)
            if n > dense * len(name):
                at = np.flatnonzero(met)
                yield _found(pa.array(np.full(len(at), run.column("shingle")[0].as_py())), _names(name[at]), pa.nulls(len(at), pa.binary()))
            elif n:
                x, y = np.concatenate(a), np.concatenate(b)
                swap = bound[x] > bound[y]  # the smaller set first; of equal sizes the smaller name
                swap |= (bound[x] == bound[y]) & np.array([name[i].tobytes() > name[j].tobytes() for i, j in zip(x.tolist(), y.tolist())])
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                yield _found(pa.nulls(n, pa.int64()), _names(name[x]), _names(name[y]))

    return _pieces(lists, percent, "profile").mapInArrow(trimmed(compare), "shingle long, a binary, b binary")


def tile_links(lists: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components c of one shingle's entries: for each piece those of a forest.

    ``lists`` has (shingle, class, c, leader, profile, set)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, PIECE):
            one = lambda c: run.column(c).combine_chunks()  # noqa: B023, E731
            name, sets = _raw(one("class"), KEY_BYTES), [np.frombuffer(x, np.uint64) for x in one("set").to_pylist()]
            found = Tile(name, _raw(one("c"), KEY_BYTES), _raw(one("profile"), CELLS), sets, percent).forest(_left(run))
            if found:
                a, b = zip(*found)
                yield pa.record_batch([_names(name[list(a)]), _names(name[list(b)])], ["a", "b"])

    return _pieces(lists, percent, "profile", "set").mapInArrow(trimmed(compare), "a binary, b binary")


class Tile:
    """Entries that are compared in one piece: by size, component, profile, the prefixes of the two further orders and whole sets."""

    def __init__(self, name: np.ndarray, c: np.ndarray, profile: np.ndarray, sets: list[np.ndarray], percent: int) -> None:
        self.profile, self.percent = profile, percent
        self.bound, self.size = _sizes(name), np.array(list(map(len, sets)))
        self.c = _numbers(c)
        flat = np.concatenate(sets)
        self.values, dense = np.unique(flat, return_inverse=True)
        ends = np.cumsum(self.size)
        self.whole = np.split(dense.reshape(-1), ends[:-1])
        lengths = [prefix_length(k, percent) for k in self.size.tolist()]
        self.prefixes = []
        for order in further_orders(flat):
            parts = np.split(order, ends[:-1])
            self.prefixes.append([w[np.argpartition(o, p - 1)[:p]] for w, o, p in zip(self.whole, parts, lengths)])

    def forest(self, left: np.ndarray | None) -> list[tuple[int, int]]:
        """Links between components, each of which joins two that were apart, of all rows or of the left with the other ones."""
        bound, percent = self.bound, self.percent
        mark, found = np.zeros(len(self.values), bool), []
        for i, near in _facing(bound, left, percent):
            near = near[self.c[near] != self.c[i]]
            near = near[_apart(self.profile[near], self.profile[i]) <= most_different(bound[near], bound[i], percent)]
            for prefix in self.prefixes:
                near = near[self._marked(mark, prefix, i, near) > 0]
            both = self._marked(mark, self.whole, i, near)
            for j in near[100 * both >= percent * (self.size[near] + self.size[i] - both)].tolist():
                if self.c[i] != self.c[j]:
                    self.c[self.c == self.c[j]] = self.c[i]
                    found.append((i, j))
        return found

    @staticmethod
    def _marked(mark: np.ndarray, parts: list[np.ndarray], i: int, near: np.ndarray) -> np.ndarray:
        """How many values of each near part are in the part of i."""
        if not len(near):
            return np.zeros(0, np.int64)
        mark[parts[i]] = True
        chosen = [parts[j] for j in near.tolist()]
        starts = np.cumsum([0, *map(len, chosen[:-1])])
        out = np.add.reduceat(mark[np.concatenate(chosen)], starts, dtype=np.int64)
        mark[parts[i]] = False
        return out


class Linked(NamedTuple):
    """``rows`` has (doc_id, key, n, class) of every document, ``labels`` (class, c) of every class that has a link."""

    rows: DataFrame
    labels: DataFrame


class Join:
    """The steps of one join, which share its tables."""

    def __init__(self, spark: SparkSession, docs: DataFrame, n: int, percent: int) -> None:
        self.spark, self.docs, self.n, self.percent = spark, docs.withColumn("key", F.xxhash64("text")), n, percent
        self.scratch = Scratch(spark)

    def linked(self, rounds: int) -> Linked:
        write = self.scratch.write
        signed = write(signatures(self.spark, self.docs, self.n, self.percent))
        rows = write(signed.select("doc_id", "key", "n", "class"))
        self.shingles = rows.agg(F.sum("n")).first()[0] or 0
        first = signed.where("profile is not null")
        postings = first.select("class", F.explode("cold").alias("shingle"))
        lists = [write(list_pairs(postings.where(F.pmod("shingle", F.lit(LIST_PARTS)) == part), self.percent)) for part in range(LIST_PARTS)]
        found = functools.reduce(DataFrame.unionByName, lists)
        hot = first.select(F.explode("hot").alias("shingle"), "class").distinct()
        opened = write(found.where("shingle is not null").select("shingle", F.col("a").alias("class")).unionByName(hot))
        pairs = write(found.where("shingle is null").select("a", "b").distinct())
        self.own = write(first.select("doc_id", "key", "class", "profile", "fine"))
        self.scratch.drop(signed, *lists)  # the index has no other readers
        links = tried = None
        for k in range(rounds + 2):  # short lists, rounds of leaders, tiles
            if k:
                opened = self._open(opened, links, k, rounds)
                if opened is None:
                    break
                if k > rounds:
                    links = links.unionByName(self._apart_or_linked(opened, tried))
                    break
                pairs = write(self._leader_pairs(opened).distinct().join(tried, ["a", "b"], "left_anti"))
            mine = self._verified(self._candidates(pairs))
            links = mine if links is None else links.unionByName(mine)
            tried = pairs if tried is None else tried.unionByName(pairs)
        labels = components(self.spark, links)
        self.scratch.keep_only(rows)
        return Linked(rows, labels.select(F.col("v").alias("class"), "c"))

    def _small(self, df: DataFrame, rows: int) -> DataFrame:
        """A hint to send ``df`` to all executors if its rows are known to be few."""
        return F.broadcast(df) if rows <= BROADCAST_ROWS else df

    def _open(self, lists: DataFrame, links: DataFrame, k: int, rounds: int) -> DataFrame | None:
        """Entries (shingle, class, c, leader) of the lists with two components or more.

        The leader of the first round is a class with the most links, which the text that copies were made
        from has; later ones are chosen by a hash. Rounds may take connected classes for apart, tiles don't."""
        if lists.isEmpty():
            return None
        write, drop = self.scratch.write, self.scratch.drop
        labels = components(self.spark, links, self.scratch) if k > rounds else rough_components(links)
        degrees = links.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("degree"))
        of_class = labels.join(degrees, "v").select(F.col("v").alias("class"), "c", "degree")
        labelled = write(lists.select("shingle", "class").join(of_class, "class", "left").select("shingle", "class", F.coalesce("c", "class").alias("c"), F.coalesce("degree", F.lit(0)).alias("degree")))
        drop(lists, labels)
        by = F.struct(F.lit(0) if k > 1 else F.col("degree"), F.xxhash64("class", F.lit(k)))
        state = labelled.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max_by(F.struct("class", "c"), by).alias("leader"))
        state = write(state.where("low < high").select("shingle", "leader"))
        out = write(labelled.join(state, "shingle").select("shingle", "class", "c", "leader"))
        drop(labelled, state)
        return None if out.isEmpty() else out

    def _leader_pairs(self, opened: DataFrame) -> DataFrame:
        a, b = F.least("class", "leader.class"), F.greatest("class", "leader.class")  # by size first
        pairs = opened.where("c <> leader.c").select(a.alias("a"), b.alias("b"))
        return pairs.where(100 * _size("a") >= self.percent * _size("b"))

    def _apart_or_linked(self, opened: DataFrame, tried: DataFrame) -> DataFrame:
        """The links that remain among the entries of open lists."""
        write = self.scratch.write
        wanted = opened.select("class").distinct()
        profiles = self._of_classes(wanted, opened.count(), "profile")
        near = write(near_pairs(opened.join(profiles, "class"), self.percent))
        pairs = write(near.where("shingle is null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        dense = write(near.where("shingle is not null").select("shingle", F.col("a").alias("class")).distinct())
        self.scratch.drop(near)
        links = self._verified(pairs)
        if dense.isEmpty():
            return links
        return links.unionByName(write(tile_links(self._with_sets(write(opened.join(dense, ["shingle", "class"]))), self.percent)))

    def _with_sets(self, opened: DataFrame) -> DataFrame:
        wanted = self.scratch.write(opened.select("class").distinct())
        rows, n = wanted.count(), self.n

        def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                for at, sets in sets_of(batch.column("text"), n, hashes):
                    yield pa.record_batch([batch.column("class").slice(at, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "set"])

        sets = self.scratch.write(self._texts(wanted, ["class"], rows).mapInArrow(trimmed(to_sets), "class binary, set binary").dropDuplicates(["class"]))
        return opened.join(self._of_classes(wanted, rows, "profile"), "class").join(sets, "class")

    def _of_classes(self, wanted: DataFrame, rows: int, *columns: str) -> DataFrame:
        return self.own.select("class", *columns).join(self._small(wanted, rows), "class").dropDuplicates(["class"])

    def _candidates(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose profiles allow the similarity."""
        percent = self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = [_sizes(_raw(batch.column(c), KEY_BYTES)) for c in "ab"]
                apart = _apart(*(_raw(batch.column(f"profile_{c}"), CELLS) for c in "ab"))
                yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(apart <= most_different(*size, percent)))

        return self.scratch.write(self._with(pairs, "profile").mapInArrow(trimmed(compare), "a binary, b binary"))

    def _finely(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose fine profiles, if both have one, allow the similarity too."""
        percent = self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                most = most_different(*(_sizes(_raw(batch.column(c), KEY_BYTES)) for c in "ab"), percent).tolist()
                fine = zip(*(batch.column(f"fine_{c}").to_pylist() for c in "ab"))
                keep = [x is None or y is None or _apart_finely(x, y) <= z for (x, y), z in zip(fine, most)]
                yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        small = _size("a") < 2 * CELLS * FINE  # a has the smaller set
        large = self.scratch.write(pairs.where(~small))
        near = self._with(large, "fine").mapInArrow(trimmed(compare), "a binary, b binary")
        out = self.scratch.write(pairs.where(small).unionByName(near))
        self.scratch.drop(large)
        return out

    def _with(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """The pairs with the columns of both classes."""
        n = pairs.count()
        ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        mine = self._of_classes(ends, 2 * n, *columns)
        of = lambda x: mine.select(F.col("class").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
        return self._small(pairs, n).join(of("a"), "a").join(of("b"), "b")

    def _texts(self, asked: DataFrame, columns: list[str], rows: int) -> DataFrame:
        """``columns`` of ``asked``, ``class`` among them, with the class's text; of repeated rows one of each task."""
        place = self.own.select("class", F.struct("doc_id", "key").alias("row")).join(self._small(asked.select("class").distinct(), rows), "class")
        place = place.groupBy("class").agg(F.min("row").alias("row"))
        at = self._small(asked.join(place, "class").select(*columns, F.col("row.doc_id").alias("at_id"), F.col("row.key").alias("at_key")), rows)
        texts = self.docs.join(at, (F.col("key") == F.col("at_key")) & F.col("doc_id").eqNullSafe(F.col("at_id"))).select(*columns, "text")

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set = set()
            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in columns)))
                new = [not (k in seen or seen.add(k)) for k in keys]
                yield batch if all(new) else batch.filter(pa.array(new))

        return texts.mapInArrow(trimmed(once), texts.schema)

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that share prefix shingles in both further orders and whose whole sets have the similarity.

        Texts are read again, as prefixes of all documents would take more room than the texts of few. Up to ``FAN`` pairs of one a meet in one piece: its text comes first, then those of the b."""
        n, percent, pairs = self.n, self.percent, self._finely(pairs)
        fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("pieces"))
        of_b = pairs.join(fan, "a").select(F.col("b").alias("class"), "a", F.pmod(F.xxhash64("b"), "pieces").cast("int").alias("piece"))
        of_a = fan.select(F.col("a").alias("class"), "a", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        asked = self.scratch.write(of_a.unionByName(of_b))
        rows, shingles = asked.agg(F.count("*"), F.sum(_size("class"))).first()
        parts = max(1, -(-TEXT_PARTS * (shingles or 0) // max(1, self.shingles)))  # by length: what meets is often long

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, own, of_own, prefixes = WordHashes(), None, None, []
            for batch in batches:
                a, name, keep = batch.column("a").to_pylist(), batch.column("class").to_pylist(), []
                for at, sets in sets_of(batch.column("text"), n, hashes):
                    for i, s in enumerate(sets, at):
                        if name[i] == a[i]:
                            own, of_own, prefixes = s, a[i], further_prefixes(s, percent)
                            keep.append(False)
                            continue
                        if of_own != a[i]:
                            raise ValueError("a pair without its first text")
                        candidate = all(_shared(x, y) for x, y in zip(prefixes, further_prefixes(s, percent)))
                        both = _shared(own, s) if candidate else 0
                        keep.append(100 * both >= percent * (len(own) + len(s) - both))
                yield pa.record_batch([batch.column("a"), batch.column("class")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        out = None
        for part in range(parts):
            mine = asked.where(F.pmod(F.xxhash64("a", "piece"), F.lit(parts)) == part) if parts > 1 else asked
            met = self._texts(mine, ["a", "piece", "class"], -(-rows // parts)).repartition("a", "piece").sortWithinPartitions("a", "piece", F.col("class") != F.col("a"), "class")
            links = self.scratch.write(met.select("a", "class", "text").mapInArrow(trimmed(check), "a binary, b binary"))
            out = links if out is None else out.unionByName(links)
        self.scratch.drop(asked)
        return out


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted sets."""
    if not len(x):
        return 0
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum())


def _ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def link_documents(spark: SparkSession, docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest id that links lead to."""
    rows, labels = Join(spark, _ids_and_texts(docs, id_col, text_col), n, percent).linked(rounds)
    scratch = Scratch(spark)
    # a class that is hot: the written tables let the join with all rows split it
    classes = scratch.write(rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least_id")))
    linked = labels.join(classes, "class")
    names = linked.groupBy("c").agg(F.min("least_id").alias("component_id"))
    of_class = classes.join(linked.join(names, "c").select("class", "component_id"), "class", "left")
    of_class = scratch.write(of_class.select("class", F.coalesce("component_id", "least_id").alias("component_id")))
    scratch.drop(classes)
    out = rows.join(of_class, "class", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: that with the smallest doc_id.

    It is decided row by row: of rows with one doc_id and different texts only those that are copies go; of
    texts with the smallest doc_id that with the smaller hash stays, of equal ones with it any one. Rows
    without words and rows with a null doc_id, which nothing names, all stay."""
    rows, labels = Join(spark, _ids_and_texts(docs, "doc_id", "text"), n, percent).linked(ROUNDS)
    scratch = Scratch(spark)
    named = rows.where("n > 0 and doc_id is not null").join(labels, "class", "left").select("doc_id", "key", F.coalesce("c", "class").alias("c"))
    firsts = scratch.write(named.groupBy("c").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("rows")).where("rows > 1"))
    copies = named.join(firsts, "c")
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    tag = uuid.uuid4().hex[:8]  # no column of ``docs`` has such a name
    of_id, of_key, key = f"id_{tag}", f"key_{tag}", F.xxhash64(docs["text"].cast("string"))
    names = F.col("doc_id").alias(of_id), F.col("key").alias(of_key)
    gone = scratch.write(copies.where(~same).select(*names).distinct())
    again = scratch.write(copies.where(same).groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select(*names))
    scratch.drop(firsts)
    at = (docs["doc_id"].cast("long") == F.col(of_id)) & (key == F.col(of_key))
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    kept = docs.join(few(gone), at, "left_anti")
    if again.isEmpty():
        return kept
    once = docs.join(few(again), at, "left_semi").withColumn(of_key, key).dropDuplicates(["doc_id", of_key]).drop(of_key)
    return kept.join(few(again), at, "left_anti").unionByName(once)
