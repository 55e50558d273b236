"""Hierarchical multi-length packing of tokenised documents.

A document's tokens (with its end token) first fill whole windows of the longest tier; what is left
is routed to the shortest tier that holds it. Tiers are packed from the longest down: each window
takes one fragment of its tier, its gap takes the largest fitting fragments of shorter tiers, and
the last gap is closed by cutting one. What finds no filling waits for the next block of the
partition. At the end of a partition the waiting fragments are cut into whole windows and then into
powers of two, which need no padding. Full sequences of one tier are gathered into step groups of
equal token counts.

Documents are packed where they are read: no shuffle, no key, memory bounded by one block, and a
repeated task depends on nothing but its own rows. Ids come from the tokenizers library. Text is cut
at white space, where neither normalisation nor the pre-tokenizer's pattern nor a merge reaches
across, and the ids of recent chunks are kept in a memo of bounded bytes.

Defined results: null and empty text have the end token alone; repeated rows and null ids are packed
like others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm.common import row_blocks, strings, trimmed, utf8

TIERS = (4096, 2048, 1024, 512)
STEP_TOKENS = 32768
MEMO_BYTES = 100 << 20  # of remembered chunks and parts, about, in one worker
ENTRY = 220  # bytes of an entry besides its characters

# ---------------------------------------------------------------- ids


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else the next from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class ChunkIds:
    """Ids of texts as the library gives them, as little-endian unsigned 32-bit bytes.

    Chunks of printable ASCII and Latin letters are cut by the pre-tokenizer's pattern here and their
    parts go to the library's model; all other chunks go through the whole library."""

    #: Characters that NFC leaves alone and whose lower case is one of them; ``<|`` may begin a special token.
    PLAIN = re.compile(r"(?:[!-;=-~À-ÖØ-öø-þ]|<(?!\|))+")
    #: Fixed value: the pre-tokenizer's pattern, for those characters after lower-casing.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-þ]+|[0-9]|[!-/:-`{-~]+")

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = 0
        self.most: int | None = None  # ``MEMO_BYTES`` if unset

    def forget(self) -> None:
        self.memo.clear()
        self.parts.clear()
        self.held = 0

    def _part(self, part: str) -> bytes:
        if (out := self.parts.get(part)) is None:
            word = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
            out = self.parts[part] = np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()
            self.held += ENTRY + len(part) + len(out)
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        split = [t.split() for t in texts]
        memo, plain, parts, part = self.memo, self.PLAIN.fullmatch, self.PARTS.findall, self._part
        other = []
        new = set(chain.from_iterable(split)).difference(memo)
        for chunk in new:
            if plain(chunk):
                memo[chunk] = b"".join(map(part, parts(chunk.lower())))
            else:
                other.append(chunk)
        if other:
            for chunk, e in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False)):
                memo[chunk] = np.array(e.ids, "<u4").tobytes()
        out = [b"".join(map(memo.__getitem__, chunks)) for chunks in split]
        self.held += ENTRY * len(new) + sum(map(len, new)) + sum(len(memo[c]) for c in new)
        if self.held > (MEMO_BYTES if self.most is None else self.most):
            self.forget()
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(2)
def chunk_ids(path: str) -> ChunkIds:
    """One for all tasks of a worker."""
    return ChunkIds(path)


def batch_ids(encoder: ChunkIds, texts: pa.Array, end: int, block: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The first row and the ids, with ``end``, of blocks of rows."""
    raw, offsets = utf8(texts)
    texts, tail = strings(texts), np.array([end], "<u4").tobytes()
    for a, b in row_blocks(offsets, block):
        words, own = texts.slice(a, b - a).to_pylist(), raw[offsets[a] : offsets[b]]
        if ((own >= 0x1C) & (own <= 0x1F)).any():  # str.split() takes these for white space, the pattern does not
            odd = [any("\x1c" <= c <= "\x1f" for c in t) for t in words]
            ids = encoder.texts(["" if o else t for t, o in zip(words, odd)])
            ids = [encoder.whole(t) if o else i for t, o, i in zip(words, odd, ids)]
        else:
            ids = encoder.texts(words)
        yield a, [i + tail for i in ids]


# ---------------------------------------------------------------- packing


@dataclass(slots=True)
class Piece:
    doc_id: int | None
    start: int
    length: int
    doc_tokens: int
    ids: bytes  # of this piece

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, n, self.doc_tokens, self.ids[: 4 * n]),
            Piece(self.doc_id, self.start + n, self.length - n, self.doc_tokens, self.ids[4 * n :]),
        )


class Shelf:
    """Fragments by length; takes out the largest that fits."""

    def __init__(self) -> None:
        self.keys: list[tuple[int, int]] = []
        self.pieces: dict[tuple[int, int], Piece] = {}
        self.n = 0

    def add(self, piece: Piece) -> None:
        self.n += 1
        insort(self.keys, key := (piece.length, -self.n))
        self.pieces[key] = piece

    def take(self, most: int) -> Piece | None:
        at = bisect_right(self.keys, (most, 1))
        return self.pieces.pop(self.keys.pop(at - 1)) if at else None


class TierPacker:
    """Packs one partition; every call yields (tier, pieces) of whole sequences."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.waiting: list[Piece] = []

    def block(self, docs: list[Piece]) -> Iterator[tuple[int, list[Piece]]]:
        top = self.tiers[0]
        shelves = {t: Shelf() for t in self.tiers}
        fragments, self.waiting = self.waiting, []
        for piece in docs:
            while piece.length >= top:
                whole, piece = piece.cut(top)
                yield top, [whole]
            if piece.length:
                fragments.append(piece)
        for piece in fragments:
            shelves[self.route(piece.length)].add(piece)
        for k, tier in enumerate(self.tiers):
            fill = self.tiers[k + 1 :] or (tier,)  # the shortest tier fills its own gaps
            while (first := shelves[tier].take(tier)) is not None:
                window, gap = [first], tier - first.length
                for shorter in fill:
                    while gap and (piece := shelves[shorter].take(gap)) is not None:
                        window.append(piece)
                        gap -= piece.length
                if gap:
                    piece = next((p for s in fill if (p := shelves[s].take(s)) is not None), None)
                    if piece is None:
                        self.waiting += window
                        continue
                    piece, rest = piece.cut(gap)
                    window.append(piece)
                    shelves[self.route(rest.length)].add(rest)
                yield tier, window

    def route(self, length: int) -> int:
        return min(t for t in self.tiers if t >= length)

    def end(self) -> Iterator[tuple[int, list[Piece]]]:
        """The waiting fragments as full windows, then as powers of two."""
        left, self.waiting = self.waiting[::-1], []
        total = sum(p.length for p in left)
        while total:
            size = min(self.tiers[0], 1 << (total.bit_length() - 1))
            window, gap = [], size
            while gap:
                piece = left.pop()
                if piece.length > gap:
                    piece, rest = piece.cut(gap)
                    left.append(rest)
                window.append(piece)
                gap -= piece.length
            total -= size
            yield size, window


class Numbering:
    """Sequence and step-group numbers, unique over partitions; a step group has full sequences of one tier."""

    def __init__(self, partition: int, step_tokens: int) -> None:
        self.base = partition << 33
        self.sequences = self.groups = 0
        self.open: dict[int, tuple[int, int]] = {}
        self.step = step_tokens

    def next(self, tier: int) -> tuple[int, int]:
        group, tokens = self.open.get(tier, (-1, self.step))
        if tokens + tier > self.step:
            group, tokens, self.groups = self.groups, 0, self.groups + 1
        self.open[tier] = group, tokens + tier
        self.sequences += 1
        return self.base + self.sequences - 1, self.base + group


COLUMNS = "start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"


def _packed(df: DataFrame, path: str, end: int, id_col: str, text_col: str, tiers: tuple[int, ...], step_tokens: int, extra: str, of: Callable[[bytes], object], memo: int | None) -> DataFrame:
    name, kind = extra.split()
    kinds = {"long": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = chunk_ids(path), TierPacker(tiers)
        encoder.most = memo
        numbers = Numbering(TaskContext.get().partitionId(), step_tokens)

        def rows(windows: Iterator[tuple[int, list[Piece]]]) -> Iterator[pa.RecordBatch]:
            cols: list[list] = [[] for _ in range(9)]
            for tier, window in windows:
                sequence, group = numbers.next(tier)
                offset = 0
                for p in window:
                    for c, v in zip(cols, (p.doc_id, p.start, p.length, p.doc_tokens, sequence, offset, tier, group, of(p.ids))):
                        c.append(v)
                    offset += p.length
            names = ["id", *(c.split()[0] for c in COLUMNS.split(", ")), name]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols[:8]] + [pa.array(cols[8], kinds[kind])], names)

        for batch in batches:
            keys = batch.column("id").to_pylist()
            for at, ids in batch_ids(encoder, batch.column("text"), end):
                docs = [Piece(k, 0, len(i) // 4, len(i) // 4, i) for k, i in zip(keys[at:], ids)]
                yield from rows(packer.block(docs))
        yield from rows(packer.end())
        if memo is not None:
            encoder.forget()

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run, chunk_ids), f"id long, {COLUMNS}, {extra}").withColumnRenamed("id", id_col)


def pack(df: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, memo: int | None = None) -> DataFrame:
    """A row per piece, with its ids as little-endian unsigned 32-bit integers in ``ids``.

    ``memo`` bounds the bytes that a worker remembers, in place of ``MEMO_BYTES``, and then they go with the task."""
    return _packed(df, path, end, id_col, text_col, tiers, step_tokens, "ids binary", bytes, memo)


def pack_digests(df: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, memo: int | None = None) -> DataFrame:
    """As ``pack``, with the crc32 of each piece's ids in place of them."""
    return _packed(df, path, end, id_col, text_col, tiers, step_tokens, "ids_crc32 long", zlib.crc32, memo)
