"""Token counts by overlap resynchronisation.

A long document is encoded in overlapping chunks. Where the encodings of two neighbours have the
same token over the same bytes of the overlap, the sequence "left chunk up to that token, right
chunk from it on" has only adjacent pairs that occur in one of the two encodings. For merges by
score, a sequence of tokens is the encoding of its text exactly if every adjacent pair is the
encoding of the pair's text, so that token is a proven boundary and the chunks are spliced there. If
an overlap has no such token it is doubled, at worst until the two chunks are one.

Shorter documents are cut before each run of spaces. If no entry of the vocabulary holds a space
after another character (this is checked when the model is loaded), no merge reaches across, so
those boundaries are stable too, and the counts of recent chunks are kept in a memo of bounded bytes. Without
that property such documents are encoded whole. Everything is done where the rows are read: no
shuffle, and memory bounded by a block of rows or one document.

Defined results: null and empty text have 0 bytes and 0 tokens; repeated rows and null ids give a
row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm.common import row_blocks, strings, trimmed, utf8

LONG = 16_384  # characters from which a document is encoded in overlapping chunks
CHUNK = 4_096
OVERLAP = 128
MEMO_BYTES = 40 << 20  # of remembered chunks, about, in one worker
ENTRY = 190  # bytes of an entry besides its characters
MARK = "▁"  # stands for a space
RUN = re.compile(r" +[^ ]*")


class PieceCounter:
    """Counts of a sentencepiece model of the merge type."""

    def __init__(self, path: str, long: int = LONG, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.long, self.chunk, self.overlap = long, chunk, overlap
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        #: In UTF-8 with a mark for each space; a token for a byte has one.
        self.sizes = np.array([1 if sp.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64)
        self.stable = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.memo: dict[str, int] = {"": 1}
        self.held = self.widened = 0

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text), np.int64)

    def spliced(self, text: str) -> np.ndarray:
        """All ids of a text, from overlapping chunks.

        Positions are bytes of the marked text behind the mark that the library puts in front of
        whatever it encodes; ``tail`` ends the encoding of what has been read so far."""
        text = text.replace(" ", MARK)
        mark, n = len(MARK.encode()), len(text)
        at = min(self.chunk, n)
        tail, read = self.ids(text[:at]), mark + len(text[:at].encode())
        ends, done = np.cumsum(self.sizes[tail]), []
        while at < n:
            stop, overlap = min(at + self.chunk, n), self.overlap
            while True:
                if overlap >= at:
                    return self.ids(text)
                start = read - len(text[at - overlap : at].encode())
                right = self.ids(text[at - overlap : stop])
                r_ends = np.cumsum(self.sizes[right]) - mark + start
                if done and ends[0] > start:
                    tail = np.concatenate([*done, tail])
                    ends, done = np.cumsum(self.sizes[tail]), []
                if (same := self._common(tail, ends, right, r_ends, start)) is not None:
                    break
                overlap *= 2
                self.widened += 1
            i, j = same
            tail, ends = np.concatenate([tail[:i], right[j:]]), np.concatenate([ends[:i], r_ends[j:]])
            read, at = read + len(text[at:stop].encode()), stop
            if len(tail) > 4 * self.chunk:
                done.append(tail[: -self.chunk])
                tail, ends = tail[-self.chunk :], ends[-self.chunk :]
        return np.concatenate([*done, tail])

    def _common(self, left: np.ndarray, l_ends: np.ndarray, right: np.ndarray, r_ends: np.ndarray, start: int) -> tuple[int, int] | None:
        """Places of the first token that both have over the same bytes, none before ``start``."""
        first = int(np.searchsorted(l_ends, start, "right"))
        _, a, b = np.intersect1d(l_ends[first:], r_ends, assume_unique=True, return_indices=True)
        a += first
        same = np.flatnonzero((left[a] == right[b]) & (l_ends[a] - self.sizes[left[a]] >= start))
        return (int(a[same[0]]), int(b[same[0]])) if len(same) else None

    def texts(self, texts: list[str]) -> list[int]:
        short = []
        for t in texts:
            if len(t) > self.long or not self.stable:
                short.append([])
                continue
            if MARK in t:
                t = t.replace(MARK, " ")
            if "  " in t or t[:1] == " " or t[-1:] == " ":
                short.append([run[1:] for run in RUN.findall(f" {t}")])
            else:
                short.append(t.split(" ") if t else [])
        memo = self.memo
        new = list(set(chain.from_iterable(short)).difference(memo))
        memo.update(zip(new, map(len, self.library.encode(new, num_threads=1))))
        out = [sum(map(memo.__getitem__, s)) if s or not t else len(self.spliced(t) if len(t) > self.long else self.ids(t)) for s, t in zip(short, texts)]
        self.held += ENTRY * len(new) + sum(map(len, new))
        if self.held > MEMO_BYTES:
            self.memo, self.held = {"": 1}, 0
        return out


class LibraryCounter:
    """Counts of a tokenizers file: whole texts, as its pre-tokenizer's boundaries carry no such proof."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def texts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(2)
def counter_of(path: str) -> PieceCounter | LibraryCounter:
    """One for all tasks of a worker."""
    return PieceCounter(path) if path.endswith(".model") else LibraryCounter(path)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: id, n_bytes, n_tokens and whether these are over ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            texts = strings(batch.column("text"))
            n = [x for a, b in row_blocks(offsets, 1 << 21) for x in counter.texts(texts.slice(a, b - a).to_pylist())]
            yield pa.record_batch([batch.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run, counter_of), "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
