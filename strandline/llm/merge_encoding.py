"""Exact encoding and decoding for merge-type sentencepiece models, by backtracking.

A sequence of tokens is what merging gives exactly if each token, and each adjacent pair, is what
merging its own text gives. So a text is read from the left: an Aho-Corasick automaton names the
tokens that begin at each position, the longest is tried first, it must be compatible with the token
before it (found by re-merging the pair's text, remembered in a bounded memo), and where no token
goes on, the position is marked in a bitfield of failed ones and the last token is taken back. Each
position fails at most once, so the work is linear in the text. A character outside of the
vocabulary takes part in no merge; it stands for its bytes.

Text is cut before each run of spaces where the vocabulary has no entry with a space after another
character (else not at all), and the results of recent chunks are kept in a memo of bounded bytes. Rows are
encoded where they are read: no shuffle, memory bounded by a block of rows or one document.

Defined results: null and empty text encode to the begin and end ids alone and decode to the empty
string; repeated rows and null ids give a row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import row_blocks, strings, trimmed, utf8

MARK = "▁"
MEMO_BYTES = 100 << 20  # of remembered chunks, about, in one worker
ENTRY = 220  # bytes of an entry besides its characters
PAIRS = 400_000  # remembered pairs of tokens, of about 100 bytes each
CLOSING = ".,;:!?*#$%&|"
RUN = re.compile(r" +[^ ]*")
INFINITE = float("inf")


class MergeCodec:
    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)  # for its vocabulary only
        n = sp.get_piece_size()
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.id_of = {self.pieces[i]: i for i in plain}
        self.stable = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.longest = max(map(len, self.id_of))
        self.letters = {p for p in self.id_of if len(p) == 1}
        self.silent = {self.begin, self.end}
        self.special = self.silent | set(self.bytes_of)
        self.pairs: dict[int, bool] = {}
        self.steps: dict[int, tuple[bool, list[tuple[float, str, str]]]] = {}
        self.memo: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.held = 0
        self.changed: dict[str, str] = {}  # the chunks whose ids decode to something else
        self.inside = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}  # neighbours within an entry

    # ------------------------------------------------------------ merging, for pairs of tokens

    def _steps(self, token: int) -> tuple[bool, list[tuple[float, str, str]]]:
        """Whether merging the token's text gives the token; each merge's score and what then stands first and last.

        The best score is merged first, the leftmost of equals."""
        if (known := self.steps.get(token)) is None:
            part, steps = list(self.pieces[token]), []
            while True:
                best = max(((s, -i) for i in range(len(part) - 1) if (s := self.score.get(part[i] + part[i + 1])) is not None), default=None)
                if best is None:
                    break
                i = -best[1]
                part[i : i + 2] = [part[i] + part[i + 1]]
                steps.append((best[0], part[0], part[-1]))
            known = self.steps[token] = len(part) == 1, steps
        return known

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging the text of the pair gives the pair: its merges are done again, each side's in its own
        order and the better side first, until one across the boundary is better than both sides' next."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        (_, left), (ok, right) = self._steps(a), self._steps(b)
        x, y = self.pieces[a][-1], self.pieces[b][0]
        i = j = 0
        while ok:
            of_a = left[i][0] if i < len(left) else -INFINITE
            of_b = right[j][0] if j < len(right) else -INFINITE
            across = self.score.get(x + y, -INFINITE)
            if across > of_a and across >= of_b and across > -INFINITE:
                ok = False
            elif of_a == of_b == -INFINITE:
                break
            elif of_a >= of_b:
                x, i = left[i][2], i + 1
            else:
                y, j = right[j][1], j + 1
        self.pairs[a << 20 | b] = ok
        return ok

    # ------------------------------------------------------------ encoding

    def _stretch(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        n, most = len(text), self.longest
        longest, id_of, pairs, fit = self.automaton.longest_prefix, self.id_of, self.pairs, self._fit
        failed: bytearray | None = None
        out: list[int] = []
        sizes: list[int] = []
        at, size = 0, longest(text[:most])
        while at < n:
            before = out[-1] if out else -1
            while size:
                token = id_of.get(text[at : at + size])
                if token is not None and (failed is None or not failed[at + size >> 3] >> (at + size & 7) & 1):
                    if before < 0:
                        ok = self._steps(token)[0]
                    elif (ok := pairs.get(before << 20 | token)) is None:
                        ok = fit(before, token)
                    if ok:
                        break
                size -= 1
            if size:
                out.append(token)
                sizes.append(size)
                at += size
                size = longest(text[at : at + most])
            else:
                failed = failed or bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("the vocabulary lacks single characters of its pieces")
                out.pop()
                at -= (size := sizes.pop())
                size -= 1
        return out

    def _chunk(self, text: str) -> list[int]:
        """Ids of a text with marks for spaces; characters outside of the vocabulary as bytes."""
        if self.letters.issuperset(text):
            return self._stretch(text) if text else []
        out: list[int] = []
        at = 0
        for i, c in enumerate(text):
            if c not in self.letters:
                out += self._stretch(text[at:i]) if i > at else []
                out += [self.byte_ids[b] for b in c.encode()]
                at = i + 1
        return out + (self._stretch(text[at:]) if at < len(text) else [])

    def chunks(self, text: str) -> list[str]:
        """The text, with the space that is put in front, cut before each run of spaces; a single space is left out."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if not self.stable:
            return [text] if text else []
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [run[1:] for run in RUN.findall(f" {text}")]
        return text.split(" ") if text else []

    def ids(self, chunks: list[list[str]]) -> list[bytes]:
        """Ids, without begin and end, as little-endian unsigned 32-bit integers."""
        if self.held > MEMO_BYTES:  # the last call's chunks were needed until now, for decoding
            self.memo.clear()
            self.tails.clear()
            self.changed.clear()
            self.held = 0
        memo, changed = self.memo, self.changed
        new = set(chain.from_iterable(chunks)).difference(memo)
        self.held += 2 * (ENTRY * len(new) + 5 * sum(map(len, new)))  # stems are remembered too
        for c in new:
            memo[c] = ids = self._known(c)
            if self.decode(np.frombuffer(ids, "<u4").tolist()) != c:
                changed[c] = self.decode(np.frombuffer(ids, "<u4").tolist())
        return [b"".join(map(memo.__getitem__, cs)) for cs in chunks]

    def _known(self, chunk: str) -> bytes:
        """Ids of a chunk with the space in front; closing punctuation is cut off where no entry reaches across."""
        stem = chunk.rstrip(CLOSING)
        if stem != chunk and stem and stem[-1] != " " and stem[-1] + chunk[len(stem)] not in self.inside:
            if (ids := self.memo.get(stem)) is None:
                ids = self.memo[stem] = pack(self._chunk(MARK + stem.replace(" ", MARK)))
            tail = chunk[len(stem) :]
            if (more := self.tails.get(tail)) is None:
                more = self.tails[tail] = pack(self._chunk(tail))
            return ids + more
        return pack(self._chunk(MARK + (chunk.replace(" ", MARK) if " " in chunk else chunk)))

    # ------------------------------------------------------------ decoding

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces, the one in front left out; runs of byte tokens as UTF-8, broken ones as U+FFFD each."""
        if not self.special.intersection(ids):
            text = "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
            return text[1:] if text[:1] == " " else text
        out: list[str] = []
        held = bytearray()
        for i in [*ids, -1]:
            if i in self.bytes_of:
                held.append(self.bytes_of[i])
                continue
            if held:
                out.append(utf8_text(bytes(held)))
                held.clear()
            if i >= 0 and i not in self.silent:
                out.append(self.pieces[i].replace(MARK, " "))
        text = "".join(out)
        return text[1:] if text[:1] == " " else text

    def decode_chunks(self, chunks: list[str]) -> str:
        """The decoded text of ``ids(chunks)``: runs of byte tokens end with a chunk, as each begins with a mark."""
        text = " ".join(chunks)  # each chunk but the first has a space in front
        if not self.changed or self.changed.keys().isdisjoint(chunks):
            return text
        return " ".join([self.changed.get(c, c) for c in chunks])


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes() if sys.byteorder != "little" else array("I", ids).tobytes()


def utf8_text(raw: bytes) -> str:
    """Valid characters, and U+FFFD for each byte that belongs to none."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(out)


@lru_cache(2)
def codec_of(path: str) -> MergeCodec:
    """One for all tasks of a worker."""
    return MergeCodec(path)


def _encoded(df: DataFrame, path: str, id_col: str, text_col: str, schema: str, of: Callable[[MergeCodec, list[bytes], list[list[str]]], list[list]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        names, types = zip(*(c.split() for c in schema.split(", ")))
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            texts, keys = strings(batch.column("text")), batch.column("id")
            for a, b in row_blocks(offsets, 1 << 21):
                chunks = [codec.chunks(t) for t in texts.slice(a, b - a).to_pylist()]
                begin, end = (np.array([x], "<u4").tobytes() for x in (codec.begin, codec.end))
                ids = [begin + i + end for i in codec.ids(chunks)]
                yield pa.record_batch([keys.slice(a, b - a), *(pa.array(v, kinds[t]) for v, t in zip(of(codec, ids, chunks), types))], ["id", *names])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run, codec_of), f"id long, {schema}").withColumnRenamed("id", id_col)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (with begin and end, little-endian unsigned 32-bit) and the text they decode to."""
    return _encoded(df, path, id_col, text_col, "ids binary, decoded string", lambda codec, ids, chunks: [ids, [codec.decode_chunks(c) for c in chunks]])


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the number of ids, and sha256 of the ids and of the decoded text."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _encoded(
        df, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda codec, ids, chunks: [[len(i) // 4 for i in ids], [sha(i) for i in ids], [sha(codec.decode_chunks(c).encode()) for c in chunks]],
    )
