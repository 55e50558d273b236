"""Secret scans over a block-local inverted index of trigrams.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
hold. Each block of documents gets an inverted index (trigram -> postings, as sorted row numbers)
of the trigrams that any query names; the postings are intersected and united as the query says,
and only the remaining candidates are searched with the regular expression. A rule from which no
mandatory trigram follows scans every row. The index is on text with A-Z folded to a-z, so one
query serves either case.

Blocks are built where the rows are, so there is no shuffle, memory is bounded by one block, and a
lost executor costs only the repetition of its tasks.

Defined results: null or empty text has no span; rows, also repeated ones and ones with null ids,
give one row each in the result; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import row_blocks, strings, trimmed, utf8

Query = tuple  # ("all",), ("tri", int), ("and", queries) or ("or", queries)

ALL: Query = ("all",)
MAX_EXACT = 16  # alternatives that are carried as whole strings before they become a query
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


@dataclass(frozen=True)
class Rule:
    """``group`` is the span's part that must have ``least`` code points; a shorter match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    regex: re.Pattern = field(init=False, compare=False)
    query: Query = field(init=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "regex", re.compile(self.pattern, re.ASCII))
        object.__setattr__(self, "query", trigram_query(self.pattern))

    def __reduce__(self):
        return Rule, (self.kind, self.pattern, self.group, self.least, self.base)


# ---------------------------------------------------------------- queries from expressions


def _and(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(map(_freeze, (p for p in parts if p != ALL))))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(map(_freeze, parts)))
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _freeze(q: Query) -> Query:
    return (q[0], tuple(q[1])) if q[0] in ("and", "or") else q


def _of_string(text: str) -> Query:
    raw = text.encode()
    return _and([("tri", raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) for i in range(len(raw) - 2)])


def _of_set(exact: set[str]) -> Query:
    return _or([_of_string(x) for x in exact])


def _chars(items) -> set[str] | None:
    """The folded characters of a class, None if they are many or open."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower() if arg < 128 else chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 2 * MAX_EXACT:
            out |= {chr(c).lower() if c < 128 else chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MAX_EXACT else None


def _walk(parsed) -> tuple[set[str] | None, Query]:
    """All strings that the expression can match (None: unknown), and a query that each match meets.

    ``run`` has every text that the parts since the last unknown one can have made."""
    run, whole, found = {""}, True, []
    for op, arg in parsed:
        mine: set[str] | None = None
        query = ALL
        if op is sre.LITERAL:
            mine = {chr(arg).lower() if arg < 128 else chr(arg)}
        elif op is sre.IN:
            mine = _chars(arg)
        elif op is sre.AT:
            mine = {""}
        elif op is sre.SUBPATTERN:
            mine, query = _walk(arg[3])
        elif op is sre.BRANCH:
            branches = [_walk(b) for b in arg[1]]
            if all(e is not None for e, _ in branches):
                mine = set().union(*(e for e, _ in branches))
            query = _or([q if e is None else _of_set(e) for e, q in branches])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg
            e, q = _walk(inner)
            if high == 1 and e is not None:
                mine, query = (e | {""} if low == 0 else e), (q if low else ALL)
            elif low and e is not None and len(e) == 1:  # a literal, at least ``low`` times
                query = _of_string(next(iter(e)) * min(low, 8))
            elif low:
                query = q if e is None else _of_set(e)
        joined = {a + b for a in run for b in mine} if mine is not None else set()
        if mine is not None and len(joined) <= MAX_EXACT:
            run = joined
        else:
            found += [_of_set(run), query]
            run, whole = (mine or {""}), False
    found.append(_of_set(run))
    return (run if whole else None), _and(found)


def trigram_query(pattern: str) -> Query:
    """A query that the folded text of every match meets; ``ALL`` if no trigram is mandatory."""
    return _walk(_parser.parse(pattern))[1]


def trigrams_of(q: Query) -> set[int]:
    return {q[1]} if q[0] == "tri" else set().union(*map(trigrams_of, q[1])) if q != ALL else set()


# ---------------------------------------------------------------- the index


class TrigramIndex:
    """Postings of the wanted trigrams over one block of rows."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, slot: np.ndarray) -> None:
        self.rows = len(offsets) - 1
        self.wanted = wanted
        self.postings: dict[int, np.ndarray] = {}
        if len(raw) < 3:
            return
        low = FOLD[raw].astype(np.uint32)
        hit = slot[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(hit)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 2 < offsets[row + 1]
        key = np.unique(hit[at[inside]].astype(np.int64) * self.rows + row[inside])
        which, row = key // self.rows, key % self.rows
        cuts = np.searchsorted(which, np.arange(1, len(wanted) + 2))
        self.postings = {int(t): row[cuts[i] : cuts[i + 1]] for i, t in enumerate(wanted)}

    def rows_for(self, q: Query) -> np.ndarray:
        if q == ALL:
            return np.arange(self.rows)
        if q[0] == "tri":
            return self.postings.get(q[1], np.zeros(0, np.int64))
        parts = [self.rows_for(x) for x in q[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
        return out


def slots(rules: list[Rule]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams that any rule names, and a table from trigram to 1 + its place among them."""
    wanted = np.array(sorted(set().union(*(trigrams_of(r.query) for r in rules))), np.int64)
    slot = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
    slot[wanted] = np.arange(1, len(wanted) + 1)
    return wanted, slot


# ---------------------------------------------------------------- the operator

#: The patterns of the base rules, then those that this method adds.
BASE_RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # runs are maximal, so a shorter one holds no match
]
MORE_RULES = [
    # up to the END line; where that is missing, with header lines and base64 lines, of which only the last may be short
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
        r"|(?:[ \t]*(?:\r?\n|\\n)[ \t]*[A-Za-z][A-Za-z-]*:[ ][^\r\n\\]*)*+"
        r"(?:(?:[ \t]*(?:\r?\n|\\n))++[ \t]*[A-Za-z0-9+/]{16,}+=*+(?=[ \t]*(?:[\r\n\\\"']|\Z)))++"
        r"(?:[ \t]*(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/]++=*+(?=[ \t]*(?:[\r\n\\\"']|\Z)))?|)",
    ),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
RULES = BASE_RULES + MORE_RULES

Span = tuple[int, int, int]  # start, the rule's place in the list, end


def spans_of_batch(texts: pa.Array, rules: list[Rule], tables: tuple[np.ndarray, np.ndarray], block: int = 1 << 20) -> list[list[Span]]:
    """The spans of every row, in code points, by start and then by rule."""
    raw, offsets = utf8(texts)
    out: list[list[Span]] = [[] for _ in range(len(texts))]
    for a, b in row_blocks(offsets, block):
        index = TrigramIndex(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], *tables)
        words = strings(texts.slice(a, b - a)).to_pylist()
        for k, rule in enumerate(rules):
            for i in index.rows_for(rule.query):
                for m in rule.regex.finditer(words[i]):
                    if len(m[rule.group]) >= rule.least:
                        out[a + i].append((m.start(), k, m.end()))
    for found in out:
        found.sort()
    return out


def written(found: list[Span], rules: list[Rule]) -> str:
    return ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in found)


def redacted(text: str, found: list[Span], rules: list[Rule]) -> str:
    """The text with every span replaced by its kind; overlapping spans are replaced as one."""
    out, at = [], 0
    for start, k, end in found:
        if start >= at:
            out += [text[at:start], f"[{rules[k].kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _over(df: DataFrame, f: Callable[[pa.RecordBatch, list[list[Span]]], pa.RecordBatch], text: str, rules: list[Rule], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = slots(rules)
        for batch in batches:
            yield f(batch, spans_of_batch(batch.column(text), rules, tables))

    return df.mapInArrow(trimmed(run), schema)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``df``: the id, the spans of every rule and the redacted text."""
    rules = rules or RULES

    def rows(batch: pa.RecordBatch, found: list[list[Span]]) -> pa.RecordBatch:
        texts = strings(batch.column("text")).to_pylist()
        spans = [[{"kind": rules[k].kind, "base": rules[k].base, "start": s, "end": e} for s, k, e in x] for x in found]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch([batch.column("id"), pa.array(spans, kind), pa.array([redacted(t, x, rules) if x else t for t, x in zip(texts, found)], pa.string())], ["id", "spans", "redacted"])

    return _over(
        df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, "text", rules,
        "id long, spans array<struct<kind string, base boolean, start long, end long>>, redacted string",
    ).withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's row per document: counts and digest of the base spans, and all spans as text."""
    rules = RULES
    base = {k: r.kind for k, r in enumerate(rules) if r.base}

    def rows(batch: pa.RecordBatch, found: list[list[Span]]) -> pa.RecordBatch:
        mine = [[x for x in one if x[1] in base] for one in found]
        counts = [pa.array([sum(x[1] == k for x in one) for one in mine], pa.int64()) for k in base]
        sha = [hashlib.sha256(written(one, rules).encode()).hexdigest() for one in mine]
        return pa.record_batch([batch.column("id"), *counts, pa.array(sha, pa.string()), pa.array([written(x, rules) for x in found], pa.string())], ["id", *(f"n_{x}" for x in base.values()), "base_sha256", "spans"])

    return _over(
        df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, "text", rules,
        "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    ).withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and ``n_chars`` set to the new length where that changed it.

    All rows and columns stay, in their order; null text stays null."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = slots(RULES)
        for batch in batches:
            found = spans_of_batch(batch.column("text"), RULES, tables)
            at = batch.schema.names.index("text")
            texts = batch.column(at).to_pylist()
            new = [redacted(t, x, RULES) if x else t for t, x in zip(texts, found)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if "n_chars" in batch.schema.names:
                at = batch.schema.names.index("n_chars")
                kept = batch.column(at).to_pylist()
                kept = [len(t) if x else c for t, x, c in zip(new, found, kept)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(kept, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(trimmed(run), fields)
