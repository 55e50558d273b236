"""URL filters over a sorted array of 64-bit digests.

Every rule ``host/path-prefix`` has the key xxhash64 of that string. The sorted keys, the rules'
actions and their full strings lie in files that the executors map into memory (shipped once per
node by Spark's file server, shared by its Python workers through the page cache). For each url all
keys that could fit are made (its host and every parent domain, with the path cut to each prefix
length that occurs among the rules), probed with one vectorised binary search per combination, and
a found key counts only if the stored full string equals the probed one. The longest rule wins; a
url that no rule fits gets the default verdict.

Defined results: a null url or one without ``://`` has empty host and path and fits no rule; an
empty table gives an empty result; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the contract, as (action, host and path prefix).
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
ACTIONS = ("allow", "block")


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z folded and path, as the contract cuts them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    ends = min((i for i in (path.find("?"), path.find("#")) if i >= 0), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:ends]


class DigestArray:
    """Sorted keys with, in the same order, the action and the bounds of the stored string."""

    def __init__(self, folder: str, name: str) -> None:
        load = lambda part: np.load(os.path.join(folder, f"{name}-{part}.npy"), mmap_mode="r")
        self.keys, self.actions, self.bounds, self.text = (load(x) for x in ("keys", "actions", "bounds", "text"))
        self.lengths = [int(x) for x in load("lengths")]
        self.longest_host = int(load("hosts").max(initial=0))

    def stored(self, i: int) -> str:
        return self.text[self.bounds[i] : self.bounds[i + 1]].tobytes().decode()

    def probe(self, probes: list[str]) -> list[int]:
        """The place of each probed string, or -1; equal keys of different strings are told apart."""
        wanted = np.fromiter((xxhash.xxh64_intdigest(p.encode()) for p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, wanted)
        near = np.minimum(at, max(len(self.keys) - 1, 0))
        out = np.full(len(probes), -1, np.int64)
        for i in np.flatnonzero(self.keys[near] == wanted) if len(self.keys) else ():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == wanted[i]:
                if self.stored(k) == probes[i]:
                    out[i] = k
                    break
                k += 1
        return out.tolist()


def write_digests(rules: list[tuple[str, str]], folder: str) -> str:
    """Write the array's files and return the name they start with. Of equal rules the last counts."""
    unique = dict((rule, ACTIONS.index(action)) for action, rule in rules)
    rows = sorted((xxhash.xxh64_intdigest(r.encode()), r, a) for r, a in unique.items())
    raw = [r.encode() for _, r, _ in rows]
    parts = {
        "keys": np.array([k for k, _, _ in rows], np.uint64),
        "actions": np.array([a for _, _, a in rows], np.uint8),
        "bounds": np.cumsum([0, *map(len, raw)]).astype(np.int64),
        "text": np.frombuffer(b"".join(raw), np.uint8),
        "hosts": np.array([len(r.partition("/")[0]) for r in unique], np.int64),
        "lengths": np.array(sorted({len(r) - r.index("/") if "/" in r else 0 for r in unique}), np.int64),
    }
    name = "rules-" + hashlib.sha256(repr(rows).encode()).hexdigest()[:16]
    for part, values in parts.items():
        np.save(os.path.join(folder, f"{name}-{part}.npy"), values)
    return name


def suffixes(host: str, most: int) -> list[str]:
    """The host and its parent domains, of ``most`` characters at most: no rule's host is longer."""
    out = [host] if len(host) <= most else []
    at = host.find(".", max(0, len(host) - most - 1))
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def judge(urls: list[str | None], array: DigestArray, default: str) -> list[tuple[str, str, str | None, str]]:
    """(host, path, rule, verdict) of every url."""
    split = [split_url(u) for u in urls]
    owner: list[int] = []
    probes: list[str] = []
    for i, (host, path) in enumerate(split):
        if not host:
            continue
        hosts = suffixes(host, array.longest_host)
        for n in array.lengths:
            if n <= len(path):
                owner += [i] * len(hosts)
                probes += [h + path[:n] for h in hosts]
    best: dict[int, int] = {}
    for i, p, k in zip(owner, probes, array.probe(probes)):
        if k >= 0 and (i not in best or len(p) > len(array.stored(best[i]))):
            best[i] = k
    return [(h, p, array.stored(best[i]) if i in best else None, ACTIONS[array.actions[best[i]]] if i in best else default) for i, (h, p) in enumerate(split)]


def url_filter(spark: SparkSession, df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] | None = None, default: str = "allow") -> DataFrame:
    """One row per row of ``df``: id, host, path, the longest rule that fits (or null), verdict."""
    folder = tempfile.mkdtemp(prefix="strandline-rules-")
    name = write_digests(RULES if rules is None else rules, folder)
    for part in sorted(os.listdir(folder)):
        if part not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
            spark.sparkContext.addFile(os.path.join(folder, part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.getRootDirectory(), name)
        for batch in batches:
            rows = judge(batch.column("url").to_pylist(), array, default)
            host, path, rule, verdict = zip(*rows) if rows else ((),) * 4
            yield pa.record_batch([batch.column("id"), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))], ["id", "host", "path", "rule", "verdict"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")).mapInArrow(run, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
