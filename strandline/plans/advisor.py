"""Which properties should share a group: greedy merging by the reads and writes of a workload.

Groups start as single properties. The pair with the largest gain is merged while that is above 0:
gain = reads that use both + pages of writes that touch both - pages that a write of one alone then costs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import ceil

#: Bytes of an edge record and of an update record, bytes of a page.
EDGE_BYTES, UPDATE_BYTES, PAGE = 40, 15, 4096


@dataclass(frozen=True)
class Access:
    """A query or write: the properties it uses, and how often it runs."""

    properties: frozenset[str]
    frequency: int


def gain(a: frozenset[str], b: frozenset[str], reads: list[Access], writes: list[Access], sizes: dict[str, int]) -> int:
    total = lambda group, of, without=frozenset(): sum(x.frequency for x in of if x.properties & group and not x.properties & without)
    both = lambda of: sum(x.frequency for x in of if x.properties & a and x.properties & b)
    size = lambda group: sum(sizes[p] for p in group)
    saved = both(reads) + ceil(both(writes) * EDGE_BYTES / PAGE)
    lost = size(b) * ceil(total(a, writes, b) * UPDATE_BYTES / PAGE) + size(a) * ceil(total(b, writes, a) * UPDATE_BYTES / PAGE)
    return saved - lost


def advise(properties: list[str], reads: list[Access], writes: list[Access], sizes: dict[str, int]) -> list[frozenset[str]]:
    """The groups, ties going to the pair that comes first."""
    groups = [frozenset([p]) for p in properties]
    while len(groups) > 1:
        best = max(combinations(range(len(groups)), 2), key=lambda ij: (gain(groups[ij[0]], groups[ij[1]], reads, writes, sizes), -ij[0], -ij[1]))
        i, j = best
        if gain(groups[i], groups[j], reads, writes, sizes) <= 0:
            break
        groups = [g for k, g in enumerate(groups) if k not in best] + [groups[i] | groups[j]]
    return groups
