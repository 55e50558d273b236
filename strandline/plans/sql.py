"""Building blocks of the SQL counterparts that queries are compared with (DuckDB)."""

from __future__ import annotations

import re

from strandline.sources.star import RELATIONS, relation_sql


def hop(name: str, frontier: str, edges: str, reverse: bool = False, temporal: bool = True) -> str:
    """A hop as a common table expression (pid, v, other and, if temporal, ts, amount, seq)."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    if not temporal:
        return f"{name} AS (SELECT f.pid, f.v, e.{there} AS other FROM {frontier} f JOIN {edges} e ON e.{here} = f.v)"
    return f"""{name} AS (
  SELECT f.pid, f.v, e.{there} AS other, e.ts, e.amount, e.seq
  FROM {frontier} f JOIN {edges} e ON e.{here} = f.v JOIN params p ON p.pid = f.pid
  WHERE e.ts BETWEEN p.t0 AND p.t1
  QUALIFY p.lim = 0 OR row_number() OVER (
    PARTITION BY f.pid, f.v ORDER BY CASE WHEN p.latest_first THEN -e.ts ELSE e.ts END, e.{there}, e.amount, e.seq) <= p.lim)"""


def fresh(name: str, hops: str, seen: list[str]) -> str:
    """The distinct targets of hops that are in none of the earlier frontiers."""
    return f"{name} AS (SELECT DISTINCT pid, other AS v FROM {hops} EXCEPT ({' UNION ALL '.join(f'SELECT pid, v FROM {s}' for s in seen)}))"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    literal = lambda x: str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


def query(params: str, ctes: list[str], select: str, recursive: bool = False) -> str:
    """WITH params, the relations that are named, the given expressions, and the final SELECT."""
    text = " ".join([*ctes, select])
    used = [r for r in RELATIONS if re.search(rf"\b(FROM|JOIN) {r}\b", text)]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*([params] if params else []), *map(relation_sql, used), *ctes]) + "\n" + select
