"""The financial reads in SQL, over the parameter rows of the catalogue."""

from __future__ import annotations

from strandline.plans.sql import fresh, hop, query, values

COLUMNS = ["pid", "a", "b", "amount1", "amount2", "t0", "t1", "lim", "latest_first"]
#: Windows: 1996-1998, 1995-2001 and 1997-1999.
PARAMS = [
    (1, 1, 17, 20000, 50000, 820454400000, 915148800000, 0, False),
    (2, 5, 33, 50000, 30000, 788918400000, 1009843200000, 5, True),
    (3, 42, 7, 10000, 10000, 852076800000, 946684800000, 3, False),
    (4, 9, 9, 0, 0, 788918400000, 1009843200000, 0, False),
    (5, 3, 60, 1000, 1000, 788918400000, 1009843200000, 0, False),
    (6, -5, 3, 1000, 1000, 788918400000, 1009843200000, 0, False),
]
#: Pairs with direct payments, for the cycles.
CYCLE_PARAMS = [(k, a, b, 0, 0, 788918400000, 1009843200000, lim, False) for k, (a, b, lim) in enumerate([(1, 17, 0), (5, 33, 0), (9, 4, 0), (3, 60, 0), (42, 7, 0), (2, 2, 0), (8, 5, 40)])]

START = "s0 AS (SELECT pid, CAST(a AS BIGINT) AS v FROM params)"


def _q(ctes: list[str], select: str, recursive: bool = False, params: list[tuple] = PARAMS) -> str:
    return query(values("params", COLUMNS, params), ctes, select, recursive)


def _levels(edges: list[str], temporal: bool = True, limit: bool = False) -> list[str]:
    """Three levels h1..h3 over new vertices s1..s3."""
    out = [START] if not limit else []
    for k in (1, 2, 3):
        parts = []
        for e in edges:
            out.append(hop(f"h{k}_{e}", f"s{k - 1}", e, temporal=temporal))
            parts.append(f"SELECT h.pid, h.v, h.other FROM h{k}_{e} h" + (" JOIN params p ON p.pid = h.pid WHERE h.amount >= p.amount1" if limit else ""))
        out.append(f"h{k} AS ({' UNION ALL '.join(parts)})")
        out.append(fresh(f"s{k}", f"h{k}", [f"s{i}" for i in range(k)]))
    return out


ACCOUNTS = [START, hop("owned", "s0", "own", temporal=False), "mine AS (SELECT DISTINCT pid, other AS v FROM owned)"]

SQL = {
    "fq01": _q(
        [*_levels(["transfer"]), "targets AS (SELECT DISTINCT pid, other AS v FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3))", hop("signed", "targets", "signin", reverse=True)],
        "SELECT DISTINCT pid, v AS account, other AS medium FROM signed WHERE other IN (SELECT medium FROM medium WHERE is_blocked IN ('true', 'TRUE', 'True', '1'))",
    ),
    "fq02": _q(
        [*ACCOUNTS, hop("paid", "mine", "transfer", reverse=True), "payers AS (SELECT DISTINCT pid, other AS v FROM paid)", hop("lent", "payers", "deposit", reverse=True), "loans AS (SELECT DISTINCT pid, other FROM lent)"],
        "SELECT pid, count(*) AS loans, CAST(sum(loan_amount) AS DOUBLE) AS sum_amount, CAST(sum(balance) AS DOUBLE) AS sum_balance FROM loans JOIN loan ON loan = other GROUP BY pid",
    ),
    "fq03": _q(
        [
            "every AS (SELECT pid, v FROM params, (SELECT DISTINCT src AS v FROM transfer))",
            hop("moves", "every", "transfer"),
            "links AS (SELECT DISTINCT pid, v, other FROM moves)",
            "reach(pid, v, d) AS (SELECT pid, a, 0 FROM params UNION SELECT r.pid, l.other, r.d + 1 FROM reach r JOIN links l ON l.pid = r.pid AND l.v = r.v WHERE r.d < 12)",
        ],
        "SELECT p.pid, coalesce(CAST(min(r.d) AS INTEGER), -1) AS distance FROM params p LEFT JOIN reach r ON r.pid = p.pid AND r.v = p.b GROUP BY p.pid",
        recursive=True,
    ),
    "fq04": _q(
        [
            START,
            hop("first", "s0", "transfer"),
            "ends AS (SELECT pid, a, b FROM params WHERE EXISTS (SELECT 1 FROM first f WHERE f.pid = params.pid AND f.other = params.b))",
            "from_b AS (SELECT pid, b AS v FROM ends)",
            "from_a AS (SELECT pid, a AS v FROM ends)",
            hop("onward", "from_b", "transfer"),
            hop("back", "from_a", "transfer", reverse=True),
        ],
        "SELECT DISTINCT o.pid, o.other AS m FROM onward o JOIN back k ON k.pid = o.pid AND k.other = o.other JOIN ends e ON e.pid = o.pid WHERE o.other <> e.a AND o.other <> e.b",
        params=CYCLE_PARAMS,
    ),
    "fq05": _q(
        [
            *ACCOUNTS,
            *(
                part
                for k in (1, 2, 3)
                for part in (
                    hop(f"m{k}", "mine" if k == 1 else f"t{k - 1}", "transfer"),
                    f"t{k} AS (SELECT m.pid, m.other AS v, min(m.ts) AS last FROM m{k} m" + (f" JOIN t{k - 1} t ON t.pid = m.pid AND t.v = m.v WHERE m.ts >= t.last" if k > 1 else "") + " GROUP BY m.pid, m.other)",
                )
            ),
        ],
        "SELECT pid, v AS account FROM t1 UNION SELECT pid, v FROM t2 UNION SELECT pid, v FROM t3",
    ),
    "fq06": _q(
        [START, hop("out", "s0", "withdraw", reverse=True), "mids AS (SELECT DISTINCT o.pid, o.other AS v FROM out o JOIN params p ON p.pid = o.pid WHERE o.amount >= p.amount2)", hop("gathered", "mids", "transfer", reverse=True)],
        "SELECT g.pid, g.v AS account FROM gathered g JOIN params p ON p.pid = g.pid GROUP BY g.pid, g.v HAVING count(DISTINCT g.other) >= 2 AND sum(g.amount) >= max(p.amount1)",
    ),
    "fq07": _q(
        [
            START,
            hop("income", "s0", "transfer", reverse=True),
            hop("outgo", "s0", "transfer"),
            *(f"{n} AS (SELECT h.pid, sum(h.amount) AS total, count(DISTINCT h.other) AS n FROM {h} h JOIN params p ON p.pid = h.pid WHERE h.amount >= p.amount1 GROUP BY h.pid)" for n, h in (("i", "income"), ("o", "outgo"))),
        ],
        """SELECT params.pid, CAST(coalesce(i.total, 0) AS DOUBLE) AS sum_in, CAST(coalesce(o.total, 0) AS DOUBLE) AS sum_out, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out,
  CASE WHEN coalesce(o.total, 0) = 0 THEN 0.0::DOUBLE ELSE CAST(coalesce(i.total, 0) AS DOUBLE) / CAST(o.total AS DOUBLE) END AS ratio
FROM params LEFT JOIN i ON i.pid = params.pid LEFT JOIN o ON o.pid = params.pid""",
    ),
    "fq08": _q(
        ["loan_start AS (SELECT pid, a AS v FROM params)", hop("seeded", "loan_start", "deposit"), "s0 AS (SELECT DISTINCT pid, other AS v FROM seeded)", *_levels(["transfer", "withdraw"], limit=True)],
        "SELECT DISTINCT pid, other AS account FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)",
    ),
    "fq09": _q(
        [
            START,
            hop("lent", "s0", "deposit", reverse=True),
            hop("moved", "s0", "transfer"),
            hop("drawn", "s0", "withdraw"),
            hop("repaid", "s0", "repay"),
            "o AS (SELECT m.pid, m.amount FROM moved m JOIN params p ON p.pid = m.pid WHERE m.amount >= p.amount1 UNION ALL SELECT d.pid, d.amount FROM drawn d JOIN params p ON p.pid = d.pid WHERE d.amount >= p.amount1 UNION ALL SELECT pid, amount FROM repaid)",
            "sums AS (SELECT pid, CAST(coalesce((SELECT sum(amount) FROM lent l WHERE l.pid = params.pid), 0) AS DOUBLE) AS loan_in, CAST(coalesce((SELECT sum(amount) FROM o WHERE o.pid = params.pid), 0) AS DOUBLE) AS total_out FROM params)",
        ],
        "SELECT pid, loan_in, total_out, CASE WHEN loan_in = 0 THEN 0.0::DOUBLE ELSE total_out / loan_in END AS ratio FROM sums",
    ),
    "fq10": _q(
        ["x AS (SELECT DISTINCT pid, dst FROM params JOIN invest ON src = a)", "y AS (SELECT DISTINCT pid, dst FROM params JOIN invest ON src = b)", "n AS (SELECT pid, (SELECT count(*) FROM x JOIN y ON x.pid = y.pid AND x.dst = y.dst WHERE x.pid = params.pid) AS common, (SELECT count(*) FROM (SELECT dst FROM x WHERE x.pid = params.pid UNION SELECT dst FROM y WHERE y.pid = params.pid)) AS either FROM params)"],
        "SELECT pid, CASE WHEN either = 0 THEN 0.0::DOUBLE ELSE CAST(common AS DOUBLE) / either END AS similarity FROM n",
    ),
    "fq11": _q(
        [*_levels(["guarantee"], temporal=False)],
        "SELECT DISTINCT c.pid, dst AS loan FROM (SELECT * FROM s0 UNION SELECT * FROM s1 UNION SELECT * FROM s2 UNION SELECT * FROM s3) c JOIN apply ON src = c.v",
    ),
    "fq12": _q(
        [*ACCOUNTS, hop("paid", "mine", "transfer")],
        "SELECT pid, other AS account, CAST(sum(amount) AS DOUBLE) AS total FROM paid WHERE other IN (SELECT dst FROM company_own) GROUP BY pid, other",
    ),
}
