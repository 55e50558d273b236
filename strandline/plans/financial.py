"""The twelve financial reads, each one plan over all parameter rows.

``params`` has pid and what the read needs of: start vertices a and b, thresholds amount1 and amount2,
the closed window t0..t1, lim (0: no truncation) and latest_first. An unknown start gives no row,
except for reads that always report one row per pid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import is_blocked, ratio
from strandline.operators.traverse import bounded_bfs, hop, shortest_distance
from strandline.sources.shared import materialise

Graph = dict[str, DataFrame]


def _start(params: DataFrame, column: str = "a") -> DataFrame:
    return params.select("pid", F.col(column).alias("v"))


def _per_pid(params: DataFrame, *parts: DataFrame) -> DataFrame:
    out = params.select("pid")
    for p in parts:
        out = out.join(p, "pid", "left")
    return out


def _money(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def blocked_sign_ins(g: Graph, params: DataFrame) -> DataFrame:
    """Accounts within three transfers and the blocked media that signed in to them; seen targets count again."""
    hops, _ = bounded_bfs(_start(params), [g["transfer"]], params, 3)
    targets = hops.select("pid", F.col("other").alias("v")).distinct()
    blocked = g["medium"].where(is_blocked("is_blocked")).select(F.col("medium").alias("other"))
    found = hop(targets, g["signin"], params, reverse=True).join(blocked, "other", "left_semi")
    return found.select("pid", F.col("v").alias("account"), F.col("other").alias("medium")).distinct()


def loans_behind(g: Graph, params: DataFrame) -> DataFrame:
    """Sums over the distinct loans deposited into accounts that paid a person's accounts."""
    accounts = hop(_start(params), g["own"]).select("pid", F.col("other").alias("v")).distinct()
    payers = hop(accounts, g["transfer"], params, reverse=True).select("pid", F.col("other").alias("v")).distinct()
    loans = hop(payers, g["deposit"], params, reverse=True).select("pid", F.col("other").alias("loan")).distinct()
    sums = loans.join(g["loan"], "loan").groupBy("pid").agg(F.count("*").alias("loans"), _money("loan_amount").alias("sum_amount"), _money("balance").alias("sum_balance"))
    return sums


def transfer_distance(g: Graph, params: DataFrame) -> DataFrame:
    """The length of a shortest transfer path from a to b, -1 without one."""
    return shortest_distance(params.select("pid", "a", "b"), g["transfer"], params)


def transfer_cycles(g: Graph, params: DataFrame) -> DataFrame:
    """Where a paid b: the m with b -> m and m -> a."""
    first = hop(_start(params), g["transfer"], params).join(params.select("pid", "b"), "pid").where("other = b").select("pid").distinct()
    ends = params.select("pid", "a", "b").join(first, "pid")
    out = hop(ends.select("pid", F.col("b").alias("v")), g["transfer"], params).select("pid", F.col("other").alias("m"))
    back = hop(ends.select("pid", F.col("a").alias("v")), g["transfer"], params, reverse=True).select("pid", F.col("other").alias("m"))
    return out.join(back, ["pid", "m"], "left_semi").join(ends, "pid").where("m <> a and m <> b").select("pid", "m").distinct()


def timed_reach(g: Graph, params: DataFrame) -> DataFrame:
    """Accounts on paths of up to three transfers with non-decreasing times, from a person's accounts.

    Per vertex and depth the earliest arrival is kept, which decides every continuation."""
    state = hop(_start(params), g["own"]).select("pid", F.col("other").alias("v")).distinct().withColumn("last", F.lit(-(1 << 62)).cast("long"))
    reached = []
    for _ in range(3):
        out = hop(state, g["transfer"], params).join(state, ["pid", "v"]).where("ts >= last")
        state = materialise(out.groupBy("pid", F.col("other").alias("v")).agg(F.min("ts").alias("last")))
        reached.append(state.select("pid", F.col("v").alias("account")))
    return reached[0].union(reached[1]).union(reached[2]).distinct()


def gathering_accounts(g: Graph, params: DataFrame) -> DataFrame:
    """Sources of large withdrawals into a that gathered enough from two accounts or more."""
    mids = hop(_start(params), g["withdraw"], params, reverse=True).join(params.select("pid", "amount1", "amount2"), "pid").where("amount >= amount2")
    mids = mids.select("pid", F.col("other").alias("v")).distinct()
    sums = hop(mids, g["transfer"], params, reverse=True).groupBy("pid", "v").agg(F.countDistinct("other").alias("sources"), F.sum("amount").alias("total"))
    return sums.join(params.select("pid", "amount1"), "pid").where("sources >= 2 and total >= amount1").select("pid", F.col("v").alias("account"))


def transfer_summary(g: Graph, params: DataFrame) -> DataFrame:
    """Sums and distinct partners of transfers of amount1 or more, in and out, and their ratio."""

    def side(reverse: bool, name: str) -> DataFrame:
        big = hop(_start(params), g["transfer"], params, reverse).join(params.select("pid", "amount1"), "pid").where("amount >= amount1")
        return big.groupBy("pid").agg(F.sum("amount").alias(f"sum_{name}"), F.countDistinct("other").alias(f"n_{name}"))

    out = _per_pid(params, side(True, "in"), side(False, "out"))
    sums = [F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("sum_in", "sum_out")]
    out = out.select("pid", *sums, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_in", "n_out")))
    return out.withColumn("ratio", ratio("sum_in", "sum_out"))


def loan_flow(g: Graph, params: DataFrame) -> DataFrame:
    """Accounts within three transfers or withdrawals of amount1 or more from those a loan was paid into."""
    seeds = hop(_start(params), g["deposit"], params).select("pid", F.col("other").alias("v")).distinct()
    with_limit = params.withColumn("least", F.col("amount1"))
    frontier = seen = seeds
    reached = None
    for _ in range(3):
        both = hop(frontier, g["transfer"], params).unionByName(hop(frontier, g["withdraw"], params))
        big = materialise(both.join(with_limit.select("pid", "least"), "pid").where("amount >= least").select("pid", F.col("other").alias("v")).distinct())
        reached = big if reached is None else reached.union(big)
        frontier = big.join(seen, ["pid", "v"], "left_anti")
        seen = seen.union(frontier)
    return reached.distinct().select("pid", F.col("v").alias("account"))


def loan_balance(g: Graph, params: DataFrame) -> DataFrame:
    """Loan money into an account against large transfers and withdrawals and all repayments out of it."""
    start, limit = _start(params), params.select("pid", "amount1")
    total = lambda df, name: df.groupBy("pid").agg(F.sum("amount").alias(name))
    big = lambda df: df.join(limit, "pid").where("amount >= amount1")
    parts = [
        total(hop(start, g["deposit"], params, reverse=True), "loan_in"),
        total(big(hop(start, g["transfer"], params)), "transferred"),
        total(big(hop(start, g["withdraw"], params)), "withdrawn"),
        total(hop(start, g["repay"], params), "repaid"),
    ]
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = _per_pid(params, *parts).select("pid", zero("loan_in").cast("double").alias("loan_in"), (zero("transferred") + zero("withdrawn") + zero("repaid")).cast("double").alias("total_out"))
    return out.withColumn("ratio", ratio("total_out", "loan_in"))


def investor_similarity(g: Graph, params: DataFrame) -> DataFrame:
    """Jaccard similarity of what a and b invest in, 0 if neither does."""
    one = hop(_start(params, "a"), g["invest"]).select("pid", "other").distinct().withColumn("first", F.lit(1))
    two = hop(_start(params, "b"), g["invest"]).select("pid", "other").distinct().withColumn("second", F.lit(1))
    both = one.join(two, ["pid", "other"], "full").groupBy("pid").agg(F.count(F.col("first") + F.col("second")).alias("common"), F.count("*").alias("either"))
    out = _per_pid(params, both)
    return out.select("pid", F.when(F.coalesce("either", F.lit(0)) == 0, 0.0).otherwise(F.col("common").cast("double") / F.col("either")).alias("similarity"))


def guaranteed_loans(g: Graph, params: DataFrame) -> DataFrame:
    """Loans applied for by a person and those in its guarantee chain of up to three steps."""
    _, chain = bounded_bfs(_start(params), [g["guarantee"]], None, 3)
    return hop(chain.select("pid", "v"), g["apply"]).select("pid", F.col("other").alias("loan")).distinct()


def company_payments(g: Graph, params: DataFrame) -> DataFrame:
    """What a person's accounts paid to each account that a company owns."""
    accounts = hop(_start(params), g["own"]).select("pid", F.col("other").alias("v")).distinct()
    paid = hop(accounts, g["transfer"], params).join(g["company_own"].select(F.col("dst").alias("other")), "other", "left_semi")
    return paid.groupBy("pid", F.col("other").alias("account")).agg(_money("amount").alias("total"))


READS = {
    "fq01": (blocked_sign_ins, ("transfer", "signin", "medium")),
    "fq02": (loans_behind, ("own", "transfer", "deposit", "loan")),
    "fq03": (transfer_distance, ("transfer",)),
    "fq04": (transfer_cycles, ("transfer",)),
    "fq05": (timed_reach, ("own", "transfer")),
    "fq06": (gathering_accounts, ("withdraw", "transfer")),
    "fq07": (transfer_summary, ("transfer",)),
    "fq08": (loan_flow, ("deposit", "transfer", "withdraw")),
    "fq09": (loan_balance, ("deposit", "transfer", "withdraw", "repay")),
    "fq10": (investor_similarity, ("invest",)),
    "fq11": (guaranteed_loans, ("guarantee", "apply")),
    "fq12": (company_payments, ("own", "transfer", "company_own")),
}
