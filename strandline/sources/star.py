"""A financial and a social graph projected from the star-schema tables, one SQL text per relation.

The texts serve both engines, so that a query and its SQL counterpart start from equal rows; what is
compared is what the operators make of them. ``MS(x)`` is milliseconds since 1970 and ``IDIV(a, b)``
whole division. Sign-ins are moved by 26 years into the time range of the transfers.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
SHIFT = 9496 * 86_400_000

FINANCIAL = {
    "transfer": """SELECT o_custkey AS src, l_suppkey AS dst, MS(l_shipdate) AS ts, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
        l_orderkey * 8 + l_linenumber AS seq FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "withdraw": """SELECT o_custkey AS src, l_suppkey AS dst, MS(l_shipdate) AS ts, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
        l_orderkey * 8 + l_linenumber AS seq FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'""",
    "deposit": """SELECT l_orderkey AS src, l_suppkey AS dst, MS(l_shipdate) AS ts, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
        l_orderkey * 8 + l_linenumber AS seq FROM lineitem""",
    "repay": """SELECT o_custkey AS src, o_orderkey AS dst, MS(o_orderdate) AS ts, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
        o_orderkey AS seq FROM orders WHERE o_orderstatus = 'F'""",
    "signin": f"""SELECT user_id AS src, event_id % 100 AS dst, MS(ts) - {SHIFT} AS ts, CAST(value AS DECIMAL(18,2)) AS amount, event_id AS seq FROM events""",
    "medium": "SELECT DISTINCT user_id AS medium, CASE WHEN user_id % 7 = 0 THEN 'true' ELSE 'false' END AS is_blocked FROM events",
    "loan": """SELECT o_orderkey AS loan, CAST(o_totalprice AS DECIMAL(18,2)) AS loan_amount,
        CAST(o_totalprice AS DECIMAL(18,2)) - CAST(o_custkey AS DECIMAL(18,2)) AS balance FROM orders""",
    "own": "SELECT CAST(c_nationkey AS BIGINT) AS src, c_custkey AS dst FROM customer",
    "company_own": "SELECT CAST(s_nationkey AS BIGINT) AS src, s_suppkey AS dst FROM supplier WHERE s_acctbal >= 3000",
    "invest": "SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "guarantee": """SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst FROM lineitem
        JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
        WHERE l_linenumber = 1 AND l_quantity >= 49""",
    "apply": "SELECT CAST(c_nationkey AS BIGINT) AS src, o_orderkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'",
}

SOCIAL = {
    "person": """SELECT c_custkey AS id, c_mktsegment AS first_name, c_name AS last_name,
        CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
        CAST(1 + c_custkey % 12 AS INTEGER) AS birth_month, CAST(1 + c_custkey % 28 AS INTEGER) AS birth_day,
        1000 + c_custkey % 75 AS place FROM customer""",
    "place": """SELECT DISTINCT 1000 + c_custkey % 75 AS id, concat('CITY_', CAST(c_custkey % 75 AS VARCHAR(10))) AS name, 'city' AS type, 100 + c_custkey % 25 AS part_of FROM customer
        UNION ALL SELECT 100 + CAST(n_nationkey AS BIGINT), n_name, 'country', CAST(n_regionkey AS BIGINT) FROM nation
        UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name, 'continent', -1 FROM region""",
    "tag": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS tag_class FROM nation",
    "tag_class": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CAST(r_regionkey AS BIGINT) - 1 AS subclass_of FROM region",
    "knows": "SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey",
    "post": """SELECT o_orderkey AS id, o_custkey AS creator, MS(o_orderdate) AS ts, 100 + o_orderkey % 25 AS place, o_orderkey % 50 AS forum,
        CASE WHEN o_orderstatus = 'P' THEN concat('photo', CAST(o_orderkey AS VARCHAR(20))) ELSE '' END AS image, o_orderpriority AS content FROM orders""",
    "comment": f"""SELECT 10000000 + event_id AS id, user_id AS creator, MS(ts) - {SHIFT} AS ts, 100 + event_id % 25 AS place, event_type AS content,
        CASE WHEN event_id % 3 > 0 OR event_id = 0 THEN event_id % 1500 ELSE -1 END AS reply_of_post,
        CASE WHEN event_id % 3 > 0 OR event_id = 0 THEN -1 ELSE 10000000 + IDIV(event_id, 3) END AS reply_of_comment FROM events""",
    "post_tag": """SELECT o_orderkey AS message, o_custkey % 25 AS tag FROM orders UNION SELECT o_orderkey, o_orderkey % 25 FROM orders""",
    "interest": "SELECT c_custkey AS person, CAST(c_nationkey AS BIGINT) AS tag FROM customer UNION SELECT c_custkey, c_custkey % 25 FROM customer",
    "member": f"SELECT event_id % 50 AS forum, user_id AS person, max(MS(ts) - {SHIFT}) AS joined FROM events GROUP BY event_id % 50, user_id",
    "forum": "SELECT DISTINCT o_orderkey % 50 AS id, concat('Forum ', CAST(o_orderkey % 50 AS VARCHAR(10))) AS title FROM orders",
    "likes": f"""SELECT event_id * 7 % persons AS person, event_id % 1500 AS message, max(MS(ts) - {SHIFT}) AS ts
        FROM events CROSS JOIN (SELECT count(*) AS persons FROM customer) c GROUP BY event_id * 7 % persons, event_id % 1500""",
    "organisation": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'company' ELSE 'university' END AS type, s_name AS name, 100 + CAST(s_nationkey AS BIGINT) AS place FROM supplier",
    "work_at": "SELECT c_custkey AS person, c_custkey % 5 * 2 AS organisation, CAST(1990 + c_custkey % 30 AS INTEGER) AS since FROM customer",
    "study_at": "SELECT c_custkey AS person, c_custkey % 5 * 2 + 1 AS organisation, CAST(1980 + c_custkey % 30 AS INTEGER) AS class_year FROM customer",
}
RELATIONS = FINANCIAL | SOCIAL


def _dialect(sql: str, engine: str) -> str:
    ms, idiv = {"spark": (r"unix_millis(CAST(\1 AS TIMESTAMP))", r"(\1) DIV (\2)"), "duckdb": (r"(epoch_us(\1) // 1000)", r"(\1) // (\2)")}[engine]
    return re.sub(r"IDIV\(([^,()]*), ([^()]*)\)", idiv, re.sub(r"MS\(([^()]*)\)", ms, sql))


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _dialect(RELATIONS[name], "spark")
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


@lru_cache
def relation_sql(name: str) -> str:
    """The relation as a common table expression for DuckDB."""
    return f"{name} AS ({_dialect(RELATIONS[name], 'duckdb')})"
