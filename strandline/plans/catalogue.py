"""All queries of the library over the projected graphs, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.plans import financial, financial_sql, social, social_sql, storage
from strandline.sources.star import relation

Query = Callable[[SparkSession, str], DataFrame]

FINANCIAL_SCHEMA = "pid int, a long, b long, amount1 long, amount2 long, t0 long, t1 long, lim int, latest_first boolean"


def _financial(name: str) -> Query:
    read, relations = financial.READS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = financial_sql.CYCLE_PARAMS if name == "fq04" else financial_sql.PARAMS
        return read({r: relation(spark, sf_dir, r) for r in relations}, spark.createDataFrame(rows, FINANCIAL_SCHEMA))

    run.__name__ = name
    return run


SOCIAL_SCHEMA = "pid int, a long, b long, first_name string, date long, days int, country_x string, country_y string, tag string, month int, year int, tag_class string"


def _social(name: str) -> Query:
    read, relations = social.READS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read({r: relation(spark, sf_dir, r) for r in relations}, spark.createDataFrame(social_sql.PARAMS, SOCIAL_SCHEMA))

    run.__name__ = name
    return run


QUERIES: dict[str, Query] = {name: _financial(name) for name in financial.READS} | {name: _social(name) for name in social.READS} | storage.Q
SQL: dict[str, str] = financial_sql.SQL | social_sql.SQL | storage.SQL
