"""What both vector searches share: which rows take part, and dealing rows and queries out in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of rows whose vector is not null, not zero and has only finite components; a null id takes no part."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null and vec is not null")
    return rows.where("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")


def best_of_blocks(found: DataFrame, k: int, best_first: list) -> DataFrame:
    """The k best of all blocks' answers to each query, with their rank."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first, "vec_id")))
    return ranked.where(F.col("rank") <= k)
