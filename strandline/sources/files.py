"""Delimited files, chunk tables and their JSON schema catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The stages that chunk rows belong to.
STAGES = ("snapshot_nodes", "snapshot_edges", "remaining_nodes", "remaining_edges", "mixed", "query", "single_reads", "updates")
CHUNK = "stage string, op_code int, schema_id int, row_index long, event_time_ms long, fields array<string>"


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = "|", limit: int | None = None) -> DataFrame:
    """A file with a header; columns are taken by name, missing ones are empty."""
    rows = spark.read.option("sep", sep).option("header", True).option("nullValue", "\u0000").csv(path)
    out = rows.select(*((F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in columns))
    return out if limit is None else out.limit(limit)


def read_stream_lines(spark: SparkSession, path: str, names: list[str], sep: str = "|") -> DataFrame:
    """A file without a header; fields by position, missing ones are empty."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("sep", sep).schema(schema).csv(path).fillna("")


def write_chunks(df: DataFrame, path: str) -> None:
    """Rows of the chunk schema, by stage."""
    df.write.mode("append").partitionBy("stage").parquet(path)


def read_chunks(spark: SparkSession, path: str, stage: str) -> DataFrame:
    if stage not in STAGES:
        raise ValueError(f"no stage {stage}")
    return spark.read.schema(CHUNK).parquet(path).where(F.col("stage") == stage)


def fields_as(df: DataFrame, columns: list[str]) -> DataFrame:
    """The positional fields of chunk rows under their names."""
    return df.select("row_index", "event_time_ms", *(F.coalesce(F.get("fields", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, kind, columns) of a JSON schema catalogue."""
    return spark.read.option("multiLine", True).schema("id int, name string, kind string, columns array<string>").json(path)
