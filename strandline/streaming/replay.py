"""Replaying update streams with Structured Streaming, interleaved with queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def due_tasks(done: DataFrame, plan: DataFrame, total: int) -> DataFrame:
    """How many tasks of each query (query, n) are due after ``done`` of ``total`` writes: floor(done * n / total)."""
    return done.join(F.broadcast(plan)).select("done", "query", F.floor(F.col("done") * F.col("n") / total).alias("due"))


def replay(spark: SparkSession, folder: str, schema: T.StructType, apply: Callable[[DataFrame, int], None], checkpoint: str, after: Callable[[int], None] | None = None, files_per_trigger: int = 1) -> StreamingQuery:
    """Start a stream over the Parquet files of ``folder``: each micro-batch is applied as one batch, in the
    order of its event time, then ``after`` runs the queries that are due. Files per trigger bound a batch.

    A batch is repeated under its number after a failure; ``applied_once`` makes the sink ignore that."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)

    def step(batch: DataFrame, number: int) -> None:
        apply(batch, number)
        if after:
            after(number)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def applied_once(path: str, apply: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Applies a batch unless ``path`` has a record of its number; the record is written after it."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = f"{path}/batch={number}"
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
        if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            return
        apply(batch, number)
        spark.createDataFrame([(number,)], "number long").write.mode("overwrite").parquet(log)

    return run


def newest_values(updates: DataFrame) -> DataFrame:
    """A streaming or batch view of the newest value of every (src, dst, property)."""
    return updates.groupBy("src", "dst", "property").agg(F.max_by("value", "commit_seq").alias("value"), F.max("commit_seq").alias("commit_seq"))
