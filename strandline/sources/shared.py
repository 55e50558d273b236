"""Tables that iterative plans write between their steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and all runs on one machine (tests), a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strandline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it: a new plan that survives lost executors.

    Unlike a checkpoint it is compressed and read by column. The files stay until the cluster clears
    that folder, as results may still be read from them."""
    spark = df.sparkSession
    return _written(spark, df, f"{shared_dir(spark)}/strandline/{uuid.uuid4().hex}")


#: Spark drops a query's shuffle files at its end, not when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables of one computation; each can be deleted once its last reader has been written itself.

    The shuffle files of a table go as soon as it is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/strandline/{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame) -> DataFrame:
        path, before = f"{self.root}/{uuid.uuid4().hex[:8]}", self.spark.conf.get(CLEAN, "false")
        self.spark.conf.set(CLEAN, "true")
        try:
            self.tables.append((out := _written(self.spark, df, path), path))
        finally:
            self.spark.conf.set(CLEAN, before)
        return out

    def drop(self, *tables: DataFrame) -> None:
        self._delete(lambda df: any(df is t for t in tables))

    def keep_only(self, *tables: DataFrame) -> None:
        self._delete(lambda df: not any(df is t for t in tables))

    def _delete(self, chosen) -> None:
        files = self.spark._jvm.org.apache.hadoop.fs
        for df, path in self.tables:
            if chosen(df):
                at = files.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.tables = [(df, path) for df, path in self.tables if not chosen(df)]


def numbered(df: DataFrame, first: int, name: str = "seq") -> DataFrame:
    """Consecutive numbers in the order of partitions: rows are written once, then only a count per partition meets."""
    kept = materialise(df.withColumn("_m", F.monotonically_increasing_id()))
    counts = kept.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = kept.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(offsets), "_p")
    return out.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(first)).drop("_m", "_p", "_before", "_n")
