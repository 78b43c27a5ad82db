"""Session helpers: shared checkpoints, table loading and global row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daqframe.session import checkpointed, shared_folder

__all__ = ["checkpointed", "partitions", "ranked", "shared_folder", "small_batches", "table", "written"]


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder; compact, and later reads take only the columns that they need."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of so many rows where the session has Spark's default of 10,000: rows here hold whole texts, and each task has a batch on both sides."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df (narrow rows) with rank, the gapless global row number from 0 in the given order.

    One range sort; the sorted rows are checkpointed, so a second reading has the same partitions. Only a
    row count per partition goes through a second, tiny plan. Rows equal in every order column may swap ranks.
    """
    sorted_rows = checkpointed(df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order))
    place = F.monotonically_increasing_id()
    numbered = sorted_rows.withColumn("_part", F.shiftright(place, 33)).withColumn("_in_part", place.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {int(r[0]): int(r[1]) for r in numbered.groupBy("_part").count().collect()}  # a row for each partition
    first, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, first))
        first += counts[part]
    offset_table = df.sparkSession.createDataFrame(offsets, "_part long, _first long")
    return numbered.join(F.broadcast(offset_table), "_part").withColumn("rank", F.col("_first") + F.col("_in_part")).drop("_part", "_in_part", "_first")
