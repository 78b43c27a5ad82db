"""Integrity: references, uniqueness, counts, overlaps and totals. Each returns the rows that break a rule, none where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dangling(rows: DataFrame, targets: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows whose non-null reference has no target."""
    right = targets.select(*(F.col(t).alias(f"_t{i}") for i, (_, t) in enumerate(keys))).distinct()
    met = [F.col(k) == F.col(f"_t{i}") for i, (k, _) in enumerate(keys)]
    return rows.where(F.greatest(*(F.col(k).isNotNull() for k, _ in keys)) if len(keys) > 1 else F.col(keys[0][0]).isNotNull()).join(right, met, "left_anti")


def known(rows: DataFrame, targets: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    right = targets.select(*(F.col(t).alias(f"_t{i}") for i, (_, t) in enumerate(keys))).distinct()
    return rows.join(right, [F.col(k) == F.col(f"_t{i}") for i, (k, _) in enumerate(keys)], "left_semi")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def not_one_to_one(entries: DataFrame, by: list[str], raw: str, name: str) -> DataFrame:
    """Maps in which a raw value or a name stands twice."""
    counted = entries.groupBy(*by).agg(F.count("*").alias("entries"), F.count_distinct(raw).alias("raws"), F.count_distinct(name).alias("names"))
    return counted.where("entries <> raws or entries <> names")


def overlapping(members: DataFrame, by: list[str], lsb: str, width: str) -> DataFrame:
    """Members that start before an earlier one ends."""
    order = Window.partitionBy(*by).orderBy(lsb, width).rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("taken_to", F.max(F.col(lsb) + F.col(width)).over(order)).where(F.col(lsb) < F.col("taken_to"))


def miscounted(declared: DataFrame, members: DataFrame, key: str, count: str) -> DataFrame:
    """Rows of declared whose count isn't that of their members."""
    found = members.groupBy(key).agg(F.count("*").alias("found"))
    return declared.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0))).where(F.col("found") != F.col(count))


def homogeneous(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by and homogeneous: has each column one value throughout the group?"""
    same: Column = F.lit(True)
    for c in columns:
        same = same & (F.min(c) == F.max(c))
    return rows.groupBy(*by).agg(same.alias("homogeneous"))


def redefined(schemas: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Revisions whose repeated definitions differ."""
    return schemas.groupBy(*keys).agg(F.count_distinct(F.sha2(payload, 256)).alias("definitions")).where("definitions > 1")


def chunk_index(samples: DataFrame, by: list[str], index: str, ticks: str, chunk: int) -> DataFrame:
    """An index entry for each run of chunk sample indexes: first index, count, first and last ticks."""
    block = F.expr(f"`{index}` div {chunk}").alias("chunk")
    return samples.groupBy(*by, block).agg(F.min(index).alias("first_index"), F.count("*").alias("count"), F.min(ticks).alias("first_ticks"), F.max(ticks).alias("last_ticks"))


def end_totals(records: DataFrame, by: list[str], is_data: Column) -> DataFrame:
    """What an end record must state, itself included."""
    return records.groupBy(*by).agg((F.count("*") + 1).alias("total_records"), F.count_if(is_data).alias("data_records"))
