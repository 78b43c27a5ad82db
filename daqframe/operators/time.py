"""Ticks: the timestamp modes, clocks, correlation between clocks, buckets and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daqframe.operators.lanes import stretch_of, unused, with_breaks

WIDE = "decimal(38,0)"


def floor_divide(product: Column, divisor: Column) -> Column:
    """floor(product / divisor) of whole decimals and a positive divisor, as a long; an error beyond 64 bits."""
    whole = divisor.cast("decimal(20,0)")
    return ((product.cast(WIDE) - F.pmod(product.cast(WIDE), whole)).cast(WIDE) / whole).cast(WIDE).cast("long")


def periodic_time(start: Column, sample: Column, numerator: Column, denominator: Column) -> Column:
    """start + floor(sample * numerator / denominator), exact for 32-bit samples and 64-bit periods; an error where ticks leave 64 bits.

    Integer division of decimals returns a long that wraps silently, so it is guarded before it is made.
    """
    product = sample.cast("decimal(10,0)") * numerator.cast("decimal(20,0)")
    bound = denominator.cast("decimal(20,0)") * F.lit("9223372036854775807").cast("decimal(19,0)")
    fits = product.cast(WIDE) <= bound.cast(WIDE)
    whole = ((product - (product % denominator.cast("decimal(20,0)"))) / denominator.cast("decimal(20,0)")).cast("decimal(38,0)").cast("long")
    return F.when(fits, start + whole).otherwise(F.raise_error(F.lit("timestamp overflow")).cast("long"))


def delta_time(start: Column, delta: Column) -> Column:
    """start + delta; ANSI addition raises on overflow."""
    return start + delta


def seconds(ticks: Column, numerator: Column, denominator: Column) -> Column:
    """Ticks as exact decimal seconds to nine places."""
    return (ticks.cast("decimal(20,0)") * numerator.cast("decimal(9,0)")).cast("decimal(29,0)") / denominator.cast("decimal(9,0)")


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], width: int | None = None) -> DataFrame:
    """Each left row with the values of the latest right row at or before it, by key.

    One union and one window instead of a range join: rows of both sides sorted together, the last right values carried on. Right rows come first at equal
    times; of several right rows at one time one with the largest values is taken. With width a key's rows are dealt out by stretches of so many ticks, and each
    stretch starts from the last right row of those before it, so a key of very many rows is not one task's.
    """
    names = list(left.columns)
    best = right.groupBy(*by, F.col(right_time).alias("_time")).agg(F.max(F.struct(right_time, *values)).alias("_right"))
    kind = best.schema["_right"].dataType
    a = left.select(*by, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*names).alias("_left"), F.lit(None).cast(kind).alias("_right"))
    none = F.lit(None).cast(a.schema["_left"].dataType).alias("_left")
    both = a.unionByName(best.select(*by, "_time", F.lit(0).alias("_side"), none, "_right"))
    part = list(by)
    if width is not None:
        both = both.withColumn("_stretch", bucket(F.col("_time"), width))
        part = [*by, "_stretch"]
        last = both.groupBy(*part).agg(F.max("_right").alias("_last"))  # a row for each key and stretch
        before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.withColumn("_right", F.last("_last", ignorenulls=True).over(before)).where("_right is not null")
        both = both.unionByName(carried.select(*by, F.col("_stretch").alias("_time"), F.lit(-1).alias("_side"), none, "_right", "_stretch"))
    order = Window.partitionBy(*part).orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_right", F.last("_right", ignorenulls=True).over(order)).where("_side = 1")
    return met.select("_left.*", *(F.col("_right")[c].alias(c) for c in [right_time, *values] if c not in names))


def correlated(samples: DataFrame, correlation: DataFrame, by: list[str], ticks: str, source: str, target: str, into: str, width: int | None = None) -> DataFrame:
    """samples with target ticks: linear between the correlation points around them, the slope of one tick a tick before the first and after the last.

    Points of a source tick met twice count once, at the largest target. width deals a key's rows out by stretches of so many ticks, as in as_of: each
    stretch gets the last point before it and the first one behind it.
    """
    names = samples.columns
    points = correlation.groupBy(*by, F.col(source).cast("long").alias("_time")).agg(F.max(target).cast("long").alias("_to"))
    a = samples.select(*by, F.col(ticks).cast("long").alias("_time"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast("struct<_time:bigint,_to:bigint>").alias("_point"))
    none = F.lit(None).cast(a.schema["_row"].dataType).alias("_row")
    both = a.unionByName(points.select(*by, "_time", F.lit(0).alias("_side"), none, F.struct("_time", "_to").alias("_point")))
    part = list(by)
    if width is not None:
        both = both.withColumn("_stretch", bucket(F.col("_time"), width))
        part = [*by, "_stretch"]
        ends = both.groupBy(*part).agg(F.max("_point").alias("_last"), F.min("_point").alias("_first"))  # a row for each key and stretch
        earlier = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        later = Window.partitionBy(*by).orderBy(F.col("_stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*part, F.last("_last", ignorenulls=True).over(earlier).alias("_low"), F.last("_first", ignorenulls=True).over(later).alias("_high"))
        head = ends.where("_low is not null").select(*by, F.col("_stretch").alias("_time"), F.lit(-1).alias("_side"), none, F.col("_low").alias("_point"), "_stretch")
        tail = ends.where("_high is not null").select(*by, (F.col("_stretch") + width - 1).alias("_time"), F.lit(2).alias("_side"), none, F.col("_high").alias("_point"), "_stretch")
        both = both.unionByName(head).unionByName(tail)
    back = Window.partitionBy(*part).orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what follows, seen from the end: a frame that starts at the current row would be scanned anew for every row
    ahead = Window.partitionBy(*part).orderBy(F.col("_time").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = both.withColumn("_low", F.last("_point", ignorenulls=True).over(back)).withColumn("_high", F.last("_point", ignorenulls=True).over(ahead)).where("_side = 1")
    x, low, high = F.col("_time"), F.col("_low"), F.col("_high")
    # differences are longs, so their product has at most 38 digits
    product = (x - low["_time"]).cast("decimal(19,0)") * (high["_to"] - low["_to"]).cast("decimal(19,0)")
    between = low["_to"] + floor_divide(product, high["_time"] - low["_time"])
    value = F.when(low.isNotNull() & high.isNotNull(), between).when(low.isNotNull(), low["_to"] + (x - low["_time"])).when(high.isNotNull(), high["_to"] - (high["_time"] - x))
    return placed.select("_row.*", value.alias(into))


def bucket(ticks: Column, width: int) -> Column:
    """The first tick of the bucket of this width; floors below zero too."""
    return stretch_of(ticks, width)


def sessions(frame: DataFrame, by: list[str], ticks: str, gap: int, width: int | None = None) -> DataFrame:
    """frame with session: rows of a key no more than gap apart share a number from 0. width deals a key's rows out by stretches of so many ticks."""
    return with_breaks(frame, ticks, lambda before, now: now - before > gap, by, [ticks], "session", width)
