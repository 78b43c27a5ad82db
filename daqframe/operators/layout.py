"""Positions of values in records: layouts, lanes, shuffle blocks, bits, sizes; and the long and wide forms of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interleaved_position(sample: Column, lane: Column, lanes: Column) -> Column:
    return sample * lanes + lane


def planar_position(sample: Column, start_lane: Column, element: Column, elements: Column, samples: Column) -> Column:
    """Channels one after the other; within one, sample by sample."""
    return start_lane * samples + sample * elements + element


def from_interleaved(position: Column, lanes: Column) -> tuple[Column, Column]:
    """(sample, lane) of a position."""
    return F.floor(position / lanes).cast("long"), F.pmod(position, lanes)


def start_lanes(channels: DataFrame, partition: list[str], channel: str, elements: str) -> DataFrame:
    """channels with start_lane: the elements of the channels with smaller ids."""
    before = Window.partitionBy(*partition).orderBy(channel).rowsBetween(Window.unboundedPreceding, -1)
    return channels.withColumn("start_lane", F.coalesce(F.sum(elements).over(before), F.lit(0)).cast("long"))


def shuffle_position(index: Column, byte: Column, count: Column, width: int, block: int = 256) -> Column:
    """Where byte of value index lies after the byte shuffle of count values; the last block is as long as it is."""
    first = index - F.pmod(index, F.lit(block))
    length = F.least(F.lit(block), count - first)
    return first * width + byte * length + (index - first)


def byte_lane(value: Column, byte: int) -> Column:
    return F.shiftrightunsigned(value, 8 * byte).bitwiseAND(F.lit(255).cast("long"))


def dense_bit(sample: Column, bits_before: Column, sample_bits: Column) -> Column:
    """The first bit of a field in an interleaved dense payload."""
    return sample * sample_bits + bits_before


def payload_bytes(samples: Column, sample_bits: Column) -> Column:
    """Bytes of a dense payload."""
    return F.floor((samples * sample_bits + 7) / 8).cast("long")


def aligned_bytes(storage_bits: Column) -> Column:
    return F.floor((storage_bits + 7) / 8).cast("long")


def bit_plane_bytes(values: Column, bits: Column) -> Column:
    """Bytes of bit planes: each plane is padded to whole bytes. For measurements only."""
    return F.floor((values + 7) / 8).cast("long") * bits


def long_form(frame: DataFrame, keys: list[str], channels: dict[str, int], value: str = "value") -> DataFrame:
    """A row for each key and channel: one pass, no shuffle. channels maps columns to channel ids."""
    cells = F.array(*(F.struct(F.lit(i).cast("long").alias("channel_id"), F.lit(name).alias("channel_name"), F.col(name).cast("double").alias(value)) for name, i in channels.items()))
    return frame.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.channel_id", "_cell.channel_name", f"_cell.{value}")


def wide_form(frame: DataFrame, keys: list[str], channel: str, value: str, channels: list[str]) -> DataFrame:
    """A column for each channel, which is named beforehand so that no pass over the data has to find them."""
    return frame.groupBy(*keys).agg(*(F.max(F.when(F.col(channel) == c, F.col(value))).alias(c) for c in channels))


def array_lanes(frame: DataFrame, keys: list[str], array: str, value: str = "value") -> DataFrame:
    """A row for each element of a fixed array."""
    return frame.select(*keys, F.posexplode(array).alias("element", value)).withColumn("element", F.col("element").cast("long"))
