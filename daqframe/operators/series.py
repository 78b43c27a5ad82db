"""Ordered, stateful operators on lanes: delta, zigzag, XOR, counters, gaps.

A lane is a group of rows in an order; both are named by the caller, as nothing in a DataFrame has an order of its own. With width a lane is
dealt out by stretches of its first order column, see daqframe.operators.lanes. Values are 64-bit longs, in which lanes of up to 64 bits wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from daqframe.operators.lanes import unused, with_breaks, with_folds, with_previous

HALF = (1 << 32) - 1


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def bit_mask(bits: int) -> int:
    """n ones as a 64-bit signed number; -1 for 64."""
    return -1 if bits == 64 else (1 << bits) - 1


def sign_extend(value: Column, bits: int) -> Column:
    """The two's-complement number in the low bits."""
    if bits == 64:
        return value
    half = long(1 << (bits - 1))
    return value.bitwiseAND(long(bit_mask(bits))).bitwiseXOR(half) - half


def low_half(value: Column) -> Column:
    return value.bitwiseAND(long(HALF))


def high_half(value: Column) -> Column:
    return F.shiftrightunsigned(value, 32)


def halves(low: Column, high: Column, bits: int) -> Column:
    """low + 2^32 * high modulo 2^bits, of sums that needn't fit 32 bits; shifts wrap where additions would raise."""
    return F.shiftleft(low_half(high + F.shiftright(low, 32)), 32).bitwiseOR(low_half(low)).bitwiseAND(long(bit_mask(bits)))


def difference(value: Column, previous: Column, bits: int) -> Column:
    """value less previous modulo 2^bits, up to 64 of them."""
    return halves(low_half(value) - low_half(previous), high_half(value) - high_half(previous), bits)


def delta_encode(frame: DataFrame, value: str, partition: list[str], order: list[str], bits: int, into: str, width: int | None = None) -> DataFrame:
    """frame with current less previous modulo 2^bits; the first against zero."""
    previous = unused(frame, "_previous")
    seen = with_previous(frame, value, partition, order, previous, width)
    made = difference(F.col(value), F.coalesce(F.col(previous), long(0)), bits)
    return seen.withColumn(into, made).drop(previous)


def delta_decode(frame: DataFrame, delta: str, partition: list[str], order: list[str], bits: int, into: str, width: int | None = None) -> DataFrame:
    """frame with the running sum modulo 2^bits. Halves of 32 bits are added up apart, so no width overflows."""
    low, high = unused(frame, "_low"), unused(frame, "_high")

    def carry(totals: DataFrame, before: WindowSpec) -> DataFrame:
        wide = F.col(high).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(low).cast("decimal(20,0)")
        total = F.pmod(F.sum(wide.cast("decimal(31,0)")).over(before), F.lit(str(1 << 64)).cast("decimal(20,0)"))
        split = totals.withColumn("_total", total)
        base = F.lit(1 << 32).cast("decimal(10,0)")
        least = F.pmod("_total", base)
        return split.withColumn(low, least.cast("long")).withColumn(high, ((F.col("_total") - least) / base).cast("long")).where("_total is not null")

    folds = {low: (low_half(F.col(delta)), F.sum), high: (high_half(F.col(delta)), F.sum)}
    return with_folds(frame, folds, partition, order, width, carry=carry).withColumn(into, halves(F.col(low), F.col(high), bits)).drop(low, high)


def zigzag(delta: Column, bits: int) -> Column:
    """0, -1, 1, -2 of so many bits to 0, 1, 2, 3."""
    signed = sign_extend(delta, bits)
    return F.shiftleft(signed, 1).bitwiseXOR(F.shiftright(signed, 63)).bitwiseAND(long(bit_mask(bits)))


def unzigzag(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-value.bitwiseAND(long(1))).bitwiseAND(long(bit_mask(bits)))


def xor_encode(frame: DataFrame, value: str, partition: list[str], order: list[str], into: str, width: int | None = None) -> DataFrame:
    """frame with each value XOR the one before; the first as it is."""
    previous = unused(frame, "_previous")
    seen = with_previous(frame, value, partition, order, previous, width)
    return seen.withColumn(into, F.col(value).bitwiseXOR(F.coalesce(F.col(previous), long(0)))).drop(previous)


def xor_decode(frame: DataFrame, value: str, partition: list[str], order: list[str], into: str, width: int | None = None) -> DataFrame:
    """frame with the running XOR."""
    return with_folds(frame, {into: (F.col(value), F.bit_xor)}, partition, order, width)


def unwrap(frame: DataFrame, counter: str, partition: list[str], order: list[str], bits: int, into: str, width: int | None = None) -> DataFrame:
    """frame with the wrapping counter continued: each fall adds 2^bits from there on."""
    falls = unused(frame, "_falls")
    seen = with_breaks(frame, counter, lambda before, now: now < before, partition, order, falls, width)
    return seen.withColumn(into, F.col(counter) + F.col(falls) * long(1 << bits)).drop(falls)


def sequence_gaps(frame: DataFrame, sequence: str, partition: list[str], width: int | None = None) -> DataFrame:
    """Rows whose sequence number isn't one more than the one before, with ``previous`` and ``missing`` (in place of columns of these names)."""
    seen = with_previous(frame, sequence, partition, [sequence], "previous", width)
    return seen.where(F.col(sequence) - F.col("previous") != 1).withColumn("missing", F.col(sequence) - F.col("previous") - 1)


def not_increasing(frame: DataFrame, value: str, partition: list[str], order: list[str], width: int | None = None) -> DataFrame:
    """Rows whose value isn't above the one before, with ``previous``: none where items are in order."""
    seen = with_previous(frame, value, partition, order, "previous", width)
    return seen.where(F.col(value) <= F.col("previous"))


def record_offsets(frame: DataFrame, size: str, partition: list[str], order: list[str], first: int = 64, width: int | None = None) -> DataFrame:
    """frame with record_offset: where each record starts, from the stored sizes of those before."""
    before = unused(frame, "_before")
    seen = with_folds(frame, {before: (F.col(size), F.sum)}, partition, order, width, current=False)
    return seen.withColumn("record_offset", long(first) + F.coalesce(F.col(before), long(0))).drop(before)
