"""Prefix operations along lanes.

A lane is the rows of some keys in an order. With width, a lane is dealt out by stretches of so many units of its first order column, so a lane of very many
rows is not one task's: a first pass gives each stretch's totals or last row, a row for each lane and stretch, which a window over stretches alone carries on;
the second starts every stretch from what is carried. Without width a lane is one task's, which is right for short lanes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def unused(frame: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stretch_of(ticks: Column, width: int) -> Column:
    """The first tick of the stretch of this width; floors below zero too."""
    return ticks - F.pmod(ticks, F.lit(width).cast("long"))


class Lane:
    """Rows of a frame by lane and stretch, with helper columns under names that the frame doesn't have."""

    def __init__(self, frame: DataFrame, partition: list[str], order: list[str], width: int | None):
        self.keys, self.order, self.width, self.columns = list(partition), list(order), width, frame.columns
        self.stretch, self.carried = unused(frame, "_stretch"), unused(frame, "_carried")
        self.frame = frame.withColumn(self.carried, F.lit(False))
        if width is not None:
            self.frame = self.frame.withColumn(self.stretch, stretch_of(F.col(self.order[0]), width))
        self.part = self.keys + ([self.stretch] if width is not None else [])

    def within(self) -> WindowSpec:
        """Rows of a stretch in order, behind the row that is carried into it."""
        return Window.partitionBy(*self.part).orderBy(F.col(self.carried).desc(), *self.order)

    def across(self) -> WindowSpec:
        """Stretches of a lane in order."""
        return Window.partitionBy(*self.keys).orderBy(self.stretch)

    def with_carried(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        """rows and, for each stretch, the row that is carried into it."""
        return rows.unionByName(carry.withColumn(self.carried, F.lit(True)), allowMissingColumns=True)

    def done(self, rows: DataFrame, into: dict[str, Column]) -> DataFrame:
        """The frame's own rows with new columns, once windows have seen what was carried."""
        names = list(into)
        made = {n: unused(rows, f"_into{i}") for i, n in enumerate(names)}
        for n in names:
            rows = rows.withColumn(made[n], into[n])
        kept = rows.where(~F.col(self.carried)) if self.width is not None else rows
        return kept.select(*(c for c in self.columns if c not in names), *(F.col(made[n]).alias(n) for n in names))


def with_previous(frame: DataFrame, value: Column | str, partition: list[str], order: list[str], into: str, width: int | None = None) -> DataFrame:
    """frame with the value of the row before, null for a lane's first."""
    lane = Lane(frame, partition, order, width)
    own = unused(lane.frame, "_value")
    rows = lane.frame.withColumn(own, F.col(value) if isinstance(value, str) else value)
    if width is not None:
        ends = rows.groupBy(*lane.part).agg(F.max_by(F.struct(own), F.struct(*order)).alias("last"))
        carry = ends.withColumn("before", F.lag("last").over(lane.across())).where("before is not null").select(*lane.part, F.col("before")[own].alias(own))
        rows = lane.with_carried(rows, carry)
    return lane.done(rows, {into: F.lag(own).over(lane.within())})


Fold = Callable[[Column], Column]


def with_folds(frame: DataFrame, folds: dict[str, tuple[Column, Fold]], partition: list[str], order: list[str], width: int | None = None, current: bool = True, carry: Callable[[DataFrame, WindowSpec], DataFrame] | None = None) -> DataFrame:
    """frame with running folds (F.sum, F.bit_xor) of values over a lane, with the current row or without it; null before the first.

    carry makes what a stretch starts from out of the stretches' totals, by default the same fold over those before.
    """
    lane = Lane(frame, partition, order, width)
    rows, own = lane.frame, {}
    for name, (value, _) in folds.items():
        own[name] = unused(rows, "_" + name)
        rows = rows.withColumn(own[name], value)
    if width is not None:
        totals = rows.groupBy(*lane.part).agg(*(fold(F.col(own[n])).alias(own[n]) for n, (_, fold) in folds.items()))
        before = lane.across().rowsBetween(Window.unboundedPreceding, -1)
        if carry is None:
            carried = totals.select(*lane.part, *(fold(F.col(own[n])).over(before).alias(own[n]) for n, (_, fold) in folds.items()))
        else:
            carried = carry(totals.select(*lane.part, *(F.col(own[n]).alias(n) for n in folds)), before).select(*lane.part, *(F.col(n).alias(own[n]) for n in folds))
        rows = lane.with_carried(rows, carried.dropna(subset=list(own.values())))
    over = lane.within().rowsBetween(Window.unboundedPreceding, Window.currentRow if current else -1)
    return lane.done(rows, {n: fold(F.col(own[n])).over(over) for n, (_, fold) in folds.items()})


def with_breaks(frame: DataFrame, value: str, broken: Callable[[Column, Column], Column], partition: list[str], order: list[str], into: str, width: int | None = None) -> DataFrame:
    """frame with the number of breaks of its lane up to each row: broken(previous, current) says where one is."""
    lane = Lane(frame, partition, order, width)
    step = unused(lane.frame, "_break")

    def one(test: Column) -> Column:
        return F.coalesce(test.cast("long"), F.lit(0).cast("long"))

    rows = lane.frame
    if width is None:
        rows = rows.withColumn(step, one(broken(F.lag(value).over(lane.within()), F.col(value))))
    else:
        inside = rows.withColumn(step, one(broken(F.lag(value).over(lane.within()), F.col(value))))
        ends = inside.groupBy(*lane.part).agg(F.sum(step).alias("n"), F.min_by(F.struct(value), F.struct(*order)).alias("first"), F.max_by(F.struct(value), F.struct(*order)).alias("last"))
        ends = ends.withColumn("entered", one(broken(F.lag("last").over(lane.across())[value], F.col("first")[value])))
        before = lane.across().rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("n", F.coalesce(F.sum(F.col("n") + F.col("entered")).over(before), F.lit(0)) + F.col("entered"))
        rows = lane.with_carried(inside, ends.select(*lane.part, F.col("n").alias(step)))
    return lane.done(rows, {into: F.sum(step).over(lane.within().rowsBetween(Window.unboundedPreceding, Window.currentRow))})
