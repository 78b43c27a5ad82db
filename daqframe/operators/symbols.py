"""Value maps, bitfields and scaling of raw values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ["unspecified", "trace", "debug", "info", "warning", "error", "fatal"]


def physical(raw: Column, scale: Column, offset: Column) -> Column:
    """raw * scale + offset in double precision, in this order."""
    return raw.cast("double") * scale + offset


def resolved_scale(numerator: Column, denominator: Column, plain: Column) -> Column:
    """The rational factor where there is one, else the plain one, else 1."""
    return F.coalesce(numerator.cast("double") / denominator.cast("double"), plain, F.lit(1.0))


def channel_name(name: Column, channel: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("channel_"), channel.cast("string")))


def severity_name(severity: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), severity.cast("int") + 1)


def mnemonic(type_id: Column) -> Column:
    """Names of record types, hexadecimal for unknown ones."""
    from daqframe.wire import TYPE_NAMES

    known = F.create_map(*(F.lit(x) for kv in TYPE_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, type_id.cast("int")), F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(type_id)), 4, "0")))


def map_values(frame: DataFrame, raw: str, entries: DataFrame, most: int = 1 << 16) -> DataFrame:
    """frame with value_name, null where the map has no such value.

    entries: (raw, name). Maps are a few entries; up to most of them are broadcast, beyond that the join is shuffled.
    """
    names = entries.select(F.col("raw").alias(raw), F.col("name").alias("value_name"))
    return frame.join(F.broadcast(names) if names.limit(most + 1).count() <= most else names, raw, "left")


def bitfield_values(frame: DataFrame, raw: str, members: list[dict], names: dict[int, dict[int, str]] | None = None) -> DataFrame:
    """A row for each row and member that isn't reserved: member, value and rendering.

    A member is a dict of name, lsb, width and optionally map_id and reserved, as a schema has it: few, so no join is needed. One bit without a map reads
    true or false, others their number, mapped ones the name or the number where the map has none.
    """
    cells = []
    for m in members:
        if m.get("reserved"):
            continue
        value = F.shiftrightunsigned(F.col(raw).cast("long"), m["lsb"]).bitwiseAND(F.lit((1 << m["width"]) - 1).cast("long"))
        mapped = (names or {}).get(m.get("map_id"), {})
        text = value.cast("string")
        if mapped:
            text = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in mapped.items() for x in kv)), value.cast("int")), text)
        elif m["width"] == 1:
            text = F.when(value == 1, "true").otherwise("false")
        cells.append(F.struct(F.lit(m["name"]).alias("member"), value.alias("value"), text.alias("rendering")))
    return frame.select("*", F.explode(F.array(*cells)).alias("_m")).select(*frame.columns, "_m.member", "_m.value", "_m.rendering")
