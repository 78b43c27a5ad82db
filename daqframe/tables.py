"""Decoded records as rows of fixed Arrow tables."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

from daqframe import wire as w
from daqframe.codec import FIXED, FLOAT, SIGNED, Channel, decode, numeric, sign_extend
from daqframe.schema import CORRELATION, ITEMS, SAMPLES, TEXTS, FileState, Registry, Schema, map_entries, members
from daqframe.wire import Limits, Record

KEY = "path string, sequence long, schema_id long, schema_revision long"
SCHEMAS = {
    "files": "path string, major int, minor int, created_unix_ns long, file_uuid string, first_record_offset long, size long, status string, error string",
    "records": "path string, record_offset long, sequence long, type_id int, type string, flags int, header_size int, record_version int, payload_size long, crc_in_trailer boolean, type_header binary, payload binary, decoded boolean",
    "samples": KEY + ", stream_id long, sample_index decimal(20,0), time_ticks long, channel_id long, channel_name string, element long, logical_type int, raw_bits long, raw decimal(20,0), raw_bytes binary, numeric double, physical double, unit string",
    "text": KEY + ", stream_id long, time_ticks long, severity int, source_id long, event_code int, message string",
    "blobs": KEY + ", stream_id long, item_index decimal(20,0), time_ticks long, decoded_bytes long, transforms array<int>, data binary",
    "objects": KEY + ", kind int, kind_name string, object_id long, name string, tlvs array<struct<tag:int,wire:int,value:binary>>",
    "channels": KEY + ", stream_id long, channel_id long, name string, logical_type int, logical_bits int, storage_bits int, elements long, unit string, scale double, offset double, semantic string, value_map_id long, bitfield_id long",
    "streams": KEY + ", stream_id long, name string, kind int, time_domain int, time_unit_num decimal(20,0), time_unit_den decimal(20,0), layout int, channel_count long, clock_id long, source_clock_id long, target_clock_id long, event_code_map_id long, source_id_map_id long, content_type string",
    "clocks": KEY + ", clock_id long, name string, time_domain int, tick_num decimal(20,0), tick_den decimal(20,0), counter_bits int, reset_scope int, epoch_description string",
    "value_map_entries": KEY + ", map_id long, map_name string, raw decimal(20,0), name string, description string",
    "bitfield_members": KEY + ", bitfield_id long, storage_bits int, lsb int, width int, map_id long, reserved boolean, name string, description string",
    "index_entries": "path string, sequence long, entry int, record_offset long, target_sequence long, stream_id long, first_index decimal(20,0), count long, first_time_ticks long, last_time_ticks long",
    "end_records": "path string, sequence long, total_records long, data_records long, last_index_offset long",
    "notes": "path string, sequence long, message string",
    "errors": "path string, record_offset long, sequence long, status string, reason string, message string",
}
# record types that a table needs payloads of, besides schemas
NEEDED = {
    "samples": {w.DATA}, "wide": {w.DATA}, "text": {w.TEXT}, "blobs": {w.BLOB}, "index_entries": {w.INDEX}, "end_records": {w.END}, "notes": {w.NOTE},
}
SCHEMA_TABLES = {"objects", "channels", "streams", "clocks", "value_map_entries", "bitfield_members"}


ARROW = {
    "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0), "array<int>": pa.list_(pa.int32()),
    "array<struct<tag:int,wire:int,value:binary>>": pa.list_(pa.struct([("tag", pa.int32()), ("wire", pa.int32()), ("value", pa.binary())])),
}


@lru_cache(maxsize=None)
def arrow_schema(table: str) -> pa.Schema:
    """A table's schema without a session, as tasks need it."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (f.split(" ", 1) for f in SCHEMAS[table].split(", "))])


def rows_batch(table: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = arrow_schema(table)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]

    def cell(value, kind):
        return Decimal(value) if pa.types.is_decimal(kind) and value is not None else value

    return pa.RecordBatch.from_arrays([pa.array([cell(v, f.type) for v in c], f.type) for c, f in zip(columns, schema)], schema=schema)


def decimals(words: np.ndarray, signed: np.ndarray | None = None) -> pa.Array:
    """u64 words, or int64 values, as decimal(20,0)."""
    return pa.array(words if signed is None else signed).cast(pa.decimal128(20, 0))


def fixed_bytes(lanes: list[np.ndarray | None], n: int) -> pa.Array:
    """Values of fixed bytes, sample by sample and lane by lane; null for lanes that have none."""
    sizes = np.array([0 if x is None else x.shape[1] for x in lanes])
    offsets = np.zeros(n * len(lanes) + 1, np.int64)
    np.cumsum(np.tile(sizes, n), out=offsets[1:])
    data = np.concatenate([x for x in lanes if x is not None], axis=1)
    there = np.packbits(np.tile(sizes > 0, n), bitorder="little")
    wide = pa.Array.from_buffers(pa.large_binary(), n * len(lanes), [pa.py_buffer(there.tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return wide.cast(pa.binary())


def sample_batches(path: str, record: Record, head: w.DataHeader, schema: Schema, limits: Limits, only: set[int] | None = None, step: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Long rows of one record by sample, channel and element; only limits them to some channels."""
    channels = schema.channels(head.stream_id)
    got = decode(record.payload, head, channels, limits)
    if got is None:
        return
    times, values = got
    kept = [(c, v) for c, v in zip(channels, values) if only is None or c.id in only]
    lanes = [(c, e, v[:, e]) for c, v in kept for e in range(c.elements)]
    if not lanes:
        return
    target = arrow_schema("samples")
    for a in range(0, head.count, step):
        n = min(step, head.count - a)
        rows = n * len(lanes)

        def spread(pick, dtype) -> np.ndarray:
            out = np.empty((n, len(lanes)), dtype)
            for k, (c, e, v) in enumerate(lanes):
                out[:, k] = pick(c, e, v)
            return out.ravel()

        def words(c: Channel, e: int, v: np.ndarray):
            return 0 if c.logical == FIXED else v[a : a + n]

        bits = spread(words, np.uint64)
        signed = spread(lambda c, e, v: sign_extend(v[a : a + n], c.logical_bits) if c.logical == SIGNED else 0, np.int64)
        is_signed, is_fixed, is_float = (spread(lambda c, e, v, k=k: c.logical == k, bool) for k in (SIGNED, FIXED, FLOAT))
        number = spread(lambda c, e, v: np.nan if c.logical == FIXED else numeric(c, v[a : a + n]), np.float64)
        scale, offset = spread(lambda c, e, v: c.scale, np.float64), spread(lambda c, e, v: c.offset, np.float64)
        raw = pa.compute.if_else(pa.array(is_signed), decimals(bits, signed), decimals(bits))
        raw = pa.compute.if_else(pa.array(is_fixed | is_float), pa.nulls(rows, pa.decimal128(20, 0)), raw)
        index = np.repeat(np.arange(head.first_index + a, head.first_index + a + n, dtype=np.uint64), len(lanes))
        fixed = fixed_bytes([v[a : a + n] if c.logical == FIXED else None for c, _, v in lanes], n) if is_fixed.any() else pa.nulls(rows, pa.binary())

        def constant(value, kind):
            return pa.array([value], kind).take(pa.array(np.zeros(rows, np.int64)))

        def of_lane(values, kind):
            return pa.array(values, kind).take(pa.array(np.tile(np.arange(len(lanes)), n)))

        columns = [
            constant(path, pa.string()), constant(record.sequence, pa.int64()), constant(head.schema_id, pa.int64()), constant(head.revision, pa.int64()), constant(head.stream_id, pa.int64()),
            decimals(index), pa.nulls(rows, pa.int64()) if times is None else pa.array(np.repeat(times[a : a + n], len(lanes))),
            of_lane([c.id for c, _, _ in lanes], pa.int64()), of_lane([c.name for c, _, _ in lanes], pa.string()), of_lane([e for _, e, _ in lanes], pa.int64()), of_lane([c.logical for c, _, _ in lanes], pa.int32()),
            pa.array(bits.view(np.int64), mask=is_fixed), raw, fixed, pa.array(number, mask=is_fixed), pa.array(number * scale + offset, mask=is_fixed), of_lane([c.unit for c, _, _ in lanes], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)


def wide_schema(columns: list[tuple[str, str]]) -> str:
    """The schema of table wide: a column for each named channel of one element."""
    return "path string, sequence long, stream_id long, sample_index decimal(20,0), time_ticks long" + "".join(f", `{name}` {kind}" for name, kind in columns)


WIDE_KINDS = {"long": pa.int64(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0), "double": pa.float64()}


def wide_batches(path: str, record: Record, head: w.DataHeader, schema: Schema, limits: Limits, columns: list[tuple[str, str]], step: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """A row for each sample of a record: longs and decimals are raw values, doubles physical ones. Channels that the stream lacks are null; a stream without any gives no rows."""
    channels = schema.channels(head.stream_id)
    by_name = {c.name: i for i, c in enumerate(channels) if c.elements == 1 and c.logical != FIXED}
    if not any(name in by_name for name, _ in columns):
        return
    got = decode(record.payload, head, channels, limits)
    if got is None:
        return
    times, values = got
    for a in range(0, head.count, step):
        n = min(step, head.count - a)
        index = np.arange(head.first_index + a, head.first_index + a + n, dtype=np.uint64)
        cells = [pa.array([path] * n, pa.string()), pa.array(np.full(n, record.sequence)), pa.array(np.full(n, head.stream_id)), decimals(index), pa.nulls(n, pa.int64()) if times is None else pa.array(times[a : a + n])]
        for name, kind in columns:
            target = WIDE_KINDS[kind]
            if name not in by_name:
                cells.append(pa.nulls(n, target))
                continue
            c, words = channels[by_name[name]], values[by_name[name]][a : a + n, 0]
            if pa.types.is_floating(target):
                cells.append(pa.array(numeric(c, words) * c.scale + c.offset))
                continue
            w.require(c.logical != FLOAT, "wide_type", f"{name} holds floats")
            raw = pa.array(sign_extend(words, c.logical_bits)) if c.logical == SIGNED else pa.array(words)
            cells.append(raw.cast(target))  # raises where an unsigned value leaves a long
        yield pa.RecordBatch.from_arrays(cells, names=["path", "sequence", "stream_id", "sample_index", "time_ticks", *(name for name, _ in columns)])


def schema_rows(table: str, path: str, sequence: int, schema: Schema) -> list[tuple]:
    key = (path, sequence, schema.id, schema.revision)
    out = []
    for o in schema.objects:
        if table == "objects":
            out.append((*key, o.kind, w.KIND_NAMES.get(o.kind, str(o.kind)), o.id, o.name, [{"tag": t.tag, "wire": t.wire, "value": t.value} for t in o.tlvs]))
        elif table == "channels" and o.kind == w.CHANNEL:
            c = schema.channel(o)
            out.append((*key, o.get(200), c.id, c.name, c.logical, c.logical_bits, c.storage_bits, c.elements, c.unit, c.scale, c.offset, o.get(208), o.get(209), o.get(210)))
        elif table == "streams" and o.kind == w.STREAM:
            unit = o.get(101) or (None, None)
            out.append((*key, o.id, o.name, o.get(106, SAMPLES), o.get(100), *unit, o.get(103), o.get(104), o.get(105), o.get(108), o.get(109), o.get(110), o.get(111), o.get(107)))
        elif table == "clocks" and o.kind == w.CLOCK:
            out.append((*key, o.id, o.name, o.get(300), *o.get(301), o.get(302, 0), o.get(303, 0), o.get(304)))
        elif table == "value_map_entries" and o.kind == w.VALUE_MAP:
            out += [(*key, o.id, o.name, e.raw, e.name, e.description) for e in map_entries(o)]
        elif table == "bitfield_members" and o.kind == w.BITFIELD:
            out += [(*key, o.id, o.get(500), m.lsb, m.width, m.map_id or None, m.reserved, m.name, m.description) for m in members(o)]
    return out


def parsed(record: Record, registry: Registry, limits: Limits) -> tuple[object, Schema | None, bool]:
    """A record's content and schema, checked against what came before, and whether it can be decoded."""
    if record.type == w.DATA:
        head = w.DataHeader.parse(record, limits)
        ids, _ = w.parse_descriptors(record.payload, head.transforms)
        kind = w.chain_kind(ids)  # illegal chains are errors, whether the schema is known or not
        schema = registry.stream(head.schema_id, head.revision, head.stream_id, (SAMPLES, CORRELATION))
        if schema is not None and schema.stream_kind(head.stream_id) == CORRELATION:
            w.require(head.time_mode == 4, "timestamp_mode")
        return head, schema, schema is not None and kind != "unsupported"
    if record.type == w.TEXT:
        text = w.TextRecord.parse(record, limits)
        schema = registry.stream(text.schema_id, text.revision, text.stream_id, (TEXTS,)) if text.schema_id else None
        return text, schema, True
    if record.type == w.BLOB:
        blob = w.BlobRecord.parse(record, limits)
        schema = registry.stream(blob.schema_id, blob.revision, blob.stream_id, (ITEMS,))
        return blob, schema, blob.data is not None
    if record.type == w.SCHEMA:
        schema = registry.add(record)
        return schema, schema, True
    if record.type == w.INDEX:
        return w.parse_index(record), None, True
    if record.type == w.END:
        return w.parse_end(record), None, True
    if record.type == w.NOTE:
        return w.parse_note(record, limits), None, True
    return None, None, False


def record_batches(table: str, path: str, record: Record, registry: Registry, limits: Limits, only: set[int] | None = None, known: tuple | None = None, columns: list[tuple[str, str]] = ()) -> Iterator[pa.RecordBatch]:
    """The rows that one record adds to a table; known is what parsed has already given, columns those of table wide."""
    content, schema, decoded = known or parsed(record, registry, limits)
    if table == "records":
        yield rows_batch(table, [(path, record.offset, record.sequence, record.type, w.type_name(record.type), record.flags, record.header_size, record.version, record.payload_size, record.trailing, record.header, record.payload, decoded)])
    elif table == "samples" and record.type == w.DATA and decoded:
        yield from sample_batches(path, record, content, schema, limits, only)
    elif table == "wide" and record.type == w.DATA and decoded:
        yield from wide_batches(path, record, content, schema, limits, columns)
    elif table == "text" and record.type == w.TEXT:
        t = content
        yield rows_batch(table, [(path, record.sequence, t.schema_id, t.revision, t.stream_id, t.ticks, t.severity, t.source_id, t.event_code, t.message)])
    elif table == "blobs" and record.type == w.BLOB:
        b = content
        yield rows_batch(table, [(path, record.sequence, b.schema_id, b.revision, b.stream_id, b.item_index, None if b.ticks == w.UNKNOWN_TIME else b.ticks, b.decoded_bytes, b.transforms, b.data)])
    elif table == "index_entries" and record.type == w.INDEX:
        yield rows_batch(table, [(path, record.sequence, i, o, s, st, f, n, a, z) for i, (o, s, st, f, n, a, z) in enumerate(content)])
    elif table == "end_records" and record.type == w.END:
        yield rows_batch(table, [(path, record.sequence, *content)])
    elif table == "notes" and record.type == w.NOTE:
        yield rows_batch(table, [(path, record.sequence, content)])
    elif table in SCHEMA_TABLES and record.type == w.SCHEMA:
        yield rows_batch(table, schema_rows(table, path, record.sequence, content))


def check_order(record: Record, state: FileState, limits: Limits) -> tuple[object, Schema | None, bool]:
    """One record's content, once it and its place among the earlier ones are sound."""
    known = parsed(record, state.registry, limits)
    state.see(record, head=known[0] if record.type == w.DATA else None, blob=known[0] if record.type == w.BLOB else None)
    return known


def file_batches(table: str, path: str, data: bytes, limits: Limits) -> Iterator[pa.RecordBatch]:
    """The rows of a whole file in memory; the first error is raised."""
    import io

    state = FileState(limits)
    for record in w.Walk(io.BytesIO(data), limits):
        yield from record_batches(table, path, record, state.registry, limits, known=check_order(record, state, limits))


def decode_bytes(data: bytes, table: str = "samples", path: str = "memory", limits: Limits = Limits()) -> pa.Table:
    """All rows of a table from a whole file in memory; the first error is raised."""
    return pa.Table.from_batches(file_batches(table, path, data, limits), arrow_schema(table))
