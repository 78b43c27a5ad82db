"""Writing log files: ``df.write.format("daq")`` and ``df.writeStream.format("daq")``.

Option ``table`` says what the rows are:

* ``rows`` (default): one sample a row. Columns become channels, a column ``time_ticks`` the times.
* ``text``: time_ticks, severity, source_id, event_code, message; the middle three may be null or missing.
* ``blobs``: item_index (rising within a task), time_ticks (may be null or missing), data. Options ``contentType``, ``compression`` (zstd, identity).
* ``notes``: message.
* ``records``: type_id (private ones, from 0x8000 on), type_header, payload, as they are.

Rows have the options ``compression`` (identity, zstd, integer, bitwise), ``layout`` (interleaved, planar), ``packing`` (dense, aligned), ``chunk`` (rows to a record),
``channels`` (JSON: what a column's channel is, below), ``time`` (explicit, delta, periodic, none; explicit where there is a time_ticks) and for periodic times ``period``
(a fraction of ticks a sample) and ``start``. All tables have ``stream`` (a name), ``trailer`` (checksums behind the payload), ``timeUnit`` (a fraction of a second a tick),
``timeDomain``, ``clock`` (the id of a clock) and ``objects`` (JSON: clocks, value maps and bitfields, below).

A channel is ``{"type": "unsigned", "bits": 12, "storage": 16, "unit": "V", "scale": [1, 100], "offset": 0.5, "semantic": "...", "value_map": 1, "bitfield": 1, "elements": 3}``;
what isn't said follows from the column: integers are signed, decimals unsigned, binary columns fixed bytes (``bits`` says how many), arrays have ``elements``. Raw values that don't fit
are an error. Where a float column has an integer channel, its values are physical and the nearest raw ones are stored.

Objects are ``{"clocks": {"1": {"name": "pps", "domain": 1, "tick": [1, 1000000], "bits": 32}}, "value_maps": {"1": {"name": "fix", "entries": [[0, "none", "no fix"]]}},
"bitfields": {"1": {"name": "status", "bits": 16, "members": [{"lsb": 0, "width": 1, "name": "failure", "map": 1, "reserved": false}]}}}``.

Each task writes a file. Files lie in a folder of the job's own until the job commits; what overwriting replaces is deleted only then.
"""

from __future__ import annotations

import json
import uuid as uuids
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, StructType

from daqframe import wire as w
from daqframe.codec import BOOLEAN, FIXED, FLOAT, SIGNED, UNSIGNED, Channel, encode, field_bytes
from daqframe.schema import ITEMS, SAMPLES, TEXTS, Schema, pack_map_entry, pack_member
from daqframe.wire import Record, SchemaObject, Tlv

LOGICAL = {"unsigned": UNSIGNED, "signed": SIGNED, "float": FLOAT, "boolean": BOOLEAN, "bytes": FIXED}
COLUMN_KINDS = {"long": (SIGNED, 64), "integer": (SIGNED, 32), "short": (SIGNED, 16), "byte": (SIGNED, 8), "float": (FLOAT, 32), "double": (FLOAT, 64), "boolean": (BOOLEAN, 1), "decimal": (UNSIGNED, 64), "binary": (FIXED, 0)}
TIME_MODES = {"periodic": 1, "delta": 2, "explicit": 3, "none": 4}
U64 = np.uint64


class FileBuilder:
    """Appends records to a file in order and keeps the counts that an index and an end record need."""

    def __init__(self, out, created: int = w.UNKNOWN_TIME, uuid: bytes = bytes(16), trailing: bool = False):
        self.out, self.trailing = out, trailing
        self.sequence = self.data = self.last_index = 0
        self.entries: list[tuple] = []
        header = w.FileHeader(created, uuid).pack()
        out.write(header)
        self.offset = len(header)

    def add(self, record: Record) -> int:
        record.sequence, at = self.sequence, self.offset
        if self.trailing:
            record.flags |= w.CRC_IN_TRAILER
        data = record.pack()
        self.out.write(data)
        self.sequence += 1
        self.offset += len(data)
        self.data += record.type == w.DATA
        return at

    def schema(self, schema_id: int, revision: int, objects: list[SchemaObject]) -> None:
        Schema(schema_id, revision, objects).check()
        header, payload = w.pack_schema(schema_id, revision, objects)
        self.add(Record(w.SCHEMA, 0, 0, header, payload))

    def table(self, head: w.DataHeader, values: list[np.ndarray], channels: list, compression: str, times: np.ndarray | None = None) -> None:
        area = b"" if times is None else times.astype("<i8").tobytes()
        head.time_bytes = len(area)
        ids, payload, head.decoded_bytes = encode(values, area, channels, head.layout, head.packing, compression)
        if ids and len(payload) >= head.decoded_bytes:  # no gain: stored as it is
            ids, payload, head.decoded_bytes = encode(values, area, channels, head.layout, head.packing, "identity")
        head.transforms = len(ids)
        head.check_time()
        at = self.add(Record(w.DATA, 0, 0, head.pack(), payload))
        first = last = w.UNKNOWN_TIME
        if times is not None and len(times):  # the earliest and the latest: samples needn't lie in the order of their times
            start = head.start if head.time_mode == 2 else 0
            first, last = start + int(times.min()), start + int(times.max())
        if head.time_mode == 1 and head.count:
            first, last = head.start, head.start + (head.count - 1) * head.period[0] // head.period[1]
        self.entries.append((at, self.sequence - 1, head.stream_id, head.first_index, head.count, first, last))

    def item(self, item: w.BlobRecord) -> None:
        at = self.add(item.record(0))
        self.entries.append((at, self.sequence - 1, item.stream_id, item.item_index, 1, item.ticks, item.ticks))

    def close(self) -> None:
        """An index of what was written since the last one, and the end record."""
        if self.entries:
            self.last_index = self.add(w.index_record(self.entries, 0))
            self.entries = []
        self.add(w.end_record(self.sequence + 1, self.data, self.last_index, 0))


def ratio(text) -> Fraction:
    return Fraction(*text) if isinstance(text, list) else Fraction(text)


def shared_objects(spec: dict) -> list[SchemaObject]:
    """Clocks, value maps and bitfields of the option objects."""
    out = []
    for i, c in spec.get("clocks", {}).items():
        tlvs = [Tlv.of(1, w.UTF8, c["name"])] if "name" in c else []
        tlvs += [Tlv.of(300, w.U8, c["domain"]), Tlv.of(301, w.RATIONAL_U64, *c["tick"])]
        tlvs += [Tlv.of(tag, kind, c[name]) for name, tag, kind in (("bits", 302, w.U16), ("reset", 303, w.U8), ("epoch", 304, w.UTF8)) if name in c]
        out.append(SchemaObject(w.CLOCK, int(i), tlvs))
    for i, m in spec.get("value_maps", {}).items():
        out.append(SchemaObject(w.VALUE_MAP, int(i), [Tlv.of(1, w.UTF8, m["name"]), *(Tlv.of(400, w.BYTES, pack_map_entry(*e)) for e in m["entries"])]))
    for i, b in spec.get("bitfields", {}).items():
        members = [pack_member(m["lsb"], m["width"], m["name"], m.get("map", 0), m.get("reserved", False), m.get("description", "")) for m in b["members"]]
        out.append(SchemaObject(w.BITFIELD, int(i), [Tlv.of(1, w.UTF8, b["name"]), Tlv.of(500, w.U16, b["bits"]), *(Tlv.of(501, w.BYTES, m) for m in members)]))
    return out


def channel_object(i: int, name: str, kind: DataType, spec: dict) -> SchemaObject:
    """The channel of a column, as its type and the option channels say."""
    elements = spec.get("elements", 1)
    if isinstance(kind, ArrayType):
        kind = kind.elementType
        if "elements" not in spec:
            raise ValueError(f"channel {name} needs elements: how many an array has")
    if kind.typeName() not in COLUMN_KINDS:
        raise ValueError(f"column {name} is neither numbers, booleans nor bytes")
    logical, bits = COLUMN_KINDS[kind.typeName()]
    if "type" in spec:
        logical = LOGICAL[spec["type"]]
    bits = spec.get("bits", bits)
    tlvs = [Tlv.of(1, w.UTF8, name), Tlv.of(200, w.U32, 1), Tlv.of(201, w.U8, logical), Tlv.of(202, w.U16, bits), Tlv.of(203, w.U16, spec.get("storage", bits))]
    tlvs += [Tlv.of(204, w.UTF8, spec["unit"])] if "unit" in spec else []
    for key, plain, exact in (("scale", 205, 211), ("offset", 206, 212)):
        if key in spec:
            value = spec[key]
            tlvs.append(Tlv.of(exact, w.RATIONAL_I64, *value) if isinstance(value, list) else Tlv.of(plain, w.F64, float(value)))
    tlvs += [Tlv.of(207, w.U32, elements)] if elements != 1 else []
    tlvs += [Tlv.of(tag, form, spec[key]) for key, tag, form in (("semantic", 208, w.UTF8), ("value_map", 209, w.U32), ("bitfield", 210, w.U32)) if key in spec]
    return SchemaObject(w.CHANNEL, i, sorted(tlvs, key=lambda t: t.tag))


def unsigned_words(column: pa.Array) -> np.ndarray:
    """A decimal column as 64-bit words; an error where one doesn't fit."""
    wide = np.frombuffer(column.buffers()[1], "<u8").reshape(-1, 2)[column.offset : column.offset + len(column)]
    if (wide[:, 1] != 0).any():
        raise ValueError("a value doesn't fit 64 unsigned bits")
    return wide[:, 0]


def raw_values(column: pa.Array, c: Channel) -> np.ndarray:
    """(rows, elements) raw words of a column, or (rows, elements, bytes)."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        if not pa.compute.all(pa.compute.equal(pa.compute.list_value_length(column), c.elements)).as_py() and len(column):
            raise ValueError(f"channel {c.name}: an array hasn't {c.elements} elements")
        flat = column.flatten()
    else:
        flat = column
    if flat.null_count:
        raise ValueError("a null has no form in a sample table")
    rows = len(column)
    if c.logical == FIXED:
        size = c.storage_bits // 8
        if not pa.compute.all(pa.compute.equal(pa.compute.binary_length(flat), size)).as_py() and len(flat):
            raise ValueError(f"channel {c.name}: a value hasn't {size} bytes")
        _, offsets, data = flat.buffers()
        first = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(flat.type) else np.int32)[flat.offset] if len(flat) else 0
        whole = np.frombuffer(data, np.uint8)[first : first + len(flat) * size] if data is not None else np.zeros(0, np.uint8)
        return whole.reshape(rows, c.elements, size)
    if pa.types.is_decimal(flat.type):
        x, negative = unsigned_words(flat), None
    elif pa.types.is_boolean(flat.type):
        x, negative = flat.to_numpy(zero_copy_only=False).astype(U64), None
    elif pa.types.is_floating(flat.type):
        v = flat.to_numpy(zero_copy_only=False)
        if c.logical == FLOAT:
            x = v.astype(np.float32).view(np.uint32).astype(U64) if c.logical_bits == 32 else v.astype(np.float64).view(U64)
            return x.reshape(rows, c.elements)
        nearest = np.rint((v.astype(np.float64) - c.offset) / c.scale)
        low, high = (-(2.0 ** (c.logical_bits - 1)), 2.0 ** (c.logical_bits - 1)) if c.logical == SIGNED else (0.0, 2.0**c.logical_bits)
        if not ((nearest >= low) & (nearest < high)).all():
            raise ValueError(f"channel {c.name}: a value doesn't fit {c.logical_bits} bits")
        x = nearest.astype(np.int64).view(U64) if c.logical == SIGNED else nearest.astype(U64)
        return (x & U64((1 << c.logical_bits) - 1)).reshape(rows, c.elements)
    else:
        v = flat.to_numpy(zero_copy_only=False).astype(np.int64)
        x, negative = v.view(U64), v
    mask = U64((1 << c.logical_bits) - 1)
    if negative is None or c.logical in (UNSIGNED, BOOLEAN):
        fits = (x & ~mask) == 0
        if c.logical == SIGNED:
            fits &= x < U64(1 << (c.logical_bits - 1))
        if negative is not None:
            fits &= negative >= 0
    else:
        half = 1 << (c.logical_bits - 1)
        fits = (negative >= -half) & (negative <= half - 1)
    if not fits.all():
        raise ValueError(f"channel {c.name}: a value doesn't fit {c.logical_bits} bits")
    return (x & mask).reshape(rows, c.elements)


@dataclass
class Written(WriterCommitMessage):
    """A task's file and the job whose folder it lies in: what commits a streaming batch may be another copy of the writer than what wrote it."""

    job: str
    file: str
    records: int


class Plan:
    """What a write's options and columns come to."""

    def __init__(self, options: dict[str, str], schema: StructType):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.table = low["path"], low.get("table", "rows")
        self.trailing = low.get("trailer", "false").lower() == "true"
        self.names = [f.name for f in schema.fields]
        self.types = {f.name: f.dataType for f in schema.fields}
        self.stream = low.get("stream", {"text": "messages", "blobs": "items"}.get(self.table, "rows"))
        self.time_unit = ratio(low["timeunit"]) if "timeunit" in low else None
        self.time_domain = int(low["timedomain"]) if "timedomain" in low else None
        self.clock = int(low["clock"]) if "clock" in low else None
        self.shared = shared_objects(json.loads(low.get("objects", "{}")))
        self.content_type = low.get("contenttype", "application/octet-stream")
        self.compression = low.get("compression", "zstd")
        self.chunk = int(low.get("chunk", 4096))
        writers: dict[str, tuple[Callable, set[str]]] = {"rows": (self._rows, set()), "text": (self._text, {"message"}), "blobs": (self._items, {"item_index", "data"}), "notes": (self._notes, {"message"}), "records": (self._records, {"type_id", "payload"})}
        if self.table not in writers:
            raise ValueError(f"table {self.table}: use one of {sorted(writers)}")
        self.write_batch, needed = writers[self.table]
        if needed - set(self.names):
            raise ValueError(f"table {self.table} needs the columns {sorted(needed)}")
        if self.table == "rows":
            self._plan_rows(low)
        objects = self.objects()
        if objects:
            Schema(1, 1, objects).check()  # on the driver, before any task starts

    def _plan_rows(self, low: dict[str, str]) -> None:
        self.layout = {"interleaved": 1, "planar": 2}[low.get("layout", "interleaved")]
        self.packing = {"dense": 1, "aligned": 2}[low.get("packing", "dense")]
        self.timed = "time_ticks" in self.names
        self.mode = TIME_MODES[low.get("time", "explicit" if self.timed else "periodic" if "period" in low else "none")]
        self.period, self.start = ratio(low.get("period", "1")), int(low.get("start", 0))
        if self.mode in (2, 3) and not self.timed:
            raise ValueError("explicit and delta times need a column time_ticks")
        self.columns = [n for n in self.names if n != "time_ticks"]
        specs = json.loads(low.get("channels", "{}"))
        if set(specs) - set(self.columns):
            raise ValueError(f"channels {sorted(set(specs) - set(self.columns))} have no column")
        self.channels = [channel_object(i + 1, n, self.types[n], specs.get(n, {})) for i, n in enumerate(self.columns)]

    def objects(self) -> list[SchemaObject]:
        kind = {"rows": SAMPLES, "text": TEXTS, "blobs": ITEMS}.get(self.table)
        if kind is None:
            return self.shared
        tlvs = [Tlv.of(1, w.UTF8, self.stream)]
        tlvs += [Tlv.of(100, w.U8, self.time_domain)] if self.time_domain is not None else []
        tlvs += [Tlv.of(101, w.RATIONAL_U64, self.time_unit.numerator, self.time_unit.denominator)] if self.time_unit is not None else []
        tlvs += [Tlv.of(103, w.U8, self.layout)] if kind == SAMPLES else []
        tlvs += [Tlv.of(104, w.U32, len(self.channels) if kind == SAMPLES else 0)]
        tlvs += [Tlv.of(105, w.U32, self.clock)] if self.clock is not None else []
        tlvs += [Tlv.of(106, w.U8, kind)] + ([Tlv.of(107, w.UTF8, self.content_type)] if kind == ITEMS else [])
        return [SchemaObject(w.STREAM, 1, tlvs), *(self.channels if kind == SAMPLES else []), *self.shared]

    def write(self, out, batches: Iterator[pa.RecordBatch]) -> int:
        """A whole file of the batches; the number of rows."""
        build = FileBuilder(out, uuid=uuids.uuid4().bytes, trailing=self.trailing)
        objects = self.objects()
        if objects:
            build.schema(1, 1, objects)
        self.first = 0
        self.last = -1
        self.known = Schema(1, 1, objects).channels(1) if self.table == "rows" else []
        for batch in batches:
            self.write_batch(build, batch)
            self.first += batch.num_rows
        build.close()
        return self.first

    def _rows(self, build: FileBuilder, batch: pa.RecordBatch) -> None:
        for a in range(0, batch.num_rows, self.chunk):
            part = batch.slice(a, self.chunk)
            values = [raw_values(part.column(n), c) for n, c in zip(self.columns, self.known)]
            first, times, start, period = self.first + a, None, 0, (0, 0)
            if self.timed and self.mode != 4:
                if part.column("time_ticks").null_count:
                    raise ValueError("a null has no form in a sample table")
                times = part.column("time_ticks").cast(pa.int64()).to_numpy(zero_copy_only=False)
            if self.mode == 1:
                period = self.period.numerator, self.period.denominator
                start = self.start + first * period[0] // period[1] if times is None else int(times[0])
                if times is not None and any(int(t) != start + n * period[0] // period[1] for n, t in enumerate(times)):
                    raise ValueError("time_ticks aren't periodic")
                times = None
            elif self.mode == 2:
                start = int(times[0])
                low, high = int(times.min()) - start, int(times.max()) - start
                if low < -(2**63) or high >= 2**63:
                    raise ValueError("time_ticks are further apart than 64 bits")
                times = times - np.int64(start)
            head = w.DataHeader(1, 1, 1, part.num_rows, first, start, period, self.mode, self.layout, self.packing)
            build.table(head, values, self.known, self.compression, times)

    def _cells(self, batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
        return zip(*(batch.column(n).to_pylist() if n in self.names else [None] * batch.num_rows for n in names))

    def _text(self, build: FileBuilder, batch: pa.RecordBatch) -> None:
        for ticks, severity, source, event, message in self._cells(batch, "time_ticks", "severity", "source_id", "event_code", "message"):
            if message is None:
                raise ValueError("a text record needs a message")
            build.add(w.TextRecord(message, ticks or 0, severity or 0, 1, 1, 1, source, event).record(0))

    def _items(self, build: FileBuilder, batch: pa.RecordBatch) -> None:
        for index, ticks, data in self._cells(batch, "item_index", "time_ticks", "data"):
            if index is None or data is None or index <= self.last:
                raise ValueError(f"item_index {index} after {self.last}: items must rise and be whole")
            self.last = int(index)
            build.item(w.BlobRecord(data, self.last, 1, 1, 1, w.UNKNOWN_TIME if ticks is None else ticks, [16] if self.compression == "zstd" else []))

    def _notes(self, build: FileBuilder, batch: pa.RecordBatch) -> None:
        for (message,) in self._cells(batch, "message"):
            build.add(Record(w.NOTE, 0, 0, b"", message.encode()))

    def _records(self, build: FileBuilder, batch: pa.RecordBatch) -> None:
        for kind, header, payload in self._cells(batch, "type_id", "type_header", "payload"):
            if kind is None or not w.PRIVATE <= kind < 1 << 16:
                raise ValueError(f"record type {kind} isn't a private one")
            build.add(Record(kind, 0, 0, header or b"", payload or b""))


class Files:
    """Files that tasks write and a job commits."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.plan, self.overwrite = Plan(options, schema), overwrite
        self.job = uuids.uuid4().hex

    def _store(self) -> tuple[pafs.FileSystem, str]:
        from daqframe.sources.daq import store

        return store(self.plan.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = self._store()
        temporary = f"{folder}/_temporary/{self.job}"
        fs.create_dir(temporary, recursive=True)
        name = f"part-{uuids.uuid4().hex}.daq"
        with fs.open_output_stream(f"{temporary}/{name}") as out:
            records = self.plan.write(out, iterator)
        return Written(self.job, name, records)

    def _publish(self, messages: list[Written | None], prefix: str, replaced: Callable[[str], bool]) -> None:
        """Moves a job's files to their names, then deletes those that they replace."""
        fs, folder = self._store()
        fs.create_dir(folder, recursive=True)
        old = [f for f in fs.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.File and replaced(f.base_name)]
        for m in messages:
            if m is not None:
                fs.move(f"{folder}/_temporary/{m.job}/{m.file}", f"{folder}/{prefix}{m.file}")
        for f in old:
            fs.delete_file(f.path)
        self._clear(messages)

    def _clear(self, messages: list[Written | None]) -> None:
        """Deletes the folder of this job, and that of all jobs where it was the last."""
        fs, folder = self._store()
        rest = f"{folder}/_temporary"
        for job in {self.job, *(m.job for m in messages if m is not None)}:
            if fs.get_file_info(f"{rest}/{job}").type == pafs.FileType.Directory:
                fs.delete_dir(f"{rest}/{job}")
        if fs.get_file_info(rest).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(rest)):
            fs.delete_dir(rest)


class DaqWriter(Files, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._publish(messages, "", lambda name: self.overwrite and not name.startswith(("_", ".")))

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(messages)


class DaqStreamWriter(Files, DataSourceStreamArrowWriter):
    """Files of a batch carry its number; a batch that is committed again replaces what it left the first time."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        prefix = f"batch-{batchId:010d}-"
        self._publish(messages, prefix, lambda name: name.startswith(prefix))

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._clear(messages)
