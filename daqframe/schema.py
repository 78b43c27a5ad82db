"""Schema revisions: objects to channels, streams, clocks, value maps and bitfields, and the rules between them."""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from dataclasses import dataclass

from daqframe import wire as w
from daqframe.codec import BOOLEAN, FIXED, SIGNED, UNSIGNED, Channel
from daqframe.wire import FormatError, Limits, SchemaObject, require

# Tags of the format, with the wire type each must have
TAGS = {
    1: w.UTF8, 2: w.UTF8, 3: w.UTF8, 4: w.UTF8, 5: w.UTF8, 6: w.UTF8, 7: w.UTF8, 8: w.U32, 9: w.U32, 10: w.UTF8,
    100: w.U8, 101: w.RATIONAL_U64, 102: w.RATIONAL_U64, 103: w.U8, 104: w.U32, 105: w.U32, 106: w.U8, 107: w.UTF8, 108: w.U32, 109: w.U32, 110: w.U32, 111: w.U32,
    200: w.U32, 201: w.U8, 202: w.U16, 203: w.U16, 204: w.UTF8, 205: w.F64, 206: w.F64, 207: w.U32, 208: w.UTF8, 209: w.U32, 210: w.U32, 211: w.RATIONAL_I64, 212: w.RATIONAL_I64,
    300: w.U8, 301: w.RATIONAL_U64, 302: w.U16, 303: w.U8, 304: w.UTF8,
    400: w.BYTES, 500: w.U16, 501: w.BYTES,
}
REPEATABLE = {400, 501}
SAMPLES, TEXTS, ITEMS, CORRELATION = 1, 2, 3, 4
CLOCK_SEMANTICS = {"clock.source_ticks", "clock.target_ticks"}


@dataclass(frozen=True)
class MapEntry:
    raw: int
    name: str
    description: str


@dataclass(frozen=True)
class Member:
    lsb: int
    width: int
    map_id: int
    reserved: bool
    name: str
    description: str


def pack_map_entry(raw: int, name: str, description: str = "") -> bytes:
    a, b = name.encode(), description.encode()
    return struct.pack("<QHH", raw, len(a), len(b)) + a + b


def pack_member(lsb: int, width: int, name: str, map_id: int = 0, reserved: bool = False, description: str = "") -> bytes:
    a, b = name.encode(), description.encode()
    return struct.pack("<HHIHHH", lsb, width, map_id, int(reserved), len(a), len(b)) + a + b


def _strings(value: bytes, at: int, sizes: tuple[int, int], what: str) -> tuple[str, str]:
    require(len(value) == at + sum(sizes), f"{what}_size")
    try:
        return value[at : at + sizes[0]].decode(), value[at + sizes[0] :].decode()
    except UnicodeDecodeError:
        raise FormatError(f"{what}_utf8") from None


def map_entries(o: SchemaObject) -> list[MapEntry]:
    out = []
    for value in o.all(400):
        require(len(value) >= 12, "value_map_entry_size")
        raw, a, b = struct.unpack_from("<QHH", value)
        out.append(MapEntry(raw, *_strings(value, 12, (a, b), "value_map_entry")))
    return out


def members(o: SchemaObject) -> list[Member]:
    out = []
    for value in o.all(501):
        require(len(value) >= 14, "bitfield_member_size")
        lsb, width, map_id, flags, a, b = struct.unpack_from("<HHIHHH", value)
        require(flags & ~1 == 0, "bitfield_member_flags")
        out.append(Member(lsb, width, map_id, bool(flags & 1), *_strings(value, 14, (a, b), "bitfield_member")))
    return out


class Schema:
    """One revision, checked; streams and channels as decoders need them."""

    def __init__(self, schema_id: int, revision: int, objects: list[SchemaObject], payload: bytes = b"", limits: Limits = Limits()):
        self.id, self.revision, self.objects, self.limits = schema_id, revision, objects, limits
        self.digest = hashlib.sha256(payload or b"".join(o.pack() for o in objects)).hexdigest()
        self.by = {(o.kind, o.id): o for o in objects}
        self._channels: dict[int, list[Channel]] = {}

    @classmethod
    def parse(cls, record: w.Record, limits: Limits = Limits(), checked: bool = True) -> Schema:
        schema = cls(*w.parse_schema(record, limits), record.payload, limits)
        if checked:
            schema.check()
        return schema

    def of_kind(self, kind: int) -> list[SchemaObject]:
        return [o for o in self.objects if o.kind == kind]

    def stream_kind(self, stream_id: int) -> int:
        return self.by[w.STREAM, stream_id].get(106, SAMPLES)

    def channel_objects(self, stream_id: int) -> list[SchemaObject]:
        return sorted((o for o in self.of_kind(w.CHANNEL) if o.get(200) == stream_id), key=lambda o: o.id)

    def channels(self, stream_id: int) -> list[Channel]:
        """Channels of a stream by ascending id."""
        if stream_id not in self._channels:
            found = [self.channel(o) for o in self.channel_objects(stream_id)]
            require(len(found) <= self.limits.channels, "channel_count", status="LIMIT")
            self._channels[stream_id] = found
        return self._channels[stream_id]

    @staticmethod
    def channel(o: SchemaObject) -> Channel:
        def factor(exact: int, plain: int, default: float) -> float:
            require(not (o.has(exact) and o.has(plain)), "scale_twice", f"channel {o.id}")
            ratio = o.get(exact)
            return float(ratio[0]) / float(ratio[1]) if ratio else o.get(plain, default)

        logical, storage = o.get(201), o.get(203)
        require(logical is not None, "channel_type", f"channel {o.id}")
        bits = o.get(202)
        if logical == BOOLEAN:
            bits, storage = bits or 1, storage or 1
        if logical == FIXED:
            bits = bits or storage
        c = Channel(o.id, o.name, logical, bits or 0, storage or 0, o.get(207, 1), o.get(204), factor(211, 205, 1.0), factor(212, 206, 0.0))
        c.check()
        return c

    # --- the rules ---

    def check(self) -> None:
        for (kind, _), n in Counter((o.kind, o.id) for o in self.objects).items():
            require(n == 1, "object_duplicate", w.KIND_NAMES.get(kind, str(kind)))
        for o in self.objects:
            for tag, n in Counter(t.tag for t in o.tlvs if t.tag in TAGS).items():
                require(n == 1 or tag in REPEATABLE, "tag_duplicate", str(tag))
            for t in o.tlvs:
                require(TAGS.get(t.tag, t.wire) == t.wire, "tag_wire", str(t.tag))
        for o in self.of_kind(w.VALUE_MAP):
            self._check_map(o)
        for o in self.of_kind(w.BITFIELD):
            self._check_bitfield(o)
        for o in self.of_kind(w.CLOCK):
            require(o.has(300) and o.has(301), "clock_fields", str(o.id))
            require(o.get(300) <= 4 and o.get(303, 0) <= 3, "clock_fields", str(o.id))
        for o in self.of_kind(w.CHANNEL):
            self._check_channel(o)
        for o in self.of_kind(w.STREAM):
            self._check_stream(o)

    def _resolve(self, kind: int, object_id: int | None, what: str) -> SchemaObject | None:
        if object_id is None:
            return None
        require((kind, object_id) in self.by, "reference", f"{what} {object_id}")
        return self.by[kind, object_id]

    def _check_map(self, o: SchemaObject) -> None:
        entries = map_entries(o)
        require(all(e.name for e in entries), "value_map_name", str(o.id))
        require(len({e.raw for e in entries}) == len(entries) == len({e.name for e in entries}), "value_map_unique", str(o.id))

    def _check_bitfield(self, o: SchemaObject) -> None:
        width, last = o.get(500), 0
        require(width is not None and 1 <= width <= 64, "bitfield_bits", str(o.id))
        for m in sorted(members(o), key=lambda m: m.lsb):
            require(m.width >= 1 and m.lsb + m.width <= width, "bitfield_range", m.name)
            require(m.lsb >= last, "bitfield_overlap", m.name)
            last = m.lsb + m.width
            if m.map_id:
                self._resolve(w.VALUE_MAP, m.map_id, "value map")

    def _check_channel(self, o: SchemaObject) -> None:
        c = self.channel(o)
        require(o.has(200), "channel_stream", str(o.id))
        self._resolve(w.STREAM, o.get(200), "stream")
        require(not (o.has(209) and o.has(210)), "channel_symbols", str(o.id))
        self._resolve(w.VALUE_MAP, o.get(209), "value map")
        field = self._resolve(w.BITFIELD, o.get(210), "bitfield")
        require(not (o.has(209) or o.has(210)) or c.logical in (UNSIGNED, SIGNED), "channel_symbols", str(o.id))
        require(field is None or field.get(500) == c.storage_bits, "bitfield_bits", str(o.id))

    def _check_stream(self, o: SchemaObject) -> None:
        kind, channels = o.get(106, SAMPLES), self.channel_objects(o.id)
        require(kind in (SAMPLES, TEXTS, ITEMS, CORRELATION), "stream_kind", str(o.id))
        require(o.get(103, 1) in (1, 2) and o.get(100, 0) <= 4, "stream_fields", str(o.id))
        if kind in (TEXTS, ITEMS):
            require(not channels and o.get(104, 0) == 0, "stream_channels", str(o.id))
        else:
            require(o.get(104, len(channels)) == len(channels), "stream_channels", str(o.id))
        require(kind != ITEMS or bool(o.get(107)), "stream_content_type", str(o.id))
        require(kind == TEXTS or not (o.has(110) or o.has(111)), "stream_maps", str(o.id))
        for tag in (110, 111):
            self._resolve(w.VALUE_MAP, o.get(tag), "value map")
        clock = self._resolve(w.CLOCK, o.get(105) or None, "clock")
        if clock is not None:
            require(o.get(100, clock.get(300)) == clock.get(300), "stream_clock", str(o.id))
            unit, tick = o.get(101), clock.get(301)
            require(unit is None or unit[0] * tick[1] == tick[0] * unit[1], "stream_clock", str(o.id))
        require(kind == CORRELATION or not (o.has(108) or o.has(109)), "stream_correlation", str(o.id))
        if kind == CORRELATION:
            for tag in (108, 109):
                require(bool(o.get(tag)), "stream_correlation", str(o.id))
                self._resolve(w.CLOCK, o.get(tag), "clock")
            semantics = [c.get(208) for c in channels]
            require(all(semantics.count(s) == 1 for s in CLOCK_SEMANTICS), "stream_correlation", str(o.id))
            require(all(c.get(201) == SIGNED and c.get(207, 1) == 1 for c in channels), "stream_correlation", str(o.id))


class Registry:
    """The revisions seen so far in a file. A record binds only to one before it."""

    def __init__(self, limits: Limits = Limits()):
        self.limits, self.known = limits, {}

    def add(self, record: w.Record) -> Schema:
        schema = Schema.parse(record, self.limits)
        old = self.known.get((schema.id, schema.revision))
        require(old is None or old.digest == schema.digest, "schema_redefined", f"{schema.id}/{schema.revision}")
        self.known[schema.id, schema.revision] = schema
        return schema

    def stream(self, schema_id: int, revision: int, stream_id: int, kinds: tuple[int, ...]) -> Schema | None:
        """The schema, once the stream is there and of one of the kinds; None for an unseen revision."""
        schema = self.known.get((schema_id, revision))
        if schema is not None:
            require((w.STREAM, stream_id) in schema.by, "stream_unknown", str(stream_id))
            require(schema.stream_kind(stream_id) in kinds, "stream_kind", str(stream_id))
        return schema


class FileState:
    """What earlier records of a file demand of later ones."""

    def __init__(self, limits: Limits = Limits()):
        self.registry, self.items = Registry(limits), {}
        self.records: dict[int, tuple[int, int, int, int, int]] = {}
        self.total = self.data = 0

    def see(self, record: w.Record, head: w.DataHeader | None = None, blob: w.BlobRecord | None = None) -> None:
        """Counts and checks one record in file order; payloads of schemas, indexes and ends must be there."""
        self.total += 1
        if record.type == w.DATA:
            self.data += 1
            self.records[record.offset] = (record.sequence, head.stream_id, head.first_index, head.count, w.DATA)
        elif record.type == w.BLOB:
            key = blob.schema_id, blob.stream_id
            require(blob.item_index > self.items.get(key, -1), "item_order", str(blob.item_index))
            self.items[key] = blob.item_index
            self.records[record.offset] = (record.sequence, blob.stream_id, blob.item_index, 1, w.BLOB)
        elif record.type == w.INDEX:
            for offset, sequence, stream, first, count, _, _ in w.parse_index(record):
                require(offset in self.records, "index_offset", str(offset))
                require(self.records[offset][:4] == (sequence, stream, first, count), "index_entry", str(offset))
            self.records[record.offset] = (record.sequence, 0, 0, 0, w.INDEX)
        else:
            if record.type == w.END:
                total, data, last = w.parse_end(record)
                require((total, data) == (self.total, self.data), "end_totals", f"{total}, {data}")
                require(last == 0 or self.records.get(last, (0,) * 5)[4] == w.INDEX, "end_index", str(last))
            if record.type == w.TEXT:
                self.records[record.offset] = (record.sequence, 0, 0, 1, w.TEXT)


