"""The binary framing: file header, records, schema objects and TLVs. Pure functions over bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from daqframe.crc import crc32c

# Fixed values of the format
MAGIC = bytes.fromhex("53 44 41 46 0d 0a 1a 0a")
MARKER = bytes.fromhex("53 44 52 43")
TRAILER_MARKER = bytes.fromhex("53 44 43 54")
BYTE_ORDER = 0x12345678
UNKNOWN_TIME = -(2**63)
CRC_IN_TRAILER, SOURCE_PRESENT, EVENT_PRESENT = 0x0001, 0x0100, 0x0200
SCHEMA, DATA, TEXT, INDEX, END, BLOB, NOTE, PRIVATE = 1, 2, 3, 4, 5, 6, 0x7FFF, 0x8000
TYPE_NAMES = {SCHEMA: "SCMA", DATA: "DATA", TEXT: "TEXT", INDEX: "INDX", END: "END!", BLOB: "BLOB", NOTE: "NOTE"}
HEADER_SIZES = {SCHEMA: 48, DATA: 96, TEXT: 64, INDEX: 48, END: 64, BLOB: 80, NOTE: 32}
SEVERITIES = ["unspecified", "trace", "debug", "info", "warning", "error", "fatal"]
FILE_META, STREAM, CHANNEL, CLOCK, VALUE_MAP, BITFIELD = 1, 2, 3, 4, 5, 6
KIND_NAMES = {FILE_META: "file", STREAM: "stream", CHANNEL: "channel", CLOCK: "clock", VALUE_MAP: "value_map", BITFIELD: "bitfield"}
U8, U16, U32, U64, I64, F64, UTF8, BYTES, RATIONAL_U64, BOOL, RATIONAL_I64 = range(1, 12)
WIRE_FORMATS = {U8: "<B", U16: "<H", U32: "<I", U64: "<Q", I64: "<q", F64: "<d", RATIONAL_U64: "<QQ", BOOL: "<B", RATIONAL_I64: "<qQ"}

FILE_HEADER = struct.Struct("<8sBBHIIIq16sQII")
ENVELOPE = struct.Struct("<4sHHHBBIQII")
TRAILER = struct.Struct("<4sHBBII")
SCHEMA_HEADER = struct.Struct("<IIII")
OBJECT_HEADER = struct.Struct("<BBHII")
TLV_HEADER = struct.Struct("<HBBI")
DATA_HEADER = struct.Struct("<IIIIQqQQBBBBIQ")
TEXT_HEADER = struct.Struct("<IIqBBHIiI")
BLOB_HEADER = struct.Struct("<IIIIQqQB7s")
INDEX_HEADER = struct.Struct("<I12s")
INDEX_ENTRY = struct.Struct("<QIIQIIqq")
END_HEADER = struct.Struct("<QQQ8s")
DESCRIPTOR = struct.Struct("<HBBI")


class FormatError(Exception):
    """Bytes that break the format. reason is a stable word, status one of FORMAT, LIMIT, UNSUPPORTED."""

    def __init__(self, reason: str, detail: str = "", status: str = "FORMAT", offset: int | None = None, sequence: int | None = None):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason, self.status, self.offset, self.sequence = reason, status, offset, sequence


def require(condition: bool, reason: str, detail: str = "", status: str = "FORMAT") -> None:
    if not condition:
        raise FormatError(reason, detail, status)


@dataclass(frozen=True)
class Limits:
    """What a reader accepts before it allocates; more is a LIMIT error and says nothing about the file."""

    header: int = 64 << 10
    payload: int = 1 << 30
    decoded: int = 4 << 30
    objects: int = 65_535
    channels: int = 4_096
    text: int = 16 << 20
    records: int = 2**62


@dataclass
class FileHeader:
    created_unix_ns: int = UNKNOWN_TIME
    uuid: bytes = bytes(16)
    major: int = 1
    minor: int = 0
    size: int = 64

    def pack(self) -> bytes:
        def form(crc: int) -> bytes:
            return FILE_HEADER.pack(MAGIC, self.major, self.minor, 64, BYTE_ORDER, 0, 0, self.created_unix_ns, self.uuid, 64, crc, 0)

        return form(crc32c(form(0)))

    @classmethod
    def parse(cls, data: bytes, limits: Limits = Limits()) -> FileHeader:
        require(len(data) >= 64, "file_header_size")
        magic, major, minor, size, order, features, reserved, created, uuid, first, crc, reserved2 = FILE_HEADER.unpack_from(data)
        require(magic == MAGIC, "file_magic")
        require(major == 1, "file_version", str(major), "UNSUPPORTED")
        require(size >= 64, "file_header_size")
        require(size <= limits.header, "file_header_size", str(size), "LIMIT")
        require(order == BYTE_ORDER, "file_byte_order")
        require(len(data) >= size, "file_header_size")
        require(crc32c(data[:56] + bytes(4) + data[60:size]) == crc, "file_header_crc")
        require(features == 0 and reserved == 0 and reserved2 == 0, "file_reserved")
        require(first == size, "file_first_record")
        return cls(created, uuid, major, minor, size)


@dataclass
class Record:
    """One record; offset is that of its envelope. payload is None where only headers were walked."""

    type: int
    flags: int = 0
    sequence: int = 0
    header: bytes = b""
    payload: bytes | None = b""
    version: int = 1
    offset: int = 0
    payload_size: int = 0

    @property
    def trailing(self) -> bool:
        return bool(self.flags & CRC_IN_TRAILER)

    @property
    def header_size(self) -> int:
        return 32 + len(self.header)

    @property
    def stored_size(self) -> int:
        return self.header_size + self.payload_size + 16 * self.trailing

    def pack(self) -> bytes:
        crc = crc32c(self.payload)

        def form(header_crc: int) -> bytes:
            return ENVELOPE.pack(MARKER, self.type, self.flags, self.header_size, self.version, 0, self.sequence, len(self.payload), header_crc, 0 if self.trailing else crc) + self.header

        out = form(crc32c(form(0))) + self.payload
        return out + TRAILER.pack(TRAILER_MARKER, 16, 1, 0, self.sequence, crc) if self.trailing else out


def type_name(record_type: int) -> str:
    return TYPE_NAMES.get(record_type, f"0x{record_type:04x}")


def parse_envelope(head: bytes, offset: int, limits: Limits) -> tuple[Record, int, int]:
    """A record without payload from its 32-byte envelope, and the header and payload CRCs that it states."""
    marker, kind, flags, size, version, reserved, sequence, payload, header_crc, payload_crc = ENVELOPE.unpack_from(head)
    record = Record(kind, flags, sequence, b"", None, version, offset, payload)
    require(marker == MARKER, "record_marker")
    require(flags & 0x00FE == 0, "reserved_flag")
    require(size >= 32, "record_header_size")
    require(size <= limits.header, "record_header_size", str(size), "LIMIT")
    require(payload <= limits.payload, "payload_size", str(payload), "LIMIT")
    require(reserved == 0, "record_reserved")
    require(version == 1, "record_version", str(version), "UNSUPPORTED")
    require(not flags & CRC_IN_TRAILER or payload_crc == 0, "payload_crc_placement")
    return record, header_crc, payload_crc


class Walk:
    """The records of an open, seekable file in order.

    A file that ends inside a record ends before it; ``truncated`` then says where (truncated_final_header or truncated_final_payload).
    Anything else that is wrong raises a FormatError with the offset; with recover the walk goes on at the next sound record and
    keeps the errors in ``errors``. Headers are read and checked always, payloads where wanted(record) says so, or later by ``load``.
    The file is taken to end at end; records that start at until or behind it aren't looked at.
    """

    def __init__(self, file, limits: Limits = Limits(), wanted=lambda record: True, verify: bool = True, recover: bool = False, start: int | None = None, end: int | None = None, until: int | None = None):
        self.file, self.limits, self.wanted, self.verify, self.recover = file, limits, wanted, verify, recover
        self.until = 1 << 63 if until is None else until
        file.seek(0, 2)
        self.size = file.tell() if end is None else min(end, file.tell())
        file.seek(0)
        self.header: FileHeader | None = None
        if start is None:
            first = file.read(64)
            more = struct.unpack_from("<H", first, 10)[0] - 64 if len(first) == 64 else 0
            self.header = FileHeader.parse(first + (file.read(more) if 0 < more <= limits.header else b""), limits)
            start = self.header.size
        self.position, self.truncated, self.errors = start, "", []

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _one(self, offset: int) -> Record | None:
        left = self.size - offset
        if left < 32:
            self.truncated = "truncated_final_header"
            return None
        head = self._at(offset, 32)
        record, header_crc, payload_crc = parse_envelope(head, offset, self.limits)
        size = struct.unpack_from("<H", head, 8)[0]
        if left < size:
            self.truncated = "truncated_final_header"
            return None
        record.header = self.file.read(size - 32)
        require(crc32c(head[:24] + bytes(4) + head[28:] + record.header) == header_crc, "record_header_crc")
        if left < record.stored_size:
            self.truncated = "truncated_final_payload"
            return None
        self.stated = payload_crc
        if self.wanted(record):
            self.load(record)
        return record

    def load(self, record: Record) -> None:
        """Reads the payload of the record that the walk has just given."""
        payload_crc = self.stated
        record.payload = self._at(record.offset + record.header_size, record.payload_size)
        if record.trailing:
            marker, trailer_size, version, flags, sequence, payload_crc = TRAILER.unpack(self.file.read(16))
            require(marker == TRAILER_MARKER, "trailer_marker")
            require((trailer_size, version, flags) == (16, 1, 0), "trailer_fields")
            require(sequence == record.sequence, "trailer_sequence")
        if self.verify:
            require(crc32c(record.payload) == payload_crc, "payload_crc")

    def __iter__(self) -> Iterator[Record]:
        count = 0
        while self.position < min(self.size, self.until):
            try:
                record = self._one(self.position)
                if record is None:
                    return
                count += 1
                require(count <= self.limits.records, "record_count", status="LIMIT")
            except FormatError as e:
                e.offset = self.position
                if not self.recover:
                    raise
                self.errors.append(e)
                self.position = self._next_sound(self.position + 1)
                continue
            yield record
            self.position += record.stored_size

    def _next_sound(self, offset: int) -> int:
        """The next offset at which a whole record checks out, else the end."""
        chunk = 1 << 20
        while offset < self.size:
            data = self._at(offset, chunk + 3)
            at = data.find(MARKER)
            while at >= 0:
                wanted, self.wanted = self.wanted, lambda record: True
                try:
                    if self._one(offset + at) is not None:
                        return offset + at
                except FormatError:
                    pass
                finally:
                    self.wanted, self.truncated = wanted, ""
                at = data.find(MARKER, at + 1)
            offset += chunk
        return self.size


# --- schema records -------------------------------------------------------------------------------------------------


@dataclass
class Tlv:
    tag: int
    wire: int
    value: bytes

    def pack(self) -> bytes:
        return TLV_HEADER.pack(self.tag, self.wire, 0, len(self.value)) + self.value

    @classmethod
    def of(cls, tag: int, wire: int, *values) -> Tlv:
        if wire == UTF8:
            return cls(tag, wire, values[0].encode())
        return cls(tag, wire, values[0] if wire == BYTES else struct.pack(WIRE_FORMATS[wire], *values))

    def get(self):
        """The value: int, float, bool, str, bytes or a pair for rationals; None for an unknown wire type."""
        if self.wire == UTF8:
            return self.value.decode()
        if self.wire == BYTES:
            return self.value
        if self.wire not in WIRE_FORMATS:
            return None
        got = struct.unpack(WIRE_FORMATS[self.wire], self.value)
        return bool(got[0]) if self.wire == BOOL else got if len(got) == 2 else got[0]

    def check(self, limits: Limits) -> None:
        if self.wire in WIRE_FORMATS:
            require(len(self.value) == struct.calcsize(WIRE_FORMATS[self.wire]), "tlv_size", f"tag {self.tag}")
        if self.wire == UTF8:
            require(len(self.value) <= limits.text, "tlv_text", f"tag {self.tag}", "LIMIT")
            try:
                self.value.decode("utf-8", "strict")
            except UnicodeDecodeError:
                raise FormatError("tlv_utf8", f"tag {self.tag}") from None
        elif self.wire == BOOL:
            require(self.value in (b"\0", b"\1"), "tlv_bool", f"tag {self.tag}")
        elif self.wire in (RATIONAL_U64, RATIONAL_I64):
            require(self.get()[1] != 0, "tlv_denominator", f"tag {self.tag}")


@dataclass
class SchemaObject:
    kind: int
    id: int
    tlvs: list[Tlv] = field(default_factory=list)

    def pack(self) -> bytes:
        body = b"".join(t.pack() for t in self.tlvs)
        return OBJECT_HEADER.pack(self.kind, 0, 12, 12 + len(body), self.id) + body

    def all(self, tag: int) -> list:
        return [t.get() for t in self.tlvs if t.tag == tag]

    def get(self, tag: int, default=None):
        return next((t.get() for t in self.tlvs if t.tag == tag), default)

    def has(self, tag: int) -> bool:
        return any(t.tag == tag for t in self.tlvs)

    @property
    def name(self) -> str:
        """The name, or kind and id for want of one."""
        return self.get(1) or f"{KIND_NAMES.get(self.kind, 'object')}_{self.id}"


def pack_schema(schema_id: int, revision: int, objects: list[SchemaObject]) -> tuple[bytes, bytes]:
    return SCHEMA_HEADER.pack(schema_id, revision, len(objects), 0), b"".join(o.pack() for o in objects)


def type_header(record: Record, form: struct.Struct) -> tuple:
    require(record.header_size == HEADER_SIZES[record.type], "record_header_size")
    return form.unpack(record.header)


def parse_schema(record: Record, limits: Limits = Limits()) -> tuple[int, int, list[SchemaObject]]:
    schema_id, revision, count, reserved = type_header(record, SCHEMA_HEADER)
    require(record.flags & ~CRC_IN_TRAILER == 0, "reserved_flag")
    require(schema_id > 0 and revision > 0 and reserved == 0, "schema_header")
    require(count <= limits.objects, "object_count", str(count), "LIMIT")
    data, at, objects = record.payload, 0, []
    for _ in range(count):
        require(len(data) - at >= 12, "object_overrun")
        kind, flags, head, size, object_id = OBJECT_HEADER.unpack_from(data, at)
        require(flags == 0 and head == 12 and object_id > 0, "object_header")
        require(12 <= size <= len(data) - at, "object_overrun")
        tlvs, place, end = [], at + 12, at + size
        while place < end:
            require(end - place >= 8, "tlv_overrun")
            tag, wire, tlv_flags, length = TLV_HEADER.unpack_from(data, place)
            require(tlv_flags == 0, "tlv_flags")
            require(length <= end - place - 8, "tlv_overrun")
            tlvs.append(Tlv(tag, wire, data[place + 8 : place + 8 + length]))
            tlvs[-1].check(limits)
            place += 8 + length
        objects.append(SchemaObject(kind, object_id, tlvs))
        at = end
    require(at == len(data), "schema_payload_size")
    return schema_id, revision, objects


# --- other records ----------------------------------------------------------------------------------------------------


def parse_descriptors(payload: bytes, count: int) -> tuple[list[int], int]:
    """Transform ids in encoding order, and where the encoded bytes start."""
    ids, at = [], 0
    for _ in range(count):
        require(len(payload) - at >= 8, "descriptor_overrun")
        kind, version, flags, size = DESCRIPTOR.unpack_from(payload, at)
        require(size <= len(payload) - at - 8, "descriptor_overrun")
        require(flags == 0, "descriptor_flags")
        if kind in (1, 2, 3, 5, 16):
            require(version == 1 and size == 0, "descriptor_version")
        ids.append(kind)
        at += 8 + size
    return ids, at


def pack_descriptors(ids: list[int]) -> bytes:
    return b"".join(DESCRIPTOR.pack(i, 1, 0, 0) for i in ids)


# The chains that the format defines
INTEGER_CHAIN, BITWISE_CHAIN, ZSTD_CHAIN = [1, 2, 3, 16], [5, 3, 16], [16]


def chain_kind(ids: list[int]) -> str:
    """identity, zstd, integer or bitwise; unsupported for chains of unknown ids; typed ids in any other chain are an error."""
    named = {(): "identity", (16,): "zstd", (1, 2, 3, 16): "integer", (5, 3, 16): "bitwise"}.get(tuple(ids))
    if named is None:
        require(not {1, 2, 3, 5} & set(ids), "transform_order", str(ids))
        require(16 not in ids, "transform_order", str(ids))
        return "unsupported"
    return named


@dataclass
class DataHeader:
    schema_id: int
    revision: int
    stream_id: int
    count: int
    first_index: int = 0
    start: int = 0
    period: tuple[int, int] = (0, 0)
    time_mode: int = 4
    layout: int = 1
    packing: int = 1
    transforms: int = 0
    time_bytes: int = 0
    decoded_bytes: int = 0

    def pack(self) -> bytes:
        return DATA_HEADER.pack(self.schema_id, self.revision, self.stream_id, self.count, self.first_index, self.start, *self.period, self.time_mode, self.layout, self.packing, self.transforms, self.time_bytes, self.decoded_bytes)

    @classmethod
    def parse(cls, record: Record, limits: Limits = Limits()) -> DataHeader:
        schema, revision, stream, count, first, start, num, den, mode, layout, packing, transforms, time_bytes, decoded = type_header(record, DATA_HEADER)
        head = cls(schema, revision, stream, count, first, start, (num, den), mode, layout, packing, transforms, time_bytes, decoded)
        require(record.flags & ~CRC_IN_TRAILER == 0, "reserved_flag")
        require(schema > 0 and revision > 0 and stream > 0, "data_ids")
        require(layout in (1, 2), "layout")
        require(packing in (1, 2), "packing")
        require(decoded <= limits.decoded, "decoded_size", str(decoded), "LIMIT")
        require(count == 0 or first + count - 1 < 2**64, "sample_index")
        head.check_time()
        return head

    def check_time(self) -> None:
        require(self.time_mode in (1, 2, 3, 4), "timestamp_mode")
        num, den = self.period
        fits = {
            1: den != 0 and self.time_bytes == 0,
            2: (num, den) == (0, 0) and self.time_bytes == 8 * self.count,
            3: (num, den) == (0, 0) and self.start == 0 and self.time_bytes == 8 * self.count,
            4: (num, den, self.start, self.time_bytes) == (0, 0, 0, 0),
        }[self.time_mode]
        require(fits, "timestamp_fields", f"mode {self.time_mode}")


@dataclass
class TextRecord:
    message: str
    ticks: int = 0
    severity: int = 0
    schema_id: int = 0
    revision: int = 0
    stream_id: int = 0
    source_id: int | None = None
    event_code: int | None = None

    def record(self, sequence: int, trailing: bool = False) -> Record:
        flags = (SOURCE_PRESENT if self.source_id is not None else 0) | (EVENT_PRESENT if self.event_code is not None else 0) | trailing
        header = TEXT_HEADER.pack(self.schema_id, self.stream_id, self.ticks, self.severity, 1, 0, self.source_id or 0, self.event_code or 0, self.revision)
        return Record(TEXT, flags, sequence, header, self.message.encode())

    @classmethod
    def parse(cls, record: Record, limits: Limits = Limits()) -> TextRecord:
        schema, stream, ticks, severity, encoding, reserved, source, event, revision = type_header(record, TEXT_HEADER)
        require(record.flags & ~(CRC_IN_TRAILER | SOURCE_PRESENT | EVENT_PRESENT) == 0, "reserved_flag")
        require(severity <= 6 and encoding == 1 and reserved == 0, "text_header")
        require(bool(schema) == bool(revision) == bool(stream), "text_ids")
        has_source, has_event = bool(record.flags & SOURCE_PRESENT), bool(record.flags & EVENT_PRESENT)
        require((has_source or source == 0) and (has_event or event == 0), "text_absent_fields")
        require(len(record.payload) <= limits.text, "text_size", status="LIMIT")
        try:
            message = record.payload.decode("utf-8", "strict")
        except UnicodeDecodeError:
            raise FormatError("text_utf8") from None
        return cls(message, ticks, severity, schema, revision, stream, source if has_source else None, event if has_event else None)


@dataclass
class BlobRecord:
    data: bytes | None
    item_index: int
    schema_id: int
    revision: int
    stream_id: int
    ticks: int = UNKNOWN_TIME
    transforms: list[int] = field(default_factory=list)
    decoded_bytes: int = 0

    def record(self, sequence: int, trailing: bool = False) -> Record:
        from daqframe.codec import compress

        require(self.transforms in ([], [16]), "transform_order", str(self.transforms))
        body = compress(self.data) if self.transforms else self.data
        header = BLOB_HEADER.pack(self.schema_id, self.revision, self.stream_id, 0, self.item_index, self.ticks, len(self.data), len(self.transforms), bytes(7))
        return Record(BLOB, int(trailing), sequence, header, pack_descriptors(self.transforms) + body)

    @classmethod
    def head(cls, record: Record, limits: Limits = Limits()) -> tuple[BlobRecord, int]:
        """What the header says, without data, and the number of transforms."""
        schema, revision, stream, reserved, index, ticks, decoded, count, reserved2 = type_header(record, BLOB_HEADER)
        require(record.flags & ~CRC_IN_TRAILER == 0, "reserved_flag")
        require(schema > 0 and revision > 0 and stream > 0 and reserved == 0 and reserved2 == bytes(7), "blob_header")
        require(decoded <= limits.decoded, "decoded_size", str(decoded), "LIMIT")
        require(count <= 1, "transform_order", f"{count} transforms")
        return cls(None, index, schema, revision, stream, ticks, [], decoded), count

    @classmethod
    def parse(cls, record: Record, limits: Limits = Limits()) -> BlobRecord:
        from daqframe.codec import decompress

        out, count = cls.head(record, limits)
        decoded = out.decoded_bytes
        ids, at = parse_descriptors(record.payload, count)
        require(not {1, 2, 3, 5} & set(ids), "transform_order", str(ids))
        body = record.payload[at:]
        if ids == [16]:
            body = decompress(body, decoded)
        elif ids:
            body = None
        require(body is None or len(body) == decoded, "decoded_size")
        out.data, out.transforms = body, ids
        return out


def index_record(entries: list[tuple[int, int, int, int, int, int, int]], sequence: int) -> Record:
    """entries: (record_offset, sequence, stream_id, first_index, count, first_ticks, last_ticks)."""
    body = b"".join(INDEX_ENTRY.pack(o, s, st, f, n, 0, a, z) for o, s, st, f, n, a, z in entries)
    return Record(INDEX, 0, sequence, INDEX_HEADER.pack(len(entries), bytes(12)), body)


def parse_index(record: Record) -> list[tuple[int, int, int, int, int, int, int]]:
    count, reserved = type_header(record, INDEX_HEADER)
    require(reserved == bytes(12) and record.flags & ~CRC_IN_TRAILER == 0, "index_header")
    require(len(record.payload) == 48 * count, "index_size")
    out = []
    for o, s, st, f, n, zero, a, z in INDEX_ENTRY.iter_unpack(record.payload):
        require(zero == 0, "index_reserved")
        out.append((o, s, st, f, n, a, z))
    return out


def end_record(total: int, data: int, last_index: int, sequence: int) -> Record:
    return Record(END, 0, sequence, END_HEADER.pack(total, data, last_index, bytes(8)), b"")


def parse_end(record: Record) -> tuple[int, int, int]:
    total, data, last_index, reserved = type_header(record, END_HEADER)
    require(reserved == bytes(8) and record.payload_size == 0 and record.flags & ~CRC_IN_TRAILER == 0, "end_header")
    return total, data, last_index


def parse_note(record: Record, limits: Limits = Limits()) -> str:
    require(record.header_size == 32 and record.flags & ~CRC_IN_TRAILER == 0, "note_header")
    require(len(record.payload) <= limits.text, "note_size", status="LIMIT")
    try:
        return record.payload.decode("utf-8", "strict")
    except UnicodeDecodeError:
        raise FormatError("note_utf8") from None
