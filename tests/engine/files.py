"""Builds the golden files from their description."""

from daqframe import codec, wire as w
from daqframe.schema import pack_map_entry, pack_member
from daqframe.wire import DataHeader, FileHeader, Record, SchemaObject, Tlv

import numpy as np

HEADER = FileHeader(1_700_000_000_000_000_000, bytes.fromhex("00112233445566778899aabbccddeeff"))


def stream(object_id, name, channels, kind=1, content=None):
    tlvs = [Tlv.of(1, w.UTF8, name), Tlv.of(100, w.U8, 1), Tlv.of(101, w.RATIONAL_U64, 1, 1000), Tlv.of(103, w.U8, 1), Tlv.of(104, w.U32, channels), Tlv.of(106, w.U8, kind)]
    return SchemaObject(w.STREAM, object_id, tlvs + ([Tlv.of(107, w.UTF8, content)] if content else []))


def channel(object_id, name, stream_id, logical, bits, unit=None, bitfield=None, scale=None, storage=None, elements=None):
    tlvs = [Tlv.of(1, w.UTF8, name), Tlv.of(200, w.U32, stream_id), Tlv.of(201, w.U8, logical), Tlv.of(202, w.U16, bits), Tlv.of(203, w.U16, storage or bits)]
    tlvs += [Tlv.of(204, w.UTF8, unit)] if unit else []
    tlvs += [Tlv.of(207, w.U32, elements)] if elements else []
    tlvs += [Tlv.of(210, w.U32, bitfield)] if bitfield else []
    tlvs += [Tlv.of(211, w.RATIONAL_I64, *scale)] if scale else []
    return SchemaObject(w.CHANNEL, object_id, tlvs)


def schema_record(schema_id, objects, sequence=0):
    header, payload = w.pack_schema(schema_id, 1, objects)
    return Record(w.SCHEMA, 0, sequence, header, payload)


def file(*records):
    return HEADER.pack() + b"".join(r.pack() for r in records)


ADC = [stream(1, "adc", 2), channel(1, "adc0", 1, 1, 12, "code"), channel(2, "adc1", 1, 1, 12, "code")]


def data_record(payload, count, trailing=False, transforms=0, decoded=None, schema=1, stream_id=1, sequence=1, **fields):
    head = DataHeader(schema, 1, stream_id, count, transforms=transforms, decoded_bytes=len(payload) if decoded is None else decoded, **({"start": 1_000_000, "period": (1, 1), "time_mode": 1} | fields))
    return Record(w.DATA, int(trailing), sequence, head.pack(), payload)


def minimal(trailing):
    return file(schema_record(1, ADC), data_record(bytes.fromhex("00f0ff236145bc9a78"), 3, trailing))


def compressed():
    values = [np.array([[256], [257], [255]], np.uint64), np.array([[512], [511], [513]], np.uint64)]
    objects = [stream(1, "compressed_adc", 2), *ADC[1:]]
    from daqframe.schema import Schema

    channels = Schema(2, 1, objects).channels(1)
    ids, payload, decoded = codec.encode(values, b"", channels, 1, 1, "integer")
    return file(schema_record(2, objects), data_record(payload, 3, transforms=len(ids), decoded=decoded, schema=2))


def rational():
    names = ["no_fix", "fix_2d", "fix_3d", "sbas"]
    objects = [
        stream(2, "navigation", 2),
        channel(1, "status", 2, 1, 16, bitfield=1),
        channel(2, "temperature", 2, 2, 16, "degC", scale=(1, 100)),
        SchemaObject(w.VALUE_MAP, 1, [Tlv.of(1, w.UTF8, "GNSS fix status"), *(Tlv.of(400, w.BYTES, pack_map_entry(i, n)) for i, n in enumerate(names))]),
        SchemaObject(w.BITFIELD, 1, [Tlv.of(1, w.UTF8, "navigation status"), Tlv.of(500, w.U16, 16), *(Tlv.of(501, w.BYTES, m) for m in (pack_member(0, 1, "sensor_failure"), pack_member(4, 3, "gnss_fix", 1), pack_member(7, 9, "reserved", reserved=True)))]),
    ]
    return file(schema_record(3, objects), data_record(bytes.fromhex("31000809"), 1, schema=3, stream_id=2, packing=2, time_mode=4, start=0, period=(0, 0)))


def blob(transforms):
    item = w.BlobRecord(bytes.fromhex("aa55010203"), 42, 4, 1, 20, 123456789, transforms)
    return file(schema_record(4, [stream(20, "source_frames", 0, 3, "application/vnd.sbg.ecom")]), item.record(1))


VALID = {
    "minimal-leading": (lambda: minimal(False), 457, "064b7be4c9791f56a7d441736c19894d15e506c5f2197b4aadcbf36a0308c92d"),
    "minimal-trailing": (lambda: minimal(True), 473, "5c740a01e909fb0fd2658c923c23335470feb741c29a4875992c8762f4205c62"),
    "compressed-numeric": (compressed, 516, "cb966d4356f338f675a5989b7c2a20ae7fc17e1e04837ee8ec081227826ed413"),
    "rational-symbolic": (rational, 772, "ccded77039c5f48fe2fa21989b86b5cea4c778ee4aca6a37d97522939a61609d"),
    "blob-uncompressed": (lambda: blob([]), 325, "a1973646dc4b006870975f705c1b7007986c5261bad3334458ed8b6013a8363f"),
    "blob-zstd": (lambda: blob([16]), 346, "562ff80692cffebe20a8d0e005ea4c8dd17b6b44eddfaae9f4ee0ebcc1f702d1"),
}
