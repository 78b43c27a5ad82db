import hashlib
import io
import struct

import numpy as np
import pytest

from daqframe import codec, tables, wire as w
from daqframe.crc import crc32c
from daqframe.schema import FileState, Schema
from daqframe.tables import check_order, decode_bytes
from daqframe.wire import DataHeader, FormatError, Limits, Record, SchemaObject, Tlv, Walk
from tests.engine import files


def rows(data, table="samples", **limits):
    return decode_bytes(data, table, limits=Limits(**limits)).to_pylist()


def repaired(data, offset):
    """The record at offset with its CRCs made right."""
    data = bytearray(data)
    size, payload = struct.unpack_from("<H", data, offset + 8)[0], struct.unpack_from("<Q", data, offset + 16)[0]
    data[offset + 28 : offset + 32] = struct.pack("<I", crc32c(data[offset + size : offset + size + payload]))
    data[offset + 24 : offset + 28] = bytes(4)
    data[offset + 24 : offset + 28] = struct.pack("<I", crc32c(data[offset : offset + size]))
    return bytes(data)


def flipped(data, at, bits=1):
    return data[:at] + bytes([data[at] ^ bits]) + data[at + 1 :]


def second(data):
    """Offset of the record after the schema."""
    return 64 + struct.unpack_from("<H", data, 72)[0] + struct.unpack_from("<Q", data, 80)[0]


@pytest.mark.parametrize("name", files.VALID)
def test_golden_files(name):
    make, size, digest = files.VALID[name]
    data = make()
    assert len(data) == size and hashlib.sha256(data).hexdigest() == digest


def test_golden_values():
    for name in ("minimal-leading", "minimal-trailing"):
        got = rows(files.VALID[name][0]())
        assert [int(r["raw"]) for r in got] == [0, 4095, 291, 1110, 2748, 1929]
        assert [r["time_ticks"] for r in got] == [1000000, 1000000, 1000001, 1000001, 1000002, 1000002]
    assert [int(r["raw"]) for r in rows(files.compressed())] == [256, 512, 257, 511, 255, 513]
    status, temperature = rows(files.rational())
    assert (int(status["raw"]), int(temperature["raw"]), temperature["physical"], temperature["unit"], temperature["time_ticks"]) == (49, 2312, pytest.approx(23.12, abs=1e-12), "degC", None)
    for transforms in ([], [16]):
        (item,) = rows(files.blob(transforms), "blobs")
        assert (item["data"], int(item["item_index"]), item["time_ticks"]) == (bytes.fromhex("aa55010203"), 42, 123456789)


def corrupt():
    leading, trailing, packed, item = files.minimal(False), files.minimal(True), files.compressed(), files.blob([16])
    at = second(leading)
    trailer = second(trailing) + 96 + 9
    overrun = Record(w.SCHEMA, 0, 0, w.SCHEMA_HEADER.pack(9, 1, 1, 0), w.OBJECT_HEADER.pack(2, 0, 12, 20, 1) + w.TLV_HEADER.pack(1, w.UTF8, 0, 10))
    place = second(packed)
    swapped = bytearray(packed)
    swapped[place + 96], swapped[place + 104] = 2, 1
    short = bytearray(item)
    struct.pack_into("<Q", short, second(item) + 64, 6)
    return {
        "file_header_crc": flipped(leading, 56),
        "record_header_crc": flipped(leading, 88),
        "payload_crc": flipped(leading, at + 96),
        "trailer_marker": flipped(trailing, trailer),
        "trailer_sequence": trailing[: trailer + 8] + struct.pack("<I", 99) + trailing[trailer + 12 :],
        "tlv_overrun": files.HEADER.pack() + overrun.pack(),
        "transform_order": repaired(swapped, place),
        "decoded_size": repaired(short, second(item)),
        "reserved_flag": repaired(flipped(leading, at + 6, 2), at),
    }


# fixed values: the SHA-256 of the golden corrupt and truncated files
CORRUPT = {
    "file_header_crc": "ba306a6c667e5e5a6c6b65eab674958b4ae1df34c1282d5583861ec447b99bc8",
    "record_header_crc": "c41798c3586d225bb361f5aac06d72950e88c3fdc5b9a33dbc00b30c1df62c69",
    "payload_crc": "e6a1c2aa8282a978ad0ae0e146623a8b70cb2c3ea8c33e1c55d37925f4ff89c2",
    "trailer_marker": "cc201d7bd2b4c0bc7ca4a89549a3d829c4548243555c504b87e28779b3cb7601",
    "trailer_sequence": "ca93d1f5413fc6bc2fa93ec20f54956f30256e72c63cc2bca211c60b97e47977",
    "tlv_overrun": "b6530824ee1a3f27fb2009990fdbcc8d47c4ba9db7a13afab70c2f90a341c32d",
    "transform_order": "dc653550120ff07f78510c0b57244de1f1dac1a028c05e11f5d5f1ebbcca1416",
    "decoded_size": "9f42b741b3515703442d119743fe7e4cf264c56e9d09fcc4ae1dbad827ca0473",
    "reserved_flag": "bef553b9bb7b472e09dc76d266b47246e98b506b705d39edd4c9b737282487c8",
    "truncated_final_header": "fa66771d23fd08c4c0a6777d0f6bdf5937ada461ef2bde87b85c2766285353e8",
    "truncated_final_payload": "a58236fd1d4fd7ad38a5a32dc14e5ce75bf9b3b31ef7fecfd2cf2fec378f7fbb",
}


def test_corrupt_and_truncated_files_are_the_golden_ones():
    data = files.minimal(False)
    made = corrupt() | {"truncated_final_header": data + bytes.fromhex("53445243 0200 0000 6000 01 00"), "truncated_final_payload": data[:-2]}
    assert {reason: hashlib.sha256(x).hexdigest() for reason, x in made.items()} == CORRUPT


@pytest.mark.parametrize("reason", corrupt())
def test_corrupt_files(reason):
    with pytest.raises(FormatError) as e:
        rows(corrupt()[reason])
    assert e.value.reason == reason and e.value.status == "FORMAT"


def test_truncated_tails():
    data = files.minimal(False)
    walk = Walk(io.BytesIO(data + bytes.fromhex("53445243 0200 0000 6000 01 00")))
    assert len(list(walk)) == 2 and walk.truncated == "truncated_final_header"
    walk = Walk(io.BytesIO(data[:-2]))
    assert len(list(walk)) == 1 and walk.truncated == "truncated_final_payload"


def test_corrupt_header_of_a_short_tail_is_an_error():
    data = files.minimal(False)
    with pytest.raises(FormatError, match="record_header_crc"):
        list(Walk(io.BytesIO(flipped(data, second(data) + 40)[:-2])))


def test_recovery():
    data = files.minimal(False)
    at = second(data)
    walk = Walk(io.BytesIO(data[:at] + b"garbage SDRC more" + data[at:]), recover=True)
    assert [r.type for r in walk] == [w.SCHEMA, w.DATA] and [e.offset for e in walk.errors] == [at]


def test_limits():
    with pytest.raises(FormatError) as e:
        rows(files.minimal(False), payload=8)
    assert e.value.status == "LIMIT"
    with pytest.raises(FormatError) as e:
        rows(files.minimal(False), records=1)
    assert e.value.status == "LIMIT"


# --- byte vectors of the format ---


def channels(*specs):
    return [codec.Channel(i + 1, f"c{i}", logical, bits, storage, *rest) for i, (logical, bits, storage, *rest) in enumerate(specs)]


def test_packing_vectors():
    u12 = channels((1, 12, 12))
    assert codec.write_canonical([np.array([[0xABC], [0x123]], np.uint64)], u12, 1, 1) == bytes.fromhex("bc3a12")
    assert codec.write_canonical([np.array([[0xABC], [0x123]], np.uint64)], channels((1, 12, 16)), 1, 2) == bytes.fromhex("bc0a2301")
    signed = np.array([[-1], [-2048], [2047]]).astype(np.uint64) & np.uint64(0xFFF)
    assert codec.write_canonical([signed], channels((2, 12, 12)), 1, 1) == bytes.fromhex("ff0f80ff07")
    got = codec.read_canonical(bytes.fromhex("ff0f80ff07"), channels((2, 12, 12)), 3, 1, 1)
    assert list(codec.numeric(channels((2, 12, 12))[0], got[0][:, 0])) == [-1, -2048, 2047]


def test_delta_time_vector():
    head = DataHeader(1, 1, 1, 3, start=1_000_000, time_mode=2, layout=2, time_bytes=24, decoded_bytes=30)
    payload = bytes.fromhex("0000000000000000 6500000000000000 cd00000000000000 08090a090709")
    times, values = codec.decode(payload, head, channels((2, 16, 16, 1, "degC", 0.01)))
    assert list(times) == [1000000, 1000101, 1000205]
    assert codec.physical(channels((2, 16, 16, 1, "degC", 0.01))[0], values[0][:, 0]) == pytest.approx([23.12, 23.14, 23.11])


def test_integer_profile_vector():
    two = [np.array([[0x100], [0x101], [0x0FF]], np.uint64), np.array([[0x200], [0x1FF], [0x201]], np.uint64)]
    changed = [codec.zigzag((v - np.concatenate([[[np.uint64(0)]], v[:-1]])) & codec.mask(12), 12) for v in two]
    assert [int(x) for x in codec.in_layout(changed, 1)] == [0x200, 0x400, 2, 1, 3, 4]
    assert codec.shuffle(codec.in_layout(changed, 1), 2) == bytes.fromhex("000002010304020400000000")


def test_bitwise_words_are_exact():
    words = np.array([0x8000000000000000, 0x7FF8000000001234, 1, 0x7FF0000000000000], np.uint64).reshape(-1, 1)
    ids, payload, size = codec.encode([words], b"", channels((3, 64, 64)), 1, 1, "bitwise")
    head = DataHeader(1, 1, 1, 4, transforms=len(ids), decoded_bytes=size)
    assert (codec.decode(payload, head, channels((3, 64, 64)))[1][0] == words).all()


def test_text_and_note_and_private():
    text = w.TextRecord("µ warning", 5, 4, source_id=3, event_code=-7)
    data = files.HEADER.pack() + text.record(0).pack() + Record(w.NOTE, 0, 1, b"", "note".encode()).pack() + Record(0x8001, 0, 2, b"abcd", b"xyz").pack() + w.end_record(4, 0, 0, 3).pack()
    assert [(r["message"], r["severity"], r["source_id"], r["event_code"]) for r in rows(data, "text")] == [("µ warning", 4, 3, -7)]
    assert [r["message"] for r in rows(data, "notes")] == ["note"]
    assert [(r["type"], r["payload"], r["decoded"]) for r in rows(data, "records")][2] == ("0x8001", b"xyz", False)


@pytest.mark.parametrize("mode,start,time_bytes,area,want", [(3, 0, 16, struct.pack("<qq", -5, 25), [-5, 25]), (2, 100, 16, struct.pack("<qq", 0, 7), [100, 107]), (4, 0, 0, b"", None)])
def test_time_modes(mode, start, time_bytes, area, want):
    head = DataHeader(1, 1, 1, 2, start=start, time_mode=mode, time_bytes=time_bytes, decoded_bytes=time_bytes + 2)
    times, values = codec.decode(area + b"\1\2", head, channels((1, 8, 8)))
    assert (times is None and want is None) or list(times) == want


def test_time_overflow_and_padding():
    with pytest.raises(FormatError, match="timestamp_overflow"):
        codec.ticks(DataHeader(1, 1, 1, 3, start=2**63 - 2, period=(1, 1), time_mode=1), b"")
    with pytest.raises(FormatError, match="padding"):
        codec.read_canonical(b"\xfe", channels((4, 1, 1)), 1, 1, 1)
    with pytest.raises(FormatError, match="high_bits"):
        codec.read_canonical(b"\xbc\x1a", channels((1, 12, 16)), 1, 1, 2)
    assert list(codec.ticks(DataHeader(1, 1, 1, 3, start=10, period=(2**64 - 1, 2**63), time_mode=1), b"")) == [10, 11, 13]


@pytest.mark.parametrize("seed", range(40))
def test_random_round_trips(seed):
    rng = np.random.default_rng(seed)
    count, layout, packing = int(rng.integers(0, 700)), int(rng.integers(1, 3)), int(rng.integers(1, 3))
    kind = ["identity", "zstd", "integer", "bitwise"][seed % 4]
    if kind == "integer":
        bits = int(rng.integers(1, 65))
        specs = [(int(rng.integers(1, 3)), bits, int(rng.integers(bits, 65)), int(rng.integers(1, 4))) for _ in range(int(rng.integers(1, 4)))]
    elif kind == "bitwise":
        bits = int(rng.choice([32, 64]))
        specs = [(3, bits, bits, int(rng.integers(1, 4))) for _ in range(2)]
    else:
        specs = []
        for _ in range(int(rng.integers(1, 5))):
            logical, bits = int(rng.integers(1, 6)), int(rng.integers(1, 65))
            storage = {3: 64, 4: 1, 5: 8 * int(rng.integers(1, 20))}.get(logical, int(rng.integers(bits, 65)))
            specs.append((logical, {3: 64, 4: 1, 5: storage}.get(logical, bits), storage, int(rng.integers(1, 4))))
    given = channels(*specs)
    values = [rng.integers(0, 256, (count, c.elements, c.storage_bits // 8), dtype=np.uint8) if c.logical == 5 else rng.integers(0, 2**64, (count, c.elements), dtype=np.uint64) & codec.mask(c.logical_bits) for c in given]
    times = rng.integers(-(2**60), 2**60, count)
    ids, payload, size = codec.encode(values, times.astype("<i8").tobytes(), given, layout, packing, kind)
    head = DataHeader(1, 1, 1, count, time_mode=3, layout=layout, packing=packing, transforms=len(ids), time_bytes=8 * count, decoded_bytes=size)
    got_times, got = codec.decode(payload, head, given)
    assert (got_times == times).all() and all((a == b).all() for a, b in zip(got, values))


def test_bit_planes_and_blocks():
    values = np.random.default_rng(1).integers(0, 4096, 1000, dtype=np.uint64)
    assert (codec.from_bit_planes(codec.bit_planes(values, 12), 12, 1000) == values).all()
    for block in (64, 128, 256):
        assert (codec.unshuffle(codec.shuffle(values, 2, block), 2, 1000, block) == values).all()


# --- schema rules ---


def revision(*objects):
    Schema(1, 1, list(objects)).check()


def test_schema_rules():
    stream, adc0, adc1 = files.ADC
    revision(stream, adc0, adc1)
    bad = [
        ("object_duplicate", (stream, adc0, adc0)),
        ("stream_channels", (stream, adc0)),
        ("reference", (stream, adc0, files.channel(2, "x", 9, 1, 12))),
        ("channel_type", (stream, adc0, files.channel(2, "x", 1, 1, 65))),
        ("tag_duplicate", (SchemaObject(w.STREAM, 1, [*stream.tlvs, stream.tlvs[0]]), adc0, adc1)),
        ("tag_wire", (SchemaObject(w.STREAM, 1, [Tlv.of(106, w.U16, 1)]),)),
        ("stream_content_type", (files.stream(1, "items", 0, 3),)),
        ("value_map_unique", (SchemaObject(w.VALUE_MAP, 1, [Tlv.of(400, w.BYTES, files.pack_map_entry(i, "same")) for i in range(2)]),)),
        ("bitfield_overlap", (SchemaObject(w.BITFIELD, 1, [Tlv.of(500, w.U16, 8), Tlv.of(501, w.BYTES, files.pack_member(0, 3, "a")), Tlv.of(501, w.BYTES, files.pack_member(2, 1, "b"))]),)),
        ("bitfield_range", (SchemaObject(w.BITFIELD, 1, [Tlv.of(500, w.U16, 8), Tlv.of(501, w.BYTES, files.pack_member(6, 3, "a"))]),)),
        ("clock_fields", (SchemaObject(w.CLOCK, 1, [Tlv.of(300, w.U8, 1)]),)),
        ("scale_twice", (files.stream(1, "s", 1), SchemaObject(w.CHANNEL, 1, [*files.channel(1, "x", 1, 1, 12, scale=(1, 2)).tlvs, Tlv.of(205, w.F64, 0.5)]))),
        ("stream_correlation", (files.stream(1, "s", 0, 4),)),
    ]
    for reason, objects in bad:
        with pytest.raises(FormatError) as e:
            revision(*objects)
        assert e.value.reason == reason


def test_order_across_records():
    header = files.schema_record(1, files.ADC)
    item = files.data_record(bytes.fromhex("00f0ff236145bc9a78"), 3)
    at = 64 + len(header.pack())

    def check(*records):
        state, data = FileState(), files.file(*records)
        for r in Walk(io.BytesIO(data)):
            check_order(r, state, Limits())

    check(header, item, w.index_record([(at, 1, 1, 0, 3, 1000000, 1000002)], 2), w.end_record(4, 1, at + len(item.pack()), 3))
    for reason, records in {
        "index_offset": (header, item, w.index_record([(at + 1, 1, 1, 0, 3, 0, 0)], 2)),
        "index_entry": (header, item, w.index_record([(at, 1, 1, 0, 4, 0, 0)], 2)),
        "end_totals": (header, item, w.end_record(9, 1, 0, 2)),
        "end_index": (header, item, w.end_record(3, 1, at, 2)),
        "schema_redefined": (header, files.schema_record(1, files.ADC[:1] + [files.ADC[1], files.channel(2, "other", 1, 1, 12)], 1)),
        "item_order": (files.schema_record(4, [files.stream(20, "f", 0, 3, "x/y")]), *(w.BlobRecord(b"a", 5, 4, 1, 20).record(k + 1) for k in range(2))),
    }.items():
        with pytest.raises(FormatError) as e:
            check(*records)
        assert e.value.reason == reason


def test_unseen_schema_stays_opaque():
    data = files.file(files.data_record(bytes.fromhex("00f0ff236145bc9a78"), 3))
    assert rows(data) == [] and rows(data, "records")[0]["decoded"] is False
    assert tables.decode_bytes(data, "records").num_rows == 1
