"""One test for each choice where readers of the format differ."""

import io

import numpy as np
import pytest

from daqframe import codec, wire as w
from daqframe.schema import FileState, Schema
from daqframe.sources.export import to_json
from daqframe.tables import decode_bytes
from daqframe.wire import DataHeader, FormatError, Limits, Record, SchemaObject, Tlv, Walk
from tests.engine import files

PAYLOAD = bytes.fromhex("00f0ff236145bc9a78")


def rows(data, table="samples"):
    return decode_bytes(data, table).to_pylist()


def test_illegal_chain_is_an_error_without_a_schema():
    record = files.data_record(w.pack_descriptors([2, 1, 3, 16]) + PAYLOAD, 3, transforms=4, decoded=9, schema=77)
    with pytest.raises(FormatError, match="transform_order"):
        rows(files.file(record))


def test_unsupported_transform_stays_opaque():
    record = files.data_record(w.pack_descriptors([17]) + PAYLOAD, 3, transforms=1, decoded=9)
    data = files.file(files.schema_record(1, files.ADC), record)
    assert rows(data) == [] and [r["decoded"] for r in rows(data, "records")] == [True, False]


def test_unsigned_values_have_one_raw_form():
    objects = [files.stream(1, "s", 1), files.channel(1, "x", 1, 1, 64)]
    data = files.file(files.schema_record(1, objects), files.data_record(b"\xff" * 8, 1))
    (row,) = rows(data)
    assert int(row["raw"]) == 2**64 - 1 and row["numeric"] == float(2**64 - 1) and row["raw_bits"] == -1


def test_default_names():
    bare = SchemaObject(w.CHANNEL, 7, [t for t in files.ADC[1].tlvs if t.tag != 1])
    assert Schema(1, 1, [files.ADC[0], bare]).channel(bare).name == "channel_7"


def test_sample_index_overflow():
    with pytest.raises(FormatError, match="sample_index"):
        rows(files.file(files.schema_record(1, files.ADC), files.data_record(PAYLOAD, 3, first_index=2**64 - 2)))
    data = files.file(files.schema_record(1, files.ADC), files.data_record(PAYLOAD, 3, first_index=2**64 - 3))
    assert max(int(r["sample_index"]) for r in rows(data)) == 2**64 - 1


def test_identical_schemas_may_repeat():
    data = files.file(files.schema_record(1, files.ADC), files.schema_record(1, files.ADC, 1), files.data_record(PAYLOAD, 3, sequence=2))
    assert len(rows(data)) == 6


def test_clock_agreement_and_clock_zero():
    clock = SchemaObject(w.CLOCK, 3, [Tlv.of(300, w.U8, 2), Tlv.of(301, w.RATIONAL_U64, 1, 1000)])

    def stream(clock_id, domain, unit):
        return SchemaObject(w.STREAM, 1, [Tlv.of(100, w.U8, domain), Tlv.of(101, w.RATIONAL_U64, *unit), Tlv.of(105, w.U32, clock_id)])

    Schema(1, 1, [stream(3, 2, (2, 2000)), clock]).check()
    Schema(1, 1, [stream(0, 1, (1, 1)), clock]).check()
    for bad in (stream(3, 1, (1, 1000)), stream(3, 2, (1, 999)), stream(4, 2, (1, 1000))):
        with pytest.raises(FormatError):
            Schema(1, 1, [bad, clock]).check()


def test_correlation_streams():
    clocks = [SchemaObject(w.CLOCK, i, [Tlv.of(300, w.U8, 2), Tlv.of(301, w.RATIONAL_U64, 1, 1000)]) for i in (1, 2)]
    stream = SchemaObject(w.STREAM, 1, [Tlv.of(106, w.U8, 4), Tlv.of(108, w.U32, 1), Tlv.of(109, w.U32, 2)])

    def ticks(i, semantic, logical=2):
        o = files.channel(i, semantic, 1, logical, 64)
        return SchemaObject(w.CHANNEL, i, [*o.tlvs, Tlv.of(208, w.UTF8, semantic)])

    Schema(1, 1, [*clocks, stream, ticks(1, "clock.source_ticks"), ticks(2, "clock.target_ticks")]).check()
    for channels in ([ticks(1, "clock.source_ticks")], [ticks(1, "clock.source_ticks"), ticks(2, "clock.target_ticks", 1)]):
        with pytest.raises(FormatError, match="stream_correlation"):
            Schema(1, 1, [*clocks, stream, *channels]).check()


def test_writer_checks_schemas_and_item_order(tmp_path):
    from daqframe.sources.daq import FileBuilder

    build = FileBuilder(io.BytesIO())
    with pytest.raises(FormatError):
        build.schema(1, 1, [files.channel(1, "x", 9, 1, 12)])


def test_writer_stores_what_does_not_compress():
    from daqframe.sources.daq import FileBuilder

    out = io.BytesIO()
    build = FileBuilder(out)
    objects = [files.stream(1, "s", 1), files.channel(1, "x", 1, 1, 64)]
    build.schema(1, 1, objects)
    values = np.random.default_rng(1).integers(0, 2**64, (50, 1), dtype=np.uint64)
    build.table(DataHeader(1, 1, 1, 50), [values], Schema(1, 1, objects).channels(1), "zstd")
    build.close()
    records = list(Walk(io.BytesIO(out.getvalue())))
    assert DataHeader.parse(records[1]).transforms == 0
    assert [int(r["raw"]) for r in rows(out.getvalue())] == values.ravel().tolist()


def test_json_null_for_what_json_lacks():
    assert "null" in to_json([float("inf")])


def test_text_rules():
    good = w.TextRecord("a", 1, 2, source_id=0, event_code=0)
    assert rows(files.HEADER.pack() + good.record(0).pack(), "text")[0]["source_id"] == 0
    for bad in (Record(w.TEXT, 0, 0, w.TEXT_HEADER.pack(0, 0, 0, 2, 1, 0, 5, 0, 0), b"a"), Record(w.TEXT, 0, 0, w.TEXT_HEADER.pack(0, 0, 0, 9, 1, 0, 0, 0, 0), b"a"), Record(w.TEXT, 0, 0, w.TEXT_HEADER.pack(1, 0, 0, 2, 1, 0, 0, 0, 0), b"a"), Record(w.TEXT, 0, 0, w.TEXT_HEADER.pack(0, 0, 0, 2, 1, 0, 0, 0, 0), b"\xff")):
        with pytest.raises(FormatError):
            rows(files.HEADER.pack() + bad.pack(), "text")


def test_wrong_stream_kind():
    data = files.file(files.schema_record(4, [files.stream(20, "f", 0, 3, "x/y")]), files.data_record(b"", 0, schema=4, stream_id=20))
    with pytest.raises(FormatError, match="stream_kind"):
        rows(data)


def test_mixed_aligned_channels_and_fixed_bytes():
    objects = [files.stream(1, "s", 4), files.channel(1, "i", 1, 2, 12, storage=16), files.channel(2, "f", 1, 3, 32), files.channel(3, "b", 1, 4, 1), files.channel(4, "x", 1, 5, 128)]
    body = b"\xff\xff" + np.float32(1.5).tobytes() + b"\1" + bytes(range(16))
    data = files.file(files.schema_record(1, objects), files.data_record(body, 1, packing=2))
    i, f, b, x = rows(data)
    assert (int(i["raw"]), f["numeric"], int(b["raw"]), x["raw_bytes"], x["raw"]) == (-1, 1.5, 1, bytes(range(16)), None)


def test_planar():
    objects = [files.stream(1, "s", 2), files.channel(1, "a", 1, 1, 8), files.channel(2, "b", 1, 1, 8)]
    data = files.file(files.schema_record(1, objects), files.data_record(bytes.fromhex("01020a14"), 2, layout=2))
    assert [int(r["raw"]) for r in rows(data)] == [1, 10, 2, 20]


def test_elements_are_lanes():
    channels = [codec.Channel(1, "v", codec.SIGNED, 16, 16, 3)]
    values = [np.array([[1, 100, 1000], [2, 101, 999]], np.uint64)]
    ids, payload, size = codec.encode(values, b"", channels, 1, 1, "integer")
    _, got = codec.decode(payload, DataHeader(1, 1, 1, 2, transforms=4, decoded_bytes=size), channels)
    assert (got[0] == values[0]).all() and ids == [1, 2, 3, 16]


def test_state_counts_unknown_records():
    data = files.HEADER.pack() + Record(0x9000, 0, 0, b"", b"private").pack() + w.end_record(2, 0, 0, 1).pack()
    state = FileState(Limits())
    for r in Walk(io.BytesIO(data)):
        state.see(r)
    assert state.total == 2
