import io
import json
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daqframe import cli, sources, streaming, tables, wire as w
from daqframe.sources import export
from daqframe.sources.daq import DaqReader, FileBuilder, Options, Pruning
from tests.engine import files
from tests.engine.test_files import corrupt, flipped, second

GOLDEN_LINE = "1,1,2,1000002,2,adc1,0,1929,1929,code"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    sources.register(spark)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    for name, (make, _, _) in files.VALID.items():
        (path / f"{name}.daq").write_bytes(make())
    return path


def test_tables(spark, folder):
    count = {t: sources.read(spark, str(folder), t).count() for t in ("samples", "records", "files", "blobs", "objects", "channels", "streams", "value_map_entries", "bitfield_members", "errors")}
    assert count == {"samples": 20, "records": 12, "files": 6, "blobs": 2, "objects": 16, "channels": 8, "streams": 6, "value_map_entries": 4, "bitfield_members": 3, "errors": 0}


def test_same_rows_through_binary_files(spark, folder):
    a = sources.read(spark, f"{folder}/*.daq").drop("path")
    b = sources.read_binary(spark, str(folder)).drop("path")
    assert sorted(a.collect()) == sorted(b.collect())


def test_modes(spark, tmp_path):
    data = files.minimal(False)
    two = data + files.data_record(bytes.fromhex("00f0ff236145bc9a78"), 3, sequence=2).pack()
    bad = flipped(two, second(two) + 96)
    path = tmp_path / "bad.daq"
    path.write_bytes(bad)
    with pytest.raises(Exception, match="payload_crc"):
        sources.read(spark, str(path)).count()
    assert sources.read(spark, str(path), mode="DROPTAIL").count() == 0
    assert sources.read(spark, str(path), mode="RECOVER").count() == 6
    (error,) = sources.read(spark, str(path), "errors", mode="PERMISSIVE").collect()
    assert (error.reason, error.status, error.record_offset) == ("payload_crc", "FORMAT", second(two))
    # only payloads are wrong: headers alone don't tell
    assert sources.read(spark, str(path), "files").collect()[0].status == "ok"
    assert sources.read(spark, str(path), "files", mode="DROPTAIL").collect()[0].status == "FORMAT"


def test_corrupt_files_are_told(spark, tmp_path):
    for reason, data in corrupt().items():
        (tmp_path / f"{reason}.daq").write_bytes(data)
    told = {r.path.rsplit("/", 1)[1][:-4]: r.reason for r in sources.read(spark, str(tmp_path), "errors", mode="PERMISSIVE").collect()}
    assert told == {r: r for r in corrupt()}


def test_limits_and_channels(spark, folder):
    path = f"{folder}/minimal-leading.daq"
    assert sources.read(spark, path, channels="2").count() == 3
    (error,) = sources.read(spark, path, "errors", mode="PERMISSIVE", maxPayload="8").collect()
    assert error.status == "LIMIT"


def test_pruning_skips_records(spark, tmp_path):
    path = tmp_path / "many.daq"
    with path.open("wb") as out:
        build = FileBuilder(out)
        objects = [files.stream(1, "s", 1), files.channel(1, "x", 1, 1, 16)]
        build.schema(1, 1, objects)
        from daqframe.schema import Schema

        channels = Schema(1, 1, objects).channels(1)
        for i in range(10):
            build.table(w.DataHeader(1, 1, 1, 100, 100 * i, 1000 * i, (10, 1), 1), [np.arange(100, dtype=np.uint64).reshape(-1, 1)], channels, "identity")
        build.close()
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    pruning = Pruning()
    pruning.take(GreaterThanOrEqual(("sample_index",), 250))
    pruning.take(LessThan(("sample_index",), 410))
    reader = DaqReader(Options(str(path)))
    reader.pruning = pruning
    assert sum(reader._uses(record) for record in w.Walk(path.open("rb"), wanted=lambda r: False)) == 3
    got = sources.read(spark, str(path)).where("sample_index >= 250 and sample_index < 410")
    assert got.count() == 160
    assert sources.read(spark, str(path), partitionBytes="1").rdd.getNumPartitions() >= 10
    entries = sources.read(spark, str(path), "index_entries").orderBy("entry").collect()
    assert [(int(e.first_index), e["count"], e.first_time_ticks, e.last_time_ticks) for e in entries][:2] == [(0, 100, 0, 990), (100, 100, 1000, 1990)]
    end = sources.read(spark, str(path), "end_records").collect()[0]
    assert (end.total_records, end.data_records) == (13, 10)


class Watched:
    """A file system whose files count the bytes that are read from them."""

    def __init__(self, fs):
        self.fs, self.opened, self.bytes = fs, 0, 0

    def get_file_info(self, x):
        return self.fs.get_file_info(x)

    def open_input_file(self, path):
        self.opened += 1
        file, outer = self.fs.open_input_file(path), self

        class Counted:
            def __enter__(self):
                return self

            def __exit__(self, *x):
                file.close()

            def read(self, n=None):
                data = file.read(n)
                outer.bytes += len(data)
                return data

            def __getattr__(self, name):
                return getattr(file, name)

        return Counted()


def big_log(path, records=40, embedded=b""):
    """Blobs of 5,000 bytes whose payloads hold a whole log file themselves, between rows of samples."""
    from daqframe.schema import Schema

    inner = files.minimal(False)
    with path.open("wb") as out:
        build = FileBuilder(out)
        objects = [files.stream(1, "s", 1), files.channel(1, "x", 1, 1, 16), files.stream(2, "items", 0, 3, "x/y")]
        build.schema(1, 1, objects)
        channels = Schema(1, 1, objects).channels(1)
        for i in range(records):
            build.add(w.BlobRecord((inner + bytes([i])) * 10, i, 1, 1, 2).record(0))
            build.table(w.DataHeader(1, 1, 1, 10, 10 * i), [np.full((10, 1), i, np.uint64)], channels, "identity")
        build.close()


@pytest.mark.parametrize("mode", ["FAILFAST", "DROPTAIL", "PERMISSIVE", "RECOVER"])
def test_scan_is_dealt_to_tasks(spark, tmp_path, monkeypatch, mode):
    """The driver opens no file; parts of a file meet every record once, whatever payloads hold."""
    from daqframe.sources import daq

    path = tmp_path / "big.daq"
    big_log(path)
    real = daq.store(str(path))[0]
    for table, want in (("samples", 400), ("blobs", 40), ("records", 83), ("channels", 1), ("files", 1)):
        options = Options(str(path), table, mode, partition_bytes=3000)
        watched = Watched(real)
        monkeypatch.setattr(daq, "store", lambda p: (watched, p))
        reader = DaqReader(options)
        runs = reader.partitions()
        assert watched.opened == 0
        if mode in ("FAILFAST", "RECOVER") and table != "files":
            assert len(runs) > 20
        assert sum(b.num_rows for r in runs for b in reader.read(r)) == want
        if table == "channels" and mode == "FAILFAST":
            watched.bytes = 0
            list(reader.read(runs[-1]))
            assert watched.bytes < 40 * 300  # headers alone
    monkeypatch.undo()
    got = sources.read(spark, str(path), "samples", mode=mode, partitionBytes="3000")
    assert got.groupBy("raw").count().where("count = 10").count() == 40
    if mode in ("FAILFAST", "RECOVER"):
        assert got.rdd.getNumPartitions() > 20


def test_later_parts_know_earlier_schemas_and_order(spark, tmp_path):
    """A record out of order is told though it lies in another part than what it breaks with."""
    path = tmp_path / "order.daq"
    with path.open("wb") as out:
        build = FileBuilder(out)
        build.schema(1, 1, [files.stream(2, "items", 0, 3, "x/y")])
        for i in (0, 1, 2, 3, 3):
            build.add(w.BlobRecord(bytes(4000), i, 1, 1, 2).record(0))
        build.close()
    with pytest.raises(Exception, match="item_order"):
        sources.read(spark, str(path), "blobs", partitionBytes="3000").count()
    assert sources.read(spark, str(path), "blobs", mode="DROPTAIL").count() == 4


@pytest.mark.parametrize("options", [{}, {"compression": "identity", "trailer": "true"}, {"compression": "integer", "layout": "planar", "chunk": "100"}])
def test_writer(spark, tmp_path, options):
    rows = spark.range(1000).select((F.col("id") - 500).alias("a"), (F.col("id") % 7).cast("int").alias("b"), F.col("id").alias("time_ticks"))
    if options.get("compression") == "integer":
        rows = rows.drop("b")
    rows.write.format("daq").mode("append").options(**options).save(str(tmp_path / "out"))
    back = sources.read(spark, str(tmp_path / "out")).where("channel_name = 'a'").select(F.col("raw").cast("long"), "time_ticks")
    assert sorted(map(tuple, back.collect())) == [(i - 500, i) for i in range(1000)]
    rows.limit(5).write.format("daq").mode("overwrite").options(**options).save(str(tmp_path / "out"))
    assert sources.read(spark, str(tmp_path / "out")).where("channel_name = 'a'").count() == 5


def test_writer_refuses_text_and_nulls(spark, tmp_path):
    with pytest.raises(Exception, match="neither numbers"):
        spark.createDataFrame([("a",)], "x string").write.format("daq").mode("append").save(str(tmp_path / "a"))
    with pytest.raises(Exception, match="null"):
        spark.createDataFrame([(None,)], "x long").write.format("daq").mode("append").save(str(tmp_path / "b"))


def test_stream_waits_for_whole_records(spark, tmp_path):
    path, name = tmp_path / "in", "grown"
    path.mkdir()
    data = files.minimal(False)
    (path / "a.daq").write_bytes(data[:-2])
    query = spark.readStream.format("daq").load(str(path)).writeStream.format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
        assert spark.table(name).count() == 0
        (path / "a.daq").write_bytes(data + files.data_record(bytes.fromhex("00f0ff236145bc9a78"), 3, sequence=2).pack())
        query.processAllAvailable()
        assert spark.table(name).count() == 12
        (path / "b.daq").write_bytes(files.minimal(True))
        query.processAllAvailable()
        assert spark.table(name).count() == 18
    finally:
        query.stop()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    path, checkpoint, out = tmp_path / "in", str(tmp_path / "checkpoint"), str(tmp_path / "out")
    path.mkdir()
    data = files.minimal(False)
    for grown, want in ((data, 6), (data + files.data_record(bytes.fromhex("00f0ff236145bc9a78"), 3, sequence=2).pack(), 12)):
        (path / "a.daq").write_bytes(grown)
        query = spark.readStream.format("daq").option("partitionBytes", "1").load(str(path)).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        assert spark.read.parquet(out).count() == want


def test_stream_takes_a_bounded_number_of_bytes(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    big_log(path / "a.daq")
    stream = spark.readStream.format("daq").option("maxBytesPerTrigger", "60000").option("partitionBytes", "9000").load(str(path))
    query = stream.writeStream.format("memory").queryName("bounded").start()
    try:
        query.processAllAvailable()
        assert spark.table("bounded").count() == 400
        assert len([p for p in query.recentProgress if p.numInputRows]) >= 3
    finally:
        query.stop()


def test_stream_order_violations(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 2, 2), (2, 5, 3), (2, 4, 4)], "stream long, item long, position long")
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
    bad = streaming.memory_table(streaming.order_violations(stream, ["stream"], "item"), "bad_items", "append")
    assert sorted(map(tuple, bad.collect())) == [(1, 2), (2, 4)]


def test_stream_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("a", 5), ("a", 100), ("b", 7)], "k string, s long").select("k", F.timestamp_seconds("s").alias("t"))
    rows.write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
    got = streaming.memory_table(streaming.gaps(stream, "t", ["k"], "10 seconds"), "sessions_found", "complete")
    assert sorted((r.k, r.n) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1)]


# --- exports ---


def test_exports(spark, folder, tmp_path):
    samples = sources.read(spark, f"{folder}/minimal-leading.daq")
    assert GOLDEN_LINE in [r.line for r in export.csv_lines(samples).collect()]
    export.write_csv(samples, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part*")))
    assert text.split("\n")[0] == export.CSV_HEADER and GOLDEN_LINE in text.split("\n")
    lines = [json.loads(r.line) for r in export.json_lines(samples).collect()]
    assert sorted(x["raw"] for x in lines) == sorted(["0", "4095", "291", "1110", "2748", "1929"])
    items = [r["item"] for r in export.cbor_items(samples).collect()]
    assert len(items) == 6 and all(i[0] == 0xA9 for i in items)


def test_cbor_heads():
    assert export.cbor(23) == b"\x17" and export.cbor(24) == b"\x18\x18" and export.cbor(256) == b"\x19\x01\x00" and export.cbor(-1) == b"\x20"
    assert export.cbor(1 << 32) == b"\x1b\0\0\0\1\0\0\0\0" and export.cbor(65536) == b"\x1a\0\1\0\0"
    assert export.cbor([1, "a", b"b", None, True, 1.5]) == bytes.fromhex("8601616141 62f6f5fb3ff8000000000000".replace(" ", ""))


def test_json_has_no_numbers_that_json_lacks(spark):
    assert json.loads(export.to_json({"a": float("nan"), "b": b"\1", "c": [1.5]})) == {"a": None, "b": "AQ==", "c": [1.5]}


def test_cli(folder, tmp_path, capsysbinary):
    path = str(folder / "minimal-leading.daq")
    assert cli.main(["decode", path, "--format", "csv"]) == 0
    assert GOLDEN_LINE in capsysbinary.readouterr().out.decode().split("\n")
    assert cli.main(["decode", path, "--format", "cbor", "-o", str(tmp_path / "x.cbor")]) == 0
    assert (tmp_path / "x.cbor").read_bytes()[0] == 0xA2
    assert cli.main(["decode", path]) == 0
    assert 4095 in [s["raw"] for r in json.loads(capsysbinary.readouterr().out)["records"] for s in r.get("samples", [])]
    assert cli.main(["decode", path, "--format", "xml"]) == 2
    assert cli.main(["decode", str(tmp_path / "none.daq")]) == 1
    assert cli.main([path, "-f", "CSV", "--output", str(tmp_path / "x.csv")]) == 0
    assert GOLDEN_LINE in (tmp_path / "x.csv").read_text().split("\n")
    for args, code in ((["--help"], 0), ([path, "-h"], 0), ([], 2), (["decode"], 2), ([path, "-f"], 2), ([path, "--what", "x"], 2), (["-f", "csv", path], 2)):
        assert cli.main(args) == code


def write(rows, path, mode="append", **options):
    rows.write.format("daq").mode(mode).options(**options).save(str(path))


def test_items_and_texts_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([(1, 4, 3, -7, "µ warning"), (2, 0, None, None, "")], "time_ticks long, severity int, source_id long, event_code int, message string")
    write(texts, tmp_path / "t", table="text", trailer="true")
    assert sorted(map(str, sources.read(spark, str(tmp_path / "t"), "text").select(*texts.columns).collect())) == sorted(map(str, texts.collect()))
    items = spark.createDataFrame([(1, 5, b"a" * 1000), (7, None, b"")], "item_index long, time_ticks long, data binary").coalesce(1)
    for compression in ("zstd", "identity"):
        write(items, tmp_path / compression, table="blobs", compression=compression, contentType="x/y")
        got = sources.read(spark, str(tmp_path / compression), "blobs").select(F.col("item_index").cast("long").alias("item_index"), "time_ticks", "data")
        assert sorted(map(str, got.collect())) == sorted(map(str, items.collect()))
        (entry, *_) = sources.read(spark, str(tmp_path / compression), "index_entries").collect()
        assert (int(entry.first_index), entry["count"]) == (1, 1)
    notes = spark.createDataFrame([("a note",)], "message string")
    write(notes, tmp_path / "n", table="notes")
    assert [r.message for r in sources.read(spark, str(tmp_path / "n"), "notes").collect()] == ["a note"]
    private = spark.createDataFrame([(0x8001, b"\1\2", b"body")], "type_id int, type_header binary, payload binary")
    write(private, tmp_path / "p", table="records")
    (r,) = sources.read(spark, str(tmp_path / "p"), "records").where("type_id > 32768").collect()
    assert (r.type, bytes(r.type_header), bytes(r.payload), r.decoded) == ("0x8001", b"\1\2", b"body", False)


@pytest.mark.parametrize("layout", ["interleaved", "planar"])
@pytest.mark.parametrize("packing", ["dense", "aligned"])
@pytest.mark.parametrize("compression", ["identity", "zstd"])
def test_widths_and_layouts(spark, tmp_path, layout, packing, compression):
    """Channels of every width from 1 to 64, signed and unsigned, at both ends of their range, without a session for the round trip."""
    from pyspark.sql import types as T

    from daqframe.sources.writer import Plan
    from daqframe.tables import decode_bytes

    widths = [1, 2, 7, 8, 9, 12, 16, 23, 31, 32, 33, 48, 63, 64]
    fields, specs, columns = [], {}, []
    for b in widths:
        for kind, low, high in (("unsigned", 0, 2**b - 1), ("signed", -(2 ** (b - 1)), 2 ** (b - 1) - 1)):
            name = f"{kind}{b}"
            wide = high >= 2**63
            fields.append(T.StructField(name, T.DecimalType(20, 0) if wide else T.LongType()))
            specs[name] = {"type": kind, "bits": b, "storage": min(64, b + b % 3)}
            values = [low, high, 0, low, high // 2]
            columns.append(pa.array([Decimal(v) for v in values], pa.decimal128(20, 0)) if wide else pa.array(values, pa.int64()))
    fields += [T.StructField("fixed", T.BinaryType()), T.StructField("pair", T.ArrayType(T.FloatType())), T.StructField("flag", T.BooleanType())]
    specs |= {"fixed": {"bits": 24}, "pair": {"elements": 2}}
    fixed, pair, flag = [bytes([i, 255, 7]) for i in range(5)], [[i + 0.5, -1.0] for i in range(5)], [True, False, True, True, False]
    columns += [pa.array(fixed, pa.binary()), pa.array(pair, pa.list_(pa.float32())), pa.array(flag)]
    batch = pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
    plan = Plan({"path": "x", "channels": json.dumps(specs), "layout": layout, "packing": packing, "compression": compression, "chunk": "3"}, T.StructType(fields))
    out = io.BytesIO()
    plan.write(out, iter([batch.slice(0, 4), batch.slice(4)]))
    got = decode_bytes(out.getvalue()).to_pylist()
    by = {}
    for r in got:
        value = r["raw_bytes"] if r["raw_bytes"] is not None else r["numeric"] if r["logical_type"] == 3 else int(r["raw"])
        by.setdefault((r["channel_name"], r["element"]), []).append((int(r["sample_index"]), value))
    want = {(f.name, 0): c.to_pylist() for f, c in zip(fields, columns) if f.name not in ("pair",)} | {("pair", 0): [p[0] for p in pair], ("pair", 1): [p[1] for p in pair]}
    assert {k: [v for _, v in sorted(x)] for k, x in by.items()} == {k: [int(v) if isinstance(v, (Decimal, bool)) else v for v in x] for k, x in want.items()}


def test_written_by_hand_and_by_the_writer_are_the_same(spark):
    """The golden file's schema and table from rows: the same records, byte for byte, behind the file header."""
    from pyspark.sql import types as T

    from daqframe.sources.writer import Plan

    specs = {n: {"type": "unsigned", "bits": 12, "unit": "code"} for n in ("adc0", "adc1")}
    plan = Plan({"path": "x", "channels": json.dumps(specs), "compression": "identity", "period": "1", "start": "1000000", "stream": "adc", "timeDomain": "1", "timeUnit": "1/1000"}, T.StructType([T.StructField(n, T.IntegerType()) for n in specs]))
    samples = [r for r in tables.decode_bytes(files.minimal(False)).to_pylist()]
    columns = [pa.array([int(r["raw"]) for r in samples if r["channel_name"] == n], pa.int32()) for n in specs]
    out = io.BytesIO()
    plan.write(out, iter([pa.RecordBatch.from_arrays(columns, names=list(specs))]))
    assert out.getvalue()[64:].startswith(files.minimal(False)[64:])


@pytest.mark.parametrize("rows,schema,options,error", [
    ([(4096,)], "x int", {"channels": '{"x": {"type": "unsigned", "bits": 12}}'}, "fit"), ([(-1,)], "x int", {"channels": '{"x": {"type": "unsigned", "bits": 12}}'}, "fit"),
    ([(2048,)], "x int", {"channels": '{"x": {"bits": 12}}'}, "fit"), ([(1e9,)], "x double", {"channels": '{"x": {"type": "signed", "bits": 12}}'}, "fit"), ([([1, 2],)], "x array<int>", {"channels": '{"x": {"elements": 3}}'}, "elements"),
    ([(b"ab",)], "x binary", {"channels": '{"x": {"bits": 24}}'}, "bytes"), ([(1,)], "x int", {"channels": '{"y": {}}'}, "no column"), ([(1,)], "x int", {"time": "explicit"}, "time_ticks"),
    ([(1, 5), (2, 9)], "x int, time_ticks long", {"time": "periodic", "period": "3"}, "periodic"), ([(1,)], "x int", {"table": "blobs"}, "columns"), ([(1, b"")], "type_id int, payload binary", {"table": "records"}, "private"),
    ([(2, b""), (1, b"")], "item_index long, data binary", {"table": "blobs"}, "rise"), ([(1,)], "x int", {"clock": "9"}, "reference"), ([(1,)], "x int", {"table": "nothing"}, "use one of"),
])
def test_writer_says_what_is_wrong(spark, tmp_path, rows, schema, options, error):
    with pytest.raises(Exception, match=error):
        write(spark.createDataFrame(rows, schema).coalesce(1), tmp_path / "out", **options)
    assert not list(tmp_path.glob("out/*.daq"))


def test_times(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("x"), (F.col("id") * 7 + 3).alias("time_ticks")).coalesce(1)
    for mode, options in (("explicit", {}), ("delta", {"time": "delta"}), ("periodic", {"time": "periodic", "period": "7"})):
        write(rows, tmp_path / mode, chunk="30", **options)
        assert sorted((int(r.x), r.time_ticks) for r in sources.read(spark, str(tmp_path / mode), "wide", columns="x long").collect()) == [(i, 7 * i + 3) for i in range(100)]
    write(rows.drop("time_ticks"), tmp_path / "fraction", period="10/3", start="-5", chunk="30")
    assert sorted((int(r.x), r.time_ticks) for r in sources.read(spark, str(tmp_path / "fraction"), "wide", columns="x long").collect()) == [(i, -5 + i * 10 // 3) for i in range(100)]
    write(rows, tmp_path / "none", time="none")
    assert {r.time_ticks for r in sources.read(spark, str(tmp_path / "none"), "wide", columns="x long").collect()} == {None}


def test_wide_rows(spark, tmp_path):
    write(spark.createDataFrame([(1, 2.5, True)], "a int, b double, c boolean"), tmp_path / "w")
    (r,) = sources.read(spark, str(tmp_path / "w"), "wide", columns="c long, a decimal(20,0), b double, missing long").collect()
    assert (r.c, int(r.a), r.b, r.missing) == (1, 1, 2.5, None)
    assert sources.read(spark, str(tmp_path / "w"), "wide", columns="other long").count() == 0
    with pytest.raises(Exception, match="needs columns"):
        sources.read(spark, str(tmp_path / "w"), "wide").count()


def test_jobs_keep_to_their_own_files(spark, tmp_path):
    out = tmp_path / "out"
    other = out / "_temporary" / "another"
    other.mkdir(parents=True)
    (other / "part.daq").write_bytes(b"of a job that still runs")
    write(spark.range(5).withColumnRenamed("id", "x"), out)
    write(spark.range(3).withColumnRenamed("id", "x"), out, mode="overwrite")
    assert (other / "part.daq").exists()
    assert sources.read(spark, str(out)).count() == 3
    with pytest.raises(Exception, match="fit"):
        write(spark.range(300).withColumnRenamed("id", "x"), out, mode="overwrite", channels='{"x": {"bits": 8}}')
    assert sources.read(spark, str(out)).count() == 3  # nothing was deleted for a job that failed


def test_stream_writer(spark, tmp_path):
    spark.range(40).withColumnRenamed("id", "x").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))

    def run(checkpoint):
        query = stream.writeStream.format("daq").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()

    run("a")
    names = sorted(p.name for p in (tmp_path / "out").glob("*.daq"))
    assert {n[:17] for n in names} >= {"batch-0000000000-", "batch-0000000001-"}
    assert sorted(int(r.x) for r in sources.read(spark, str(tmp_path / "out"), "wide", columns="x long").collect()) == list(range(40))
    run("a")
    assert sorted(p.name for p in (tmp_path / "out").glob("*.daq")) == names
    run("b")  # a new query of the same batches: each replaces what its number left
    assert sources.read(spark, str(tmp_path / "out"), "wide", columns="x long").count() == 40


def test_rows_of_any_table_as_json(spark, folder):
    for table in ("records", "objects", "channels", "blobs", "value_map_entries"):
        frame = sources.read(spark, str(folder), table)
        lines = [json.loads(r.line) for r in export.json_rows(frame).collect()]
        assert len(lines) == frame.count() and all(list(x) == frame.columns for x in lines)


def test_documents(spark, folder, tmp_path):
    export.write_documents(spark, f"{folder}/minimal-*.daq", str(tmp_path / "json"))
    found = [json.loads(p.read_text()) for p in (tmp_path / "json").glob("part*") if p.stat().st_size]
    assert len(found) == 2 and all(4095 in [s["raw"] for r in d["records"] for s in r.get("samples", [])] for d in found)
    binary = spark.read.format("binaryFile").load(f"{folder}/*.daq")
    assert {bytes(r.document)[0] for r in export.documents(binary, "cbor").collect()} == {0xA2}


@pytest.mark.parametrize("time", ["explicit", "delta"])
def test_index_entries_bound_times_in_any_order(spark, tmp_path, time):
    ticks = [500, -40, 900, 7, 8, 6, 30]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ticks)], "x long, time_ticks long").coalesce(1)
    write(rows, tmp_path / "t", time=time, chunk="3")
    entries = sources.read(spark, str(tmp_path / "t"), "index_entries").orderBy("entry").collect()
    assert [(e["count"], e.first_time_ticks, e.last_time_ticks) for e in entries] == [(3, -40, 900), (3, 6, 8), (1, 30, 30)]
