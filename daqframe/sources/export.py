"""Sinks: CSV and JSON lines from Catalyst, CBOR from Arrow batches, and whole files as JSON or CBOR documents."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daqframe import wire as w
from daqframe.codec import FIXED, FLOAT

CSV_HEADER = "sequence,stream_id,sample_index,time_ticks,channel_id,channel_name,element,raw,physical,unit"


def shortest(x: Column) -> Column:
    """A double as its shortest text that reads back the same; whole numbers without a fraction."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def quoted(text: Column) -> Column:
    """A CSV field: quoted where it holds a comma, a quote or a line break."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def raw_text() -> Column:
    """Fixed bytes as lower hex, floats as numbers, integers as they are."""
    kind = F.col("logical_type")
    return F.when(kind == FIXED, F.lower(F.hex("raw_bytes"))).when(kind == FLOAT, shortest(F.col("numeric"))).otherwise(F.col("raw").cast("string"))


def csv_lines(samples: DataFrame) -> DataFrame:
    """samples' keys and a column line, without the header line."""
    blank = F.lit("")
    cells = [F.col(c).cast("string") for c in ("sequence", "stream_id", "sample_index")]
    cells += [F.coalesce(F.col("time_ticks").cast("string"), blank), F.col("channel_id").cast("string"), quoted(F.col("channel_name")), F.col("element").cast("string")]
    cells += [raw_text(), F.when(F.col("logical_type") == FIXED, blank).otherwise(shortest(F.col("physical"))), quoted(F.coalesce("unit", blank))]
    return samples.select("path", "sequence", "sample_index", "channel_id", "element", F.concat_ws(",", *cells).alias("line"))


def write_csv(samples: DataFrame, path: str) -> None:
    """Rows in file order, range-sorted into part files; each part starts with the header."""
    ordered = samples.orderBy("path", "sequence", "sample_index", "channel_id", "element")
    physical = F.when(F.col("logical_type") != FIXED, shortest(F.col("physical")))
    columns = ["sequence", "stream_id", F.col("sample_index").cast("string").alias("sample_index"), "time_ticks", "channel_id", "channel_name", "element", raw_text().alias("raw"), physical.alias("physical"), "unit"]
    ordered.select(*columns).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def json_lines(samples: DataFrame) -> DataFrame:
    """(path, sequence, line): a JSON object for each sample row. Doubles that JSON can't hold are null; raw_bits has them."""
    body = F.to_json(
        F.struct(
            "stream_id", "sample_index", "time_ticks", "channel_id", F.col("channel_name").alias("name"), "element", raw_text().alias("raw"), "raw_bits",
            finite(F.col("numeric")).alias("numeric"), finite(F.col("physical")).alias("physical"), "unit",
        ),
        {"ignoreNullFields": "false"},
    )
    return samples.select("path", "sequence", body.alias("line"))


def json_rows(frame: DataFrame) -> DataFrame:
    """(line): each row of any table as a JSON object; binary values as base64, doubles that JSON can't hold as null."""
    plain = [finite(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in frame.schema.fields]
    return frame.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("line"))


# --- CBOR ---------------------------------------------------------------------------------------------------------------


def cbor_head(major: int, value: int) -> bytes:
    """Shortest head of a major type."""
    if value < 24:
        return bytes([major << 5 | value])
    for extra, form in ((24, ">B"), (25, ">H"), (26, ">I"), (27, ">Q")):
        if value < 1 << (8 * struct.calcsize(form)):
            return bytes([major << 5 | extra]) + struct.pack(form, value)
    raise OverflowError(value)


def cbor(value) -> bytes:
    """Maps, lists, text, bytes, integers, doubles, booleans and None."""
    if value is None or isinstance(value, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[value]
    if isinstance(value, int):
        return cbor_head(0, value) if value >= 0 else cbor_head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, str):
        return cbor_head(3, len(value.encode())) + value.encode()
    if isinstance(value, bytes):
        return cbor_head(2, len(value)) + value
    if isinstance(value, dict):
        return cbor_head(5, len(value)) + b"".join(cbor(k) + cbor(v) for k, v in value.items())
    return cbor_head(4, len(value)) + b"".join(map(cbor, value))


def sample_value(r: dict):
    if r["logical_type"] == FIXED:
        return r["raw_bytes"]
    if r["logical_type"] == FLOAT:
        return r["numeric"]
    return int(r["raw"])


def cbor_items(samples: DataFrame) -> DataFrame:
    """(path, sequence, item): a CBOR map for each sample row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = []
            for r in batch.to_pylist():
                item = {k: r[k] for k in ("stream_id", "time_ticks", "channel_id", "channel_name", "element", "physical", "unit")}
                items.append(cbor({"sample_index": int(r["sample_index"]), **item, "raw": sample_value(r)}))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("sequence"), pa.array(items, pa.binary())], names=["path", "sequence", "item"])

    return samples.mapInArrow(run, "path string, sequence long, item binary")


def document(data: bytes) -> dict:
    """One file as a nested document of plain values, for a JSON or CBOR export of a whole file."""
    from daqframe import tables
    from daqframe.schema import FileState

    limits, state = w.Limits(), FileState()
    walk = w.Walk(io.BytesIO(data), limits)
    h = walk.header
    out = {"header": {"major": h.major, "minor": h.minor, "created_unix_ns": None if h.created_unix_ns == w.UNKNOWN_TIME else h.created_unix_ns, "uuid": h.uuid.hex(), "size": h.size}, "records": []}
    for record in walk:
        entry = {"offset": record.offset, "sequence": record.sequence, "type": w.type_name(record.type)}
        content, schema, decoded = tables.parsed(record, state.registry, limits)
        if record.type == w.SCHEMA:
            entry |= {"schema_id": schema.id, "revision": schema.revision, "objects": [{"kind": w.KIND_NAMES.get(o.kind, str(o.kind)), "id": o.id, "name": o.name} for o in schema.objects]}
        elif record.type == w.DATA:
            entry |= {"schema_id": content.schema_id, "revision": content.revision, "stream_id": content.stream_id, "decoded": decoded}
            rows = [r for b in tables.sample_batches("", record, content, schema, limits) for r in b.to_pylist()] if decoded else []
            entry["samples"] = [{"index": int(r["sample_index"]), "time_ticks": r["time_ticks"], "channel_id": r["channel_id"], "name": r["channel_name"], "element": r["element"], "raw": sample_value(r), "physical": r["physical"], "unit": r["unit"]} for r in rows]
        elif record.type == w.TEXT:
            entry |= {"stream_id": content.stream_id, "time_ticks": content.ticks, "severity": w.SEVERITIES[content.severity], "source_id": content.source_id, "event_code": content.event_code, "message": content.message}
        elif record.type == w.BLOB:
            entry |= {"stream_id": content.stream_id, "item_index": content.item_index, "time_ticks": None if content.ticks == w.UNKNOWN_TIME else content.ticks, "data": content.data}
        elif record.type == w.NOTE:
            entry["message"] = content
        elif record.type == w.INDEX:
            entry["entries"] = [list(e) for e in content]
        elif record.type == w.END:
            entry |= dict(zip(("total_records", "data_records", "last_index_offset"), content))
        else:
            entry["payload"] = record.payload
        out["records"].append(entry)
    return out


def to_json(value) -> str:
    """Indented JSON: bytes as base64, doubles that JSON can't hold as null."""
    import base64
    import json
    import math

    def plain(x):
        if isinstance(x, bytes):
            return base64.b64encode(x).decode()
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), indent=2, ensure_ascii=False)


def documents(files: DataFrame, kind: str = "json") -> DataFrame:
    """(path, document): each file of (path, content) as one JSON or CBOR document; document is binary, of UTF-8 text for JSON. A task holds one file at a time."""
    if kind not in ("json", "cbor"):
        raise ValueError(f"documents are json or cbor, not {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                made = document(content.as_py())
                made = to_json(made).encode() if kind == "json" else cbor(made)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([made], pa.binary())], names=["path", "document"])

    return files.select("path", "content").mapInArrow(run, "path string, document binary")


def write_documents(spark: SparkSession, logs: str, path: str, kind: str = "json") -> None:
    """The log files of a path as documents, by Spark's own file reader and writer: a row for each file, in Parquet or, for JSON, as text files of one document each."""
    found = spark.read.format("binaryFile").load(logs)
    made = documents(found, kind)
    if kind == "json":
        made.select(F.col("document").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    else:
        made.write.parquet(path)
