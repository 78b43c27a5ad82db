"""The ``daq`` format: batch reader and streaming reader; daqframe.sources.writer has the writers.

Reading options: ``table`` (samples, records, text, ... as in daqframe.tables.SCHEMAS; or wide, a row for each sample, with ``columns``, such as "a long, b double": raw values of
channels as longs or decimal(20,0), physical ones as doubles), ``mode`` (FAILFAST raises the first
error; DROPTAIL ends a file before it; PERMISSIVE also lists it in the table errors; RECOVER goes on at the next sound record),
``channels`` (ids, comma-separated), ``verifyCrc``, ``partitionBytes`` and the limits ``maxHeader``, ``maxPayload``, ``maxDecoded``,
``maxObjects``, ``maxChannels``, ``maxText``, ``maxRecords``.

Files are dealt to tasks by bytes, on the driver by their sizes alone: no file is opened there. A task of a later part of a file first walks the headers
before it, seeking past payloads but those of schemas, indexes and ends, so it knows the schemas and the order that its records must keep. Where an
error ends a file (DROPTAIL, PERMISSIVE, table errors) each record must be read before the next counts: there a file is one task's. Filters on
type, stream, schema, sequence and index skip records before their payload is read; they are applied again by Spark, so pruning can't change a result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from daqframe import wire as w
from daqframe.schema import FileState, Registry
from daqframe.sources.writer import DaqStreamWriter, DaqWriter, FileBuilder
from daqframe.tables import NEEDED, SCHEMA_TABLES, SCHEMAS, WIDE_KINDS, arrow_schema, check_order, file_batches, record_batches, rows_batch, wide_schema
from daqframe.wire import FormatError, Limits, Record

__all__ = ["DaqSource", "FileBuilder", "decoded", "read", "read_binary"]

LIMIT_OPTIONS = {"maxheader": "header", "maxpayload": "payload", "maxdecoded": "decoded", "maxobjects": "objects", "maxchannels": "channels", "maxtext": "text", "maxrecords": "records"}
MODES = ("FAILFAST", "DROPTAIL", "PERMISSIVE", "RECOVER")


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def sized(path: str) -> list[tuple[str, int]]:
    """The files of a path and their sizes: itself, a folder's files, or what a pattern in its last part matches."""
    import fnmatch

    fs, inner = store(path)
    folder, _, last = inner.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in fs.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, last)]
    else:
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if info.type == pafs.FileType.Directory else [info]
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")) and "/_temporary/" not in f.path[len(inner) :])


def listed(path: str) -> list[str]:
    return [f for f, _ in sized(path)]


# records whose payload tells what others must keep to
ORDERING = (w.SCHEMA, w.INDEX, w.END)


def seen(record: Record, state: FileState, limits: Limits) -> None:
    """Checks a record's place among the earlier ones by its header, and by its payload where that is an ordering one."""
    if record.type == w.SCHEMA:
        state.registry.add(record)
    state.see(record, w.DataHeader.parse(record, limits) if record.type == w.DATA else None, w.BlobRecord.head(record, limits)[0] if record.type == w.BLOB else None)


@dataclass
class Options:
    path: str
    table: str = "samples"
    mode: str = "FAILFAST"
    channels: set[int] | None = None
    verify: bool = True
    partition_bytes: int = 64 << 20
    limits: Limits = Limits()
    trigger_bytes: int = 1 << 62
    columns: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def of(cls, options: dict[str, str]) -> Options:
        low = {k.lower(): v for k, v in options.items()}
        limits = Limits(**{name: int(low[key]) for key, name in LIMIT_OPTIONS.items() if key in low})
        channels = {int(x) for x in low["channels"].split(",")} if low.get("channels") else None
        out = cls(low.get("path", ""), low.get("table", "samples"), low.get("mode", "FAILFAST").upper(), channels, low.get("verifycrc", "true").lower() != "false", int(low.get("partitionbytes", 64 << 20)), limits, int(low.get("maxbytespertrigger", 1 << 62)))
        if out.mode not in MODES or out.table not in (*SCHEMAS, "wide"):
            raise ValueError(f"mode {out.mode}, table {out.table}: use one of {MODES} and of {sorted([*SCHEMAS, 'wide'])}")
        if out.table == "wide":
            pairs = [c.rsplit(None, 1) for c in re.split(r",(?![^(]*\))", low.get("columns", ""))]
            if any(len(p) != 2 or p[1].lower() not in WIDE_KINDS for p in pairs):
                raise ValueError(f"table wide needs columns, such as 'a long, b double'; kinds: {sorted(WIDE_KINDS)}")
            out.columns = [(name.strip().strip("`"), kind.lower()) for name, kind in pairs]
        return out


@dataclass
class Run(InputPartition):
    """The records of one file that start from byte first to byte end. Where schemas are given, the walk starts at first with these known."""

    path: str
    first: int = 0
    end: int | None = None
    schemas: list[tuple[int, bytes, bytes]] | None = None


class Pruning:
    """Conjunctions on record headers that rule records out."""

    COLUMNS = {"sequence", "type_id", "record_offset", "stream_id", "schema_id", "schema_revision", "sample_index"}

    def __init__(self):
        self.tests: list[tuple[str, str, object]] = []

    def take(self, f) -> None:
        names = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        if type(f) in names and len(f.attribute) == 1 and f.attribute[0] in self.COLUMNS:
            self.tests.append((f.attribute[0], names[type(f)], f.value))

    def allows(self, record: Record) -> bool:
        known: dict[str, tuple[int, int]] = {"sequence": (record.sequence,) * 2, "type_id": (record.type,) * 2, "record_offset": (record.offset,) * 2}
        if record.type == w.DATA and record.header_size == 96:
            schema, revision, stream, count, first = w.DATA_HEADER.unpack(record.header)[:5]
            known |= {"schema_id": (schema, schema), "schema_revision": (revision, revision), "stream_id": (stream, stream), "sample_index": (first, first + max(count - 1, 0))}
        for column, op, value in self.tests:
            if column not in known:
                continue
            low, high = known[column]
            if (op == "=" and not low <= value <= high) or (op == ">" and high <= value) or (op == ">=" and high < value) or (op == "<" and low >= value) or (op == "<=" and low > value):
                return False
            if op == "in" and not any(low <= v <= high for v in value):
                return False
        return True


PARTS = 256


def plan(options: Options, path: str, size: int) -> list[Run]:
    """A file in parts of at least partitionBytes, at most PARTS of them as each walks the headers before it; in one where its end depends on every record."""
    if options.table in ("files", "errors") or options.mode in ("DROPTAIL", "PERMISSIVE"):
        return [Run(path)]
    step = max(options.partition_bytes, -(-size // PARTS), 1)
    starts = range(0, max(size, 1), step)
    return [Run(path, a, None if a + step >= size else a + step) for a in starts]


class DaqReader(DataSourceReader):
    def __init__(self, options: Options):
        self.options, self.pruning = options, Pruning()

    def pushFilters(self, filters):
        for f in filters:
            self.pruning.take(f)
        yield from filters  # all of them are applied again

    def partitions(self):
        return [run for path, size in sized(self.options.path) for run in plan(self.options, path, size)] or [Run("")]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from joined(self._read(partition))

    def _read(self, run: Run) -> Iterator[pa.RecordBatch]:
        fs, _ = store(self.options.path)
        with fs.open_input_file(run.path) as file:
            if self.options.table in ("files", "errors"):
                yield self._file(run.path, file)
            elif self.options.mode in ("DROPTAIL", "PERMISSIVE"):
                yield from self._until_error(run.path, file)
            else:
                yield from self._part(run, file)

    def _uses(self, record: Record) -> bool:
        table = self.options.table
        use = table == "records" or record.type in NEEDED.get(table, ()) or (table in SCHEMA_TABLES and record.type == w.SCHEMA)
        return use and self.pruning.allows(record)

    def _checked(self, file, whole: bool, errors: list[FormatError]) -> Iterator[tuple[Record, Registry, tuple | None]]:
        """All records of a file in order, up to the first error, which ends up in errors; whole: payloads are read and checked too."""
        options, state = self.options, FileState(self.options.limits)
        recover = options.mode == "RECOVER"
        header = None
        try:
            walk = w.Walk(file, options.limits, lambda record: whole or record.type in ORDERING, options.verify, recover)
            header = walk.header
            walk.errors = errors
            for record in walk:
                try:
                    known = check_order(record, state, options.limits) if whole else seen(record, state, options.limits)
                except FormatError as e:
                    e.offset, e.sequence = record.offset, record.sequence
                    if not recover:
                        raise
                    errors.append(e)
                    continue
                yield record, state.registry, known
        except FormatError as e:
            errors.append(e)
        finally:
            self.header = header

    def _file(self, path: str, file) -> pa.RecordBatch:
        """The row of table files, or the rows of table errors."""
        options, errors = self.options, []
        length = file.size()
        self.header = None
        for _ in self._checked(file, options.table == "errors" or options.mode in ("DROPTAIL", "PERMISSIVE"), errors):
            pass
        if options.table == "errors":
            return rows_batch("errors", [(path, e.offset, e.sequence, e.status, e.reason, str(e)) for e in errors])
        error = errors[0] if errors and options.mode != "RECOVER" else None
        h = self.header or w.FileHeader()
        created = None if h.created_unix_ns == w.UNKNOWN_TIME else h.created_unix_ns
        return rows_batch("files", [(path, h.major, h.minor, created, h.uuid.hex(), h.size, length, "ok" if error is None else error.status, str(error) if error else None)])

    def _until_error(self, path: str, file) -> Iterator[pa.RecordBatch]:
        options = self.options
        for record, registry, known in self._checked(file, True, []):
            if self._uses(record):
                yield from record_batches(options.table, path, record, registry, options.limits, options.channels, known, options.columns)

    def _part(self, run: Run, file) -> Iterator[pa.RecordBatch]:
        """Records of a part of a file; those before it are walked for what they say about schemas and order."""
        options, limits = self.options, self.options.limits
        recover = options.mode == "RECOVER"
        state = FileState(limits) if run.schemas is None else None
        registry = state.registry if state else Registry(limits)
        for sequence, header, payload in run.schemas or ():
            registry.add(Record(w.SCHEMA, 0, sequence, header, payload, payload_size=len(payload)))
        walk = w.Walk(file, limits, lambda record: record.type in ORDERING, options.verify, recover, run.first if state is None else None, until=run.end)
        for record in walk:
            try:
                if state is not None and not recover:
                    seen(record, state, limits)
                elif record.type == w.SCHEMA:
                    registry.add(record)
                if record.offset >= run.first and self._uses(record):
                    if record.payload is None:
                        walk.load(record)
                    yield from record_batches(options.table, run.path, record, registry, limits, options.channels, columns=options.columns)
            except FormatError as e:
                e.offset, e.sequence = record.offset, record.sequence
                if not recover:
                    raise


# --- streaming ------------------------------------------------------------------------------------------------------------


class DaqStreamReader(DataSourceStreamReader):
    """Tails files that grow. The offset holds, for each file, the byte after its last complete record; an incomplete tail waits for more bytes.

    How far each file was walked, the schemas met there and where the records of the next batch start are kept between triggers, so a trigger reads new headers only,
    once; after a restart the first one walks from the start. ``maxBytesPerTrigger`` bounds what a batch takes on.
    """

    def __init__(self, options: Options):
        self.options = options
        self.walked: dict[str, int] = {}
        self.schemas: dict[str, list[tuple[int, int, bytes, bytes]]] = {}  # offset, sequence, header, payload
        self.starts: dict[str, list[int]] = {}  # of records from partitionBytes to partitionBytes, since the last commit

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _walk(self, path: str, most: int) -> int:
        """Takes note of the schemas and the end of the complete records that are there by now, up to most bytes of them; gives the bytes walked."""
        fs, _ = store(self.options.path)
        before = self.walked.get(path, 0)
        with fs.open_input_file(path) as file:
            if file.size() < 64 or file.size() <= before:
                return 0
            walk = w.Walk(file, self.options.limits, lambda record: record.type == w.SCHEMA, self.options.verify, start=self.walked.get(path))
            starts = self.starts.setdefault(path, [])
            for record in walk:
                if record.type == w.SCHEMA:
                    self.schemas.setdefault(path, []).append((record.offset, record.sequence, record.header, record.payload))
                if not starts or record.offset - starts[-1] >= self.options.partition_bytes:
                    starts.append(record.offset)
                self.walked[path] = record.offset + record.stored_size
                if self.walked[path] - before >= most:
                    break
            self.walked.setdefault(path, walk.position)
        return self.walked[path] - before

    def latestOffset(self) -> dict:
        left = self.options.trigger_bytes
        for path in listed(self.options.path):
            if left > 0:
                left -= self._walk(path, left)
        return {"files": json.dumps(self.walked, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        old, runs = json.loads(start["files"]), []
        for path, position in json.loads(end["files"]).items():
            first = old.get(path, 0)
            if position <= first:
                continue
            if self.walked.get(path, 0) < position:  # after a restart
                self._walk(path, 1 << 62)
            cuts = [first] + [a for a in self.starts.get(path, []) if first < a < position] + [position]
            for a, z in zip(cuts, cuts[1:]):
                runs.append(Run(path, a, z, [s[1:] for s in self.schemas.get(path, []) if s[0] < a] if a else None))
        return runs

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        yield from DaqReader(self.options).read(partition)

    def commit(self, end: dict) -> None:
        for path, position in json.loads(end["files"]).items():
            self.starts[path] = [a for a in self.starts.get(path, []) if a >= position]


class DaqSource(DataSource):
    """spark.read.format("daq"), df.write.format("daq"), spark.readStream.format("daq") and df.writeStream.format("daq")."""

    @classmethod
    def name(cls) -> str:
        return "daq"

    def schema(self) -> str:
        options = Options.of(dict(self.options))
        return wide_schema(options.columns) if options.table == "wide" else SCHEMAS[options.table]

    def reader(self, schema: StructType) -> DaqReader:
        return DaqReader(Options.of(dict(self.options)))

    def writer(self, schema: StructType, overwrite: bool) -> DaqWriter:
        return DaqWriter(dict(self.options), schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DaqStreamWriter:
        return DaqStreamWriter(dict(self.options), schema, overwrite)

    def streamReader(self, schema: StructType) -> DaqStreamReader:
        return DaqStreamReader(Options.of(dict(self.options)))


def read(spark: SparkSession, path: str, table: str = "samples", **options) -> DataFrame:
    """A table of the files of path. Filters reach the reader where spark.sql.python.filterPushdown.enabled is set, as register does."""
    spark.dataSource.register(DaqSource)
    return spark.read.format("daq").option("table", table).options(**options).load(path)


def read_binary(spark: SparkSession, path: str, table: str = "samples", limits: Limits = Limits()) -> DataFrame:
    """The same rows by Spark's own file reader, for stores that only Spark can open; one task reads a whole file."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content"))
    return decoded(files, table, limits)


def decoded(files: DataFrame, table: str = "samples", limits: Limits = Limits()) -> DataFrame:
    """Rows of a table from a frame of (path, content), each a whole file."""
    schema = arrow_schema(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield from joined(file_batches(table, path, content.as_py(), limits))
        yield pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)

    return files.select("path", "content").mapInArrow(run, SCHEMAS[table])


def joined(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches put together: records of one item each would cross to the JVM one by one."""
    kept: list[pa.RecordBatch] = []
    n = held = 0
    for batch in batches:
        kept.append(batch)
        n, held = n + batch.num_rows, held + batch.nbytes
        if n >= rows or held >= size:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept, n, held = [], 0, 0
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
