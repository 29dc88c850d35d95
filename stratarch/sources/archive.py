"""The `webarchive` data source: scans archives into the record table and writes record tables as archives."""

from __future__ import annotations

import json
import socket
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from ..schema import HOT_HEADERS, RECORD_SCHEMA
from . import codec
from .files import listing, locate

FORMAT = "webarchive"
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


@dataclass
class Slice(InputPartition):
    """Some files, or the members of one gzip file that begin in a range."""

    files: tuple[tuple[str, int, int | None], ...]


def _flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() in ("true", "1", "yes")


def parse_date(text: str | None) -> datetime | None:
    if not text:
        return None
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def _value(r: codec.Record, file: str, column: str):
    if column == "file":
        return file
    if column == "record_index":
        return r.index
    if column == "version":
        return r.version
    if column == "content_length":
        return r.content_length
    return r.header(HOT_HEADERS[column])


_PUSHED = {"file", "record_index", "version", "content_length", *HOT_HEADERS}


def passes(f: Filter, r: codec.Record, file: str) -> bool | None:
    """SQL truth of a filter for a record's headers."""
    if isinstance(f, Not):
        inner = passes(f.child, r, file)
        return None if inner is None else not inner
    v = _value(r, file, f.attribute[0])
    if isinstance(f, IsNull):
        return v is None
    if isinstance(f, IsNotNull):
        return v is not None
    if isinstance(f, EqualNullSafe):
        return v == f.value
    if v is None:
        return None
    if isinstance(f, EqualTo):
        return v == f.value
    if isinstance(f, In):
        return True if v in f.value else None if None in f.value else False
    if isinstance(f, GreaterThan):
        return v > f.value
    if isinstance(f, GreaterThanOrEqual):
        return v >= f.value
    if isinstance(f, LessThan):
        return v < f.value
    if isinstance(f, LessThanOrEqual):
        return v <= f.value
    if isinstance(f, StringStartsWith):
        return v.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return v.endswith(f.value)
    return f.value in v


def _pushable(f: Filter) -> bool:
    if isinstance(f, Not):
        return _pushable(f.child)
    known = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)
    return isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED


class ArchiveReader(DataSourceReader):
    """Partitions are files, small ones together and large gzip ones cut at member borders on request."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.content = _flag(options, "content", True)
        self.strict = str(options.get("multirecordmember", "first")) == "error"
        self.most = int(options["maxcontentbytes"]) if "maxcontentbytes" in options else None
        self.push = _flag(options, "pushfilters", False)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        """Only on request: Spark keeps one reader for a relation, so where one plan filters it twice, as in a join with
        itself, the last filter would hold for both."""
        self.filters = [f for f in filters if self.push and _pushable(f)]
        # a damaged file's last row has no headers and must reach Spark's own filter, so all are applied there again
        return filters

    def _files(self) -> list[tuple[str, int]]:
        paths = [p for p in self.options.get("path", "").split(",") if p]
        if not paths:
            raise ValueError("load() needs a path")
        found = [f for p in paths for f in listing(p, _flag(self.options, "includeopen", True))]
        only = [f for f in self.filters if not isinstance(f, Not) and f.attribute == ("file",)]
        return [(p, n) for p, n in found if all(passes(f, codec.Record(0), p) for f in only)]

    def partitions(self) -> list[InputPartition]:
        files = self._files()
        # few bytes may be much work where they are well compressed: all cores take part unless that leaves them under 4 MB each
        share = max(4 << 20, -(-sum(n for _, n in files) // int(self.options.get("minpartitionnum", 1))))
        most = min(int(self.options.get("maxpartitionbytes", 128 << 20)), share)
        split = int(self.options.get("splitbytes", 0))
        out, held, size = [], [], 0
        for path, n in files:
            if split and n > split:
                out += [Slice(((path, a, min(a + split, n)),)) for a in range(0, n, split)]
                continue
            if held and size + n > most:
                out.append(Slice(tuple(held)))
                held, size = [], 0
            held.append((path, 0, None))
            size += n
        if held:
            out.append(Slice(tuple(held)))
        return out or [Slice(())]

    def _wanted(self, file: str):
        if not self.filters:
            return None
        return lambda r: all(passes(f, r, file) for f in self.filters)

    def _records(self, path: str, start: int, end: int | None) -> Iterator[codec.Record]:
        try:
            system, inner = locate(path)
            with system.open_input_file(inner) as raw:
                if end is not None:
                    head = raw.read(6)
                    if codec.sniff(head) != "gzip":
                        # other codecs can't be entered in the middle; the first slice reads them whole
                        if start:
                            return
                        end = None
                    elif start:
                        size = raw.size()
                        start = codec.next_member(raw, start, size)
                        if start >= end:
                            return
                for r in codec.records(raw, self.content, self._wanted(path), self.most, start, end, self.strict):
                    if end is not None:
                        r.index += start << 16
                    yield r
        except OSError as e:
            yield codec.Record(0, error=f"{type(e).__name__}: {e}")

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        for path, start, end in partition.files:
            wanted = self._wanted(path)
            rows, size = [], 0
            for r in self._records(path, start, end):
                if wanted is not None and r.error is None and not wanted(r):
                    continue
                rows.append(r)
                size += len(r.content or b"") + 512
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield to_batch(rows, path)
                    rows, size = [], 0
            if rows:
                yield to_batch(rows, path)


_HEADERS = pa.map_(pa.string(), pa.string())


def to_batch(rows: list[codec.Record], path: str) -> pa.RecordBatch:
    hot = {c: pa.array([None if r.error else r.header(h) for r in rows], pa.string()) for c, h in HOT_HEADERS.items()}
    columns = {
        "file": pa.array([path] * len(rows), pa.string()),
        "record_index": pa.array([r.index for r in rows], pa.int64()),
        "offset": pa.array([r.offset for r in rows], pa.int64()),
        "size": pa.array([r.size for r in rows], pa.int64()),
        "version": pa.array([None if r.error else r.version for r in rows], pa.string()),
        "headers": pa.array([None if r.error else list(r.headers.items()) for r in rows], _HEADERS),
        **hot,
        "warc_date": pa.array([parse_date(x) for x in hot["warc_date_raw"].to_pylist()], pa.timestamp("us", "UTC")),
        "content_length": pa.array([r.content_length for r in rows], pa.int64()),
        "content": pa.array([r.content for r in rows], pa.binary()),
        "error": pa.array([r.error for r in rows], pa.string()),
    }
    return pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in RECORD_SCHEMA.fields})


def to_row(r: codec.Record, path: str) -> tuple:
    """A record as a row of the record table, with the values that to_batch gives."""
    low = {} if r.error else {k.lower(): v for k, v in r.headers.items()}
    hot = {c: low.get(h) for c, h in HOT_HEADERS.items()}
    values = {
        "file": path, "record_index": r.index, "offset": r.offset, "size": r.size, "version": None if r.error else r.version, "headers": None if r.error else r.headers, **hot,
        "warc_date": parse_date(hot["warc_date_raw"]), "content_length": r.content_length, "content": r.content, "error": r.error}
    return tuple(values[name] for name in RECORD_SCHEMA.names)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    records: int
    content_bytes: int


class ArchiveWriter(DataSourceWriter):
    """Every task writes files of its own, `.open` until the job commits, then renamed. Names bear the job, so what failed
    or speculative attempts have left is known and deleted at the end, and so is everything of an aborted job."""

    def __init__(self, options: dict, schema, overwrite: bool):
        path = options.get("path")
        if not path:
            raise ValueError("save() needs a path")
        self.path, self.job = path, uuid.uuid4().hex[:8]
        self.names = [f.name for f in schema.fields]
        self.prefix = options.get("prefix", "WARC")
        self.compression = options.get("compression", "gzip").lower()
        self.limit = float(options.get("maxfilemb", 1000))
        self.algorithm = options.get("digest", "sha1")
        self.host = options.get("hostname") or socket.gethostname()
        self.software = options.get("software", "stratarch")
        self.info = {str(k): str(v) for k, v in json.loads(options.get("info", "{}")).items()}
        self.now = options.get("now")
        self.keep_open = _flag(options, "keepopen", False)
        self.level = int(options["level"]) if "level" in options else None
        self.dictionary = None
        if "dictionary" in options:
            system, inner = locate(options["dictionary"])
            with system.open_input_stream(inner, compression=None) as f:
                self.dictionary = f.read()
        codec.Encoder(self.compression, self.dictionary, self.level)  # fails early on bad options
        system, inner = locate(path)
        if overwrite and system.get_file_info(inner).type.name == "Directory":
            system.delete_dir_contents(inner)
        system.create_dir(inner, recursive=True)

    def _now(self) -> datetime:
        return parse_date(self.now) or datetime.now(UTC)

    def write(self, iterator) -> Written:
        out = _Files(self)
        batch, held = object(), []
        for row in iterator:
            values = dict(zip(self.names, row))
            key = values.get("batch_id")
            if held and (key is None or key != batch):
                out.batch(held)
                held = []
            batch = key
            held.append(values)
        if held:
            out.batch(held)
        out.close()
        return Written(out.files, out.count, out.total)

    def commit(self, messages) -> None:
        system, base = locate(self.path)
        ours = {name for m in messages if m is not None for name in m.files}
        self._drop(system, base, ours)
        if not self.keep_open:
            with ThreadPoolExecutor(16) as pool:  # a store's renames are slow one by one
                list(pool.map(lambda name: system.move(f"{base}/{name}", f"{base}/{name.removesuffix('.open')}"), sorted(ours)))

    def abort(self, messages) -> None:
        self._drop(*locate(self.path), set())

    def _drop(self, system: fs.FileSystem, base: str, but: set[str]) -> None:
        """Delete the job's open files that no committed attempt has named."""
        for i in system.get_file_info(fs.FileSelector(base)):
            if i.base_name.endswith(".open") and f"-{self.job}x" in i.base_name and i.base_name not in but:
                system.delete_file(i.path)


class _Files:
    """The files of one task: rotation, first records, serial numbers."""

    def __init__(self, w: ArchiveWriter):
        from pyspark import TaskContext

        task = TaskContext.get()
        # a retried or speculative attempt writes names of its own; only the committed attempt's are renamed
        self.tag = f"{w.job}x{task.partitionId():05d}x{task.taskAttemptId()}" if task else f"{w.job}x{uuid.uuid4().hex[:8]}"
        self.w, self.encoder = w, codec.Encoder(w.compression, w.dictionary, w.level)
        self.system, self.base = locate(w.path)
        self.files: list[str] = []
        self.sink, self.size, self.serial, self.count, self.total, self.info_id = None, 0, 0, 0, 0, ""

    def _put(self, headers: dict[str, str], content: bytes) -> None:
        data = self.encoder.encode(codec.frame("WARC/1.1", headers, content))
        self.sink.write(data)
        self.size += len(data)
        self.total += len(content)

    def _open(self) -> None:
        self.serial = self.serial % 99999 + 1
        at = self.w._now()
        stamp = at.strftime("%Y%m%d%H%M%S") + f"{at.microsecond // 1000:03d}"
        name = f"{self.w.prefix}-{stamp}-{self.serial:05d}-{self.w.host}-{self.tag}.warc{self.encoder.suffix}.open"
        self.files.append(name)
        self.sink = self.system.open_output_stream(f"{self.base}/{name}", compression=None)
        self.sink.write(self.encoder.head)
        self.size = len(self.encoder.head)
        block = "".join(f"{k}: {v}\r\n" for k, v in sorted({
            "software": self.w.software, "hostname": self.w.host, "format": "WARC file version 1.1",
            "conformsTo": "http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/", **self.w.info}.items())).encode()
        self.info_id = _urn(name)
        self._put(self._filled({
            "WARC-Type": "warcinfo", "Content-Type": "application/warc-fields", "WARC-Record-ID": self.info_id,
            "WARC-Filename": name.removesuffix(".open"), "WARC-Date": _stamp(at)}, block), block)

    def _filled(self, headers: dict[str, str], content: bytes) -> dict[str, str]:
        h = dict(headers)
        low = {k.lower() for k in h}
        for name, value in (("WARC-Type", lambda: "resource"), ("WARC-Record-ID", lambda: f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", lambda: _stamp(self.w._now()))):
            if name.lower() not in low:
                h[name] = value()
        # a given digest is kept; the length is always that of the content, or the file could not be read again
        for k in [k for k in h if k.lower() == "content-length" or k.lower() == "warc-block-digest" and not h[k]]:
            del h[k]
        h["Content-Length"] = str(len(content))
        if "warc-block-digest" not in {k.lower() for k in h}:
            h["WARC-Block-Digest"] = block_digest(content, self.w.algorithm)
        return h

    def batch(self, rows: list[dict]) -> None:
        """Write records that belong together; the file's size is looked at before, so they are never parted."""
        if self.sink is not None and self.size // (1 << 20) >= self.w.limit:
            self.close()
        if self.sink is None:
            self._open()
        for v in rows:
            headers = {k: x for k, x in (v.get("headers") or {}).items() if x is not None}
            for column, name in _NAMES.items():
                if v.get(column) is not None:
                    for k in [k for k in headers if k.lower() == name.lower()]:
                        del headers[k]
                    headers[name] = v[column]
            at = v.get("capture_time") or v.get("warc_date")
            if at is not None and v.get("warc_date_raw") is None:
                headers = {k: x for k, x in headers.items() if k.lower() != "warc-date"} | {"WARC-Date": _stamp(at if at.tzinfo else at.replace(tzinfo=UTC))}
            headers = {k: x for k, x in headers.items() if k.lower() != "warc-warcinfo-id"} | {"WARC-Warcinfo-ID": self.info_id}
            content = bytes(v.get("content") or b"")
            self._put(self._filled({k: " ".join(x.split("\r\n")) for k, x in headers.items()}, content), content)
            self.count += 1

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.sink = None


_NAMES = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "warc_date_raw": "WARC-Date", "target_uri": "WARC-Target-URI", "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To",
}


def _stamp(at: datetime) -> str:
    at = at.astimezone(UTC)
    return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{at.microsecond:06d}".rstrip("0") if at.microsecond else "") + "Z"


def _urn(text: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, text)}>"


def block_digest(content: bytes, algorithm: str) -> str:
    import base64
    import hashlib

    if algorithm == "sha1":
        return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()
    if algorithm == "sha256_base16":
        return "sha256:" + hashlib.sha256(content).hexdigest()
    if algorithm == "sha256_base32":
        return "sha256:" + base64.b32encode(hashlib.sha256(content).digest()).decode()
    if algorithm == "blake3":
        from ..functions.digest import blake3_many

        return "blake3:" + blake3_many([content])[0]
    raise ValueError(f"unknown digest algorithm {algorithm!r}")


class WebArchive(DataSource):
    """spark.read.format("webarchive").load(path), df.write.format("webarchive").mode("append").save(path).

    Read options: content (true), maxContentBytes, multiRecordMember (first | error), includeOpen (true),
    pushFilters (false; rejected records are then skipped without their contents; for a relation that a plan reads once),
    maxPartitionBytes (small files share a task), minPartitionNum (tasks that a scan is spread over if it has 4 MB for each; by
    read_archives the cores there are), splitBytes (gzip files above it are cut at member borders; their
    record_index then ascends in file order but has gaps).
    Write options: prefix, compression (gzip | zstd | none), maxFileMb, digest, dictionary, hostname, level, now, keepOpen,
    software, info (a JSON object of more fields for the information records).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return RECORD_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WebArchive)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """The record table of a file, folder or pattern."""
    register(spark)
    reader = spark.read.format(FORMAT).option("minPartitionNum", spark.sparkContext.defaultParallelism)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    return reader.load(path)


def write_archives(records: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Write records (any columns of the record table, and batch_id to keep rows together) as archives.

    One task writes one file at a time: repartition first for more or fewer writers, by batch_id if it is used."""
    register(records.sparkSession)
    writer = records.write.format(FORMAT).mode(mode)
    for k, v in options.items():
        writer = writer.option(k, str(v).lower() if isinstance(v, bool) else v)
    writer.save(path)


def decode_files(files: DataFrame, content: bool = True) -> DataFrame:
    """Record table from rows (path, content) as the binaryFile source gives them, in batch or streaming."""

    def run(it):
        for batch in it:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for r in codec.records(codec.open_bytes(data.as_py() or b""), content):
                    rows.append(r)
                    size += len(r.content or b"") + 512
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield to_batch(rows, path)
                        rows, size = [], 0
                if rows:
                    yield to_batch(rows, path)

    return files.select("path", "content").mapInArrow(run, RECORD_SCHEMA)


def read_archives_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16, content: bool = True, pattern: str = "*.warc*") -> DataFrame:
    """A stream of records from archives as they are published in a folder; files still `.open` are left for later."""
    from pyspark.sql import functions as F

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return decode_files(files.where(~F.col("path").endswith(".open")), content)


def register_functions(spark: SparkSession) -> None:
    """The table function archive_records(path, bytes) in SQL: the records of a file that is a value, for lateral joins."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=RECORD_SCHEMA)
    class Records:
        def eval(self, path: str, data: bytes):
            for r in codec.records(codec.open_bytes(data or b""), True):
                yield to_row(r, path)

    spark.udtf.register("archive_records", Records)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_size) for every file of a path."""
    return spark.createDataFrame(listing(path, True), "file string, file_size long")


__all__ = ["FORMAT", "ArchiveReader", "ArchiveWriter", "WebArchive", "decode_files", "file_sizes", "read_archives", "read_archives_stream", "register", "register_functions", "write_archives"]
