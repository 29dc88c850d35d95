"""WARC writer with a Zstandard dictionary in a leading skippable frame and one frame for every record."""

from __future__ import annotations

import hashlib
import struct
import time
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch_path

DICTIONARY_MAGIC = 0x184D2A5D


def record_id(*parts: str) -> str:
    """A URN named by the parts, so that a task that runs again names its records alike."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('\n'.join(parts).encode()).digest(), version=5)}>"


def record_bytes(key: str, url: str | None, payload: bytes, date: str) -> bytes:
    """One archived record: version, sorted header lines, block, two empty lines."""
    head = {
        "Content-Length": str(len(payload)),
        "Content-Type": "text/html",
        "WARC-Block-Digest": "sha256:" + hashlib.sha256(payload).hexdigest(),
        "WARC-Date": date,
        "WARC-Record-ID": record_id(key),
        "WARC-Type": "resource",
    }
    if url is not None:
        head["WARC-Target-URI"] = " ".join(url.split())
    lines = "".join(f"{k}: {v}\r\n" for k, v in sorted(head.items()))
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + payload + b"\r\n\r\n"


def train(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from all of a file's records; None where they are too few or too alike to train on."""
    total = sum(map(len, records))
    if len(records) < 8 or total < 8 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(size, total // 8), records, k=200, d=8, level=3)
    except zstandard.ZstdError:
        return None


def dictionary_frame(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    """The dictionary, itself compressed, as a skippable frame."""
    data = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data


def archive_file(records: list[bytes], dictionary_size: int, level: int) -> tuple[bytes, list[tuple[int, int]]]:
    """A file's bytes and each record's (offset, length). Frames declare their content size and have a checksum."""
    dictionary = train(records, dictionary_size)
    if dictionary is not None:
        dictionary.precompute_compress(level)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
    out = [dictionary_frame(dictionary)] if dictionary is not None else []
    at, places = sum(map(len, out)), []
    for r in records:
        frame = compressor.compress(r)
        places.append((at, len(frame)))
        out.append(frame)
        at += len(frame)
    return b"".join(out), places


def publish(target: fs.FileSystem, path: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a reader never sees half a file, and a task that runs again
    replaces its file with the same bytes."""
    part = f"{path}.{uuid.uuid4().hex}.open"
    with target.open_output_stream(part) as f:
        f.write(data)
    target.move(part, path)


def _write(folder: str, job: str, target_bytes: int, dictionary_size: int, level: int, date: str):
    def run(it):
        target, base = fs.FileSystem.from_uri(folder)
        number, held, size, names = 0, [], 0, []
        task = TaskContext.get().partitionId()

        def flush():
            nonlocal number, held, size, names
            name = f"part-{job}-{task:06d}-{number:05d}.warc.zst"
            data, places = archive_file(held, dictionary_size, level)
            publish(target, f"{base}/{name}", data)
            rows = [names, [name] * len(held), list(range(len(held))), [p[0] for p in places], [p[1] for p in places], [len(r) for r in held]]
            number, held, size, names = number + 1, [], 0, []
            kinds = [ids_type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["page_id", "file", "record", "offset", "length", "record_bytes"])

        ids_type, count = None, 0
        for batch in it:
            ids_type = batch.column(0).type
            for key, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                # the place in the job tells repeated rows apart
                r = record_bytes(f"{job}\n{task}\n{count}\n{key}\n{url}", url, html or b"", date)
                count += 1
                held.append(r)
                names.append(key)
                size += len(r)
                if size >= target_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


def write_archive(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    target_bytes: int = 32 << 20, dictionary_size: int = 64 << 10, level: int = 3, date: str | None = None,
) -> DataFrame:
    """Write every row of pages as a record of a .warc.zst file and return the index of what was written.

    Index: (page_id, file, record, offset, length, record_bytes), one row for every row of pages, file names relative
    to `folder` (a URI; a new one in the shared folder by default). Each task writes its own files of about
    `target_bytes` of records, with no shuffle; a file's dictionary is trained on all its records. Files bear the name of
    the job, so writes into one folder add to it; every record has an id of its own, repeated rows too. `date` is that of all
    records, the time of the call by default. A null body is
    an empty one, a null URL leaves its header out, line breaks in URLs become spaces, a null id stays null;
    repeated rows are repeated records; a record larger than a file's size has a file to itself; an empty table
    writes nothing. Files with too little to train on have no dictionary frame. The files are written when the index is computed.
    """
    folder = scratch_path(pages.sparkSession, "warc") if folder is None else folder
    date = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()) if date is None else date
    job = uuid.uuid4().hex[:12]
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{body_col}`").cast("binary").alias("body"))
    return rows.mapInArrow(
        _write(folder, job, target_bytes, dictionary_size, level, date), f"page_id {id_type}, file string, record long, offset long, length long, record_bytes long")


def read_archive(data: bytes) -> list[bytes]:
    """The records of a file: what any reader does that follows the dictionary frame."""
    dictionary, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        at = 8 + size
    out = []
    while at < len(data):
        d = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        out.append(d.decompress(data[at:]))
        at = len(data) - len(d.unused_data)
    return out
