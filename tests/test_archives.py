"""Archives written and read in every codec, damaged in every way, verified, mended and extracted."""

import bz2
import gzip
import io
import lzma
import os
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from stratarch import cli
from stratarch.operators import capture, dedupe, extract, mend, verify
from stratarch.sources import codec
from stratarch.sources.archive import block_digest, file_sizes, read_archives, read_archives_stream, write_archives


def record(k, content, kind="response", **more):
    headers = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{k}>", "WARC-Target-URI": f"http://h/{k}.html", "WARC-Date": "2024-01-01T00:00:00Z",
               "Content-Type": "application/http; msgtype=response" if kind == "response" else "application/warc-fields", "Content-Length": str(len(content)),
               "WARC-Block-Digest": block_digest(content, "sha1"), **more}
    return codec.frame("WARC/1.1", {k: v for k, v in headers.items() if v is not None}, content)


BLOCKS = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"x" * n for n in (10, 70_000, 0, 300)]
RECORDS = [record("info", b"software: t\r\n", "warcinfo"), *(record(k, b) for k, b in enumerate(BLOCKS))]


def zstd_with_dictionary(records):
    d = zstandard.train_dictionary(4096, [f"{k} some sample text {k * 7} of records".encode() * 9 for k in range(500)])
    e = codec.Encoder("zstd", d.as_bytes())
    return e.head + b"".join(e.encode(r) for r in records)


CODECS = {
    "plain.warc": lambda r: b"".join(r), "gz.warc.gz": lambda r: b"".join(map(gzip.compress, r)), "bz.warc.bz2": lambda r: bz2.compress(b"".join(r)),
    "xz.warc.xz": lambda r: lzma.compress(b"".join(r)), "z.warc.zst": lambda r: b"".join(map(codec.Encoder("zstd").encode, r)), "d.warc.zst": zstd_with_dictionary,
}


def scan(data, **options):
    return list(codec.records(io.BytesIO(data), **options))


@pytest.mark.parametrize("name", CODECS)
def test_codecs(name):
    got = scan(CODECS[name](RECORDS))
    assert [r.error for r in got] == [None] * 5 and [r.content for r in got[1:]] == BLOCKS
    assert all(r.header("warc-type") for r in got) and [r.index for r in got] == list(range(5))


def test_offsets_agree_with_the_independent_finder():
    data = CODECS["gz.warc.gz"](RECORDS)
    got = [(r.offset, r.size) for r in scan(data)]
    assert got == codec.gzip_members(data) and sum(n for _, n in got) == len(data)
    assert all((r.offset, r.size) == (-1, -1) for r in scan(CODECS["plain.warc"](RECORDS)))


def test_damage_is_a_row():
    plain, gz = CODECS["plain.warc"](RECORDS), CODECS["gz.warc.gz"](RECORDS)
    assert scan(plain[:-2])[-1].error == "reading record boundary: EOF" and len(scan(plain[:-2])) == 5
    assert scan(gz + b"garbage that is no member")[-1].error == "gzip: invalid header"
    assert "EOF" in scan(gz[:-5])[-1].error and len(scan(gz[:-5])) == 5
    flipped = bytearray(gz)
    flipped[len(gz) - 60] ^= 0xFF
    assert scan(bytes(flipped))[-1].error
    assert scan(b"WARC/") == [] and scan(b"") == []
    for bad in ("x", "-5", None):
        out = scan(record(1, b"abc", **{"Content-Length": bad}))
        assert len(out) == 1 and "Content-Length" in out[0].error
    two = gzip.compress(RECORDS[1] + RECORDS[2])
    assert len(scan(two)) == 1 and scan(two)[0].error is None and scan(two, strict_members=True)[-1].error
    assert scan(gzip.compress(b"") + gzip.compress(RECORDS[1]))[0].content == BLOCKS[0]
    assert "EOF" in scan(plain[: len(RECORDS[0]) + 30])[-1].error


def test_content_can_be_left_out_or_cut():
    gz = CODECS["gz.warc.gz"](RECORDS)
    assert [r.content for r in scan(gz, content=False)] == [None] * 5
    assert [len(r.content) for r in scan(gz, most=100)][1:] == [min(100, len(b)) for b in BLOCKS]
    assert scan(record("a", b"", **{"warc-type": "second"}))[0].header("warc-type") == "second"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    for name, make in CODECS.items():
        (at / name).write_bytes(make(RECORDS))
    return at


def test_scan_of_a_folder(spark, folder):
    df = read_archives(spark, str(folder))
    got = df.groupBy("file").agg(F.count("*").alias("n"), F.max("error").alias("e")).collect()
    assert len(got) == 6 and all(r.n == 5 and r.e is None for r in got)
    one = read_archives(spark, str(folder / "*.gz")).where("warc_type = 'response' and record_index >= 3").collect()
    assert [r.record_index for r in one] == [3, 4] and one[0].warc_date.year == 2024 and bytes(one[1].content) == BLOCKS[3]
    assert read_archives(spark, str(folder), content=False).where("content is not null").count() == 0
    assert read_archives(spark, str(folder)).where(F.col("file").endswith("plain.warc")).count() == 5
    assert read_archives(spark, str(folder)).where("warc_type not in ('warcinfo') or target_uri is null").count() == 24


def test_splits_find_every_member_once(spark, tmp_path):
    records = [record(k, os.urandom(3000)) for k in range(200)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    whole = read_archives(spark, str(tmp_path)).select("offset", "record_id").collect()
    cut = read_archives(spark, str(tmp_path), splitBytes=50_000)
    assert cut.rdd.getNumPartitions() > 5 and sorted(cut.select("offset", "record_id").collect()) == sorted(whole)
    ordered = [r.offset for r in cut.orderBy("record_index").collect()]
    assert ordered == sorted(ordered)


@pytest.fixture(scope="module")
def captured(spark):
    rows = [(k, "http", f"GET /p{k % 5} HTTP/1.1\r\nHost: h{k % 3}\r\n\r\n".encode(), BLOCKS[k % 2] + bytes([k % 4]) * 3000, "192.0.2.1") for k in range(40)]
    df = spark.createDataFrame([(k, s, bytearray(a), bytearray(b), ip) for k, s, a, b, ip in rows], "seq long, scheme string, request binary, response binary, ip string")
    return df.withColumn("capture_time", F.timestamp_seconds(F.lit(1704067200) + F.col("seq")))


@pytest.mark.parametrize("compression", ["gzip", "zstd", "none"])
def test_written_archives_verify(spark, captured, tmp_path, compression):
    records = capture.capture_records(captured).repartition(2, "batch_id").sortWithinPartitions("batch_id")
    write_archives(records, str(tmp_path / "w"), compression=compression, digest="sha256_base16", prefix="P", hostname="host")
    names = sorted(os.listdir(tmp_path / "w"))
    assert len(names) == 2 and all(n.startswith("P-") and "-00001-host-" in n and not n.endswith(".open") for n in names)
    df = read_archives(spark, str(tmp_path / "w")).cache()
    assert df.groupBy("warc_type").count().where("warc_type = 'warcinfo'").first()["count"] == 2 and df.count() == 82
    assert df.where("warc_type <> 'warcinfo' and warcinfo_id is null").count() == 0
    assert all(r.valid and r.all_records_read for r in verify.verify_files(df).collect())
    assert capture.pair_records(df).count() == 40
    raw = (tmp_path / "w" / names[0]).read_bytes()
    if compression == "zstd":
        p = zstandard.get_frame_parameters(raw)
        assert p.has_checksum and p.content_size > 0


def test_rotation_never_parts_a_batch(spark, tmp_path):
    rows = [(k // 2, "response", bytearray(os.urandom(400_000))) for k in range(16)]
    df = spark.createDataFrame(rows, "batch_id long, warc_type string, content binary").coalesce(1).sortWithinPartitions("batch_id")
    write_archives(df, str(tmp_path / "r"), maxFileMb=1, compression="none")
    got = read_archives(spark, str(tmp_path / "r")).where("warc_type = 'response'").groupBy("file").count().collect()
    assert len(got) == 4 and all(r["count"] == 4 for r in got)
    with pytest.raises(Exception, match="unknown compression"):
        write_archives(df, str(tmp_path / "bad"), compression="lzw")


def test_mend(spark, tmp_path):
    gz = CODECS["gz.warc.gz"](RECORDS)
    files = {
        "good.warc.gz.open": gz, "tail.warc.gz.open": gz + b"\x00" * 24, "cut.warc.gz.open": gz[:-9], "empty.warc.gz.open": gzip.compress(b""), "closed.warc.gz": gz,
        "first.warc.gz.open": gz[:40], "info.warc.gz": gzip.compress(RECORDS[0]), "plain.warc.gz.open": b"".join(RECORDS),
    }
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    plan = {os.path.basename(r.file): r for r in mend.plan_files(spark, str(tmp_path)).collect()}
    assert {n: r.action for n, r in plan.items()} == {
        "good.warc.gz.open": "rename", "tail.warc.gz.open": "truncate_rename", "cut.warc.gz.open": "truncate_rename", "empty.warc.gz.open": "rename", "closed.warc.gz": "skipped",
        "first.warc.gz.open": "rename", "info.warc.gz": "skipped", "plain.warc.gz.open": "skipped"}
    assert plan["tail.warc.gz.open"].truncate_at == len(gz) and plan["cut.warc.gz.open"].record_count == 4 and plan["closed.warc.gz"].file_size == 0
    before = {n: (tmp_path / n).read_bytes() for n in files}
    df = mend.plan_files(spark, str(tmp_path), force=True).cache()
    forced = {os.path.basename(r.file): r.action for r in df.collect()}
    assert forced["closed.warc.gz"] == "ok" and forced["info.warc.gz"] == "delete_candidate"
    mend.apply_plan(df)
    assert {n: (tmp_path / n).read_bytes() for n in os.listdir(tmp_path)} == before
    total = mend.mend_summary(df).first()
    assert (total.truncated, total.renamed, total.deleted, total.skipped, total.bytes_truncated) == (2, 5, 1, 1, 24 + len(gz) - 9 - plan["cut.warc.gz.open"].truncate_at)
    mend.apply_plan(df, dry_run=False)
    assert (tmp_path / "tail.warc.gz").read_bytes() == gz and (tmp_path / "info.warc.gz").exists() and not (tmp_path / "good.warc.gz.open").exists()
    checked = {os.path.basename(r.file): r for r in verify.verify_files(read_archives(spark, str(tmp_path / "[ctg]*.warc.gz"))).collect()}
    assert all(r.valid for r in checked.values()) and checked["cut.warc.gz"].record_count == 4


def test_verify_finds_each_fault(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nbody"
    payload = block_digest(b"body", "sha1")
    cases = {
        "ok": record(1, body, **{"WARC-Payload-Digest": payload}), "block": record(1, body, **{"WARC-Block-Digest": payload}), "missing": record(1, body, **{"WARC-Block-Digest": None}),
        "payload": record(1, body, **{"WARC-Payload-Digest": block_digest(b"x", "sha1")}), "md5": record(1, body, **{"WARC-Block-Digest": "md5:1"}), "version": record(1, body).replace(b"WARC/1.1", b"WARC/0.9"),
        "crawler": record(1, b"HTTP/1.1 200 OK\r\nX-Crawler-Content-Encoding: gzip\r\n\r\nbody", **{"WARC-Payload-Digest": payload}), "cut": record(1, body)[:-2],
        "blake": record(1, body, **{"WARC-Block-Digest": block_digest(body, "blake3")}), "request": record(1, body, "request", **{"WARC-Block-Digest": "md5:1"}),
    }
    for n, b in cases.items():
        (tmp_path / n).write_bytes(b)
    got = {os.path.basename(r.file): r.errors_count for r in verify.verify_files(read_archives(spark, str(tmp_path))).collect()}
    assert got == {"ok": 0, "block": 1, "missing": 1, "payload": 1, "md5": 1, "version": 1, "crawler": 1, "cut": 1, "blake": 0, "request": 0}


def test_extract(spark, tmp_path):
    page = lambda b, t=b"text/html", extra=b"": b"HTTP/1.1 200 OK\r\nContent-Type: " + t + b"\r\n" + extra + b"\r\n" + b
    records = [record(1, page(b"one")), record(1, page(b"one")), record(1, page(b"two")), record(2, page(gzip.compress(b"packed"), b"text/plain", b"Content-Encoding: gzip\r\n")), record(3, page(b"img", b"image/png"))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    selected = extract.responses(read_archives(spark, str(tmp_path / "a.warc.gz")), ["html", "plain"])
    report = {r.http_content_type: r["count"] for r in extract.extract_report(selected).collect()}
    assert report == {"text/html": 3, "text/plain": 1}
    plan = extract.extract_plan(selected, host_sort=True)
    for _ in range(2):  # the second time everything is there
        got = [r.status for r in extract.write_payloads(plan, str(tmp_path / "out"), hash_suffix=True).orderBy("record_index").collect()]
        assert got in (["written", "left_out", "written", "written"], ["exists", "left_out", "exists", "exists"])
    made = {n: (tmp_path / "out" / "h" / n).read_bytes() for n in os.listdir(tmp_path / "out" / "h")}
    assert made["1.html"] == b"one" and made["2.html"] == b"packed" and len(made) == 3 and b"two" in made.values()


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main(["--json", "verify", str(folder / "gz.warc.gz")]) == 0
    assert '"valid": true' in capsys.readouterr().out
    assert cli.main(["extract", "-o", str(tmp_path / "o"), str(folder / "gz.warc.gz")]) == 0 and len(os.listdir(tmp_path / "o")) == 4
    assert cli.main(["mend", "--dry-run", "--force", str(folder / "gz.warc.gz")]) == 0 and "total=1" in capsys.readouterr().out


def test_stream_of_archives(spark, folder, tmp_path):
    out = read_archives_stream(spark, str(folder), pattern="*.warc.gz")
    q = out.select("file", "record_index", "warc_type").writeStream.format("memory").queryName("scanned").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from scanned").count() == 5


def test_dictionary_frame_layout():
    data = zstd_with_dictionary(RECORDS)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == codec.DICTIONARY_MAGIC and zstandard.ZstdDecompressor().decompressobj().decompress(data[8 : 8 + size])


def test_revisits_are_truncated_and_discarded(spark):
    of = F.struct(F.lit("<urn:x>").alias("record_id"), F.lit("http://o").alias("target_uri"), F.timestamp_seconds(F.lit(0)).alias("warc_date"))
    df = spark.createDataFrame([(bytearray(BLOCKS[0]), {"warc-type": "response"}, "response", "u")], "content binary, headers map<string,string>, warc_type string, target_uri string")
    r = dedupe.truncate_revisits(df.withColumn("revisit_of", of)).first()
    assert bytes(r.content) == BLOCKS[0][:-10] and r.headers["WARC-Type"] == "revisit" and r.headers["WARC-Refers-To-Date"] == "1970-01-01T00:00:00Z"
    kept, gone = dedupe.discard(df, F.struct(F.lit(True).alias("drop"), F.lit("429").alias("reason")))
    assert kept.count() == 0 and gone.first().asDict() == {"target_uri": "u", "reason": "429"}
    assert file_sizes(spark, __file__).first().file_size == os.path.getsize(__file__)


def test_one_scan_filtered_twice_in_a_plan(spark, tmp_path):
    """Filters of two uses of a relation don't mix; pushed down on request, one use skips contents."""
    from stratarch.operators import capture
    from stratarch.sources.archive import read_archives, write_archives

    rows = spark.createDataFrame([(k, f"http://x/{k}", "body" * 9) for k in range(5)], "k long, url string, content string")
    write_archives(capture.new_records(rows, "content", {"WARC-Target-URI": "url"}).coalesce(1), str(tmp_path / "w"))
    r = read_archives(spark, str(tmp_path / "w"))
    infos, made = r.where("warc_type = 'warcinfo'"), r.where("warc_type = 'resource'")
    assert infos.select("file").unionByName(made.select("file")).count() == 6
    assert infos.select("file").join(made.select("file", "target_uri"), "file").count() == 5
    once = read_archives(spark, str(tmp_path / "w"), pushFilters=True).where("warc_type = 'resource'")
    assert once.count() == 5


def test_failed_attempts_leave_no_open_files(spark, tmp_path):
    """A task that dies once has left an open file; the retry's files are published and the rest is gone."""
    from stratarch.sources.archive import ArchiveWriter, Written, write_archives

    folder = tmp_path / "w"
    writer = ArchiveWriter({"path": str(folder)}, spark.createDataFrame([], "content binary").schema, False)
    for name in ("lost", "kept"):
        (folder / f"WARC-1-00001-h-{writer.job}x{name}.warc.gz.open").write_bytes(b"")
    (folder / "WARC-1-00001-h-otherjobx0.warc.gz.open").write_bytes(b"")
    writer.commit([Written([f"WARC-1-00001-h-{writer.job}xkept.warc.gz.open"], 0, 0), None])
    assert sorted(p.name for p in folder.iterdir()) == sorted([f"WARC-1-00001-h-{writer.job}xkept.warc.gz", "WARC-1-00001-h-otherjobx0.warc.gz.open"])

    def broken(it):
        yield from it
        raise RuntimeError("no")

    rows = spark.createDataFrame([(b"x",)], "content binary").coalesce(1).mapInArrow(broken, "content binary")
    with pytest.raises(Exception):
        write_archives(rows, str(folder / "2"))
    assert not list((folder / "2").iterdir())


def test_table_function_makes_rows_without_batches(spark, monkeypatch):
    """Rows of the table function are those of a scan, error rows too, and cost no Arrow batch each."""
    from stratarch.sources import archive

    data = CODECS["gz.warc.gz"]([*RECORDS, record("twice", b"abc", **{"warc-type": "second", "WARC-Date": "no date"})]) + b"garbage that is no member"
    found = scan(data)
    want = [tuple(dict(v) if k == "headers" and v is not None else v for k, v in row.items()) for row in archive.to_batch(found, "p").to_pylist()]

    def never(rows, path):
        raise AssertionError("a batch was made")

    monkeypatch.setattr(archive, "to_batch", never)
    assert [archive.to_row(r, "p") for r in found] == want and want[-1][-1] == "gzip: invalid header"
    archive.register_functions(spark)
    monkeypatch.undo()
    files = spark.createDataFrame([("p", bytearray(data)), ("none", None)], "path string, data binary")
    got = spark.sql("SELECT r.* FROM {files} f, LATERAL archive_records(f.path, f.data) r", files=files).orderBy("record_index").collect()
    assert [tuple(r) for r in got] == [tuple(x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x for x in row) for row in want]
