"""Registered queries against DuckDB at the smallest size, and order-dependent operators against state machines."""

import bz2
import glob
import lzma
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stratarch.operators import dedupe, folds
from stratarch.plans import queries
from stratarch.plans.queries import ORACLE_SQL, QUERIES
from stratarch.sources.archive import ArchiveReader, file_sizes
from stratarch.streaming.dedupe import ttl_cache_stream, use_rocksdb

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else repr(x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(tuple(cell(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(cell(r[k]) for k in order) for r in want.fetchall())


def test_local_revisits_against_state_machine(spark):
    rng = random.Random(1)
    data = [(k, rng.choice(["sha1:A", "sha1:B", None, "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"]), rng.choice([100, 3000]), f"r{k}") for k in range(200)]
    df = spark.createDataFrame(data, "seq long, payload_digest string, size long, record_id string")
    got = {r.seq: (r.warc_type, r.original.record_id if r.original else None) for r in dedupe.local_revisits(df, ["seq"], refers=("record_id",)).collect()}
    last = {}
    for seq, d, size, rid in data:
        takes_part = d in ("sha1:A", "sha1:B")
        revisit = takes_part and d in last and size >= 2048
        assert got[seq] == (("revisit", last[d]) if revisit else ("response", None))
        if takes_part and not revisit:
            last[d] = rid


def test_rotation_and_cache_against_loops(spark):
    rng = random.Random(2)
    data = [(k, k % 3, rng.randint(0, 50), rng.randint(0, 10**9)) for k in range(300)]
    df = spark.createDataFrame(data, "seq long, writer long, size long, at long")
    got = {r.seq: r.file_number for r in folds.rotate(df, ["seq"], limit=100).collect()}
    state = {}
    for seq, w, size, _ in data:
        number, used = state.get(w, (0, 0))
        if used >= 100:
            number, used = number + 1, 0
        state[w] = (number, used + size)
        assert got[seq] == number
    hits = {r.seq: r.hit for r in folds.ttl_cache(df, "writer", "at", ["at", "seq"], 60.0).collect()}
    until = {}
    for seq, w, _, at in sorted(data, key=lambda r: (r[3], r[0])):
        hit = w in until and at < until[w]
        assert hits[seq] == hit
        if not hit:
            until[w] = at + 60_000_000


def test_cache_stream_equals_the_fold(spark, tmp_path):
    use_rocksdb(spark)
    data = [(f"k{k % 4}", k * 7_000_000, k) for k in range(100)]
    spark.createDataFrame(data, "key string, at long, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at long, seq long").parquet(str(tmp_path / "in"))
    q = ttl_cache_stream(stream, 60.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    df = spark.createDataFrame(data, "key string, at long, seq long")
    want = {(r.seq, r.hit) for r in folds.ttl_cache(df, "key", "at", ["at", "seq"], 60.0).collect()}
    assert {(r.seq, r.hit) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_hot_digests_of_nothing_are_spread(spark):
    """Empty payloads form windows of one row each, so the commonest digest makes no skew."""
    df = spark.range(1000).select(F.col("id").alias("seq"), F.lit("sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ").alias("payload_digest"), F.lit(5000).alias("size"), F.lit("r").alias("record_id"))
    out = dedupe.local_revisits(df, ["seq"], refers=("record_id",))
    assert out.where("warc_type = 'revisit'").count() == 0


def test_verify_written_in_rotated_files(spark, tmp_path):
    """Pages that don't compress fill more than one file a writer; the count is that of the SQL all the same."""
    rows = [(k, f"http://h/{k}", random.Random(k).randbytes(60_000).hex()) for k in range(160)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["verify_written"](spark, str(tmp_path))
    want = con.execute(ORACLE_SQL["verify_written"]).fetchall()
    assert [tuple(r) for r in got.collect()] == want


@pytest.mark.parametrize("folder", [True, False])
def test_stream_reads_a_table_where_it_lies(spark, tmp_path, monkeypatch, folder):
    """A table of one file or of many is split among tasks as it is, not copied by one of them."""
    t, at = spark.read.parquet(f"{SF}/documents.parquet"), tmp_path / "t" / "documents.parquet"
    t.repartition(6 if folder else 1).write.parquet(str(tmp_path / "made"))
    at.parent.mkdir()
    (tmp_path / "made" if folder else next((tmp_path / "made").glob("*.parquet"))).rename(at)
    monkeypatch.setattr(queries, "scratch_path", lambda _, name: str(tmp_path / "scratch" / name))
    got = QUERIES["stream_dedupe"](spark, str(at.parent))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}{'/*.parquet' if folder else ''}'")
    want = con.execute(ORACLE_SQL["stream_dedupe"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    written = [f for f in (tmp_path / "scratch").rglob("*.parquet") if f.is_file()]
    assert written and not any("text" in spark.read.parquet(str(f)).columns for f in written)


@pytest.mark.parametrize(("compressor", "whole"), [(bz2.BZ2Compressor, bz2.compress), (lzma.LZMACompressor, lzma.compress)])
def test_files_are_changed_in_pieces(spark, tmp_path, compressor, whole):
    """What is written is what compressing the whole file gives, and no more than a piece of it is read at once."""
    data = random.Random(3).randbytes(2_500_000) + bytes(700_000)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_bytes(data)
    (tmp_path / "a" / "none").write_bytes(b"")

    packed = queries._compressed(compressor)

    def change(pieces):
        def small():
            for piece in pieces:
                if len(piece) > 1 << 20:
                    raise ValueError("a piece is too long")
                yield piece

        return packed(small())

    queries._changed_files(spark, str(tmp_path / "a"), str(tmp_path / "b"), change, ".z")
    assert (tmp_path / "b" / "x.z").read_bytes() == whole(data) and (tmp_path / "b" / "none.z").read_bytes() == whole(b"")


def test_writers_follow_the_input_and_every_file_has_a_task(spark, tmp_path, monkeypatch):
    """More pages make more archives, not longer ones; they are compressed again one in a task and scanned by all cores."""
    monkeypatch.setattr(queries, "WRITER_BYTES", 10_000)
    path = queries._archives(spark, SF, "none", writers=None)
    files = file_sizes(spark, path).collect()
    assert len(files) > 8 and max(f.file_size for f in files) < 200_000

    def where(chunks):
        from pyspark import TaskContext

        return [*chunks, b" " * TaskContext.get().partitionId()]

    queries._changed_files(spark, path, str(tmp_path / "changed"), where)
    added = {f.file_size - (tmp_path / "changed" / f.file.rpartition("/")[2]).stat().st_size for f in files}
    assert len(added) == len(files)


def test_files_as_values_have_a_task_each(spark, duck, monkeypatch):
    """The values of a task are in memory together, so a task has one."""
    monkeypatch.setattr(queries, "WRITER_BYTES", 10_000)
    got = QUERIES["bytes_to_records"](spark, SF)
    per_task = got.select(F.spark_partition_id().alias("task"), "target_uri").groupBy("task").count().collect()
    assert len(per_task) > 8 and got.rdd.getNumPartitions() == len(per_task)
    assert got.count() == duck.execute("select count(*) from pages").fetchone()[0]


def test_scan_is_spread_over_cores(tmp_path):
    for k in range(12):
        (tmp_path / f"{k:02d}.warc.gz").write_bytes(bytes(3 << 20))
    parts = ArchiveReader({"path": str(tmp_path), "minpartitionnum": "6"}).partitions()
    assert len(parts) == 6 and sum(len(p.files) for p in parts) == 12
    assert len(ArchiveReader({"path": str(tmp_path), "minpartitionnum": "600"}).partitions()) == 12


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
