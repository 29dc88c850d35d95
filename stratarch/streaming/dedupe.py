"""Capture streams: stateful de-duplication, caches with a time to live, shared lookups, archive output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.digest import EMPTY_DIGESTS
from ..sources.archive import write_archives

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEDUPE_SCHEMA = "payload_digest string, seq long, size long, record_id string, warc_type string, original_id string, original_size long"
CACHE_SCHEMA = "key string, seq long, hit boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """State lives on disk beside the executors and in the checkpoint, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Dedupe(StatefulProcessor):
    """Per payload digest, the latest capture that was no revisit."""

    def __init__(self, threshold: int, ttl_ms: int | None):
        self.threshold, self.ttl_ms = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "record_id string, size long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("seq", kind="stable")
        digest = key[0]
        empty = digest in EMPTY_DIGESTS
        held = tuple(self.last.get()) if self.last.exists() else None
        before, out = held, []
        for seq, size, record in zip(part["seq"].tolist(), part["size"].tolist(), part["record_id"].tolist()):
            revisit = not empty and held is not None and size >= self.threshold
            out.append((digest, seq, size, record, "revisit" if revisit else "response", held[0] if revisit else None, held[1] if revisit else None))
            if not revisit and not empty:
                held = (record, size)
        if held != before:
            self.last.update(held)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in DEDUPE_SCHEMA.split(", ")])
        yield frame.astype({"original_size": "Int64"})

    def close(self) -> None:
        pass


def dedupe_stream(captures: DataFrame, threshold: int = 2048, ttl_ms: int | None = None) -> DataFrame:
    """captures (payload_digest, seq, size, record_id) to responses and revisits, as they arrive.

    Within a micro-batch the order is that of seq. `ttl_ms` lets state of payloads not seen for so long go, in the
    place of a cache of fixed size. The batch operator local_revisits is authoritative where arrival isn't in order.
    """
    keyed = captures.select("payload_digest", "seq", "size", "record_id").groupBy("payload_digest")
    return keyed.transformWithStateInPandas(_Dedupe(threshold, ttl_ms), outputStructType=DEDUPE_SCHEMA, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


class _Cache(StatefulProcessor):
    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        until = self.until.get()[0] if self.until.exists() else None
        hits = []
        for at in part["at"].tolist():
            hit = until is not None and at < until
            if not hit:
                until = at + self.ttl_us
            hits.append(hit)
        self.until.update((until,))
        yield pd.DataFrame({"key": [key[0]] * len(part), "seq": part["seq"].to_numpy(), "hit": hits})

    def close(self) -> None:
        pass


def ttl_cache_stream(lookups: DataFrame, ttl_seconds: float) -> DataFrame:
    """lookups (key, at in microseconds, seq) to hits and misses of a cache whose entries live `ttl_seconds` from
    being stored, by the rows' own time."""
    keyed = lookups.select("key", "at", "seq").groupBy("key")
    return keyed.transformWithStateInPandas(_Cache(int(ttl_seconds * 1_000_000)), outputStructType=CACHE_SCHEMA, outputMode="Append", timeMode="None")


def single_flight_stream(lookups: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """The first lookup of a key within `seconds` of the watermark; later ones share its answer and are dropped."""
    return lookups.withWatermark(at, f"{seconds} seconds").dropDuplicatesWithinWatermark(keys)


def archive_stream(records: DataFrame, folder: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, **options):
    """Write a stream of records as archives, each micro-batch published whole; `then` is told what is on disk.

    Files of a batch that runs again after a failure carry its number, and those of the failed try are removed first.
    """
    from ..sources.files import listing, locate

    prefix = options.pop("prefix", "WARC")

    def one(batch: DataFrame, number: int) -> None:
        own = f"{prefix}b{number:09d}"
        system, inner = locate(folder)
        if system.get_file_info(inner).type.name == "Directory":
            for path, _ in listing(folder, True):
                if path.rpartition("/")[2].startswith(f"{own}-"):
                    system.delete_file(locate(path)[1])
        write_archives(batch, folder, prefix=own, **options)
        if then is not None:
            then(batch, number)

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def in_flight(query) -> int:
    """Rows that a running stream has taken in and not yet published: those of the trigger under way."""
    progress = query.lastProgress
    if progress is None or not query.status["isTriggerActive"]:
        return 0
    return int(progress["numInputRows"])


def with_watermark(df: DataFrame, at: str, delay: str) -> DataFrame:
    """Event-time bound for late rows; `at` without a zone is taken as UTC."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
