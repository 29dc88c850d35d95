"""Integrity checks of scanned records, and their roll-up by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import digest_matches, digest_prefix, is_digest_supported
from ..functions.http import has_crawler_encoding, is_response_record, with_payload
from ..schema import VERSIONS


def version_valid(version: Column | str) -> Column:
    v = F.col(version) if isinstance(version, str) else version
    return F.coalesce(v.isin(*VERSIONS), F.lit(False))


def verify_records(records: DataFrame, strict: bool = False, blake: bool = True) -> DataFrame:
    """Adds `checked`, `block_errors`, `payload_errors` and `version_errors` to scanned records (with content).

    Only HTTP responses of their own are checked; of them a block digest is required and a payload digest, if any,
    must be that of the HTTP body. An unsupported algorithm, an unreadable message and a block that a crawler has
    decoded are errors too. `strict`: see digest_matches.
    """
    checked = F.col("error").isNull() & is_response_record("warc_type", "content_type")
    block, body = F.col("block_digest"), F.col("payload_digest")

    def wrong(content: Column, declared: Column) -> Column:
        ok = F.coalesce(digest_matches(content, declared, strict, blake), F.lit(False))
        return ~is_digest_supported(digest_prefix(declared)) | ~ok

    def when_checked(c: Column) -> Column:
        return F.when(F.col("checked") & c, 1).otherwise(0)

    # texts of rows that aren't checked go to no hash and no Python function
    marked = records.withColumn("checked", checked).withColumn("__content", F.when(F.col("checked"), F.col("content")))
    marked = with_payload(marked.withColumn("__message", F.when(body.isNotNull(), F.col("__content"))), "__message", "__payload")
    unreadable = has_crawler_encoding("__message") | F.col("__payload").isNull()
    return marked.withColumns({
        "block_errors": when_checked(block.isNull() | wrong(F.col("__content"), block)),
        "payload_errors": when_checked(body.isNotNull() & (unreadable | wrong(F.col("__payload"), body))),
        "version_errors": when_checked(~version_valid("version")),
    }).drop("__content", "__message", "__payload")


def verify_rollup(verified: DataFrame) -> DataFrame:
    """(file, valid, record_count, errors_count, all_records_read) from verify_records; a read error is one error.

    Partial sums by file cross the shuffle, never records.
    """
    broken = F.col("error").isNotNull()
    errors = F.col("block_errors") + F.col("payload_errors") + F.col("version_errors") + broken.cast("int")
    out = verified.groupBy("file").agg(
        F.count_if(~broken).alias("record_count"), F.sum(errors).cast("long").alias("errors_count"), (F.count_if(broken) == 0).alias("all_records_read"))
    return out.select("file", (F.col("errors_count") == 0).alias("valid"), "record_count", "errors_count", "all_records_read")


def error_rows(records: DataFrame) -> DataFrame:
    """(file, record_index, offset, error) where a file breaks: what a sink of its own keeps of a scan."""
    return records.where(F.col("error").isNotNull()).select("file", "record_index", "offset", "error")


def verify_files(records: DataFrame, strict: bool = False) -> DataFrame:
    """verify_records and verify_rollup in one. Files without records give no row."""
    return verify_rollup(verify_records(records, strict))
