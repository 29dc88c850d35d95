"""The record table: one row for every archived record, and what the engine calls its parts."""

from __future__ import annotations

from pyspark.sql import types as T

#: Headers with a column of their own, so that filters on them reach the scan.
HOT_HEADERS = {
    "warc_type": "warc-type",
    "record_id": "warc-record-id",
    "warc_date_raw": "warc-date",
    "target_uri": "warc-target-uri",
    "content_type": "content-type",
    "block_digest": "warc-block-digest",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "concurrent_to": "warc-concurrent-to",
    "warcinfo_id": "warc-warcinfo-id",
}

RECORD_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("record_index", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("version", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    *(T.StructField(name, T.StringType()) for name in HOT_HEADERS),
    T.StructField("warc_date", T.TimestampType()),
    T.StructField("content_length", T.LongType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("error", T.StringType()),
])

VERSIONS = ("WARC/1.0", "WARC/1.1")
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
