"""Captures to records: request and response blocks become pairs of records that name each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import digest
from ..functions.http import request_target_uri, with_payload


def name_uuid(*parts: Column | str) -> Column:
    """A record id that follows from its parts, so that a task that runs again gives the same one."""
    h = F.sha1(F.concat_ws("\n", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))
    cuts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def capture_records(captures: DataFrame, algorithm: str = "sha1") -> DataFrame:
    """Two records for every capture (seq, capture_time, scheme, request, response, ip): the response first, both with
    `batch_id`, the request's URI, and each other's id. Captures without a readable request are left out."""
    uri = request_target_uri("scheme", "request")
    named = captures.withColumn("target_uri", uri).where(F.col("target_uri").isNotNull())
    base = with_payload(named, "response", "__payload").withColumns({
        "__res": name_uuid(F.lit("response"), "seq", "target_uri"), "__req": name_uuid(F.lit("request"), "seq", "target_uri"),
        "payload_digest": digest("__payload", algorithm)})
    sides = F.explode(F.array(
        F.struct(F.lit("response").alias("warc_type"), F.col("__res").alias("record_id"), F.col("__req").alias("concurrent_to"), F.col("response").alias("content"), F.col("payload_digest").alias("payload_digest")),
        F.struct(F.lit("request").alias("warc_type"), F.col("__req").alias("record_id"), F.col("__res").alias("concurrent_to"), F.col("request").alias("content"), F.lit(None).cast("string").alias("payload_digest"))))
    out = base.select(F.col("seq").alias("batch_id"), "capture_time", "target_uri", "ip", sides.alias("s")).select("batch_id", "capture_time", "target_uri", "ip", "s.*")
    kind = F.concat(F.lit("application/http; msgtype="), F.col("warc_type"))
    headers = F.when(F.col("ip").isNotNull(), F.create_map(F.lit("WARC-IP-Address"), F.col("ip"))).otherwise(F.create_map().cast("map<string,string>"))
    return out.withColumns({"content_type": kind, "headers": headers}).drop("ip")


def new_records(rows: DataFrame, content: str = "content", headers: dict[str, Column | str] | None = None, batch: str | None = None) -> DataFrame:
    """Records made of any rows: `content` is the block, `headers` names header columns, rows of one `batch` stay together.

    What isn't given (type, id, date, length, digest) is filled in by the writer.
    """
    given = [x for k, c in (headers or {}).items() for x in (F.lit(k), (F.col(c) if isinstance(c, str) else c).cast("string"))]
    made = F.map_filter(F.create_map(*given), lambda _, v: v.isNotNull()) if given else F.create_map().cast("map<string,string>")
    return rows.select(*([F.col(batch).alias("batch_id")] if batch else []), made.alias("headers"), F.col(content).cast("binary").alias("content"))


def pair_records(records: DataFrame) -> DataFrame:
    """(response_id, request_id, target_uri, response_type) of responses or revisits and the requests they name."""
    left = records.where(F.col("warc_type").isin("response", "revisit")).select(
        F.col("record_id").alias("response_id"), F.col("concurrent_to").alias("__to"), "target_uri", F.col("warc_type").alias("response_type"))
    right = records.where(F.col("warc_type") == "request").select(F.col("record_id").alias("request_id"), F.col("concurrent_to").alias("__back"))
    return left.join(right, (F.col("__to") == F.col("request_id")) & (F.col("__back") == F.col("response_id"))).drop("__to", "__back")


def in_write_order(records: DataFrame) -> DataFrame:
    """Batches in order, of each the response or revisit first."""
    return records.orderBy("batch_id", F.when(F.col("warc_type").isin("response", "revisit"), 0).otherwise(1))


def stamp_warcinfo(records: DataFrame) -> DataFrame:
    """Every record with the id of its file's information record, as `warcinfo_id`."""
    info = records.where(F.col("warc_type") == "warcinfo").groupBy(F.col("file").alias("__file")).agg(F.min_by("record_id", "record_index").alias("__info"))
    joined = records.join(info, records.file == F.col("__file"), "left")
    return joined.withColumn("warcinfo_id", F.when(F.col("warc_type") != "warcinfo", F.coalesce("__info", "warcinfo_id"))).drop("__file", "__info")
