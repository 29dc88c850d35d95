"""Payload de-duplication: local, by windows; against capture indexes, by joins. Content never crosses a shuffle here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digest import digest_prefix, digest_value, is_empty_payload
from ..functions.http import header_block
from ..functions.text import header_del, header_set, parse_ts14
from ..schema import REVISIT_PROFILE

THRESHOLD = 2048


def local_revisits(
    captures: DataFrame, order: list[str], digest: str = "payload_digest", size: str = "size",
    refers: tuple[str, ...] = ("record_id", "target_uri", "warc_date"), threshold: int = THRESHOLD,
) -> DataFrame:
    """Adds `warc_type` (response or revisit), `original` (the `refers` columns of the capture it repeats) and
    `original_size`.

    In the order of `order`, a capture of at least `threshold` bytes is a revisit if its payload was captured before;
    it refers to the latest earlier capture that is no revisit itself, of whatever size. Captures that are equal in order
    aren't earlier than one another. Empty payloads and null digests repeat nothing and are repeated by nothing.

    A frequent payload makes no skew: its first capture is found by a partial aggregate and joined back, and where all its
    captures are on one side of the threshold, as equal payloads mostly are, the first is what all others refer to. Only
    payloads with captures on both sides are put in order. Leave content out and join it back if it is needed.
    """
    alone = F.coalesce(is_empty_payload(digest), F.lit(False)) | F.col(digest).isNull()
    at, large = F.struct(*order), F.col(size) >= threshold
    of = F.struct(*(F.col(c).alias(f"r{k}") for k, c in enumerate(refers)), F.col(size).alias("size"))
    first = captures.where(~alone).groupBy(F.col(digest).alias("__digest")).agg(
        F.min(at).alias("__at"), F.min_by(of, at).alias("__first"), F.count(F.lit(1)).alias("__n"), (F.bool_or(large) & F.bool_or(~large)).alias("__mixed")).where("__n > 1")
    marked = captures.join(first, F.col(digest) == F.col("__digest"), "left").withColumn("__revisit", F.coalesce(large & (at > F.col("__at")), F.lit(False)))
    # captures of all other payloads form groups of their own
    w = Window.partitionBy(F.col("__digest"), F.when(~F.coalesce("__mixed", F.lit(False)), F.xxhash64(*order))).orderBy(*order)
    last = F.last(F.when(~F.col("__revisit"), of), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = marked.withColumn("__last", F.when(F.col("__revisit"), F.when(F.col("__mixed"), last).otherwise(F.col("__first"))))
    return out.withColumns({
        "warc_type": F.when(F.col("__revisit"), "revisit").otherwise("response"),
        "original": F.when(F.col("__revisit"), F.struct(*(F.col("__last")[f"r{k}"].alias(c) for k, c in enumerate(refers)))),
        "original_size": F.col("__last")["size"],
    }).drop("__digest", "__at", "__first", "__n", "__mixed", "__revisit", "__last")


def parse_cdx(lines: DataFrame, column: str = "value") -> DataFrame:
    """Index lines to (urlkey, ts14, original, mime, status, digest, length, fields, ts): split at white space."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    names = ("urlkey", "ts14", "original", "mime", "status", "digest", "length")
    cols = [F.get(F.col("p"), F.lit(k)).alias(n) for k, n in enumerate(names)]
    return lines.select(parts.alias("p")).select(*cols, F.size("p").alias("fields")).withColumn("ts", parse_ts14("ts14"))


_ENTRY = ("ts14", "original", "mime", "digest", "length", "fields", "ts")


def cdx_latest(index: DataFrame) -> DataFrame:
    """The last entry of every URL; on a tie of time the greatest digest. A partial aggregate, so no window is sorted."""
    best = F.max_by(F.struct(*_ENTRY), F.struct("ts14", "digest", "length"))
    return index.groupBy("original").agg(best.alias("e")).select(F.col("e.*"))


def _hit(digest: str) -> Column:
    e = F.col("e")
    return (e["fields"] >= 7) & (e["mime"] != "warc/revisit") & (digest_value(e["digest"]) == digest_value(digest))


def _entry() -> Column:
    e = F.col("e")
    return F.struct(F.lit(None).cast("string").alias("record_id"), e["original"].alias("target_uri"), e["ts"].alias("warc_date"))


def cdx_revisits(captures: DataFrame, index: DataFrame, url: str = "target_uri", digest: str = "payload_digest") -> DataFrame:
    """Adds `cdx` (record_id, target_uri, warc_date) where the URL's last index entry has the same payload."""
    latest = cdx_latest(index).select(F.struct(*_ENTRY).alias("e"), F.col("original").alias("__url"))
    joined = captures.join(latest, captures[url] == F.col("__url"), "left")
    return joined.withColumn("cdx", F.when(_hit(digest), _entry())).drop("e", "__url")


def cdx_revisits_as_of(
    captures: DataFrame, index: DataFrame, url: str = "target_uri", digest: str = "payload_digest", at: str = "warc_date"
) -> DataFrame:
    """The same against the last entry at or before each capture's own time: one sort of both sides by (URL, time)."""
    names = captures.columns
    left = captures.select(F.col(url).alias("__url"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*names).alias("__row"), F.lit(None).alias("e"))
    right = index.where(F.col("ts").isNotNull()).select(F.col("original").alias("__url"), F.col("ts").alias("__at"), F.lit(0).alias("__side"), F.lit(None).alias("__row"), F.struct(*_ENTRY).alias("e"))
    tie = F.coalesce(F.col("e.digest"), F.lit(""))
    w = Window.partitionBy("__url").orderBy("__at", "__side", tie).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("e", F.last("e", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__row.*", "e").withColumn("cdx", F.when(_hit(digest), _entry())).drop("e")


_JSON = "id string, uri string, date bigint"


def parse_json_index(lines: DataFrame, key: str = "digest", column: str = "value") -> DataFrame:
    """(digest, id, uri, date) of JSON replies; what isn't JSON is left out."""
    return lines.select(F.col(key).alias("digest"), F.from_json(column, _JSON).alias("j")).where("j.id is not null").select("digest", "j.*")


def json_revisits(captures: DataFrame, index: DataFrame, url: str = "target_uri", digest: str = "payload_digest") -> DataFrame:
    """Adds `json` (record_id, target_uri, warc_date) where an index has the payload under the same URI; of several
    entries the latest. SHA-1 only."""
    latest = index.groupBy(digest_value("digest").alias("__digest"), F.col("uri").alias("__uri")).agg(F.max_by(F.struct("id", "uri", "date"), F.struct("date", "id")).alias("e"))
    joined = captures.join(latest, (digest_value(digest) == F.col("__digest")) & (F.col(url) == F.col("__uri")), "left")
    e = F.col("e")
    found = F.struct(e["id"].alias("record_id"), e["uri"].alias("target_uri"), parse_ts14(e["date"].cast("string")).alias("warc_date"))
    return joined.withColumn("json", F.when(e.isNotNull() & digest_prefix(digest).isin("sha1", "sha-1"), found)).drop("e", "__digest", "__uri")


def cascade(captures: DataFrame, digest: str = "payload_digest", size: str = "size", threshold: int = THRESHOLD) -> DataFrame:
    """From `original`, `json` and `cdx` the first that is there: adds `revisit_of` and `dedupe_source`.

    The indexes are asked only for SHA-1 digests, and all three only for payloads that aren't empty in captures of at
    least `threshold` bytes. A missing lookup column counts as no match.
    """
    able = ~is_empty_payload(digest) & F.col(digest).isNotNull() & (F.col(size) >= threshold)
    sha1 = digest_prefix(digest).isin("sha1", "sha-1")
    found = {"local": F.col("original") if "original" in captures.columns else None}
    for name in ("json", "cdx"):
        found[name] = F.when(sha1, F.col(name)) if name in captures.columns else None
    there = {k: v for k, v in found.items() if v is not None}
    if not there:
        return captures.withColumn("dedupe_source", F.lit(None).cast("string"))
    first = F.coalesce(*there.values())
    source = F.coalesce(*(F.when(v.isNotNull(), k) for k, v in there.items()))
    return captures.withColumns({"revisit_of": F.when(able, first), "dedupe_source": F.when(able, source)})


def dedupe_counters(marked: DataFrame, size: str = "size", original_size: str = "original_size") -> DataFrame:
    """(dedupe_source, revisits, bytes_saved): local revisits save their original's size, others their own."""
    saved = F.when(F.col("dedupe_source") == "local", F.col(original_size)).otherwise(F.col(size))
    return marked.where(F.col("dedupe_source").isNotNull()).groupBy("dedupe_source").agg(
        F.count(F.lit(1)).alias("revisits"), F.sum(saved.cast("long")).alias("bytes_saved"))


def truncate_revisits(records: DataFrame, decision: str = "revisit_of") -> DataFrame:
    """Rows with a decision become revisit records: the block is cut behind its HTTP headers, and header entries name
    the original. `records` has `content` and `headers`."""
    d = F.col(decision)
    h = F.col("headers")
    date = F.concat(F.date_format(d["warc_date"], "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    for name in ("WARC-Type", "WARC-Profile", "WARC-Truncated", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date"):
        h = header_del(h, name)
    for name, value in (
        ("WARC-Type", F.lit("revisit")), ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Truncated", F.lit("length")),
        ("WARC-Refers-To", d["record_id"]), ("WARC-Refers-To-Target-URI", d["target_uri"]), ("WARC-Refers-To-Date", date),
    ):
        h = header_set(h, name, value)
    block = F.coalesce(header_block("content"), F.col("content"))
    return records.withColumns({
        "headers": F.when(d.isNotNull(), F.map_filter(h, lambda _, v: v.isNotNull())).otherwise(F.col("headers")),
        "warc_type": F.when(d.isNotNull(), "revisit").otherwise(F.col("warc_type")),
        "content": F.when(d.isNotNull(), block).otherwise(F.col("content")),
    })


def discard(captures: DataFrame, verdict: Column) -> tuple[DataFrame, DataFrame]:
    """Split captures by a verdict, a struct (drop boolean, reason string): what stays, and (target_uri, reason) of
    what goes. Neither request nor response of a discarded capture is kept."""
    judged = captures.withColumn("__verdict", verdict)
    gone = F.coalesce(F.col("__verdict")["drop"], F.lit(False))
    return judged.where(~gone).drop("__verdict"), judged.where(gone).select("target_uri", F.col("__verdict")["reason"].alias("reason"))
