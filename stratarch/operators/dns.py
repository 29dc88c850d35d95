"""Archived name lookups: answer records, address families, shared lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dns_answers(records: DataFrame) -> DataFrame:
    """(host, family, address, record_id, warc_date, warc_type) of `dns:` records: of each the first answer of its type.

    The block is the reply's text; an answer is a line `name ttl IN A address`.
    """
    text = F.decode(F.col("content"), "UTF-8")
    kind = F.regexp_extract("target_uri", r"\?TYPE=(A{1}|A{4})$", 1)
    first = F.when(kind == "A", F.regexp_extract(text, r"(?m)^\S+\s+\d+\s+IN\s+A\s+(\S+)", 1)).otherwise(F.regexp_extract(text, r"(?m)^\S+\s+\d+\s+IN\s+AAAA\s+(\S+)", 1))
    found = records.where(F.col("target_uri").startswith("dns:") & (kind != ""))
    return found.select(
        F.regexp_extract("target_uri", r"^dns:([^?]*)", 1).alias("host"), F.when(kind == "A", "ipv4").otherwise("ipv6").alias("family"),
        F.nullif(first, F.lit("")).alias("address"), "record_id", "warc_date")


def address_family(address: Column | str) -> Column:
    """ipv4 or ipv6 of an address literal; null for a name."""
    a = F.col(address) if isinstance(address, str) else address
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    return F.when(a.rlike(rf"^({octet}\.){{3}}{octet}$"), "ipv4").when(a.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"), "ipv6")


def usable_families(answers: DataFrame, disable_ipv4: bool = False, disable_ipv6: bool = False) -> DataFrame:
    """Answers without those of a disabled family."""
    off = [f for f, no in (("ipv4", disable_ipv4), ("ipv6", disable_ipv6)) if no]
    return answers.where(~F.col("family").isin(*off)) if off else answers


def literal_answers(hosts: DataFrame, disable_ipv4: bool = False, disable_ipv6: bool = False, host: str = "host") -> DataFrame:
    """Adds ipv4, ipv6 and error: a host that is an address answers itself, one of a disabled family is an error; names
    have nulls and are left to a lookup."""
    kind, found = address_family(host), F.col(host)
    error = F.when((kind == "ipv4") & F.lit(disable_ipv4), "IPv4 is disabled").when((kind == "ipv6") & F.lit(disable_ipv6), "IPv6 is disabled")
    return hosts.withColumns({"ipv4": F.when((kind == "ipv4") & error.isNull(), found), "ipv6": F.when((kind == "ipv6") & error.isNull(), found), "error": error})


def combine_answers(answers: DataFrame, at: str = "warc_date") -> DataFrame:
    """(host, ipv4, ipv6, error): of each family the earliest answer; an error only where neither has one."""

    def first(family: str) -> Column:
        there = (F.col("family") == family) & F.col("address").isNotNull()
        return F.min_by(F.when(there, F.col("address")), F.when(there, F.struct(at, "address")))

    out = answers.groupBy("host").agg(first("ipv4").alias("ipv4"), first("ipv6").alias("ipv6"))
    return out.withColumn("error", F.when(F.col("ipv4").isNull() & F.col("ipv6").isNull(), "no address"))


def round_robin(rows: DataFrame, order: list[str], count: int, out: str = "choice") -> DataFrame:
    """Adds a number below `count` by turns in the order of `order`.

    Numbering is distributed: rows are ranged over partitions by the order, partitions are counted, and each row's
    place is its partition's start plus its own place.
    """
    from pyspark.sql import Window

    # a fixed number of partitions: adaptive execution must not join any, or places would change between the two reads
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    within = ranged.withColumn("__place", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    counts = within.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    placed = within.join(F.broadcast(starts), F.col("__part") == F.col("__p"))  # a row for each partition
    return placed.withColumn(out, (F.col("__start") + F.col("__place")) % count).drop("__part", "__p", "__start", "__place")


def single_flight(lookups: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """One row (key, window_start, shared) for all lookups of a key within a fixed window: they share one answer."""
    start = F.window(at, f"{seconds} seconds").getField("start")
    return lookups.groupBy(F.col(key), start.alias("window_start")).agg(F.count(F.lit(1)).alias("shared"))
