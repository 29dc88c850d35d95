"""Repair of damaged or unfinished archives: a plan as a table, and its application, dry by default."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.archive import file_sizes, read_archives
from ..sources.files import locate

PLAN = (
    "file", "file_size", "record_count", "first_record_type", "last_valid_pos", "truncate_at", "needs_truncate", "needs_rename",
    "new_name", "error_at", "error_msg", "action",
)


def file_heads(files: DataFrame) -> DataFrame:
    """Adds `is_gzip`, from each file's first two bytes; a file that can't be read isn't one."""

    @F.udf("boolean")
    def gzip(path):
        try:
            system, inner = locate(path)
            with system.open_input_stream(inner, compression=None) as f:
                return f.read(2) == b"\x1f\x8b"
        except OSError:
            return False

    return files.withColumn("is_gzip", gzip("file"))


def mend_plan(records: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """One row with an action for every file of `files` (file, file_size, is_gzip).

    Eligible are gzip files that end in `.gz.open`, with `force` also those in `.gz`; others are `skipped` and never
    touched. `records` is a scan of the files, content not needed. What follows the last whole record is cut off,
    unless no record is whole; `.open` files get their final name. A finished file without records, or with nothing
    but its first information record, is a `delete_candidate`.
    """
    low = F.lower("file")
    eligible = F.coalesce(F.col("is_gzip"), F.lit(False)) & (low.endswith(".gz.open") | (F.lit(force) & low.endswith(".gz")))
    good = F.col("error").isNull()
    # every part is a partial aggregate: the order of records isn't needed, only its extremes
    seen = records.groupBy(F.col("file").alias("__file")).agg(
        F.count_if(good).alias("n"), F.min_by(F.when(good, F.col("warc_type")), F.when(good, F.col("record_index"))).alias("first"),
        F.max(F.when(good, F.col("offset") + F.col("size"))).alias("last"), F.max("error").alias("message"))
    joined = files.join(seen, F.col("file") == F.col("__file"), "left").withColumn("eligible", eligible)

    def of(c, otherwise):
        return F.when(F.col("eligible"), F.coalesce(c, F.lit(otherwise))).otherwise(F.lit(otherwise))

    base = joined.select(
        "file", "eligible", F.when(F.col("eligible"), F.col("file_size")).otherwise(F.lit(0)).cast("long").alias("file_size"),
        of(F.col("n"), 0).cast("long").alias("record_count"), F.when(F.col("eligible"), F.col("first")).alias("first_record_type"),
        of(F.col("last"), 0).cast("long").alias("last_valid_pos"), F.when(F.col("eligible"), F.col("message")).alias("error_msg"))
    cut = F.col("eligible") & (F.col("last_valid_pos") > 0) & (F.col("error_msg").isNotNull() | (F.col("last_valid_pos") < F.col("file_size")))
    rename = F.col("eligible") & F.lower("file").endswith(".open")
    planned = base.withColumns({"needs_truncate": cut, "needs_rename": rename}).withColumns({
        "truncate_at": F.when(F.col("needs_truncate"), F.col("last_valid_pos")),
        "new_name": F.when(F.col("needs_rename"), F.expr("substring(file, 1, length(file) - 5)")),
        "error_at": F.when(F.col("error_msg").isNotNull(), F.col("last_valid_pos")),
    })
    bare = (F.col("record_count") == 0) | ((F.col("record_count") == 1) & F.coalesce(F.col("first_record_type") == "warcinfo", F.lit(False)))
    action = (
        F.when(~F.col("eligible"), "skipped")
        .when(F.col("needs_truncate") & F.col("needs_rename"), "truncate_rename")
        .when(F.col("needs_truncate"), "truncate")
        .when(F.col("needs_rename"), "rename")
        .when(bare, "delete_candidate")
        .otherwise("ok")
    )
    return planned.withColumn("action", action).select(*PLAN)


def plan_files(spark: SparkSession, path: str, force: bool = False) -> DataFrame:
    """mend_plan of what lies at a path, scanned without content."""
    files = file_heads(file_sizes(spark, path))
    return mend_plan(read_archives(spark, path, content=False), files, force)


def mend_summary(plan: DataFrame) -> DataFrame:
    """One row of totals of a plan; planned actions count as done."""
    cut, skipped = F.col("needs_truncate"), F.col("action") == "skipped"
    return plan.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~skipped).alias("processed"), F.count_if(skipped).alias("skipped"),
        F.count_if(cut).alias("truncated"), F.count_if("needs_rename").alias("renamed"), F.count_if(F.col("action") == "delete_candidate").alias("deleted"),
        F.count_if(F.col("error_msg").isNotNull()).alias("errors"),
        F.coalesce(F.sum(F.when(cut, F.col("file_size") - F.col("truncate_at"))), F.lit(0)).cast("long").alias("bytes_truncated"),
        F.coalesce(F.sum("record_count"), F.lit(0)).cast("long").alias("records"))


def apply_plan(plan: DataFrame, dry_run: bool = True, delete: bool = False, confirm: Callable[[str], bool] | None = None) -> list[tuple[str, str]]:
    """Carry out a plan and return (file, what was done). A dry run, the default, touches nothing.

    Candidates are deleted only with `delete`; `confirm`, if given, is asked before each change. A file that has
    changed its size since it was planned is left alone. The plan, one row a file, comes to the driver in pieces.
    """
    done = []
    for r in plan.where("action not in ('ok', 'skipped')").toLocalIterator():
        steps = [s for s, on in (("truncate", r.needs_truncate), ("rename", r.needs_rename), ("delete", r.action == "delete_candidate" and delete)) if on]
        if not steps or (confirm is not None and not confirm(f"{', '.join(steps)}: {r.file}?")):
            continue
        if dry_run:
            done.append((r.file, "would " + ", ".join(steps)))
            continue
        system, inner = locate(r.file)
        if system.get_file_info(inner).size != r.file_size:
            done.append((r.file, "changed since it was planned"))
            continue
        if r.needs_truncate:
            _truncate(system, inner, r.truncate_at)
        if r.needs_rename:
            system.move(inner, locate(r.new_name)[1])
        if "delete" in steps:
            system.delete_file(inner)
        done.append((r.file, ", ".join(steps)))
    return done


def _truncate(system: fs.FileSystem, path: str, size: int) -> None:
    if isinstance(system, fs.LocalFileSystem):
        with open(path, "r+b") as f:
            f.truncate(size)
        return
    # stores without truncation: the part that stays is copied and takes the file's place
    part = f"{path}.part"
    with system.open_input_stream(path, compression=None) as source, system.open_output_stream(part, compression=None) as sink:
        left = size
        while left and (data := source.read(min(left, 1 << 22))):
            sink.write(data)
            left -= len(data)
    system.move(part, path)
