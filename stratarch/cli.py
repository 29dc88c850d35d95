"""Commands over archives: extract, verify, mend; and completion of their names is left to the shell."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratarch", description="Work on web archives.")
    p.add_argument("--json", action="store_true", help="one JSON object a line")
    p.add_argument("-v", "--verbose", action="store_true", help="Spark's own log as well")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="write HTTP payloads as files")
    e.add_argument("-t", "--threads", type=int, default=1)
    e.add_argument("-o", "--output", default="output")
    e.add_argument("-c", "--content-type", action="append", default=[])
    e.add_argument("--allow-overwrite", action="store_true")
    e.add_argument("--host-sort", action="store_true")
    e.add_argument("--hash-suffix", action="store_true")
    v = sub.add_parser("verify", help="check digests and versions")
    v.add_argument("-t", "--threads", type=int, default=1)
    v.add_argument("--strict", action="store_true")
    m = sub.add_parser("mend", help="plan and carry out repairs")
    m.add_argument("--dry-run", action="store_true")
    m.add_argument("-y", "--yes", action="store_true")
    m.add_argument("--force", action="store_true")
    for s in (e, v, m):
        s.add_argument("files", nargs="+")
    return p


def _session(threads: int, verbose: bool) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    # spark-submit has set a master for a cluster; alone, the command runs in this process
    builder = SparkSession.builder.appName("stratarch").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    spark = builder.config("spark.master", f"local[{max(1, threads)}]").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if verbose else "ERROR")
    return spark


def main(argv: list[str] | None = None) -> int:
    from .operators import extract, mend, verify
    from .sources.archive import read_archives

    a = parser().parse_args(argv)
    spark = _session(getattr(a, "threads", 1), a.verbose)
    path = ",".join(a.files)

    def say(row: dict) -> None:
        print(json.dumps(row) if a.json else " ".join(f"{k}={v}" for k, v in row.items()))

    if a.command == "verify":
        bad = 0
        for r in verify.verify_files(read_archives(spark, path), a.strict).orderBy("file").toLocalIterator():
            say(r.asDict())
            bad += not r.valid
        return int(bad > 0)
    if a.command == "extract":
        selected = extract.responses(read_archives(spark, path), a.content_type)
        written = extract.write_payloads(extract.extract_plan(selected, a.host_sort), a.output, a.hash_suffix, a.allow_overwrite)
        for r in written.groupBy("file", "status").count().orderBy("file", "status").toLocalIterator():
            say(r.asDict())
        for r in extract.extract_report(selected).orderBy("file", "http_content_type").toLocalIterator():
            say(r.asDict())
        return 0
    frames = [mend.plan_files(spark, f, a.force) for f in a.files]
    plan = frames[0]
    for f in frames[1:]:
        plan = plan.unionByName(f)
    plan = plan.cache()
    ask = None if a.yes or a.dry_run else lambda q: input(f"{q} [y/N] ").strip().lower() in ("y", "yes")
    for file, what in mend.apply_plan(plan, a.dry_run, delete=True, confirm=ask):
        say({"file": file, "action": what})
    say(mend.mend_summary(plan).first().asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
