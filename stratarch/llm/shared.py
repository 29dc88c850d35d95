"""Scratch tables in the cluster's shared folder, size-checked joins and row keys."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A join side is broadcast only when its measured size is below this; otherwise the join shuffles.
BROADCAST_BYTES = 24 << 20
NULL_ID = -(1 << 63)

_created: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a fresh temporary one only in local mode where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="stratarch-")
            atexit.register(shutil.rmtree, base[len("file://") :], True)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/stratarch/{name}-{uuid.uuid4().hex}"
    _created.add(path)
    return path


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df once to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, now: bool = False) -> None:
    """Let the cleaner drop shuffle files of finished jobs; else they stay until the driver happens to collect garbage.
    Jobs that follow one another within RELEASE_SECONDS are released together, unless `now`."""
    if now or time.monotonic() - release.last >= RELEASE_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        release.last = time.monotonic()


RELEASE_SECONDS = 2
release.last = 0.0


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    _created.discard(path)


@atexit.register
def _drop_all() -> None:
    """Tables that results may read until the end; the session may have stopped by then, so not by its file system."""
    for path in sorted(_created):
        try:
            system, inner = fs.FileSystem.from_uri(path)
            if system.get_file_info(inner).type.name != "NotFound":
                system.delete_dir(inner)
        except (OSError, pa.ArrowException):  # one that can't be reached doesn't keep the others
            continue


def maybe_broadcast(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when `small` (a materialized table) measures below `limit`; else leave a shuffle join."""
    return F.broadcast(small) if small.count() * row_bytes <= limit else small


def key_columns(id_col: str, text_col: str, df: DataFrame):
    """(did, th) name a document: rows that agree in both are one.

    `did` is the id if its type is an integer, else a 64-bit hash of it, and NULL_ID for a null one (so the integer -2^63
    can't be told from null); `th` is a hash of the text. No other column is read, so extra ones cannot clash.
    """
    return (
        F.coalesce(key_of(id_col, df), F.lit(NULL_ID)).alias("did"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("th"),
    )


def key_of(id_col: str, df: DataFrame):
    """An id as an integer; null for null."""
    col, kind = F.col(f"`{id_col}`"), df.schema[id_col].dataType
    return col.cast("long") if isinstance(kind, IntegralType) else F.when(col.isNotNull(), F.xxhash64(col.cast("string")))


def original_id(col="did"):
    """Turns NULL_ID back to null."""
    return F.when(F.col(col) != NULL_ID, F.col(col))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    names = {c.lower() for c in df.columns}
    while name.lower() in names:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
