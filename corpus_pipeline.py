"""A corpus pipeline over the documents table; each stage is written as Parquet and reread by the next.

ORACLE_SQL is None: random splits, winnowing and online placement have no SQL. Tests hold the stages' operators against
brute force, the stages against planted cases, and run() against the stages one by one.

In every stage null ids and texts, empty, blank and very long texts, repeated rows, empty tables and extra columns with any
names are rows like others; each docstring says what becomes of them. All but the last stage keep the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratarch.llm.jaccard import drop_near_duplicates
from stratarch.llm.linededup import dedup_lines
from stratarch.llm.packing import pack_windows
from stratarch.llm.quality import keep_quality
from stratarch.llm.shared import scratch_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the isolation forest over rule statistics doesn't reject. Null, empty and blank texts go, as does what
    lies on the threshold; repeated rows stay or go alike; null ids count."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows without later copies of passages of 25 words or more; a text that is all copies is empty from here on.
    The first in order of id (null first) and text hash keeps a passage; null texts stay null; rows equal in id and text keep
    equal texts."""
    return dedup_lines(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of least id (null first), then text hash; of repeated rows
    one. Null, empty and wordless texts are in no class and stay. It judges the texts as line dedup has left them."""
    return drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2,048 words, one row per piece (window_id, doc_id, piece, start, length, offset). Null, empty and blank
    texts have no piece; repeated rows are packed as often as they stand; a null id stays null."""
    return pack_windows(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
