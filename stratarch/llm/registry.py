"""The queries of this subpackage over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, archive, bpe, jaccard, licenses, linededup, lmscore, packing, quality, sharding
from .shared import scratch_path, table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 is a query, against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_windows(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.cross_parse_scores(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.duplicate_classes(table(spark, sf_dir, "documents"))


def op6_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.write_archive(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), scratch_path(spark, "store"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours, op2_packing, op3_quality_rules, op4_lm_scoring, op5_ngram_jaccard_join,
        op6_warc_writer, op7_line_dedup, op8_sharding, op9_license_scan, op10_bpe,
    )
}

#: DuckDB's \\w is ASCII; letters beyond it are named by a range, as the operator keeps all non-ASCII characters.
_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')"

ORACLE_SQL = {
    "op8_sharding": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "op5_ngram_jaccard_join": f"""
WITH RECURSIVE words AS (SELECT doc_id, unnest(list_distinct({_WORDS})) AS w FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
           FROM words a JOIN words b ON a.w = b.w AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE c / (x.n + y.n - c)::DOUBLE >= 0.8 - 1e-12),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS links FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(links, 0) AS links
FROM documents JOIN classes c ON c.a = doc_id LEFT JOIN counts n ON n.a = doc_id""",
}
