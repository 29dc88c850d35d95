"""The pipeline's stages one by one over a small corpus with planted cases."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_operators import brute_jaccard, prose  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    texts = [prose(rng, rng.choice([60, 120])) for _ in range(150)]
    junk = [" ".join(rng.choice(["BUY!!!", "$$$", "||", "NOW"]) for _ in range(60)) for _ in range(15)]
    passage = prose(rng, 64, 16)
    texts += junk + [texts[0], " ".join(["other", *texts[1].split()[1:]]), texts[2] + "\n" + passage, texts[4] + "\n" + passage]
    at = tmp_path_factory.mktemp("sf")
    data = [(k, t, "xx", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    marks = [(k, int(not 150 <= k < 165), 0) for k in range(0, 165)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder).cache()
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    kept = {r.doc_id for r in seen["quality_rules"][1].collect()}
    assert not kept & set(range(150, 165)) and len(kept & set(range(150))) >= 145
    lines = {r.doc_id: r.text for r in seen["line_dedup"][1].collect()}
    assert set(lines) == kept and lines[165] == ""
    near_in = [(r.doc_id, r.text) for r in seen["ngram_jaccard"][0].collect()]
    near_out = {r.doc_id for r in seen["ngram_jaccard"][1].collect()}
    gone = {b for _, b, _ in brute_jaccard(near_in, 1, 0.8)}
    assert near_out == kept - gone
    packed = seen["packing"][1].collect()
    words = sum(len(r.text.split()) for r in seen["packing"][0].collect())
    assert sum(r.length for r in packed) == words


def stage_by_stage(spark, folder, at):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs


def test_run_equals_the_stages(spark, folder, tmp_path):
    columns = ("doc_id", "piece", "start", "length")
    got = sorted(tuple(r[c] for c in columns) for r in corpus_pipeline.run(spark, folder).collect())
    assert got and got == sorted(tuple(r[c] for c in columns) for r in stage_by_stage(spark, folder, str(tmp_path)).collect())


def test_awkward_rows_go_through_all_stages(spark, tmp_path):
    """Null ids and texts, empty, blank and very long texts, repeated rows, one id twice, columns with clashing names."""
    rng = random.Random(60)
    long, other = prose(rng, 20_000), prose(rng, 50)
    texts = [(k, prose(rng, 80)) for k in range(20)]
    odd = [(None, None), (None, other), (None, other), (100, None), (101, ""), (102, " \n "), (103, other), (103, other), (103, prose(rng, 30)), (104, long), (105, "\U0001f600 é 漢字 " * 20)]
    data = [(k, t, "xx", "s", len(t or ""), 1, 2, "a", "b", [1]) for k, t in texts + odd]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, did long, th long, sid string, matches string, size array<int>"
    for name, rows in (("some", data), ("none", [])):
        at = tmp_path / name
        spark.createDataFrame(rows, kinds).write.parquet(f"{at}/documents.parquet")
        marks = [(k, 1, 0) for k in range(10)] + [(None, 1, 0), (11, None, None)] if rows else []
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        out = corpus_pipeline.run(spark, str(at)).collect()
        if not rows:
            assert out == []
            continue
        words = {}
        for r in out:
            words[r.doc_id] = words.get(r.doc_id, 0) + r.length
        # of the text that stands under a null id twice and under 103 twice, one row stays; 105 repeats three words
        assert words[None] == 50 and words[103] == 30 and words[104] == 20_000 and words[105] == 3
        assert all(words[k] == 80 for k, _ in texts) and not {100, 101, 102} & set(words)


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns)


def test_names_of_registered_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
