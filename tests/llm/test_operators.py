"""Each operator against brute force, an exact round trip or held-out labels, and over the awkward cases."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratarch.llm import ann, archive, bpe, jaccard, licenses, linededup, lmscore, packing, quality, sharding
from stratarch.llm.shared import scratch_path

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ren", "su", "tor") for b in ("da", "fe", "gi", "pol") for c in ("", "n", "st", "ra")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASH = "did long, th long, sid string, sig double, matches string, keep boolean, score string, part int, c0 string, TEXT_ string"


def prose(rng, n, per_line=9):
    words = [rng.choice(WORDS) + (rng.choice("abcdefgh") * rng.randint(0, 2)) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + per_line]) for k in range(0, n, per_line))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([12, 40, 90, 200])) for _ in range(60)]
    near = texts[3].split(" ")
    near[5] = "changed"
    passage = prose(rng, 64, 16)
    texts += [texts[3], " ".join(near), texts[7] + "\n" + passage + "\nend of it", texts[9] + "\n" + passage, prose(rng, 30_000)]
    rows = [(k, t, "xx", "s", len(t)) for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).cache()


@pytest.fixture(scope="module")
def messy(spark, corpus):
    """Null ids and texts, empty and blank texts, one very long, repeated rows, one id twice, clashing columns."""
    rows = [(r[0], r[1]) for r in corpus[:12]] + [(None, None), (None, corpus[1][1]), (100, None), (101, ""), (102, " \n\t "), (103, corpus[2][1]), (103, corpus[2][1])]
    rows += [(104, "word " * 40_000), (105, "é ñ 漢字 \U0001f600 " * 9), (103, "another text of one id")]
    extra = (1, 2, "a", 0.5, None, True, "b", 3, "c", "d")
    return spark.createDataFrame([(*r, "xx", "s", len(r[1] or ""), *extra) for r in rows], DOCS + ", " + CLASH).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(None, 1, 0), (41, None, None), (999, 0, 0)], "doc_id long, quality int, toxic int")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# 1 ------------------------------------------------------------------------------------------------------------------


def brute_neighbours(x, ids, k):
    out = {}
    for i, v in zip(ids, x):
        d = ((x - v) ** 2).sum(1)
        out[i] = [ids[j] for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def test_ann_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[10:40] = x[10]  # ties: thirty equal vectors
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest_neighbours(df, k=8, shard_rows=300).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour_id, r.distance)
    want = brute_neighbours(x, ids, 8)
    assert set(got) == set(ids) and all(len(v) == 8 for v in got.values())
    dist = lambda a, b: float(np.sqrt(((x[a] - x[b]) ** 2).sum()))
    good = sum(d <= dist(i, want[i][-1]) + 1e-4 for i in ids for _, d in got[i].values())
    assert good / (8 * len(ids)) >= 0.9
    assert all(got[i][r][1] <= got[i][r + 1][1] for i in ids for r in range(1, 8))


def test_ann_awkward(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [1.0]), (8, [None, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "vec_id long, embedding array<double>, shard int, v string")
    # 7 and 9 have one part, and meet only each other
    df = df.union(spark.createDataFrame([(9, [3.0], 1, "x")], df.schema))
    assert rows(ann.nearest_neighbours(df), "vec_id", "rank", "neighbour_id") == [(1, 1, 2), (2, 1, 1), (7, 1, 9), (9, 1, 7)]
    named = df.selectExpr("'n' || vec_id as `a.b`", "embedding")
    assert rows(ann.nearest_neighbours(named, id_col="a.b"), "vec_id", "neighbour_id") == [("n1", "n2"), ("n2", "n1"), ("n7", "n9"), ("n9", "n7")]
    assert rows(ann.nearest_neighbours(df, df.where("vec_id = 2")), "vec_id", "rank", "neighbour_id") == [(2, 1, 1)]
    ties = spark.createDataFrame([(k, [1.0 * (k % 2), 1.0 - k % 2]) for k in range(30)] + [(99, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r[0] for r in ann.nearest_neighbours(ties, ties.where("vec_id = 99"), k=5).orderBy("rank").select("neighbour_id").collect()] == [0, 1, 2, 3, 4]
    assert ann.nearest_neighbours(df.limit(0)).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------


def brute_windows(lengths, capacity, slots):
    """Best fit by looking at every open window."""
    opened, closed = [], []
    for n in lengths:
        fits = [w for w in opened if sum(w) + n <= capacity]
        if fits:
            w = max(fits, key=lambda w: (sum(w), -opened.index(w)))
            w.append(n)
        elif n == capacity:
            closed.append([n])
            continue
        else:
            if len(opened) == slots:
                full = max(opened, key=lambda w: (sum(w), -opened.index(w)))
                opened.remove(full)
                closed.append(full)
            w = [n]
            opened.append(w)
        if sum(w) == capacity:
            opened.remove(w)
            closed.append(w)
    return closed + opened


def test_packing_is_best_fit_in_bounded_space():
    rng = random.Random(1)
    for slots in (1, 3, 8):
        lengths = [rng.randint(1, 50) for _ in range(400)]
        state, closed = packing.OpenWindows(50, slots), []
        for n in lengths:
            done = state.place(n, n)
            assert len(state.open) <= slots
            if done is not None:
                closed.append(done)
        ours, brute = closed + state.leftovers(), brute_windows(lengths, 50, slots)
        assert sorted(map(sorted, ours)) == sorted(map(sorted, brute))


def test_packing_covers_every_word_once(docs, corpus):
    got = packing.pack_windows(docs, capacity=128, slots=4, docs_per_part=9, fan_in=2).collect()
    by_doc, by_window = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_window.setdefault(r.window_id, []).append((r.offset, r.length))
    for k, t, *_ in corpus:
        at = 0
        for start, n in sorted(by_doc[k]):
            assert start == at
            at += n
        assert at == len(t.split())
    for items in by_window.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 128
    words = sum(len(t.split()) for _, t, *_ in corpus)
    assert words / (128 * len(by_window)) > 0.85


def test_packing_awkward(spark, messy):
    got = packing.pack_windows(messy, capacity=64).collect()
    assert Counter(r.doc_id for r in got)[None] >= 1 and not {100, 101, 102} & {r.doc_id for r in got}
    assert sum(r.length for r in got if r.doc_id == 104) == 40_000
    assert packing.pack_windows(empty(spark)).count() == 0


# 3 ------------------------------------------------------------------------------------------------------------------


def test_quality_features_by_hand():
    f = dict(zip(quality.FEATURES, quality.features(pa.array(["AB ab|ab !"]))[0]))
    pw, pb = quality.PRIOR_WORDS, quality.PRIOR_BYTES
    assert f["upper_share"] == pytest.approx((2 + 0.03 * pb) / (6 + pb))
    assert f["pipe_rate"] == pytest.approx(1 / (3 + pw)) and f["bang_rate"] == pytest.approx(1 / (3 + pw))
    assert f["word_length"] == pytest.approx((2 + 5 + 1 + 5 * pw) / (3 + pw))
    assert (quality.features(pa.array([None, "", "  \n"])) == 0).all()


def test_quality_path_length_against_walk():
    rng = np.random.default_rng(0)
    forest = quality.IsolationForest(rng.normal(size=(300, 3)), 10, 64, 1)
    x = rng.normal(size=(20, 3)) * 3
    for row, s in zip(x, forest.score(x)):
        total = 0.0
        for feature, cut, left, right, path in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] < cut[at] else right[at]
            total += path[at]
        assert s == pytest.approx(2.0 ** (-total / 10 / forest.average_path(64)))


def test_quality_held_out(spark):
    rng = random.Random(9)
    junk = lambda: " ".join(rng.choice(["BUY!!!", "$$$", "||", "CLICK", "###"]) for _ in range(60))
    data = [(k, prose(rng, 80) if k % 10 else junk()) for k in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(0, 300)], "doc_id long, quality int")
    got = {r.doc_id: r.keep for r in quality.quality_scores(docs, labels).collect()}
    held = range(300, 600)
    assert sum(got[k] == (k % 10 > 0) for k in held) / 300 >= 0.98
    kept = {r.doc_id for r in quality.keep_quality(docs, labels).collect()}
    assert kept == {k for k, keep in got.items() if keep}


def test_quality_threshold_by_brute_force():
    good, bad = np.zeros(quality.BINS), np.zeros(quality.BINS)
    good[:1000], bad[900:1500] = 1, 1
    best = max(range(quality.BINS + 1), key=lambda e: bad[e:].sum() / 600 - 3 * good[e:].sum() / 1000)
    t = quality.choose_threshold(good, bad, 3.0) * quality.BINS
    assert bad[int(t) :].sum() / 600 - 3 * good[int(t) :].sum() / 1000 == bad[best:].sum() / 600 - 3 * good[best:].sum() / 1000


def test_quality_awkward(spark, messy, labels):
    got = quality.quality_scores(messy, labels).collect()
    assert len(got) == messy.count()
    assert all(r.score is None and not r.keep for r in got if r.doc_id in (100, 101, 102))
    assert quality.quality_scores(empty(spark), labels).count() == 0
    assert quality.quality_scores(messy, labels.limit(0)).where("keep").count() == messy.count() - 4
    kept = quality.keep_quality(messy, labels)
    assert kept.columns == messy.columns


# 4 ------------------------------------------------------------------------------------------------------------------


def brute_phrases(reference, tokens, order=8):
    """Greedy factors by search; a match of `order` tokens goes on while its last `order` tokens stand somewhere."""
    joined = [" " + " ".join(map(str, r)) + " " for r in reference]
    stands = lambda w: any(" " + " ".join(map(str, w)) + " " in j for j in joined)
    at = n = 0
    while at < len(tokens):
        k = 0
        while at + k < len(tokens) and stands(tokens[max(at, at + k + 1 - order) : at + k + 1]):
            k += 1
        at += max(1, k)
        n += 1
    return n


@pytest.mark.parametrize("slice_words", [1, 50, 2_000_000])
def test_lm_scoring_against_search(spark, monkeypatch, slice_words):
    """Slices of one document, of some, and one slice; the reference is every other row."""
    monkeypatch.setattr(lmscore, "SLICE_WORDS", slice_words)
    rng = random.Random(21)
    data = [(k, " ".join(rng.choice("abcdefghij") for _ in range(rng.choice((1, 3, 20, 90))))) for k in range(40)]
    data += [(50, data[4][1]), (51, data[33][1]), (52, data[33][1]), (53, ""), (54, "alone here"), (55, data[7][1] + " z " + data[9][1] + " " + data[7][1])]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lmscore.cross_parse_scores(docs).collect()}
    total = sum(len(t.split()) for _, t in data)
    assert len(got) == len(data)
    for k, t in data:
        w = t.split()
        phrases = brute_phrases([x.split() for j, x in data if j != k], w)
        own = lmscore.self_phrases(w)
        assert (got[k].tokens, got[k].phrases, got[k].own_phrases, got[k].reference_tokens) == (len(w), phrases, own, total - len(w))
        assert got[k].score == (None if not w else pytest.approx(lmscore.divergence(len(w), phrases, own)))
    assert got[50].phrases == got[51].phrases == 1 and got[51].score == got[52].score


def test_lm_scoring_awkward(spark, messy):
    got = lmscore.cross_parse_scores(messy).collect()
    assert len(got) == messy.count()
    assert all(r.score is None and r.tokens == 0 for r in got if r.doc_id in (100, 101, 102))
    assert len({r.score for r in got if r.doc_id == 103 and r.tokens != 5}) == 1 and sum(r.doc_id is None for r in got) == 2
    assert lmscore.cross_parse_scores(empty(spark)).count() == 0
    one = lmscore.cross_parse_scores(spark.createDataFrame([("x", "a b a b")], "`i.d` string, text string"), "i.d").collect()
    assert [(r.doc_id, r.phrases, r.reference_tokens) for r in one] == [("x", 4, 0)]


# 5 ------------------------------------------------------------------------------------------------------------------


def brute_jaccard(corpus, n, threshold):
    import re

    sets = {}
    for k, t, *_ in corpus:
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
        g = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        sets[k] = g
    out = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= threshold - 1e-12:
                    out.append((a, b, round(j, 6)))
    return sorted(out)


@pytest.mark.parametrize("n, threshold", [(1, 0.8), (1, 0.6), (3, 0.5)])
def test_jaccard_against_all_pairs(spark, n, threshold):
    rng = random.Random(n * 100 + int(threshold * 10))
    data = []
    for k in range(30):
        base = [rng.choice(WORDS) for _ in range(rng.choice([3, 8, 20, 70, 150]))]
        for _ in range(4):
            copy = [w if rng.random() > rng.choice([0, 0.03, 0.1, 0.2]) else rng.choice(WORDS) for w in base]
            data.append((len(data), " ".join(copy)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(jaccard.duplicate_classes(df, n=n, threshold=threshold), "doc_id", "class_id", "links")
    assert sorted(got) == brute_classes(data, n, threshold)


def brute_classes(data, n, threshold):
    pairs = [(a, b) for a, b, _ in brute_jaccard(data, n, threshold)]
    root, links = {r[0]: r[0] for r in data}, Counter(x for p in pairs for x in p)
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    return sorted((k, v, links[k]) for k, v in root.items())


def test_jaccard_classes_in_blocks(spark, monkeypatch):
    """A class of several blocks, long sets with many words each, and copies that count one by one."""
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    monkeypatch.setattr(jaccard, "HELD", 50)
    rng = random.Random(31)
    base = [f"w{k}" for k in range(3000)]
    data = []
    for k in range(40):
        copy = [w if rng.random() > rng.choice([0.02, 0.06, 0.12]) else f"x{rng.randint(0, 10**6)}" for w in base]
        data += [(2 * k, " ".join(copy)), *([(2 * k + 1, " ".join(copy))] if k % 9 == 0 else [])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(jaccard.duplicate_classes(df), "doc_id", "class_id", "links") == sorted(brute_classes(data, 1, 0.8), key=repr)


def test_components_on_the_driver_and_in_rounds(spark, monkeypatch):
    rng = random.Random(14)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 460)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for a, b in [e for e in edges if e[0] != e[1]]:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    df = spark.createDataFrame(edges, "a long, b long")
    for most in (1 << 18, 0):
        monkeypatch.setattr(jaccard, "DRIVER_EDGES", most)
        assert {r.node: r.root for r in jaccard.components(df).collect()} == root


def test_jaccard_group_of_20000_near_copies(spark):
    """Every pair of the group is a link: 20,000 sets that differ in one word."""
    words = " ".join(f"w{k}" for k in range(60))
    df = spark.range(20_000).selectExpr("id as doc_id", f"concat('{words} x', id) as text")
    got = jaccard.duplicate_classes(df).groupBy("class_id", "links").count().collect()
    assert [tuple(r) for r in got] == [(0, 19_999, 20_000)]


def test_jaccard_ids_of_any_type(spark):
    data = [("b", "one two three"), ("a", "three two one"), ("c", "other words here"), (None, "one two three"), ("d", "")]
    df = spark.createDataFrame(data, "`the id.` string, text string")
    got = rows(jaccard.duplicate_classes(df, "the id."), "doc_id", "class_id", "links")
    assert got == sorted([("a", "a", 2), ("b", "a", 2), (None, "a", 2), ("c", "c", 0), ("d", "d", 0)], key=repr)
    kept = [r[0] for r in jaccard.drop_near_duplicates(df, "the id.").collect()]
    assert sorted(kept, key=str) == [None, "c", "d"]


def test_near_duplicates_keep_wordless_rows_and_a_settled_one_of_repeated_rows(spark):
    data = [(1, "", "x"), (1, "", "y"), (None, None, "x"), (None, None, "x"), (2, "!!", "x"), (3, "a b c", "p"), (3, "a b c", "q"), (4, "c b a", "r")]
    kept = {tuple(r) for k in (1, 3) for r in jaccard.drop_near_duplicates(spark.createDataFrame(data[::k - 2], "doc_id long, text string, v string")).collect()}
    once = jaccard.drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string, v string")).collect()
    assert len(once) == 6 and kept == {tuple(r) for r in once} and sum(r.doc_id == 3 for r in once) == 1


def test_sketches_never_exceed_the_difference():
    from stratarch.llm.textbatch import U64, TextBatch

    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    s = jaccard.Sets(TextBatch(pa.array(texts)), 1)
    sk = [np.frombuffer(x, U64) for x in jaccard.sketches(s)]
    for a in range(40):
        for b in range(a):
            x, y = sk[a], sk[b]
            while len(x) != len(y):
                x, y = (x[: len(x) // 2] ^ x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
            assert np.bitwise_count(x ^ y).sum() <= len(set(texts[a].split()) ^ set(texts[b].split()))


def test_near_duplicates_leave_one_of_each_group(spark, docs, corpus):
    pairs = [(a, b) for a, b, _ in brute_jaccard(corpus, 1, 0.8)]
    root = {r[0]: r[0] for r in corpus}
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    kept = [r.doc_id for r in jaccard.drop_near_duplicates(docs).collect()]
    assert sorted(kept) == sorted(set(root.values()))


def test_jaccard_awkward(spark, messy):
    got = Counter((r.doc_id, r.class_id, r.links) for r in jaccard.duplicate_classes(messy).collect())
    # two equal rows of id 103, and a null id with a copy
    assert got[2, 2, 2] == 1 and got[103, 2, 2] == 2 and got[1, 1, 1] == got[None, 1, 1] == 1
    assert got[None, None, 0] == got[100, 100, 0] == got[101, 101, 0] == got[102, 102, 0] == 1 and got.total() == messy.count()
    kept = jaccard.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[100] == ids[101] == ids[102] == 1 and ids[103] == 1 and ids[2] == 1
    assert jaccard.duplicate_classes(empty(spark)).count() == 0 and jaccard.drop_near_duplicates(empty(spark)).count() == 0


# 6 ------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(8)
    data = [(k, f"http://x/{k}", prose(rng, 200)) for k in range(80)] + [(None, None, None), (81, "http://x/\r\nEvil: 1", ""), (81, "http://x/\r\nEvil: 1", "")]
    df = spark.createDataFrame([(*r, 1) for r in data], "page_id long, url string, html string, file int").repartition(3)
    folder = "file://" + str(tmp_path / "out")
    index = archive.write_archive(df, folder, target_bytes=60_000).cache()
    got = index.collect()
    assert len(got) == len(data)
    files = {}
    for r in got:
        files.setdefault(r.file, []).append(r)
    found = []
    for name, entries in files.items():
        raw = (tmp_path / "out" / name).read_bytes()
        records = archive.read_archive(raw)
        assert len(records) == len(entries)
        for r in entries:
            assert len(records[r.record]) == r.record_bytes
            found.append((r.page_id, records[r.record].split(b"\r\n\r\n", 1)[1][:-4].decode()))
    assert sorted(found, key=repr) == sorted(((k, h or "") for k, _, h in data), key=repr)
    assert any((tmp_path / "out" / n).read_bytes()[:4] == b"\x5d\x2a\x4d\x18" for n in files)
    assert archive.write_archive(df.limit(0), folder + "2").count() == 0
    # a second write adds files, and no two records of any file share an id
    archive.write_archive(df, folder, target_bytes=60_000).count()
    raw = [r for f in (tmp_path / "out").glob("*.warc.zst") for r in archive.read_archive(f.read_bytes())]
    ids = [line for r in raw for line in r.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(raw) == len(set(ids)) == 2 * len(data)
    large = spark.createDataFrame([(k, "u", "x" * n) for k, n in enumerate([10, 300_000, 10])], "page_id long, url string, html string").coalesce(1)
    assert len({r.file for r in archive.write_archive(large, folder + "3", target_bytes=1000).collect()}) == 2


# 7 ------------------------------------------------------------------------------------------------------------------


def test_line_dedup_deletes_later_copies_only(spark, docs, corpus):
    got = {r.doc_id: (r.text, r.n_chars) for r in linededup.dedup_lines(docs).collect()}
    changed = {k for k, t, *_ in corpus if got[k][0] != t}
    assert changed == {60, 61, 62, 63}
    assert got[60][0] == "" and got[3][0] == corpus[3][1]
    # the passage's first copy stays in 62, where the text before it, itself a copy, goes; in 63 both go
    passage = corpus[63][1].split(corpus[9][1] + "\n")[1]
    assert passage in got[62][0] and got[62][0].endswith("end of it") and corpus[7][1] not in got[62][0]
    assert passage.split("\n")[1] not in got[63][0]
    assert all(n == len(t) for t, n in got.values())


def test_line_dedup_passage_inside_one_line(spark):
    rng = random.Random(12)
    passage = prose(rng, 70, 70)
    data = [(k, prose(rng, 40, 400) + " " + passage + " " + prose(rng, 40, 400)) for k in range(4)] + [(9, prose(rng, 300, 400))]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    middle = " ".join(passage.split()[15:55])
    assert middle in got[0] and got[9] == data[4][1]
    for k in (1, 2, 3):
        assert middle not in got[k] and got[k].split()[:30] == data[k][1].split()[:30] and got[k].split()[-30:] == data[k][1].split()[-30:]


def test_line_dedup_every_short_passage_in_unlike_contexts(spark):
    """Passages of 25 and of 51 words inside longer lines: every word of the later copy goes."""
    rng = random.Random(22)
    word = lambda: f"w{rng.randint(0, 5000)}"
    passages = [[word() for _ in range((25, 51)[k % 2])] for k in range(120)]
    wrap = lambda p, k: " ".join([*(word() for _ in range(30)), f"a{k}", *p, f"b{k}", *(word() for _ in range(30))])
    data = [(k, wrap(p, k)) for k, p in enumerate(passages)] + [(1000 + k, wrap(p, 1000 + k)) for k, p in enumerate(passages)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for (k, t), p in zip(data[120:], passages):
        assert got[k - 1000] == data[k - 1000][1]
        assert got[k] == t.replace(" ".join(p) + " ", "")


def test_winnowing_guarantee():
    """Any run of gram + window - 1 equal lines shares a fingerprint; minima are those of brute force."""
    from stratarch.llm.textbatch import TextBatch

    rng = random.Random(6)
    run = [f"line {rng.random()}" for _ in range(6)]
    texts = ["\n".join([f"{rng.random()} x" for _ in range(rng.randint(0, 9))] + run + [f"{rng.random()} y" for _ in range(rng.randint(0, 9))]) for _ in range(30)]
    lines = linededup.Lines(TextBatch(pa.array(texts)), 8, 4)
    at, fp = linededup.fingerprints(lines, 3, 4)
    prints = [set(fp[lines.doc[at] == d].tolist()) for d in range(30)]
    assert set.intersection(*prints)


def brute_dedup(data, gram, window, min_words):
    """The same definition with dictionaries: winnowing by looking at every window, all places in order."""
    from stratarch.llm.textbatch import TextBatch

    places = []  # (key, text's words, selected positions)
    for k, t in sorted(data):
        w = t.split()
        h = [int(x) for x in _gram_hashes(w, gram)]
        picked = set()
        for a in range(max(1, len(h) - window + 1) if h else 0):
            low = min(h[a : a + window])
            picked.add(max(i for i in range(a, min(a + window, len(h))) if h[i] == low))
        places.append((k, w, sorted(picked)))
    first_fp, first_span, texts, out = {}, {}, {k: w for k, w, _ in places}, {}
    for k, w, at in places:
        for i, p in enumerate(at):
            first_fp.setdefault(tuple(w[p : p + gram]), (k, p))
            if i + 1 < len(at):
                first_span.setdefault(tuple(w[p : at[i + 1] + gram]), (k, p))
    for k, w, at in places:
        mark = [False] * len(w)

        def extend(own, other, step, w=w, mark=mark):
            (x, p), q = other, own
            for _ in range(gram + window):
                if not (0 <= p < len(texts[x]) and 0 <= q < len(w)) or texts[x][p] != w[q]:
                    break
                mark[q] = True
                p, q = p + step, q + step

        later = [first_fp[tuple(w[p : p + gram])] != (k, p) for p in at]
        span = [None if i + 1 == len(at) else first_span[tuple(w[p : at[i + 1] + gram])] for i, p in enumerate(at)]
        led = [s is not None and s != (k, p) for s, p in zip(span, at)]
        for i, p in enumerate(at):
            if not later[i]:
                continue
            place = span[i] if led[i] else first_fp[tuple(w[p : p + gram])]
            for q in range(p, (at[i + 1] if led[i] else p) + gram):
                mark[q] = True
            if not (i and led[i - 1]):
                extend(p - 1, (place[0], place[1] - 1), -1)
            if led[i] and not led[i + 1]:
                extend(at[i + 1] + gram, (place[0], place[1] + at[i + 1] - p + gram), 1)
            if not led[i] and not (i and led[i - 1]):
                extend(p + gram, (place[0], place[1] + gram), 1)
        runs, kept, i = [], [], 0
        while i < len(w):
            j = i
            while j < len(w) and mark[j] == mark[i]:
                j += 1
            kept += [] if mark[i] and j - i >= min_words else w[i:j]
            i = j
        out[k] = kept
    return out


def _gram_hashes(words, gram):
    from stratarch.llm.textbatch import TextBatch

    lines = linededup.Lines(TextBatch(pa.array([" ".join(words)])), 0, 1)
    return linededup.fingerprints(lines, gram, 1)[1]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(40)
    pool = [[f"p{k}w{i}" for i in range(rng.randint(5, 60))] for k in range(12)]
    word = lambda: f"w{rng.randint(0, 40)}"
    data = []
    for k in range(120):
        w = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(pool)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            w += rng.choice([p, p[a:b], [word() for _ in range(rng.randint(1, 30))]])
        data.append((k, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for gram, window, least in ((8, 18, 25), (3, 4, 6), (2, 1, 2)):
        got = {r.doc_id: r.text.split() for r in linededup.dedup_lines(df, gram=gram, window=window, min_words=least).collect()}
        assert got == brute_dedup(data, gram, window, least)


def test_line_dedup_pieces_of_a_passage_in_an_earlier_text(spark):
    """The passage stands whole in texts 1, 3 and 5, its pieces are strewn over 0, 2 and 4: none of it stays in 3 and 5."""
    rng = random.Random(41)
    lines = [prose(rng, 9) for _ in range(60)]
    strewn = lambda: "\n".join(x for k in range(0, 60, 3) for x in (*lines[k : k + 3], prose(rng, 9)))
    whole = lambda: prose(rng, 30) + "\n" + "\n".join(lines) + "\n" + prose(rng, 30)
    data = [(k, whole() if k % 2 else strewn()) for k in range(6)]
    got = {r[0]: r[1] for r in linededup.dedup_lines(spark.createDataFrame(data, "`i.d` string, text string").selectExpr("cast(`i.d` as int) `i.d`", "text"), "i.d").collect()}
    for k in (3, 5):
        assert not any(x in got[k] for x in lines) and got[k].split() == data[k][1].split()[:30] + data[k][1].split()[-30:]


def test_line_dedup_awkward(spark, messy):
    got = linededup.dedup_lines(messy)
    assert got.columns == messy.columns and got.count() == messy.count()
    by = {r.doc_id: r.text for r in got.where("doc_id in (100, 101, 105)").collect()}
    assert by[100] is None and by[101] == ""
    assert len({r.text for r in got.where("doc_id = 103 and text not like 'another%'").collect()}) == 1
    assert linededup.dedup_lines(empty(spark)).count() == 0


# 8 ------------------------------------------------------------------------------------------------------------------


def test_sharding_round_trip(spark, docs, messy, tmp_path):
    store = sharding.ShardStore(spark, "file://" + str(tmp_path / "s"), target=1 << 20, base=1 << 12, fanout=3)
    for part in docs.randomSplit([1.0] * 5, seed=1):
        store.append(part.coalesce(1), shard_rows=5)
    before = len(store.manifest()["shards"])
    store.compact()
    after = store.manifest()["shards"]
    assert len(after) < before and sum(s["rows"] for s in after) == docs.count()
    assert rows(store.read(), *docs.columns) == rows(docs, *docs.columns)
    assert not sharding.plan_merges(after, 1 << 20, 1 << 12, 3)
    out = sharding.shard_documents(messy, "file://" + str(tmp_path / "m"))
    assert rows(out, *messy.columns) == rows(messy, *messy.columns)
    assert sharding.shard_documents(empty(spark), "file://" + str(tmp_path / "e")).count() == 0


def test_sharding_commit_conflict(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, "file://" + str(tmp_path / "c"))
    base = store.manifest()
    store.append(docs)
    with pytest.raises(sharding.CommitConflict):
        store.commit(base, [], docs.schema.json())
    assert store.version() == 1 and store.read().count() == docs.count()


def test_sharding_keeps_old_versions_until_vacuum(spark, docs, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, "file://" + str(tmp_path / "v"), target=1 << 20, base=1 << 12, fanout=3)
    for part in docs.randomSplit([1.0] * 4, seed=2):
        store.append(part.coalesce(1), shard_rows=5)
    before = store.version()
    assert store.compact() > before
    assert rows(store.read(before), "doc_id") == rows(store.read(), "doc_id") == rows(docs, "doc_id")
    assert store.vacuum() > 0 and rows(store.read(), "doc_id") == rows(docs, "doc_id") and store.vacuum() == 0
    # an append that another writer overtakes goes on from the new state
    commit, overtaken = store.commit, []

    def late(base, shards, schema):
        if not overtaken:
            overtaken.append(commit(base, base["shards"], schema))
        return commit(base, shards, schema)

    monkeypatch.setattr(store, "commit", late)
    store.append(docs)
    assert overtaken and store.read().count() == 2 * docs.count()


def test_merge_plan():
    shards = [{"seq": k, "bytes": b} for k, b in enumerate([10, 12, 900, 11, 9, 40, 700])]
    groups = sharding.plan_merges(shards, 1000, 16, 4)
    assert [[s["bytes"] for s in g] for g in groups] == [[10, 12, 11, 9]]


# 9 ------------------------------------------------------------------------------------------------------------------


def brute_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_patience_is_an_alignment():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) <= brute_common(a, b)
        if a == b:
            assert len(pairs) == len(a)
    same = [rng.randint(0, 5) for _ in range(30)]
    assert len(licenses.patience(same, same)) == 30


def test_license_scan(spark, corpus):
    mit = licenses.TEMPLATES["MIT"]
    cut = " ".join(w for k, w in enumerate(mit.split()) if k % 9)
    data = [(0, "front " * 500 + mit + " back" * 300), (1, cut.upper()), (2, corpus[0][1]), (3, None), (4, ""), (None, mit), (None, mit), (5, mit[: len(mit) // 2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id long, text string, license string, matched int")
    got = [r for r in licenses.scan_licenses(df).collect() if r.license == "MIT"]
    assert Counter(r.doc_id for r in got) == {0: 1, 1: 1, None: 2}
    first = next(r for r in got if r.doc_id == 0)
    assert first.coverage == 1.0 and first.first_word == 500
    assert 0.85 < next(r for r in got if r.doc_id == 1).coverage < 0.92
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_notices_are_told_apart(spark):
    cc = "This work is licensed under a Creative Commons %s 4.0 International License."
    gnu = "This work is licensed under the GNU %s."
    data = [
        ("Released under the BSD License.", {"BSD-notice"}), ("Released under the MIT License.", {"MIT-notice"}), ("Released under the Apache License.", set()),
        (gnu % "General Public License, version 2", {"GPL-2.0-notice"}), (gnu % "General Public License, version 3", {"GPL-3.0-notice"}),
        (gnu % "Lesser General Public License, version 2.1", {"LGPL-2.1-notice"}), ("Licensed under CC BY 4.0.", {"CC-BY-4.0-short-notice"}),
        ("Licensed under CC BY-SA 4.0.", {"CC-BY-SA-4.0-short-notice"}), ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0-notice"}),
        (cc % "Attribution", {"CC-BY-4.0-notice"}), (cc % "Attribution-NonCommercial", {"CC-BY-NC-4.0-long-notice"}),
    ]
    df = spark.createDataFrame([(k, f"some words before. {t} And more behind it.") for k, (t, _) in enumerate(data)], "doc_id long, text string")
    got = licenses.scan_licenses(df).collect()
    for k, (_, names) in enumerate(data):
        assert {r.license for r in got if r.doc_id == k} == names


def test_license_texts_with_foreign_words_within(spark):
    """The coverage is that of an alignment with the whole text, wherever the license stands and whatever is put in."""
    rng = random.Random(50)
    words = licenses.TEMPLATES["MIT"].split()
    foreign = lambda n: [f"x{rng.randint(0, 999)}" for _ in range(n)]
    data = []
    for k, (front, middle) in enumerate([(0, 180), (7, 400), (333, 5000), (90, 0)]):
        data.append((k, " ".join([*foreign(front), *words[:80], *foreign(middle), *words[80:], *foreign(50)])))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect() if r.license == "MIT"}
    assert [got[k].coverage for k in range(4)] == [1.0] * 4
    assert [got[k].first_word for k in range(4)] == [0, 7, 333, 90]


def test_license_scan_against_whole_alignment(spark):
    """Every template against every text by patience over all its words."""
    rng = random.Random(51)
    texts = []
    for name, t in licenses.TEMPLATES.items():
        if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Apache-2.0-header", "GPL-2.0-header", "LGPL-2.1-header", "AGPL-3.0-header", "MPL-2.0-header"):
            w = t.split()
            texts += [(name, " ".join(w)), (None, " ".join(w[: len(w) // 2])), (None, " ".join(rng.sample(w, len(w)))), (name, " ".join(x for k, x in enumerate(w) if k % 17 != 16 or k < 30))]
    texts += [(None, "The film was released under the new title by license holders."), (None, "Licensed under terms of the house, version 2.0.")]
    df = spark.createDataFrame([(k, "before it " * (k % 3) + t + " and after") for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in licenses.scan_licenses(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, (name, t) in enumerate(texts):
        found = [r.license for r in got.get(k, [])]
        if name:
            template, text = licenses.words_of([licenses.TEMPLATES[name].lower(), t.lower()])
            assert found == [name] and got[k][0].matched >= len(licenses.patience(text, template))
        else:  # half a text may be all of a part that is a template too
            assert all(n.endswith(("-conditions", "-short-header", "-notice")) for n in found)


def test_common_subsequence_without_a_table(monkeypatch):
    rng = random.Random(52)
    for _ in range(60):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 25))] for _ in range(2))
        monkeypatch.setattr(licenses, "CELLS", 1 << 22)
        table = licenses._common(a, b)
        monkeypatch.setattr(licenses, "CELLS", 0)
        pairs = licenses._common(a, b)
        assert len(pairs) == len(table) == brute_common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


# 10 -----------------------------------------------------------------------------------------------------------------


def test_bpe_equals_encoding_in_one_go(spark, docs, corpus):
    with open(bpe.VOCABULARY, "rb") as f:
        plain = bpe.encoding(f.read(), bpe.PATTERN)
    got = {r.doc_id: r for r in bpe.encode_documents(docs).collect()}
    for k, t, *_ in corpus:
        assert got[k].tokens == plain.encode_ordinary(t) and got[k].exact and got[k].n_tokens == len(got[k].tokens)


def test_bpe_chunks_are_reused():
    from stratarch.llm.textbatch import TextBatch

    rng = random.Random(7)
    shared = prose(rng, 3000)
    texts = [prose(rng, 100) + " " + shared for _ in range(5)]
    with open(bpe.VOCABULARY, "rb") as f:
        plain = bpe.encoding(f.read(), bpe.PATTERN)
    encoder = bpe.ChunkEncoder(plain.encode_ordinary)
    assert encoder.texts(TextBatch(pa.array(texts))) == [plain.encode_ordinary(t) for t in texts]
    assert encoder.hits > encoder.misses


def test_bpe_awkward(spark, messy):
    got = bpe.encode_documents(messy).cache()
    assert got.count() == messy.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[100].tokens is None and by[100].exact is None and by[101].tokens == [] and by[105].exact
    back = bpe.decode_tokens(got.withColumn("text", got.doc_id))
    assert "text_" in back.columns
    texts = {r.doc_id: r.text for r in messy.collect() if r.doc_id is not None and r.doc_id != 103}
    assert all(r.text_ == texts[r.doc_id] for r in back.collect() if r.doc_id in texts)
    assert bpe.encode_documents(empty(spark)).count() == 0


def test_bpe_with_another_pattern(spark, docs, corpus):
    pattern = r"\w+|\W+"
    with open(bpe.VOCABULARY, "rb") as f:
        plain = bpe.encoding(f.read(), pattern)
    got = {r.doc_id: r.tokens for r in bpe.encode_documents(docs.where("doc_id < 5"), pattern=pattern).collect()}
    assert got == {k: plain.encode_ordinary(t) for k, t, *_ in corpus[:5]}


def test_bpe_bytes_that_are_no_utf8(spark):
    df = spark.sql("select 1L as doc_id, cast(X'61FF6220' as string) as text union all select 2L, 'a b'")
    assert rows(bpe.encode_documents(df), "doc_id", "exact") == [(1, False), (2, True)]
    assert {r.doc_id for r in linededup.dedup_lines(df).collect()} == {1, 2}


# ids ----------------------------------------------------------------------------------------------------------------


def test_ids_of_any_type_and_names_with_dots(spark):
    data = [(f"d{k}" if k else None, f"some words of text {k} and more of them") for k in range(30)]
    df = spark.createDataFrame([(*d, len(d[1])) for d in data], "`the.id` string, text string, n_chars int")
    marks = spark.createDataFrame([(f"d{k}", 1) for k in range(1, 20)], "`the.id` string, quality int")
    ids = sorted((d[0] for d in data), key=repr)
    assert [r[0] for r in rows(packing.pack_windows(df, "the.id", capacity=64), "doc_id")] == ids
    assert [r[0] for r in rows(quality.quality_scores(df, marks, "the.id"), "doc_id")] == ids
    assert quality.keep_quality(df, marks, "the.id").columns == df.columns
    assert [r[0] for r in rows(lmscore.cross_parse_scores(df, "the.id"), "doc_id")] == ids
    assert rows(linededup.dedup_lines(df, "the.id").select("`the.id`"), "`the.id`") == [(i,) for i in ids]


# folders ------------------------------------------------------------------------------------------------------------


def test_scratch_stays_in_the_shared_folder():
    class Session:
        conf = {"spark.checkpoint.dir": "file:///shared/of/the/cluster"}

    assert scratch_path(Session(), "x").startswith("file:///shared/of/the/cluster/")
