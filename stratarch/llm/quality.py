"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated from labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import key_columns, key_of, materialize
from .textbatch import SPACE, TextBatch, distinct, lut, packed, per_doc, slices, starts_of_runs

FEATURES = (
    "upper_share", "symbol_rate", "pipe_rate", "bang_rate",
    "word_length", "distinct_share", "repeat_share", "top_share", "line_repeat_share",
)
#: Shares are taken as if so much ordinary text stood before each text: a few odd words in a short one prove little.
PRIOR_WORDS, PRIOR_BYTES = 12, 60

_UPPER, _LOWER = lut(ranges=(("A", "Z"),)), lut(ranges=(("a", "z"),))
_SYMBOL, _PIPE, _BANG, _NEWLINE = lut("#$%&*<>{}[]^~\\"), lut("|\t"), lut("!?"), lut("\n")


def features(col: pa.Array) -> np.ndarray:
    """Rule statistics, one row per text; all zero where a text has no words."""
    out = np.zeros((len(col), len(FEATURES)))
    at = 0
    for (part,) in slices([col.fill_null("") if col.null_count else col], 0):
        out[at : at + len(part)] = _features(TextBatch(part))
        at += len(part)
    return out


def _features(t: TextBatch) -> np.ndarray:
    n = t.n
    upper, lower = t.counts(_UPPER), t.counts(_LOWER)
    starts, ends = t.spans(~SPACE[t.buf])
    doc = t.doc_of(starts)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    h = t.hashes(starts, ends)
    again = ~starts_of_runs(h) & ~starts_of_runs(doc)
    key = np.sort(packed(doc, h))
    first = np.flatnonzero(starts_of_runs(key))
    key_doc = (key[first] >> np.uint64(44)).astype(np.int64)
    kinds = np.bincount(key_doc, minlength=n)
    # how often the commonest word stands in each text
    top = np.zeros(n)
    np.maximum.at(top, key_doc, np.diff(np.append(first, len(key))))
    line_starts, line_ends = t.spans(~_NEWLINE[t.buf])
    line_doc = t.doc_of(line_starts)
    lines = np.bincount(line_doc, minlength=n)
    line_kinds = np.bincount(line_doc[distinct(line_doc, t.hashes(line_starts, line_ends))], minlength=n)
    letters = upper + lower
    f = np.stack([
        (upper + 0.03 * PRIOR_BYTES) / (letters + PRIOR_BYTES),
        t.counts(_SYMBOL) / (words + PRIOR_WORDS),
        t.counts(_PIPE) / (words + PRIOR_WORDS),
        t.counts(_BANG) / (words + PRIOR_WORDS),
        (per_doc(ends - starts, doc, n) + 5 * PRIOR_WORDS) / (words + PRIOR_WORDS),
        # texts get poorer in new words as they get longer; the power levels that out
        (kinds + PRIOR_WORDS) / (words + PRIOR_WORDS) ** 0.9,
        per_doc(again, doc, n) / (words + PRIOR_WORDS),
        (top + 0.06 * PRIOR_WORDS) / (words + PRIOR_WORDS),
        (lines - line_kinds) / (lines + 4),
    ], axis=1)
    f[words == 0] = 0
    return f


class IsolationForest:
    """Trees of random splits; rare points are cut off early, so their paths are short."""

    def __init__(self, sample: np.ndarray, trees: int, subsample: int, seed: int):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(sample))
        self.depth = int(np.ceil(np.log2(max(self.size, 2)))) + 1
        self.trees = [self._grow(sample[rng.choice(len(sample), self.size, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def average_path(n: float) -> float:
        """Expected path length of an unsuccessful search in a binary tree of n points."""
        return 0.0 if n < 2 else 1.0 if n < 3 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, path = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(feature)
            for column, empty in ((feature, -1), (cut, 0.0), (left, at), (right, at), (path, depth + self.average_path(len(rows)))):
                column.append(empty)
            low, high = x[rows].min(0), x[rows].max(0)
            usable = np.flatnonzero(high > low)
            if len(rows) > 1 and depth < self.depth and len(usable):
                k = int(rng.choice(usable))
                c = rng.uniform(low[k], high[k])
                below = x[rows, k] < c
                if below.any() and not below.all():
                    feature[at], cut[at] = k, c
                    left[at] = node(rows[below], depth + 1)
                    right[at] = node(rows[~below], depth + 1)
            return at

        node(np.arange(len(x)), 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; higher is more anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, f] < cut[at], left[at], right[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.average_path(self.size), 1e-9))


class QualityModel:
    def __init__(self, forest: IsolationForest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score; NaN where there is nothing to score (no words)."""
        s = self.forest.score(x) if self.forest is not None else np.zeros(len(x))
        return np.where((x == 0).all(1), np.nan, s)

    def keeps(self, score: np.ndarray) -> np.ndarray:
        return score < self.threshold  # False for NaN


BINS = 2000


def choose_threshold(good: np.ndarray, bad: np.ndarray, cost: float) -> float:
    """From counts by score bin: the bin edge with the most bad rows rejected less `cost` times the good ones, both as shares; on a tie the midpoint of the tied stretch."""
    if not bad.sum():
        return 2.0
    rejected_bad = np.append(np.cumsum(bad[::-1])[::-1], 0) / bad.sum()
    rejected_good = np.append(np.cumsum(good[::-1])[::-1], 0) / max(good.sum(), 1)
    gain = np.round(rejected_bad - cost * rejected_good, 12)
    best = np.flatnonzero(gain == gain.max())
    return float(best[0] + best[-1]) / 2 / BINS


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(id, did, th, f) for every row of docs, in the shared folder: narrow, so later passes leave the texts alone."""

    def compute(it):
        for batch in it:
            f = features(batch.column(3))
            flat = pa.ListArray.from_arrays(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32), f.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], flat], ["id", "did", "th", "f"])

    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), *key_columns(id_col, text_col, docs), F.col(f"`{text_col}`").cast("string").alias("text"))
    return materialize(keyed.mapInArrow(compute, f"id {docs.schema[id_col].dataType.simpleString()}, did long, th long, f array<double>"), "features")


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def fit_quality(
    table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
    fit_rows: int = 8192, contamination: float = 0.05, trees: int = 128, subsample: int = 256, cost: float = 3.0, seed: int = 7,
) -> QualityModel:
    """Fit the forest and calibrate its threshold.

    `table` is from feature_table. The forest is grown on a bounded sample: the `fit_rows` labelled rows of least
    id hash, with bad ones thinned to the share `contamination`, so that they stay rare. The threshold is then
    calibrated on *all* labelled rows by a distributed histogram of their scores (2,000 bins reach the driver,
    whatever the size). Labels that are null, or of ids that no document has, don't count; without labels nothing
    but wordless texts is rejected.
    """
    marks = labels.select(key_of(id_col, labels).alias("did"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
    marked, _ = materialize(table.drop("id").join(marks, "did"), "marked")
    total, order = marked.count(), F.xxhash64("did", F.lit(seed))
    wanted = marked.select(order.alias("o"), "did", "th", "label", "f")
    # a cut by hash that leaves somewhat more than fit_rows, so that not every partition sends so many to the driver
    share = 1.5 * fit_rows / max(total, 1)
    sample = wanted.where(F.col("o") <= int(share * 2**64) - 2**63).limit(4 * fit_rows).collect() if share < 1 else []
    if len(sample) < fit_rows or len(sample) == 4 * fit_rows:
        sample = wanted.orderBy("o", "did", "th", "label").limit(fit_rows).collect()
    sample = sorted(sample, key=lambda r: r[:4])[:fit_rows]
    if not sample:
        return QualityModel(None, 2.0)
    x, y = np.array([r.f for r in sample]), np.array([r.label for r in sample])
    good, bad = x[y > 0], x[y <= 0]
    if len(good) and len(bad):
        x = np.concatenate([good, bad[: max(1, round(len(good) * contamination))]])
    forest = IsolationForest(x, trees, subsample, seed)
    raw = QualityModel(forest, 2.0)

    def bins(it):
        for batch in it:
            s = raw.score(_matrix(batch.column(0))) if batch.num_rows else np.zeros(0)
            b = np.minimum(np.nan_to_num(s, nan=1.0) * BINS, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(b), batch.column(1)], ["bin", "label"])

    counts = marked.select("f", "label").mapInArrow(bins, "bin long, label int").groupBy("bin").agg(
        F.count_if(F.col("label") > 0).alias("good"), F.count_if(F.col("label") <= 0).alias("bad")).collect()
    good_bins, bad_bins = np.zeros(BINS), np.zeros(BINS)
    for r in counts:
        good_bins[r.bin], bad_bins[r.bin] = r.good, r.bad
    return QualityModel(forest, choose_threshold(good_bins, bad_bins, cost))


def score_table(table: DataFrame, model: QualityModel) -> DataFrame:
    def score(it):
        for batch in it:
            s = model.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, mask=np.isnan(s)), pa.array(model.keeps(s))], ["doc_id", "score", "keep"])

    return table.select("id", "f").mapInArrow(score, f"doc_id {table.schema['id'].dataType.simpleString()}, score double, keep boolean")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fit) -> DataFrame:
    """One row (doc_id, score, keep) for every row of docs, repeated rows included.

    Null, empty and blank texts have score null and keep false; a null id stays null; ids may be of any type, the same in
    docs and labels. A long text counts whole.
    Ties at the threshold are rejected. An empty table gives an empty result.
    """
    table, _ = feature_table(docs, id_col, text_col)
    model = fit_quality(table, labels, id_col, label_col, **fit)
    return score_table(table, model)


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fit) -> DataFrame:
    """docs without the rows that quality_scores rejects: same columns, same rows otherwise.

    The decision is made where the text is read, so no text is shuffled or joined.
    """
    table, _ = feature_table(docs, id_col, text_col)
    model = fit_quality(table, labels, id_col, label_col, **fit)

    @F.arrow_udf("boolean")
    def keeps(col: pa.Array) -> pa.Array:
        return pa.array(model.keeps(model.score(features(col))))

    return docs.filter(keeps(F.col(f"`{text_col}`").cast("string")))


__all__ = ["FEATURES", "IsolationForest", "QualityModel", "choose_threshold", "features", "fit_quality", "keep_quality", "quality_scores"]
