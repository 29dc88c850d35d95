"""LM scoring: Ziv-Merhav cross-parsing of every document against the text of all others."""

from __future__ import annotations

import gc
import math
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_path, materialize, release, scratch_path
from .textbatch import SPACE, U64, TextBatch, batches, mix, starts_of_runs

#: Lengths whose word sequences are looked up together; a round goes on only where the last length of the one before
#: was found. The last length is the order: longer matches are followed by their windows of so many words.
ROUNDS = ((1, 2), (3, 4), (5, 6, 7, 8))
#: Words of a slice, the unit of work; a longer document is a slice of its own.
SLICE_WORDS = 2_000_000
WORD_BYTES, GRAM_BYTES = 5, 5
_WORD = U64((1 << (8 * WORD_BYTES)) - 1)


def self_phrases(tokens) -> int:
    """Phrases of the incremental (LZ78) parsing of a text by itself."""
    nodes: dict = {}
    node, count, fresh = 0, 0, 1
    for c in tokens:
        to = nodes.get((node, c))
        if to is None:
            nodes[node, c] = fresh
            fresh += 1
            count += 1
            node = 0
        else:
            node = to
    return count + (node != 0)


def divergence(tokens: int, cross: int, own: int) -> float | None:
    """Ziv-Merhav estimate of relative entropy, in bits per token; None for no tokens."""
    if not tokens:
        return None
    return (cross * math.log2(tokens) - own * math.log2(max(own, 1))) / tokens


def greedy_phrases(longest: list[int]) -> int:
    """Greedy factors: each is the longest match from where the last ended, or one unknown token."""
    at = count = 0
    while at < len(longest):
        at += longest[at] or 1
        count += 1
    return count


def _packed(x: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of each integer, one after the other."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).ravel()


def _unpacked(data, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def _slices(folder: str, most: int):
    """Documents to slices: a file with their words each, and a row that names it."""

    def run(it):
        system, base = fs.FileSystem.from_uri(folder)
        ids, counts, words, size = [], [], [], 0

        def flush():
            name = f"{base}/{uuid.uuid4().hex}"
            with system.open_output_stream(name) as f:
                for w in words:
                    f.write(_packed(w, WORD_BYTES))
            n = np.concatenate(counts)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), x) for x in (pa.concat_arrays(ids), pa.array(n))]
            return pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([size], pa.int64()), *lists], ["file", "words", "ids", "counts"])

        for part in batches(it):
            t = TextBatch(part["text"])
            starts, ends = t.spans(~SPACE[t.buf])
            ids.append(part["id"])
            counts.append(np.bincount(t.doc_of(starts), minlength=t.n).astype(np.int64))
            words.append(t.hashes(starts, ends) & _WORD)
            size += len(starts)
            if size >= most:
                yield flush()
                ids, counts, words, size = [], [], [], 0
        if ids:
            yield flush()

    return run


class Slice:
    """The words of some documents, and how much of each place's longest match is known."""

    def __init__(self, folder: str, file: str, counts: np.ndarray):
        system, base = fs.FileSystem.from_uri(folder)
        with system.open_input_stream(f"{base}/{file}") as f:
            self.words = _unpacked(f.read(), WORD_BYTES)
        self.counts, self.doc = counts, np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.room = np.repeat(np.cumsum(counts), counts) - np.arange(len(self.doc))  # words up to the document's end

    def grams(self, known: np.ndarray, lengths: tuple[int, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(places, hashes) by length: of what may stand elsewhere, going by the matches `known` so far."""
        least = lengths[0] - 1
        open_ = known >= least
        open_[:-1] &= open_[1:] | (self.room[:-1] == least)
        h, places, hashes = None, [], []
        for n in range(1, lengths[-1] + 1):
            at = np.flatnonzero(open_ & (self.room >= n)) if n >= lengths[0] or h is None else at
            if h is None:
                at = at[self.room[at] >= lengths[0]]
                h = np.zeros(len(at), U64)
            elif n > lengths[0]:
                stay = self.room[before] >= n
                h = h[stay]
                at = before[stay]
            before = at
            h = mix(h * U64(31) + self.words[at + n - 1] + U64(n))
            if n >= lengths[0]:
                places.append(at)
                hashes.append(h)
        return places, hashes

    def distinct(self, places: list[np.ndarray], hashes: list[np.ndarray], buckets: int):
        """(entries by bucket, where each bucket begins, index of each place's entry). The lowest bit of an entry tells
        that several documents of the slice have it."""
        h, doc = np.concatenate(hashes), self.doc[np.concatenate(places)]
        order = np.argsort(h)
        new = starts_of_runs(h[order])
        first = np.flatnonzero(new)
        index = np.empty(len(h), np.int64)
        index[order] = np.cumsum(new) - 1
        one, by = h[order[first]], doc[order]
        many = np.minimum.reduceat(by, first) != np.maximum.reduceat(by, first) if len(first) else np.zeros(0, bool)
        bucket = (one % U64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # the former sorts by radix
        turn = np.argsort(bucket, kind="stable")
        place = np.empty(len(turn), np.int64)
        place[turn] = np.arange(len(turn))
        entries = (((one >> U64(16)) & ~U64(1)) | many.astype(U64))[turn]
        return entries, np.searchsorted(bucket[turn], np.arange(buckets + 1)), place[index]


def _known(s: Slice, rows: list, upto: int, buckets: int) -> np.ndarray:
    """Longest matches, of up to the last length of round `upto` - 1, from the answers (bucket, data) of a round; the row of
    bucket -1 has what was known before."""
    known = next((np.frombuffer(r["data"], np.uint8).copy() for r in rows if r["bucket"] < 0), np.zeros(len(s.words), np.uint8))
    if not upto:
        return known
    places, hashes = s.grams(known, ROUNDS[upto - 1])
    _, _, index = s.distinct(places, hashes, buckets)
    answers = [np.frombuffer(r["data"], np.uint8) for r in sorted((r for r in rows if r["bucket"] >= 0), key=lambda r: r["bucket"])]
    found = np.concatenate([*answers, np.zeros(0, np.uint8)])[index] > 0
    at = 0
    for n, p in zip(ROUNDS[upto - 1], places):
        yes = p[found[at : at + len(p)]]
        known[yes[known[yes] == n - 1]] = n
        at += len(p)
    return known


def _ask(folder: str, upto: int, buckets: int):
    """Slices with the answers of the round before to what round `upto` looks up: (bucket, slice, data); bucket -1 has what is
    known."""

    def run(it):
        for batch in it:
            for r in batch.to_pylist():
                s = Slice(folder, r["file"], np.array(r["counts"], np.int64))
                known = _known(s, r["answers"] or [], upto, buckets)
                entries, edges, _ = s.distinct(*s.grams(known, ROUNDS[upto]), buckets)
                some = np.flatnonzero(np.diff(edges))
                offsets = (np.append(edges[some], edges[-1]) * GRAM_BYTES).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(_packed(entries, GRAM_BYTES))])
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(np.full(len(some), r["slice"], np.int64)), data], _ASKED)
                yield pa.RecordBatch.from_arrays([pa.array([-1 - r["slice"]]), pa.array([r["slice"]]), pa.array([known.tobytes()], pa.binary())], _ASKED)

    return run


_ASKED = ["bucket", "slice", "data"]


def _answer(it):
    """Rows sorted by bucket to a byte for each entry: 1 if several slices, or several documents of one, have it."""

    def flush(slices, data):
        if not data:
            return
        e = _unpacked(b"".join(data), GRAM_BYTES)
        order = np.argsort(e >> U64(1))
        first = np.flatnonzero(starts_of_runs(e[order] >> U64(1)))
        size = np.diff(np.append(first, len(e)))
        found = np.zeros(len(e), np.uint8)
        found[order] = np.repeat((size > 1) | (np.maximum.reduceat(e[order] & U64(1), first) > 0), size)
        offsets = np.append(0, np.cumsum([len(d) // GRAM_BYTES for d in data])).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket] * len(slices), pa.int64()), pa.array(slices, pa.int64()), pa.Array.from_buffers(pa.binary(), len(slices), [None, pa.py_buffer(offsets), pa.py_buffer(found)])], _ASKED)

    bucket, slices, data = None, [], []
    for batch in it:
        for b, s, d in zip(*(c.to_pylist() for c in batch.columns)):
            if b < 0:
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([s]), pa.array([d], pa.binary())], _ASKED)
                continue
            if b != bucket:
                yield from flush(slices, data)
                bucket, slices, data = b, [], []
            slices.append(s)
            data.append(d)
    yield from flush(slices, data)


def longest_matches(known: np.ndarray, doc: np.ndarray, order: int) -> np.ndarray:
    """Matches of up to `order` words to whole ones: a place of `order` words leads on to the next such one."""
    out = known.astype(np.int64)
    full = known == order
    if full.any():
        last = full.copy()
        last[:-1] &= ~(full[1:] & (doc[1:] == doc[:-1]))
        ends = np.flatnonzero(last)
        at = np.flatnonzero(full)
        out[at] = ends[np.searchsorted(ends, at)] - at + order
    return out


def _score(folder: str, buckets: int, total: int, id_type: str):
    def run(it):
        gc.disable()  # parses make many objects without cycles; collecting them over and over takes longer
        for batch in it:
            ids_column = batch.column(batch.schema.get_field_index("ids"))
            for k, r in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                counts = np.array(r["counts"], np.int64)
                s = Slice(folder, r["file"], counts)
                longest = longest_matches(_known(s, r["answers"] or [], len(ROUNDS), buckets), s.doc, ROUNDS[-1][-1])
                border, out = np.append(0, np.cumsum(counts)).tolist(), []
                for a, b in zip(border, border[1:]):
                    cross, own = greedy_phrases(longest[a:b].tolist()), self_phrases(s.words[a:b].tolist())
                    out.append((b - a, cross, own, total - (b - a), divergence(b - a, cross, own)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.float64()])]
                yield pa.RecordBatch.from_arrays([ids_column.slice(k, 1).flatten(), *columns], _NAMES)
        gc.enable()

    return run


_NAMES = ["doc_id", "tokens", "phrases", "own_phrases", "reference_tokens", "score"]


def cross_parse_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Relative entropy of every document against all others; low is like what other documents have.

    Result: (doc_id, tokens, phrases, own_phrases, reference_tokens, score), one row for every row of docs. A document is
    factored greedily: each phrase is the longest match with the text of any other row, or one unknown word. The reference is
    the whole table, every row but the document's own, so `reference_tokens` is all words less its own; nothing of it is
    left out, and equal texts get equal scores. Longest matches are exact up to 8 words (ROUNDS); beyond, a match goes on
    as long as each window of 8 words stands in another row, as in an automaton of that order. Words are told apart by 40
    bits of their hashes, sequences by 39 bits within a bucket.

    Words are what stands between white space. Null, empty and blank texts have 0 tokens and score null. A null id stays
    null; ids may be of any type. Repeated rows match each other and get equal scores. Long texts are parsed whole. An empty
    table gives no rows; a single text has no reference, and every word is a phrase.

    The words of slices of documents are written once. In each round a slice sends the distinct sequences that may
    still match, 5 bytes each, to buckets by hash, and gets a byte for each; a sequence that many documents have is sent once
    a slice, so no bucket is hot. Shuffles and work grow with the words, not with documents times reference.
    """
    spark = docs.sparkSession
    schema = docs.schema[id_col].dataType.simpleString()
    out_schema = f"doc_id {schema}, tokens long, phrases long, own_phrases long, reference_tokens long, score double"
    folder = scratch_path(spark, "words")
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    slices, _ = materialize(rows.mapInArrow(_slices(folder, SLICE_WORDS), f"file string, words long, ids array<{schema}>, counts array<long>"), "slices")
    count, total = slices.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    if not count:
        return spark.createDataFrame([], out_schema)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, tasks = 4 * width, min(count, 8 * width)
    # numbers are dense, so slices are dealt evenly to tasks; the window sorts names, one a slice
    names = slices.select("file").withColumn("slice", (F.row_number().over(Window.orderBy("file")) - 1).cast("long"))
    numbered, _ = materialize(slices.join(names, "file").select("slice", "file", "counts", "ids"), "numbered")
    by_slice = F.pmod("slice", F.lit(tasks)).cast("int")

    def round_of(upto: int, answers: DataFrame | None) -> tuple[DataFrame, str]:
        kinds = "bucket long, slice long, data binary"
        given = numbered.select("slice", "file", "counts")
        given = given.withColumn("answers", F.lit(None).cast("array<struct<bucket long, data binary>>")) if answers is None else given.join(answers, "slice")
        asked = given.repartitionById(tasks, by_slice).mapInArrow(_ask(folder, upto, buckets), kinds)
        told = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, kinds)
        return materialize(told.groupBy("slice").agg(F.collect_list(F.struct("bucket", "data")).alias("answers")), "answers")

    answers, path = round_of(0, None)
    for upto in range(1, len(ROUNDS)):
        release(spark, True)  # a round's shuffle goes before the next one's comes
        old = path
        answers, path = round_of(upto, answers)
        drop_path(spark, old)
    release(spark, True)
    final = numbered.join(answers, "slice").repartitionById(tasks, by_slice)
    return final.mapInArrow(_score(folder, buckets, total, schema), out_schema)
