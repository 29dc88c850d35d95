"""Line dedup: winnowing over line hashes, position joins, extension both ways, deletion of later runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, key_columns, materialize, maybe_broadcast
from .textbatch import SPACE, U64, TextBatch, _powers, batches, int64, lut, mix, ranks, starts_of_runs

_NEWLINE = lut("\n\r")


class Lines:
    """The lines of some texts. A line of more than `long_line` words is cut behind every word whose hash is a
    multiple of `cut`, so that a passage inside a longer line falls into the same pieces wherever it stands."""

    def __init__(self, t: TextBatch, long_line: int, cut: int):
        starts, ends = t.spans(~SPACE[t.buf])
        doc = t.doc_of(starts)
        if cut == 1 and long_line == 0:  # every word is a piece
            self.start, self.end, self.doc, self.rank = starts, ends, doc, ranks(doc)
            self.words, self.hash = np.ones(len(starts), np.int64), t.hashes(starts, ends)
            return
        breaks = np.zeros(len(t.buf) + 1, np.int64)
        np.cumsum(_NEWLINE[t.buf], out=breaks[1:])
        new = starts_of_runs(breaks[starts]) | starts_of_runs(doc) if len(starts) else np.zeros(0, bool)
        line = np.cumsum(new) - 1
        if len(starts):
            length = np.bincount(line)
            h = t.hashes(starts, ends)
            behind = np.zeros(len(starts), bool)
            behind[1:] = (h[:-1] % U64(cut) == 0) & (length[line[1:]] > long_line)
            new |= behind
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1 if len(first) else first
        self.start, self.end, self.doc = starts[first], ends[last], doc[first]
        self.words = last - first + 1
        # a line cut from a longer one is hashed word by word, so white space does not matter
        if len(starts):
            mixed = np.zeros(len(starts) + 1, U64)
            np.cumsum(mix(h + (np.arange(len(starts)) - np.repeat(first, self.words)).astype(U64) * U64(0x9E3779B97F4A7C15)), out=mixed[1:])
            self.hash = mix(mixed[last + 1] - mixed[first] + self.words.astype(U64))
        else:
            self.hash = np.zeros(0, U64)
        self.rank = ranks(self.doc)


def fingerprints(lines: Lines, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: (index of first line, hash of `gram` lines) of the rightmost minimum of each `window` such hashes.

    Any run of gram + window - 1 equal lines in two places holds a fingerprint that both share.
    """
    n = len(lines.hash)
    if n < gram:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    m = n - gram + 1
    h = np.zeros(m, U64)
    for j in range(gram):
        h = mix(h * U64(31) + lines.hash[j : j + m] + U64(j + 1))
    at = np.flatnonzero(lines.doc[:m] == lines.doc[gram - 1 :])
    h, doc = h[at], lines.doc[at]
    if not len(at):
        return at, h
    k = len(at)
    best = np.arange(k)

    def merge(j: int) -> np.ndarray:
        """Minima of windows joined with those that start j later."""
        to = np.minimum(np.arange(k) + j, k - 1)
        return np.where((doc[to] == doc) & (h[best[to]] <= h[best]), best[to], best)

    span = 1
    while span < window:
        step = min(span, window - span)
        best, span = merge(step), span + step
    # windows that would reach past a text's last gram don't count, unless the text has too few for one window
    size = np.bincount(doc)[doc]
    whole = (ranks(doc) + window <= size) | (ranks(doc) == 0)
    chosen = np.unique(best[whole])
    return at[chosen], h[chosen]


def spans(lines: Lines, at: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, gap): of all that stands from a fingerprint's first line to the last one of the text's next fingerprint,
    and how many lines the one starts before the other; 0 for a text's last fingerprint."""
    gap = np.zeros(len(at), np.int64)
    if len(at) < 2:
        return np.zeros(len(at), np.int32), gap
    gap[:-1] = np.where(lines.doc[at[1:]] == lines.doc[at[:-1]], np.diff(at), 0)
    p, q = _powers(len(lines.hash) + 1)
    sums = np.zeros(len(lines.hash) + 1, U64)
    np.cumsum(lines.hash * p[: len(lines.hash)], out=sums[1:])
    h = mix((sums[at + gap + gram] - sums[at]) * q[at] + gap.astype(U64))
    return np.where(gap > 0, (h >> U64(32)).astype(np.uint32).view(np.int32), 0), gap


def _fingerprint_rows(long_line, cut, gram, window):
    def run(it):
        for part in batches(it):
            lines = Lines(TextBatch(part["text"]), long_line, cut)
            at, fp = fingerprints(lines, gram, window)
            span, gap = spans(lines, at, gram)
            doc = pa.array(lines.doc[at])
            yield pa.RecordBatch.from_arrays(
                [int64(fp), pa.array(span), part["did"].take(doc), part["th"].take(doc), pa.array(lines.rank[at].astype(np.int32)), pa.array(gap.astype(np.int32))],
                ["fp", "span", "did", "th", "pos", "gap"])

    return run


def _line_rows(long_line, cut):
    def run(it):
        for part in batches(it):
            t = TextBatch(part["text"])
            lines = Lines(t, long_line, cut)
            count = np.bincount(lines.doc, minlength=t.n)
            data = lines.hash.astype(np.uint32).tobytes()
            offsets = np.append(0, np.cumsum(count)).astype(np.int32) * 4
            col = pa.Array.from_buffers(pa.binary(), t.n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([part["did"], part["th"], col], ["did", "th", "lines"])

    return run


def _runs(gram: int):
    """Matches sorted by (did, th, pos) to runs: a matched span leads from its fingerprint to the next one. A run has the
    place where its first line stands earlier, and one behind which its end stands. The last run of a batch waits."""

    def joined(c: list[np.ndarray]):
        did, th, pos, gap = c[:4]
        linked = np.zeros(len(did), bool)  # to the row before
        linked[1:] = (did[1:] == did[:-1]) & (th[1:] == th[:-1]) & (gap[:-1] > 0) & (pos[:-1] + gap[:-1] == pos[1:])
        return linked

    def rows(c, linked):
        did, th, pos, gap, a_did, a_th, a_pos = c
        first = np.flatnonzero(~linked)
        last = np.append(first[1:], len(did)) - 1
        by = np.where(last > first, last - 1, last)  # whose place leads to the end
        step = np.where(last > first, gap[by], 0)
        out = [did[first], th[first], pos[first], pos[last] + gram, a_did[first], a_th[first], a_pos[first], a_did[by], a_th[by], a_pos[by] + step + gram]
        for k in range(0, len(first), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)].astype(np.int64)) for x in out], _RUN)

    def run(it):
        left = [np.zeros(0, np.int64)] * 7
        for batch in it:
            c = [np.concatenate([old, batch.column(k).to_numpy().astype(np.int64)]) for k, old in enumerate(left)]
            if not len(c[0]):
                continue
            linked = joined(c)
            cut = int(np.flatnonzero(~linked)[-1])
            left = [x[cut:] for x in c]
            if cut:
                yield from rows([x[:cut] for x in c], linked[:cut])
        if len(left[0]):
            yield from rows(left, joined(left))

    return run


_RUN = ["did", "th", "lo", "hi", "a_did", "a_th", "a_pos", "b_did", "b_th", "b_pos"]


def extension(own: np.ndarray, at: np.ndarray, room: np.ndarray, piece: pa.Array, step: int) -> np.ndarray:
    """How many lines of `own` from each place on, backwards for step -1, equal those of its piece, read from its near
    end; `room` is how many the text has there."""
    offsets = np.frombuffer(piece.buffers()[1], np.int32)[piece.offset : piece.offset + len(piece) + 1].astype(np.int64) // 4
    data = piece.buffers()[2]
    other = np.frombuffer(data, np.uint32) if data is not None and data.size else np.zeros(0, np.uint32)
    begin, end = offsets[:-1], offsets[1:]
    near = begin if step > 0 else end - 1
    room = np.minimum(room, end - begin)
    n, live, k = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(live):
        live = live[room[live] > k]
        live = live[own[at[live] + step * k] == other[near[live] + step * k]]
        k += 1
        n[live] = k
    return n


def _rewrite(long_line, cut, min_words):
    def cuts(lines: Lines, borders: np.ndarray, owner: np.ndarray, found: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """First lines and ends of the repeated runs of at least min_words words."""
        lo, hi, side = (found.field(k).to_numpy().astype(np.int64) for k in range(3))
        own = lines.hash.astype(np.uint32)
        lo, hi = borders[owner] + lo, borders[owner] + hi
        for s, step in ((0, -1), (1, 1)):
            some = np.flatnonzero(side == s)
            piece = found.field(3).take(pa.array(some))
            if s:
                hi[some] += extension(own, hi[some], borders[owner[some] + 1] - hi[some], piece, step)
            else:
                lo[some] -= extension(own, lo[some] - 1, lo[some] - borders[owner[some]], piece, step)
        edge = np.zeros(len(own) + 1, np.int64)
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
        mark = np.cumsum(edge[:-1]) > 0
        inner = mark.copy()  # continues the run of the line before
        inner[1:] &= mark[:-1]
        inner[0] = False
        inner[borders[:-1][borders[:-1] < len(mark)]] = False
        first = np.flatnonzero(mark & ~inner)
        end = np.flatnonzero(mark & ~np.append(inner[1:], False)) + 1
        words = np.append(0, np.cumsum(lines.words))
        long = words[end] - words[first] >= min_words
        return first[long], end[long]

    def run(it):
        for part in batches(it):
            found = part["matches"]
            hit = np.flatnonzero(~np.asarray(found.is_null())) if len(found) else []
            if len(hit):
                t = TextBatch(part["text"].take(pa.array(hit)))
                lines = Lines(t, long_line, cut)
                borders = np.searchsorted(lines.doc, np.arange(t.n + 1))
                lists = found.take(pa.array(hit))
                owner = np.repeat(np.arange(t.n), np.diff(lists.offsets.to_numpy()))
                first, end = cuts(lines, borders, owner, lists.flatten())
                row = lines.doc[first]
                new, at = [], np.flatnonzero(starts_of_runs(row))
                for i, j in zip(at, np.append(at[1:], len(row))):
                    begin, stop = int(t.offsets[row[i]]), int(t.offsets[row[i] + 1])
                    out = []
                    for a, b in zip(first[i:j], end[i:j]):
                        out.append(t.buf[begin : lines.start[a]].tobytes())
                        begin = int(lines.start[b]) if b < borders[row[i] + 1] else stop
                    out.append(t.buf[begin:stop].tobytes())
                    new.append(b"".join(out).decode(errors="replace").rstrip())
                if new:
                    mask = np.zeros(len(found), bool)
                    mask[np.asarray(hit)[row[at]]] = True
                    part["text"] = pc.replace_with_mask(part["text"], pa.array(mask), pa.array(new, part["text"].type))
            del part["matches"]
            yield pa.RecordBatch.from_arrays(list(part.values()), list(part.keys()))

    return run


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
    min_words: int = 25, gram: int = 8, window: int = 18, long_line: int = 0, cut: int = 1,
) -> DataFrame:
    """docs with later copies of repeated passages deleted; same rows and columns, `length_col` brought up to date.

    Texts are sequences of pieces (see Lines), here single words, so a passage falls into the same pieces wherever it
    stands. Winnowing picks fingerprints of `gram` pieces, at least one in any gram + window - 1 = 25 repeated words.
    Places are ordered by id (hash of the id, if it isn't an integer), text hash and position. A fingerprint that stands
    earlier is repeated; so is all from one fingerprint to the next if that span stands earlier, at whatever place, so a
    passage need not have one partner for all its fingerprints. Such runs are extended word by word at both ends along
    the place where their first or last span stands first (the first place of the fingerprint, if no span matches), by
    up to gram + window words: within that many, what is repeated would hold another fingerprint. Runs that overlap or
    touch are one, and a run of at least `min_words` words is deleted, with the white space behind it. Repeats within a
    text count like those between texts. Spans are compared by 96 bits of hashes, words at the ends by 32 bits.

    Null texts stay null, empty ones empty; a text that is all repeats becomes empty, and its row stays. A null
    id comes before all others. Rows equal in id and text are one document and keep equal texts. Other columns
    pass through whatever their names. Long texts are handled whole. An empty table stays empty.

    Fingerprints are a small share of the input; texts are shuffled once, to meet what was found in them.
    """
    spark = docs.sparkSession
    keyed = docs.select(*key_columns(id_col, text_col, docs), F.col(f"`{text_col}`").cast("string").alias("text"))
    prints, prints_path = materialize(
        keyed.mapInArrow(_fingerprint_rows(long_line, cut, gram, window), "fp long, span int, did long, th long, pos int, gap int"), "fingerprints")
    place = F.struct("did", "th", "pos")
    first = prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(place).alias("f")).where("n > 1").drop("n")
    hits, hits_path = materialize(prints.join(first, "fp").select(F.xxhash64("fp", "span").alias("key"), "gap", "did", "th", "pos", "f"), "hits")
    drop_path(spark, prints_path)
    known = hits.where("gap > 0").groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("s")).where("n > 1").drop("n")
    later = hits.where(F.col("f") != place).join(known, "key", "left").withColumn("known", F.coalesce(F.col("s") != place, F.lit(False)) & (F.col("gap") > 0))
    earlier = F.when(F.col("known"), F.col("s")).otherwise(F.col("f"))
    matches = later.select("did", "th", "pos", F.when(F.col("known"), F.col("gap")).otherwise(0).alias("gap"), earlier.alias("e"))
    matches = matches.select("did", "th", "pos", "gap", F.col("e.did").alias("a_did"), F.col("e.th").alias("a_th"), F.col("e.pos").alias("a_pos")).distinct()
    runs = matches.repartition("did", "th").sortWithinPartitions("did", "th", "pos").mapInArrow(_runs(gram), ", ".join(f"{c} long" for c in _RUN))
    runs, runs_path = materialize(runs, "runs")
    drop_path(spark, hits_path)
    reach = gram + window
    ahead = runs.where("lo > 0").select(
        F.col("a_did").alias("p_did"), F.col("a_th").alias("p_th"), F.greatest(F.col("a_pos") - reach, F.lit(0)).alias("from"), F.col("a_pos").alias("to"), F.lit(0).alias("side"), "did", "th", "lo", "hi")
    behind = runs.select(
        F.col("b_did").alias("p_did"), F.col("b_th").alias("p_th"), F.col("b_pos").alias("from"), (F.col("b_pos") + reach).alias("to"), F.lit(1).alias("side"), "did", "th", "lo", "hi")
    asked = ahead.unionByName(behind)
    sources, _ = materialize(asked.select(F.col("p_did").alias("did"), F.col("p_th").alias("th")).distinct(), "sources")
    lines = keyed.join(maybe_broadcast(sources, 32), ["did", "th"], "left_semi").mapInArrow(_line_rows(long_line, cut), "did long, th long, lines binary")
    lines = lines.dropDuplicates(["did", "th"]).select(F.col("did").alias("p_did"), F.col("th").alias("p_th"), "lines")
    piece = F.substring("lines", (F.col("from") * 4 + 1).cast("int"), ((F.col("to") - F.col("from")) * 4).cast("int"))
    answered = asked.join(lines, ["p_did", "p_th"]).select("did", "th", F.struct(F.col("lo").cast("int"), F.col("hi").cast("int"), "side", piece.alias("piece")).alias("m"))
    found = answered.groupBy(F.col("did").alias("m_did"), F.col("th").alias("m_th")).agg(F.collect_list("m").alias("matches"))
    found, _ = materialize(found, "found")
    drop_path(spark, runs_path)
    names = [f.name for f in docs.schema.fields]
    # positional names inside: input columns may be called anything
    inner = [f"c{k}" for k in range(len(names))]
    inner[names.index(text_col)] = "text"
    typed = docs.toDF(*inner).withColumn("text", F.col("text").cast("string"))
    did, th = key_columns(inner[names.index(id_col)], "text", typed)
    # the smaller side of a shuffled hash join: a partition of `found` has no more than the repeats of its documents
    joined = typed.join(found.hint("shuffle_hash"), (did == F.col("m_did")) & (th == F.col("m_th")), "left")
    out = joined.select(*inner, "matches").mapInArrow(_rewrite(long_line, cut, min_words), typed.schema)
    if length_col in names:
        k = inner[names.index(length_col)]
        out = out.withColumn(k, F.char_length("text").cast(docs.schema[length_col].dataType))
    return out.toDF(*names)
