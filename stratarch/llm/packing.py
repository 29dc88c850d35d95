"""Packing: bounded-space online best fit into windows, with a tree of merges for what stays open."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import key_columns, materialize, original_id


class OpenWindows:
    """At most `slots` open windows of `capacity`; full ones and, when none fits, the fullest are emitted."""

    def __init__(self, capacity: int, slots: int):
        self.capacity, self.slots = capacity, slots
        self.open: list[tuple[int, int]] = []  # (room left, number), ascending: the first that fits is the best fit
        self.items: dict[int, list] = {}
        self.next = 0

    def place(self, length: int, item) -> list | None:
        """Put an item into a window; the items of a window that is thereby closed, if any."""
        at = bisect.bisect_left(self.open, (length, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
            self.items[number].append(item)
            if room == length:
                return self.items.pop(number)
            bisect.insort(self.open, (room - length, number))
            return None
        if length == self.capacity:
            return [item]
        closed = None
        if len(self.open) == self.slots:
            closed = self.items.pop(self.open.pop(0)[1])
        bisect.insort(self.open, (self.capacity - length, self.next))
        self.items[self.next] = [item]
        self.next += 1
        return closed

    def leftovers(self) -> list[list]:
        """What is still open, fullest first."""
        return [self.items[number] for _, number in self.open]


def word_count(text_col: str = "text"):
    """Words between white space; a stand-in for a token count that needs no tokenizer."""
    return F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(r"\S+"))


def _rows(windows: list[tuple[int, int, list]]) -> pa.RecordBatch:
    """(part, number, items) to rows; an item is (did, th, piece, start, length)."""
    sizes = [len(w[2]) for w in windows]
    part, number = (np.repeat(np.array([w[k] for w in windows], np.int64), sizes) for k in (0, 1))
    items = np.array([i for w in windows for i in w[2]], np.int64).reshape(-1, 5)
    before = np.cumsum(items[:, 4]) - items[:, 4]
    first = np.cumsum([0, *sizes[:-1]])
    columns = [part, number, *items.T, before - np.repeat(before[first], sizes)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], _NAMES)


_NAMES = ["part", "number", "did", "th", "piece", "start", "length", "offset"]
_SCHEMA = ", ".join(f"`{n}` long" for n in _NAMES)


def _pack_stream(capacity: int, slots: int, whole: bool):
    """mapInArrow function over rows sorted by part (then order).

    First level (whole=False): rows are documents (part, did, th, n), cut into pieces of at most capacity.
    Merge levels (whole=True): rows are pieces of left-over windows, moved window by window. Windows still open at a
    part's end get a negative number.
    """

    def run(it):
        state: OpenWindows | None = None
        part, done, count = None, [], 0
        pending: list = []
        pending_key = None

        def put(length, items):
            nonlocal count
            closed = state.place(length, items)
            if closed is not None:
                done.append((part, count, [x for y in closed for x in y]))
                count += 1

        def flush_window():
            nonlocal pending, pending_key
            if pending:
                put(sum(i[4] for i in pending), pending)
            pending, pending_key = [], None

        def finish():
            flush_window()
            for k, w in enumerate(state.leftovers()):
                done.append((part, -1 - k, [x for y in w for x in y]))

        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != part:
                    if state is not None:
                        finish()
                    part, state, count = row[0], OpenWindows(capacity, slots), 0
                if whole:
                    if row[1:3] != pending_key:
                        flush_window()
                        pending_key = row[1:3]
                    pending.append(row[3:])
                else:
                    did, th, n = row[1:]
                    for piece, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        put(length, [(did, th, piece, start, length)])
                if len(done) >= 2048:
                    yield _rows(done)
                    done.clear()
        if state is not None:
            finish()
        if done:
            yield _rows(done)

    return run


def pack_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length=None,
    capacity: int = 2048, slots: int = 64, docs_per_part: int = 16384, fan_in: int = 16,
) -> DataFrame:
    """Pack documents into windows of `capacity` words (or of any `length` column); one row per piece.

    Result: (window_id, doc_id, piece, start, length, offset). A document longer than a window is cut into pieces
    of `capacity` and a rest; pieces go into windows whole. Documents are spread over parts by a hash of id and
    text, about `docs_per_part` to a part, so the result depends on the rows alone, not on the cluster; within a
    part they come in order of id (of its hash, if it isn't an integer), then text hash. Each part keeps `slots` windows open: a piece goes to the open window that it
    fills best; when it fits none and all slots are taken, the fullest is emitted. What stays open in `fan_in`
    parts at a time is packed again, window by window, until one part remains.

    Only ids and lengths are shuffled. Null, empty and blank texts have length 0 (as has a null `length`) and give
    no rows; repeated rows are packed as often as they stand; a null id stays null; an empty table gives no rows.
    """
    length = word_count(text_col) if length is None else length
    base = docs.select(F.col(f"`{id_col}`").alias("id"), *key_columns(id_col, text_col, docs), F.coalesce(length.cast("long"), F.lit(0)).alias("n")).where("n > 0")
    sizes, _ = materialize(base, "lengths")
    parts = max(1, -(-sizes.count() // docs_per_part))
    rows = sizes.select(F.pmod(F.xxhash64("did", "th"), F.lit(parts)).alias("part"), "did", "th", "n")
    rows = rows.repartition("part").sortWithinPartitions("part", "did", "th", "n")
    packed, _ = materialize(rows.mapInArrow(_pack_stream(capacity, slots, False), _SCHEMA), "windows")
    done = [packed.where("number >= 0").withColumn("level", F.lit(0))]
    left, level = packed.where("number < 0"), 0
    while parts > 1:
        parts, level = -(-parts // fan_in), level + 1
        moved = left.select(
            F.floor(F.col("part") / fan_in).alias("part"), F.col("part").alias("from"), F.negative("number").alias("rank"),
            "did", "th", "piece", "start", "length")
        moved = moved.repartition("part").sortWithinPartitions("part", "from", "rank", "did", "th", "piece")
        packed, _ = materialize(moved.mapInArrow(_pack_stream(capacity, slots, True), _SCHEMA), "windows")
        done.append(packed.where("number >= 0").withColumn("level", F.lit(level)))
        left = packed.where("number < 0")
    done.append(left.withColumn("level", F.lit(level)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    window = F.concat_ws("-", "level", "part", "number")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        out = out.join(sizes.groupBy("did", "th").agg(F.first("id").alias("id")), ["did", "th"])
        return out.select(window.alias("window_id"), F.col("id").alias("doc_id"), "piece", "start", "length", "offset")
    return out.select(window.alias("window_id"), original_id().alias("doc_id"), "piece", "start", "length", "offset")
