"""Ordered folds that no window function expresses: file rotation and time-to-live caches.

Rows are sorted by group and order across the cluster; each group streams through one task, and only its running
state is held. Nothing is collected to a list.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fold(df: DataFrame, group: str, order: list[str], inputs: list[str], step, out: str, kind: str) -> DataFrame:
    """Adds `out`: step(state or None, *inputs) -> (state, value), run over each group's rows in order."""
    schema = df.withColumn(out, F.lit(None).cast(kind)).schema

    def run(it):
        at, state, begun = None, None, False
        for batch in it:
            names = batch.schema.names
            groups = batch.column(names.index(group)).to_pylist()
            values = []
            for g, *x in zip(groups, *(batch.column(names.index(c)).to_pylist() for c in inputs)):
                if not begun or g != at:
                    at, state, begun = g, None, True
                state, v = step(state, *x)
                values.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64() if kind == "long" else pa.bool_())], [*names, out])

    return df.repartition(F.col(group)).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def rotate(batches: DataFrame, order: list[str], writer: str = "writer", size: str = "size", limit: int = 1000 << 20) -> DataFrame:
    """Adds `file_number`, from 0 for each writer: a file is closed once it has `limit` or more, looked at before each
    batch, so batches are never parted."""

    def step(state, n):
        number, used = state or (0, 0)
        if used >= limit:
            number, used = number + 1, 0
        return (number, used + (n or 0)), number

    return _fold(batches, writer, order, [size], step, "file_number", "long")


def ttl_cache(lookups: DataFrame, key: str, at: str, order: list[str], ttl_seconds: float) -> DataFrame:
    """Adds `hit`: whether a lookup finds an answer stored less than `ttl_seconds` ago. A miss stores one; a hit
    doesn't prolong it. `at` is in microseconds."""
    life = int(ttl_seconds * 1_000_000)

    def step(state, t):
        if state is not None and t is not None and t < state:
            return state, True
        return (state if t is None else t + life), False

    return _fold(lookups, key, order, [at], step, "hit", "boolean")
