"""Vectorised text handling over Arrow batches: token spans, exact span hashes and small set helpers.

Nothing here works row by row: a batch of texts is one byte buffer with document offsets, and every step is a
whole-buffer numpy operation. Batches are processed in slices of about `SLICE_BYTES`, so memory does not follow
the number of rows in an Arrow batch; one longer text makes a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("p", _P), ("q", _PINV)):
            t = np.full(size, base, U64)
            t[0] = 1
            _tables[name] = np.cumprod(t, dtype=U64)
    return _tables["p"], _tables["q"]


def slices(arrays: list[pa.Array], text: int, max_bytes: int = SLICE_BYTES):
    """Cut parallel arrays into runs of rows whose texts add up to about max_bytes."""
    col = arrays[text]
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) else np.int32)
    offsets = offsets[col.offset : col.offset + len(col) + 1].astype(np.int64)
    at = 0
    while at < len(col):
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        to = min(max(to, at + 1), at + (1 << 20) - 1, len(col))
        yield [a.slice(at, to - at) for a in arrays]
        at = to


class TextBatch:
    """The UTF-8 bytes of some texts; null counts as empty."""

    def __init__(self, col: pa.Array):
        if col.null_count:
            col = col.fill_null("")
        n = len(col)
        if n:
            kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
            offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
            data = col.buffers()[2]
            self.buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
            self.offsets = offsets - offsets[0]
        else:
            self.buf, self.offsets = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.n = n
        self._prefix: np.ndarray | None = None

    @property
    def doc_starts(self) -> np.ndarray:
        """First byte of every text that has one."""
        return self.offsets[:-1][np.diff(self.offsets) > 0]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends (exclusive) of maximal runs of True, cut at text borders."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        borders = self.doc_starts
        first[borders] = inside[borders]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = borders[borders > 0] - 1
        last[ends] = inside[ends]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
        if self._prefix is None:
            p, _ = _powers(len(self.buf) + 1)
            prefix = np.zeros(len(self.buf) + 1, U64)
            np.cumsum((self.buf.astype(U64) + U64(1)) * p[: len(self.buf)], out=prefix[1:])
            self._prefix = prefix
        _, q = _powers(len(self.buf) + 1)
        return mix((self._prefix[ends] - self._prefix[starts]) * q[starts] + (ends - starts).astype(U64))

    def counts(self, lut: np.ndarray) -> np.ndarray:
        """Per text, the sum of lut over its bytes."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(lut[self.buf], out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def lut(chars: str | bytes = b"", ranges: tuple = ()) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode() if isinstance(chars, str) else chars)] = True
    for a, b in ranges:
        t[ord(a) : ord(b) + 1] = True
    return t


SPACE = lut(" \t\n\r\x0b\x0c")
#: Letters, digits and all non-ASCII bytes: what words are made of once punctuation is dropped.
WORD = lut(ranges=(("a", "z"), ("A", "Z"), ("0", "9")))
WORD[128:] = True


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def starts_of_runs(key: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before it."""
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return first


def packed(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Text number and the upper 44 bits of a hash in one sortable word; a slice has fewer than 2**20 texts."""
    return (doc.astype(U64) << U64(44)) | (value >> U64(20))


def distinct(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Indexes of the first of each distinct (doc, value), ordered by doc; value is a hash."""
    key = packed(doc, value)
    order = np.argsort(key)
    return order[starts_of_runs(key[order])]


def ranks(doc: np.ndarray) -> np.ndarray:
    """Position of each element within its text; doc must be sorted."""
    n = len(doc)
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(starts_of_runs(doc))
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


def grams(tokens: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n consecutive tokens in a text, their texts and first token indexes; a shorter text gives one gram of all it has."""
    size = len(tokens)
    if n == 1 or not size:
        return tokens, doc, np.arange(size)
    h = np.zeros(size, U64)
    alive = np.ones(size, bool)
    for j in range(n):
        t = np.zeros(size, U64)
        t[: size - j] = tokens[j:] if j else tokens
        same = np.zeros(size, bool)
        same[: size - j] = doc[j:] == doc[: size - j] if j else True
        h = np.where(same, mix(h * U64(31) + t + U64(j + 1)), h)
        alive &= same
    first = np.ones(size, bool)
    first[1:] = doc[1:] != doc[:-1]
    at = np.flatnonzero(alive | first)
    # a text's first token always stands: with fewer than n tokens it carries the hash of them all
    return h[at], doc[at], at


def batches(iterator, text_name: str = "text"):
    """Slices of a mapInArrow iterator, as dicts of arrays."""
    for batch in iterator:
        names = batch.schema.names
        for part in slices(list(batch.columns), names.index(text_name)):
            yield dict(zip(names, part))


def int64(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == U64 else a.astype(np.int64, copy=False))
