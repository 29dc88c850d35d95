"""BPE encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import base64
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh
from .textbatch import U64, TextBatch, _powers, mix, slices

#: Where byte-level BPE of this kind first cuts a text; goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WINDOW = 16
#: A single space before a letter and behind a non-space: whatever stands around, a word begins here and no token
#: spans the place. Encodings on both its sides don't depend on each other.
_SAFE = re.compile(r"(?<=\S) (?=[^\W\d_])")


def boundaries(t: TextBatch, bits: int, least: int) -> list[list[int]]:
    """Chunk ends of every text (without its own end): places behind WINDOW bytes whose hash ends in `bits` zeros,
    moved on to the next character and at least `least` bytes apart. They follow the content, not the position."""
    n = len(t.buf)
    out: list[list[int]] = [[] for _ in range(t.n)]
    if n < WINDOW:
        return out
    p, q = _powers(n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((t.buf.astype(U64) + U64(1)) * p[:n], out=prefix[1:])
    rolled = mix((prefix[WINDOW:] - prefix[:-WINDOW]) * q[: n + 1 - WINDOW])
    ends = np.flatnonzero((rolled & U64((1 << bits) - 1)) == 0) + WINDOW
    doc = t.doc_of(ends - 1)
    inside = ends - WINDOW >= t.offsets[doc]
    last = [0] * t.n
    for end, d in zip(ends[inside].tolist(), doc[inside].tolist()):
        a, b = int(t.offsets[d]), int(t.offsets[d + 1])
        while end < b and (t.buf[end] & 0xC0) == 0x80:
            end += 1
        if end < b and end - (last[d] or a) >= least:
            out[d].append(end)
            last[d] = end
    return out


class Chunk:
    """A chunk's text up to its first safe place, the tokens from there to its last one, and the rest."""

    __slots__ = ("head", "core", "tail")

    def __init__(self, text: str, encode):
        first = _SAFE.search(text)
        if first is None:
            self.head, self.core, self.tail = text, None, ""
            return
        a = b = first.start()
        at = len(text)
        while at > a:
            at = text.rfind(" ", a, at)
            if _SAFE.match(text, at):
                b = at
                break
        self.head, self.core, self.tail = text[:a], encode(text[a:b]), text[b:]


class ChunkEncoder:
    """Encodes texts chunk by chunk; a chunk met before is not encoded again.

    Cutting at chunk borders changes tokens there. At each join the text from the left chunk's last safe place to
    the right one's first is encoded anew; where a chunk has no safe place, the stretch grows over all of it. Left
    and right of that stretch the tokens are those of the whole text, so the result is exact.
    `held` bounds the memory of chunks kept; it bears on speed alone.
    """

    def __init__(self, encode, bits: int = 10, least: int = 256, held: int = 32 << 20):
        self.encode, self.bits, self.least, self.held = encode, bits, least, held
        self.known: OrderedDict[bytes, Chunk] = OrderedDict()
        self.size = self.hits = self.misses = 0

    def chunk(self, data: bytes) -> Chunk:
        c = self.known.get(data)
        if c is not None:
            self.hits += 1
            self.known.move_to_end(data)
            return c
        self.misses += 1
        c = self.known[data] = Chunk(data.decode(errors="replace"), self.encode)
        self.size += 12 * len(data)
        while self.size > self.held:
            self.size -= 12 * len(self.known.popitem(last=False)[0])
        return c

    def texts(self, t: TextBatch) -> list[list[int]]:
        data, out = t.buf.tobytes(), []
        for d, ends in enumerate(boundaries(t, self.bits, self.least)):
            a, b = int(t.offsets[d]), int(t.offsets[d + 1])
            tokens: list[int] = []
            loose: list[str] = []
            for end in (*ends, b) if b > a else ():
                c = self.chunk(data[a:end])
                loose.append(c.head)
                if c.core is not None:
                    tokens += self.encode("".join(loose))
                    tokens += c.core
                    loose = [c.tail]
                a = end
            if loose:
                tokens += self.encode("".join(loose))
            out.append(tokens)
        return out


def encoding(vocabulary: bytes, pattern: str):
    """The tokenizer, made once in a Python process."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_made", {})
    key = (hash(vocabulary), pattern)
    if key not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        kept[key] = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return kept[key]


def _anchors(bits: int, least: int):
    """Adds to each text the least hash of its chunks: copies and near copies mostly agree in it."""

    def run(it):
        for batch in it:
            for part in slices(list(batch.columns), 1):
                t = TextBatch(part[1])
                cuts = boundaries(t, bits, least)
                starts = np.array([x for d, e in enumerate(cuts) for x in (int(t.offsets[d]), *e)], np.int64)
                ends = np.array([x for d, e in enumerate(cuts) for x in (*e, int(t.offsets[d + 1]))], np.int64)
                first = np.append(0, np.cumsum([len(e) + 1 for e in cuts]))[:-1]
                anchor = np.minimum.reduceat(t.hashes(starts, ends), first)
                yield pa.RecordBatch.from_arrays([*part, pa.array(anchor.view(np.int64))], ["id", "text", "anchor"])

    return run


def _encode(vocabulary, pattern: str, bits: int, least: int):
    def run(it):
        tokenizer = encoding(vocabulary.value, pattern)
        encoder = ChunkEncoder(tokenizer.encode_ordinary, bits, least)
        for batch in it:
            for ids, texts in slices(list(batch.columns), 1):
                t = TextBatch(texts)
                if pattern == PATTERN:
                    lists = encoder.texts(t)
                else:  # where a token may end is known for the built-in pattern only
                    lists = [tokenizer.encode_ordinary(x or "") for x in texts.to_pylist()]
                data = t.buf.tobytes()
                same = [tokenizer.decode_bytes(x) == data[a:b] for x, a, b in zip(lists, t.offsets.tolist(), t.offsets[1:].tolist())]
                size = np.array([len(x) for x in lists], np.int64)
                flat = np.concatenate([np.array(x, np.int32) for x in lists])
                offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32), mask=np.append(np.asarray(texts.is_null()), False))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(size), pa.array(same, mask=np.asarray(texts.is_null()))], ["doc_id", "tokens", "n_tokens", "exact"])

    return run


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, bits: int = 10, least: int = 256,
) -> DataFrame:
    """BPE tokens of every document, equal to those of encoding its text in one go.

    Result: (doc_id, tokens, n_tokens, exact), one row for every row of docs; `exact` says that decoding gives the
    text back. A null text has null tokens and null exact, and n_tokens 0; an empty one has an empty list. Ids
    may be null. Bytes that are no UTF-8 count as U+FFFD, and `exact` is false. Strings of special tokens are ordinary text. Long texts are encoded whole; an empty table gives
    no rows.

    Documents meet by their least chunk hash (one shuffle), so shared chunks come to one task, where each is encoded
    once. With another `pattern` than the built-in one texts are encoded whole. `vocabulary` is read on the driver and sent to executors, which need no file of it.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    placed = rows.mapInArrow(_anchors(bits, least), f"id {id_type}, text string, anchor long")
    # rebalancing keeps equal anchors together but splits what is too much for one task
    placed = spark.sql("SELECT /*+ REBALANCE(anchor) */ * FROM {placed}", placed=placed).select("id", "text")
    return placed.mapInArrow(_encode(sent, pattern, bits, least), f"doc_id {id_type}, tokens array<int>, n_tokens long, exact boolean")


def decode_tokens(df: DataFrame, tokens_col: str = "tokens", vocabulary: str = VOCABULARY, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """df with the decoded text as a new column (`text_col`, given underscores if taken). Null tokens give null; ids
    outside the vocabulary are an error; bytes that are no UTF-8 are replaced by U+FFFD."""
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("string")
    def decode(col: pa.Array) -> pa.Array:
        tokenizer = encoding(sent.value, pattern)
        return pa.array([None if x is None else tokenizer.decode(x, errors="replace") for x in col.to_pylist()], pa.string())

    return df.withColumn(fresh(df, text_col), decode(F.col(f"`{tokens_col}`")))
