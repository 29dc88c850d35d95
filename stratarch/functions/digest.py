"""Record digests as columns: SHA-1 and SHA-256 are built-in expressions, BLAKE3 is a vectorised Arrow function."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALGORITHMS = ("sha1", "sha256_base16", "sha256_base32", "blake3")
SUPPORTED_PREFIXES = ("sha1", "sha-1", "sha256", "sha-256", "blake3")
#: Digests of no bytes at all, in every algorithm.
EMPTY_DIGESTS = (
    "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ",
    "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    "sha256:4OYMIQUY7QOBJGX36TEJS35ZEQT24QPEMSNZGTFESWMRW6CSXBKQ====",
    "blake3:af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
)
_SPARK32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base32_of_hex(hex_digits: Column, length: int) -> Column:
    """RFC 4648 Base32 of `length` hex digits: groups of 10 digits are 8 symbols; a rest of 4 digits gives 4 and padding."""
    groups = [F.lpad(F.conv(F.substring(hex_digits, at, 10), 16, 32), 8, "0") for at in range(1, length - 8, 10)]
    if length % 10 == 4:
        rest = F.concat(F.substring(hex_digits, length - 3, 4), F.lit("0"))
        groups += [F.lpad(F.conv(rest, 16, 32), 4, "0"), F.lit("====")]
    return F.translate(F.concat(*groups), _SPARK32, _RFC32)


def sha1(content: Column | str) -> Column:
    """`sha1:` and Base32 in upper case."""
    return F.concat(F.lit("sha1:"), base32_of_hex(F.sha1(_col(content).cast("binary")), 40))


def sha256_base16(content: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_col(content).cast("binary"), 256))


def sha256_base32(content: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), base32_of_hex(F.sha2(_col(content).cast("binary"), 256), 64))


_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
_ORDER = np.array([2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8])
_QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_CHUNK, _BLOCK = 1024, 64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(chain: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The chaining values (n x 8) after one block (n x 16 words) each, for n independent inputs at a time."""
    n = len(chain)
    v = np.empty((16, n), np.uint32)
    v[:8], v[8:12] = chain.T, _IV[:4, None]
    v[12], v[13] = counter & 0xFFFFFFFF, counter >> 32
    v[14], v[15] = length, flags
    m = block.T.copy()
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(_QUARTERS):
            for word, (x, y) in ((m[2 * k], (16, 12)), (m[2 * k + 1], (8, 7))):
                v[a] += v[b] + word
                v[d] = _turn(v[d] ^ v[a], x)
                v[c] += v[d]
                v[b] = _turn(v[b] ^ v[c], y)
        m = m[_ORDER]
    return (v[:8] ^ v[8:]).T


def blake3_many(messages: list[bytes]) -> list[str]:
    """Hex BLAKE3 digests; chunks of all messages advance together, block by block, then pair up level by level."""
    if not messages:
        return []
    chunks = [max(1, -(-len(x) // _CHUNK)) for x in messages]
    first = np.append(0, np.cumsum(chunks))
    total = int(first[-1])
    data = np.zeros((total, _CHUNK), np.uint8)
    size = np.full(total, _CHUNK, np.int64)
    for x, a, b in zip(messages, first, first[1:]):
        flat = data[a:b].reshape(-1)
        flat[: len(x)] = np.frombuffer(x, np.uint8)
        size[b - 1] = len(x) - (b - a - 1) * _CHUNK
    words = data.view("<u4").reshape(total, _CHUNK // _BLOCK, 16).astype(np.uint32)
    blocks = np.maximum(1, -(-size // _BLOCK))
    counter = np.arange(total, dtype=np.uint64) - np.repeat(first[:-1], chunks).astype(np.uint64)
    alone = np.repeat(np.array(chunks) == 1, chunks)
    chain = np.tile(_IV, (total, 1))
    for k in range(int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        last = blocks[on] == k + 1
        flags = np.where(last, _END | np.where(alone[on], _ROOT, 0), 0) | (_START if k == 0 else 0)
        length = np.where(last, size[on] - k * _BLOCK, _BLOCK)
        chain[on] = _compress(chain[on], words[on, k], counter[on], length.astype(np.uint32), flags.astype(np.uint32))
    owner = np.repeat(np.arange(len(messages)), chunks)
    while len(owner) > len(messages):
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        count = np.bincount(owner)[owner]
        left = np.flatnonzero((rank % 2 == 0) & (rank + 1 < count))
        flags = np.where(count[left] == 2, _PARENT | _ROOT, _PARENT).astype(np.uint32)
        n = len(left)
        chain[left] = _compress(
            np.tile(_IV, (n, 1)), np.concatenate([chain[left], chain[left + 1]], 1), np.zeros(n, np.uint64), np.full(n, _BLOCK, np.uint32), flags)
        stays = rank % 2 == 0
        chain, owner = chain[stays], owner[stays]
    return [row.astype("<u4").tobytes().hex() for row in chain]


@F.arrow_udf(T.StringType())
def _blake3(content: pa.Array) -> pa.Array:
    out: list[str | None] = [None] * len(content)
    held: list[int] = []
    size = 0
    for k in range(len(content) + 1):
        if k == len(content) or size > 8 << 20:
            for at, value in zip(held, blake3_many([content[i].as_py() for i in held])):
                out[at] = "blake3:" + value
            held, size = [], 0
        if k < len(content) and content[k].is_valid:
            held.append(k)
            size += _CHUNK + len(content[k].as_buffer())
    return pa.array(out, pa.string())


def blake3(content: Column | str) -> Column:
    return _blake3(_col(content).cast("binary"))


def digest(content: Column | str, algorithm: str = "sha1") -> Column:
    """Digest with its prefix; null for null."""
    made = {"sha1": sha1, "sha256_base16": sha256_base16, "sha256_base32": sha256_base32, "blake3": blake3}
    if algorithm not in made:
        raise ValueError(f"unknown digest algorithm {algorithm!r}; known: {', '.join(ALGORITHMS)}")
    return made[algorithm](content)


def digest_prefix(declared: Column | str) -> Column:
    return F.substring_index(_col(declared), ":", 1)


def digest_value(declared: Column | str) -> Column:
    """A digest without its prefix."""
    return F.substring_index(_col(declared), ":", -1)


def is_digest_supported(prefix: Column | str) -> Column:
    return F.coalesce(_col(prefix).isin(*SUPPORTED_PREFIXES), F.lit(False))


def algorithm_of_prefix(prefix: Column | str) -> Column:
    """Name of the algorithm that a declared digest's prefix stands for; null if unsupported."""
    p = _col(prefix)
    return F.when(p.isin("sha1", "sha-1"), "sha1").when(p.isin("sha256", "sha-256"), "sha256_base16").when(p == "blake3", "blake3")


def is_empty_payload(declared: Column | str) -> Column:
    return F.coalesce(_col(declared).isin(*EMPTY_DIGESTS), F.lit(False))


def digest_matches(content: Column | str, declared: Column | str, strict: bool = False, blake: bool = True) -> Column:
    """Whether a declared digest is that of the content; null for an unsupported prefix.

    `strict` compares with the one canonical string of each prefix: Base32 for SHA-1, Base16 for SHA-256, prefixes
    without hyphen. Otherwise hyphenated prefixes and SHA-256 in Base32 count too. With `blake` off, BLAKE3
    digests count as unsupported and no Python runs.
    """
    d, p, v = _col(declared), digest_prefix(declared), digest_value(declared)
    if strict:
        known = F.when(p.isin("sha1", "sha-1"), d == sha1(content)).when(p.isin("sha256", "sha-256"), d == sha256_base16(content))
    else:
        short = F.when(F.length(v) == 64, F.lower(v) == digest_value(sha256_base16(content))).otherwise(v == digest_value(sha256_base32(content)))
        ones = F.when(F.length(v) == 40, F.lower(v) == F.sha1(_col(content).cast("binary"))).otherwise(v == digest_value(sha1(content)))
        known = F.when(p.isin("sha1", "sha-1"), ones).when(p.isin("sha256", "sha-256"), short)
    if blake:
        # the function runs for every row that reaches it, so rows of other algorithms send it no bytes
        only = F.when(p == "blake3", _col(content).cast("binary"))
        known = known.when(p == "blake3", d == blake3(only))
    return known
