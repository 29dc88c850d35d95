"""Archive bytes to records: codec sniffing, compressed members and record framing. No Spark in here."""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import zstandard

DICTIONARY_MAGIC = 0x184D2A5D
READ_BYTES = 1 << 18
_LEAST_SOURCE = 6
_LEAST_MEMBER = 18


class ArchiveError(Exception):
    """A file that can't be read on."""


def sniff(head: bytes) -> str:
    """Codec by the first bytes: empty (too short for any), gzip, bzip2, xz, zstd, zstd_dictionary or none."""
    if len(head) < _LEAST_SOURCE:
        return "empty"
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:2] == b"BZ":
        return "bzip2"
    if head[:6] == b"\xfd7zXZ\x00":
        return "xz"
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    if 0x50 <= head[0] <= 0x5F and head[1:4] == b"\x2a\x4d\x18":
        return "zstd_dictionary"
    return "none"


@dataclass
class Record:
    index: int
    version: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    content: bytes | None = None
    content_length: int | None = None
    offset: int = -1
    size: int = -1
    error: str | None = None

    def header(self, name: str) -> str | None:
        """A header's value whatever its case; of several spellings the last in the file."""
        found = None
        for k, v in self.headers.items():
            if k.lower() == name:
                found = v
        return found


class _Bytes:
    """Decoded bytes from `pull`, which gives b"" at the end."""

    def __init__(self, pull: Callable[[], bytes]):
        self._pull, self._held, self._at = pull, b"", 0

    def _more(self) -> bool:
        data = self._pull()
        self._held = self._held[self._at :] + data
        self._at = 0
        return bool(data)

    def line(self) -> tuple[bytes, bool]:
        """Bytes up to the next CRLF, and whether it was there."""
        look = self._at
        while True:
            end = self._held.find(b"\r\n", look)
            if end >= 0:
                out = self._held[self._at : end]
                self._at = end + 2
                return out, True
            behind = max(0, len(self._held) - self._at - 1)
            if not self._more():
                out = self._held[self._at :]
                self._at = len(self._held)
                return out, False
            look = behind

    def take(self, n: int, keep: bool, most: int | None) -> tuple[bytes | None, int]:
        """The next n bytes (kept up to `most` of them, or not at all), and how many there were."""
        parts, left, kept = [], n, 0
        while left:
            if self._at == len(self._held) and not self._more():
                break
            size = min(left, len(self._held) - self._at)
            if keep and (most is None or kept < most):
                part = self._held[self._at : self._at + (size if most is None else min(size, most - kept))]
                parts.append(part)
                kept += len(part)
            self._at += size
            left -= size
        return (b"".join(parts) if keep else None), n - left

    def drain(self) -> int:
        n = len(self._held) - self._at
        self._held, self._at = b"", 0
        while data := self._pull():
            n += len(data)
        return n


class _Members:
    """The members of a gzip file one by one, with exact compressed positions."""

    def __init__(self, raw, at: int):
        self.raw, self.at, self.held, self.inflate = raw, at, b"", None

    def open(self) -> bool:
        """Start the member at `at`; False at the end of the file."""
        if not self.held:
            self.held = self.raw.read(READ_BYTES)
        if not self.held:
            return False
        if not (self.held + (self.raw_peek() if len(self.held) < 2 else b"")).startswith(b"\x1f\x8b"):
            raise ArchiveError("gzip: invalid header")
        self.inflate = zlib.decompressobj(31)
        self.start = self.at
        return True

    def raw_peek(self) -> bytes:
        more = self.raw.read(READ_BYTES)
        self.held += more
        return more

    def pull(self) -> bytes:
        while not self.inflate.eof:
            if not self.held:
                self.held = self.raw.read(READ_BYTES)
                if not self.held:
                    raise ArchiveError("gzip: unexpected EOF")
            before = len(self.held)
            try:
                out = self.inflate.decompress(self.held, 1 << 20)
            except zlib.error as e:
                raise ArchiveError(f"gzip: {e}") from e
            self.held = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.at += before - len(self.held)
            if out:
                return out
        return b""


def _stream(raw, codec: str) -> Callable[[], bytes]:
    """pull() over the whole decoded stream of a codec without members of its own."""
    if codec == "none":
        return lambda: raw.read(READ_BYTES)
    if codec == "bzip2":
        reader, broken = bz2.BZ2File(raw), (OSError, EOFError, ValueError)
    elif codec == "xz":
        reader, broken = lzma.LZMAFile(raw), (lzma.LZMAError, EOFError)
    else:
        reader, broken = _zstd(raw, codec), (zstandard.ZstdError,)

    def pull() -> bytes:
        try:
            return reader.read(READ_BYTES)
        except broken as e:
            raise ArchiveError(f"{codec}: {e}") from e

    return pull


def _zstd(raw, codec: str):
    dictionary = None
    if codec == "zstd_dictionary":
        head = raw.read(8)
        magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
        body = raw.read(size)
        if len(head) < 8 or len(body) < size:
            raise ArchiveError("zstd: dictionary frame is cut off")
        if magic == DICTIONARY_MAGIC:
            try:
                dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(body))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"zstd: dictionary: {e}") from e
    return zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(raw, read_across_frames=True)


Wanted = Callable[[Record], bool]


def _record(data: _Bytes, index: int, content: bool, wanted: Wanted | None, most: int | None) -> Record | None:
    """The next record; None at a clean end."""
    r = Record(index)
    version, whole = data.line()
    if not whole:
        if not version:
            return None
        raise ArchiveError("reading version: EOF")
    r.version = version.decode("utf-8", "replace")
    while True:
        line, whole = data.line()
        if not whole:
            raise ArchiveError("reading header: EOF")
        if not line:
            break
        key, colon, value = line.partition(b":")
        if colon and key:
            r.headers[key.decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    declared = r.header("content-length")
    try:
        r.content_length = int(declared) if declared is not None and declared.strip("+-").isascii() and declared.lstrip("+-").isdigit() else None
    except ValueError:
        r.content_length = None
    if r.content_length is None:
        raise ArchiveError(f"parsing Content-Length: {declared!r}")
    if r.content_length < 0:
        raise ArchiveError(f"negative Content-Length: {declared}")
    keep = content and (wanted is None or wanted(r))
    r.content, got = data.take(r.content_length, keep, most)
    if got < r.content_length:
        raise ArchiveError("copying content: EOF")
    for _ in range(2):
        line, whole = data.line()
        if not whole:
            raise ArchiveError("reading record boundary: EOF")
        if line:
            raise ArchiveError("non-empty record boundary")
    return r


def records(
    raw, content: bool = True, wanted: Wanted | None = None, most: int | None = None,
    start: int = 0, end: int | None = None, strict_members: bool = False,
) -> Iterator[Record]:
    """The records of an open binary file; a failure is a last record with `error`, never an exception.

    `wanted` sees headers before content is read; content of other records is skipped. `start` and `end` read the
    gzip members that begin in that range. Only the first record of a gzip member counts, unless
    `strict_members`, which makes a second one an error. A source of under 6 bytes is empty.
    """
    index = 0
    try:
        raw.seek(0)
        head = raw.read(_LEAST_SOURCE)
        codec = sniff(head)
        if codec == "empty":
            return
        raw.seek(start)
        if codec != "gzip":
            data = _Bytes(_stream(raw, codec))
            while (r := _record(data, index, content, wanted, most)) is not None:
                yield r
                index += 1
            return
        members = _Members(raw, start)
        while (end is None or members.at < end) and members.open():
            data = _Bytes(members.pull)
            r = _record(data, index, content, wanted, most)
            rest = data.drain()
            if r is None:
                continue  # an empty member
            if rest and strict_members:
                raise ArchiveError("more than one record in a gzip member")
            r.offset, r.size = members.start, members.at - members.start
            yield r
            index += 1
    except ArchiveError as e:
        yield Record(index, error=str(e))
    except OSError as e:
        yield Record(index, error=f"{type(e).__name__}: {e}")


def is_member(data: bytes, at: int) -> int | None:
    """Length of the gzip member at a position of a buffer; None if none is whole there."""
    if len(data) - at < _LEAST_MEMBER or data[at : at + 3] != b"\x1f\x8b\x08" or data[at + 3] & 0xE0:
        return None
    inflate = zlib.decompressobj(31)
    try:
        view = memoryview(data)[at:]
        while not inflate.eof:
            inflate.decompress(view, 1 << 20)
            if inflate.eof:
                break
            if not inflate.unconsumed_tail:
                return None
            view = inflate.unconsumed_tail
    except zlib.error:
        return None
    return len(data) - at - len(inflate.unused_data)


def gzip_members(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of every valid member, found by its magic bytes, independent of the record reader."""
    out, at = [], 0
    while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
        n = is_member(data, at)
        if n is None:
            at += 1
        else:
            out.append((at, n))
            at += n
    return out


def next_member(raw, at: int, size: int, probe: int = 1 << 16) -> int:
    """First place at or behind `at` where a gzip member begins whose first bytes decode to a record; `size` if none.

    Magic bytes also turn up inside compressed data, so a place counts only if inflating it yields a version line.
    """
    while at < size:
        raw.seek(at)
        block = raw.read(READ_BYTES)
        found = block.find(b"\x1f\x8b\x08")
        while found >= 0:
            raw.seek(at + found)
            inflate = zlib.decompressobj(31)
            try:
                if inflate.decompress(raw.read(probe), 5) == b"WARC/":
                    return at + found
            except zlib.error:
                pass
            found = block.find(b"\x1f\x8b\x08", found + 1)
        at += max(1, len(block) - 2)
        if len(block) <= 2:
            break
    return size


def frame(version: str, headers: dict[str, str], content: bytes) -> bytes:
    """A record's bytes: version, header lines in order of name, block, two empty lines."""
    head = "".join(f"{k}: {v}\r\n" for k, v in sorted(headers.items()))
    return b"".join((version.encode(), b"\r\n", head.encode(), b"\r\n", content, b"\r\n\r\n"))


class Encoder:
    """One independently readable member or frame for every record."""

    def __init__(self, compression: str, dictionary: bytes | None = None, level: int | None = None):
        if compression not in ("gzip", "zstd", "none"):
            raise ValueError(f"unknown compression {compression!r}; known: gzip, zstd, none")
        self.compression, self.level = compression, level
        self.head = b""
        if compression == "zstd":
            known = None
            if dictionary:
                known = zstandard.ZstdCompressionDict(dictionary)
                packed = zstandard.ZstdCompressor().compress(dictionary)
                self.head = struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
            self._zstd = zstandard.ZstdCompressor(
                level=7 if level is None else level, dict_data=known, write_content_size=True, write_checksum=True)

    @property
    def suffix(self) -> str:
        return {"gzip": ".gz", "zstd": ".zst", "none": ""}[self.compression]

    def encode(self, data: bytes) -> bytes:
        if self.compression == "zstd":
            return self._zstd.compress(data)
        if self.compression == "gzip":
            c = zlib.compressobj(6 if self.level is None else self.level, zlib.DEFLATED, 31)
            return c.compress(data) + c.flush()
        return data


def open_bytes(data: bytes):
    return io.BytesIO(data)
