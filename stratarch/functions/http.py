"""HTTP messages inside record blocks, as column expressions; only transfer and content decoding needs Python."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METHODS = ("GET", "HEAD", "POST", "PUT", "DELETE", "CONNECT", "OPTIONS", "TRACE", "PATCH")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _latin(block: Column | str) -> Column:
    """Bytes as characters, one for one, so that positions in text are positions in bytes."""
    return F.decode(_col(block).cast("binary"), "ISO-8859-1")


def header_end(block: Column | str) -> Column:
    """Offset of the first byte behind the blank line that ends the header block; null if there is none."""
    at = F.instr(_latin(block), "\r\n\r\n")
    return F.when(at > 0, at + 3)


def header_block(block: Column | str) -> Column:
    return F.substring(_col(block).cast("binary"), F.lit(1), header_end(block))


def raw_payload(block: Column | str) -> Column:
    """Bytes behind the header block; null without one."""
    b = _col(block).cast("binary")
    return F.substring(b, header_end(block) + 1, F.octet_length(b))


def _head_text(block: Column | str) -> Column:
    text = _latin(block)
    return F.when(F.instr(text, "\r\n\r\n") > 0, F.substring_index(text, "\r\n\r\n", 1))


def first_line(block: Column | str) -> Column:
    return F.substring_index(_latin(block), "\r\n", 1)


def is_http_request(line: Column | str) -> Column:
    """A request line: a known method and a space in front, HTTP/1.0 or HTTP/1.1 at the end."""
    return _col(line).rlike(r"(?s)^(" + "|".join(METHODS) + r") .*HTTP/1\.[01]\z")


def status_code(block: Column | str) -> Column:
    return F.regexp_extract(first_line(block), r"^HTTP/\d\.\d (\d{3})", 1).try_cast("int")


def http_headers(block: Column | str) -> Column:
    """Header map with names in lower case and trimmed values; of repeated names the first counts. Null unless a header block is found."""
    lines = F.split(_head_text(block), "\r\n")
    lines = F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(0)))
    named = F.filter(lines, lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(named, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]))


def _header_of(head: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(head, r"(?i)\r\n" + name.replace("-", r"\-") + r":([^\r\n]*)", 1)), F.lit(""))


def http_header(block: Column | str, name: str) -> Column:
    """One header's first value, without building the map."""
    return _header_of(_head_text(block), name)


def http_content_type(block: Column | str) -> Column:
    return F.coalesce(http_header(block, "Content-Type"), F.lit(""))


def has_crawler_encoding(block: Column | str) -> Column:
    """Blocks that a crawler has stored decoded, under renamed headers; their payload digests can't be checked."""
    return F.coalesce(_head_text(block).rlike(r"(?i)\r\nX-Crawler-(Transfer|Content)-Encoding:"), F.lit(False))


def request_target_uri(scheme: Column | str, block: Column | str) -> Column:
    """Absolute URI of a captured request; null without a request line or Host header. An absolute target stays."""
    line, host = first_line(block), http_header(block, "Host")
    target = F.regexp_extract(line, r"^\S+ (\S+) HTTP/1\.[01]$", 1)
    absolute = target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    full = F.when(absolute, target).otherwise(F.concat(_col(scheme), F.lit("://"), host, target))
    return F.when(is_http_request(line) & host.isNotNull() & (target != ""), full)


def dechunk(data: bytes) -> bytes | None:
    """A body without its chunked transfer coding; None where it is damaged or cut off."""
    out, at = [], 0
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            return None
        try:
            size = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 1
        if size == 0:
            return b"".join(out)
        if size < 0 or at + size > len(data):
            return None
        out.append(data[at : at + size])
        at += size
        if data[at : at + 2] == b"\r\n":
            at += 2
        elif data[at : at + 1] == b"\n":
            at += 1
        else:
            return None


def decoded(data: bytes, coding: str) -> bytes | None:
    """A body without its content coding (gzip, deflate, zstd); other codings leave it as it is, damage gives None."""
    coding = coding.strip().lower()
    try:
        if coding in ("gzip", "x-gzip"):
            out, rest = [], data
            while rest:
                d = zlib.decompressobj(31)
                out.append(d.decompress(rest))
                if not d.eof:
                    return None
                rest = d.unused_data
            return b"".join(out)
        if coding == "deflate":
            return zlib.decompress(data)
        if coding == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    except Exception as e:
        if isinstance(e, (zlib.error, ValueError)) or type(e).__name__ == "ZstdError":
            return None
        raise
    return data


@F.arrow_udf(T.BinaryType())
def _transfer_decoded(body: pa.Array) -> pa.Array:
    return pa.array([None if x is None else dechunk(x) for x in body.to_pylist()], pa.binary())


@F.arrow_udf(T.BinaryType())
def _content_decoded(body: pa.Array, coding: pa.Array) -> pa.Array:
    return pa.array([None if x is None else decoded(x, c or "") for x, c in zip(body.to_pylist(), coding.to_pylist())], pa.binary())


def with_payload(df: DataFrame, block: str, out: str, decode: bool = False) -> DataFrame:
    """df with the body of an HTTP block as `out`: transfer coding undone, and with `decode` content coding too.

    Empty for statuses without a body; null where a message can't be read. The header block is found once and its
    parts are columns of a projection below, so that a block isn't searched again for each of them. Only chunked
    and compressed bodies travel to Python.
    """
    names = {c.lower() for c in df.columns}
    p = "__http"
    while any(n.startswith(p) for n in names):
        p += "_"
    head, raw = F.col(f"{p}_head"), F.col(f"{p}_raw")
    df = df.withColumn(f"{p}_head", _head_text(block))
    body = F.col(block).cast("binary")
    df = df.withColumns({
        f"{p}_raw": F.substring(body, F.length(head) + 5, F.octet_length(body)),
        f"{p}_none": F.regexp_extract(F.substring_index(head, "\r\n", 1), r"^HTTP/\d\.\d (\d{3})", 1).rlike("^(1..|204|304)$"),
        f"{p}_chunked": F.lower(F.coalesce(_header_of(head, "Transfer-Encoding"), F.lit(""))).contains("chunked"),
        f"{p}_size": F.nullif(F.regexp_extract(F.coalesce(_header_of(head, "Content-Length"), F.lit("")), r"^\d{1,18}$", 0), F.lit("")).cast("long"),
        f"{p}_coding": F.lower(F.coalesce(_header_of(head, "Content-Encoding"), F.lit(""))),
    })
    none, chunked, size = F.col(f"{p}_none"), F.col(f"{p}_chunked"), F.col(f"{p}_size")
    whole = F.when(size.isNull(), raw).when(F.octet_length(raw) >= size, F.substring(raw, F.lit(1), size.cast("int")))
    plain = F.when(none, F.lit(b"")).when(~chunked, whole)
    df = df.withColumn(out, F.coalesce(plain, _transfer_decoded(F.when(chunked & ~none, raw))))
    if decode:
        packed = F.col(f"{p}_coding").isin("gzip", "x-gzip", "deflate", "zstd")
        df = df.withColumn(out, F.when(packed, _content_decoded(F.when(packed, F.col(out)), F.col(f"{p}_coding"))).otherwise(F.col(out)))
    return df.drop(*(f"{p}_{n}" for n in ("head", "raw", "none", "chunked", "size", "coding")))


def is_response_record(warc_type: Column | str, content_type: Column | str) -> Column:
    """Records that hold an HTTP response of their own: no revisits, and a record type that names a response message."""
    return (F.coalesce(_col(warc_type), F.lit("")) != "revisit") & F.coalesce(_col(content_type), F.lit("")).contains("msgtype=response")


def content_type_matches(content_type: Column | str, wanted: list[str] | None) -> Column:
    """Contains any of the wanted strings; all do if none is named."""
    c = F.coalesce(_col(content_type), F.lit(""))
    out = F.lit(not wanted)
    for w in wanted or []:
        out = out | c.contains(w)
    return out
