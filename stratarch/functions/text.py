"""Small text functions: header maps, file names, times, URLs, sizes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NAME, MAX_NAME_WITH_HASH = 255, 247


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def header_get(headers: Column | str, name: str) -> Column:
    """Value of a header whatever the case of its name; null if missing. Of several spellings the last counts."""
    found = F.filter(F.map_entries(_col(headers)), lambda e: F.lower(e["key"]) == name.lower())
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])


def header_del(headers: Column | str, name: str) -> Column:
    return F.map_filter(_col(headers), lambda k, v: F.lower(k) != name.lower())


def header_set(headers: Column | str, name: str, value: Column | str) -> Column:
    """The map with one more entry; the exact spelling is replaced, others stay."""
    v = F.lit(value) if isinstance(value, str) else value
    return F.map_concat(F.map_filter(_col(headers), lambda k, _: k != name), F.create_map(F.lit(name), v))


def header_lines(headers: Column | str) -> Column:
    """Serialised header lines in order of name."""
    entries = F.array_sort(F.map_entries(_col(headers)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n"))), "")


def split_key_value(line: Column | str) -> Column:
    """(key, value) cut at the first colon, the value trimmed; null without a colon or key."""
    c = _col(line)
    at = F.instr(c, ":")
    return F.when(at > 1, F.struct(F.substring(c, F.lit(1), at - 1).alias("key"), F.trim(F.substring(c, at + 1, F.length(c))).alias("value")))


def format_bytes(n: Column | str) -> Column:
    """Bytes for people: plain below 1,024, else one decimal in steps of 1,024."""
    c = _col(n)
    units = "KMGTPE"
    out = F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units, 1):
        # halves round to even, as binary floating point is printed elsewhere
        shown = F.format_string(f"%.1f {unit}B", F.bround(c / F.lit(float(1024**k)), 1))
        out = out.otherwise(shown) if k == len(units) else out.when(c < F.lit(1024 ** (k + 1)), shown)
    return out


def format_serial(n: Column | str) -> Column:
    """Five digits, zeros in front."""
    c = _col(n).cast("string")
    return F.when(F.length(c) >= 5, c).otherwise(F.lpad(c, 5, "0"))


def next_serial(n: Column | str) -> Column:
    """Serial number of the n-th file (from 1): after 99999 comes 1 again."""
    return F.pmod(_col(n) - 1, F.lit(99999)) + 1


def archive_name(prefix: str, at: Column, serial: Column, host: str, compression: str = "gzip", open_: bool = True) -> Column:
    """prefix-<17 digits of UTC time>-<serial>-<host>.warc with the codec's suffix, and .open while it is written."""
    tail = {"gzip": ".gz", "zstd": ".zst", "none": ""}[compression] + (".open" if open_ else "")
    return F.concat(F.lit(f"{prefix}-"), F.date_format(at, "yyyyMMddHHmmssSSS"), F.lit("-"), format_serial(serial), F.lit(f"-{host}.warc{tail}"))


def size_exceeded(n: Column | str, limit_mb: float) -> Column:
    """Whole MiB reach the limit."""
    return F.floor(_col(n) / F.lit(1 << 20)) >= F.lit(float(limit_mb))


def parse_ts14(c: Column | str) -> Column:
    """Index timestamps of 14 digits; null if they aren't a time."""
    return F.try_to_timestamp(_col(c), F.lit("yyyyMMddHHmmss"))


def format_ts14(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyyMMddHHmmss")


def parse_date(c: Column | str) -> Column:
    """RFC 3339 times, to the microsecond; null if they aren't one."""
    return F.try_to_timestamp(_col(c))


def format_date(c: Column | str) -> Column:
    """RFC 3339 in UTC without trailing zeros of the second's fraction."""
    return F.concat(F.regexp_replace(F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_host(url: Column | str) -> Column:
    """Host with its port, without user information."""
    return F.substring_index(F.regexp_extract(_col(url), _AUTHORITY, 1), "@", -1)


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[^?#]*\?([^#]*)", 1)


def url_fragment(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"#(.*)$", 1)


def host_name(host: Column | str) -> Column:
    """Host without port."""
    return F.regexp_replace(_col(host), r":\d+$", "")


def extension(name: Column | str) -> Column:
    """From the last dot on; empty without one."""
    return F.regexp_extract(_col(name), r"(\.[^./]*)$", 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fit(name: Column, most: int) -> Column:
    return F.when(F.octet_length(name) > most, F.concat(F.substring(name, F.lit(1), F.lit(most) - F.length(extension(name))), extension(name))).otherwise(name)


def output_name(uri: Column | str, disposition: Column | str) -> Column:
    """File name of an extracted payload.

    The last part of the URI, query and fragment included; a `filename` in Content-Disposition comes before it; a
    disposition that can't be parsed adds `.pdf`. Names are cut to 255, their extension kept; slashes become
    underscores.
    """
    u, d = F.coalesce(_col(uri), F.lit("")), F.coalesce(_col(disposition), F.lit(""))
    base = F.coalesce(F.nullif(F.regexp_extract(u, "([^/]+)/*$", 1), F.lit("")), F.when(u == "", ".").otherwise("/"))
    token = r"[!#$%&'*+.^_`|~0-9A-Za-z\-]+"
    grammar = rf"^\s*{token}\s*(;\s*{token}\s*=\s*(\"[^\"]*\"|{token})\s*)*;?\s*$"
    filename = r"(?i);\s*filename\s*=\s*(?:\"([^\"]*)\"|([^\";\s]+))"

    def named(x: Column) -> Column:
        given = F.nullif(F.concat(F.regexp_extract(x, filename, 1), F.regexp_extract(x, filename, 2)), F.lit(""))
        broken = (x != "") & ~x.rlike(grammar)
        return _let(base, lambda b: F.when(broken, F.when(b.endswith(".pdf"), b).otherwise(F.concat(b, F.lit(".pdf")))).otherwise(F.coalesce(given, b)))

    return F.replace(_let(_let(d, named), lambda n: _fit(n, MAX_NAME)), F.lit("/"), F.lit("_"))


def hashed_name(name: Column | str, payload_digest: Column | str) -> Column:
    """The name with the digest's tail in brackets before its extension; long names are cut to 247 first."""
    n, tail = _col(name), F.substring(_col(payload_digest), 27, 1000)
    ext = extension(n)
    stem_length = F.when(F.octet_length(n) > MAX_NAME_WITH_HASH, F.lit(MAX_NAME_WITH_HASH)).otherwise(F.length(n)) - F.length(ext)
    return F.concat(F.substring(n, F.lit(1), stem_length), F.lit("["), tail, F.lit("]"), ext)


def escapes_folder(relative: Column | str) -> Column:
    """Whether a relative path leaves its folder: at some step it has gone up more often than down."""
    steps = F.filter(F.split(_col(relative), "/"), lambda s: (s != "") & (s != "."))
    walk = F.aggregate(
        steps, F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out")),
        lambda s, x: F.struct((s["depth"] + F.when(x == "..", -1).otherwise(1)).alias("depth"), (s["out"] | ((x == "..") & (s["depth"] <= 0))).alias("out")),
        lambda s: s["out"])
    return walk | F.startswith(_col(relative), F.lit("/"))


def is_gzip(content: Column | str) -> Column:
    return F.coalesce(F.substring(_col(content).cast("binary"), 1, 2) == F.lit(b"\x1f\x8b"), F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
