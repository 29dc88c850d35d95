"""Known answers of the column functions, and vectorised BLAKE3 against a direct implementation."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from stratarch.functions import digest as dg
from stratarch.functions import http, text


def one(spark, column, **values):
    row = [bytearray(v) if isinstance(v, bytes) else v for v in values.values()]
    kinds = {bytes: "binary", str: "string", int: "long", float: "double", dict: "map<string,string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(row)], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("data, algorithm, expected", [
    (b"hello world", "sha1", "sha1:FKXGYNOJJ7H3IFO35FPUBC445EPOQRXN"),
    (b"", "sha1", "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"),
    (b"hello world", "sha256_base32", "sha256:XFGSPOMTJU7ARJJOKLL5U7NL7LCIJ37DPJJYB3UQRD32ZYXPZXUQ===="),
    (b"hello world", "sha256_base16", "sha256:b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"),
    (b"hello world", "blake3", "blake3:d74981efa70a0c880b8d8c1985d075dbcbf679b99a5f9914e5aaf96b831a9e24"),
    (b"", "blake3", "blake3:af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"),
])
def test_digests(spark, data, algorithm, expected):
    assert one(spark, dg.digest("c", algorithm), c=data) == expected


def test_base32_of_random_bytes(spark):
    rng = random.Random(1)
    data = [rng.randbytes(n) for n in range(40)]
    df = spark.createDataFrame([(bytearray(x),) for x in data], "c binary").select("c", dg.sha1("c").alias("a"), dg.sha256_base32("c").alias("b"))
    for r in df.collect():
        assert r.a == "sha1:" + base64.b32encode(hashlib.sha1(r.c).digest()).decode()
        assert r.b == "sha256:" + base64.b32encode(hashlib.sha256(r.c).digest()).decode()


def blake3_direct(data):
    """The specification's tree, one block at a time in plain integers."""
    iv = [0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19]
    order = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
    turn = lambda x, n: ((x >> n) | (x << (32 - n))) & 0xFFFFFFFF

    def compress(chain, m, counter, length, flags):
        v = [*chain, *iv[:4], counter & 0xFFFFFFFF, counter >> 32, length, flags]
        for _ in range(7):
            for k, (a, b, c, d) in enumerate([(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]):
                for w, x, y in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                    v[a] = (v[a] + v[b] + w) & 0xFFFFFFFF
                    v[d] = turn(v[d] ^ v[a], x)
                    v[c] = (v[c] + v[d]) & 0xFFFFFFFF
                    v[b] = turn(v[b] ^ v[c], y)
            m = [m[i] for i in order]
        return [v[i] ^ v[i + 8] for i in range(8)]

    def words(block):
        block = block.ljust(64, b"\0")
        return [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]

    def node(chunk, n, root):
        if n > 1:
            left = 1 << (n - 1).bit_length() - 1
            a, b = node(chunk, left, False), node(chunk + left, n - left, False)
            return compress(iv, a + b, 0, 64, 4 | (8 if root else 0))
        part, chain = data[chunk * 1024 : (chunk + 1) * 1024], iv
        blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        for k, b in enumerate(blocks):
            last = k == len(blocks) - 1
            chain = compress(chain, words(b), chunk, len(b), (1 if k == 0 else 0) | (2 | (8 if root else 0) if last else 0))
        return chain

    return b"".join(w.to_bytes(4, "little") for w in node(0, max(1, -(-len(data) // 1024)), True)).hex()


def test_blake3_trees():
    rng = random.Random(2)
    data = [rng.randbytes(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 3000, 5 * 1024, 7 * 1024 + 1, 16 * 1024, 17 * 1024)]
    assert dg.blake3_many(data) == [blake3_direct(x) for x in data]


def test_digest_policies(spark):
    plain, hyphen, b32 = "sha1:FKXGYNOJJ7H3IFO35FPUBC445EPOQRXN", "sha-1:FKXGYNOJJ7H3IFO35FPUBC445EPOQRXN", "sha256:XFGSPOMTJU7ARJJOKLL5U7NL7LCIJ37DPJJYB3UQRD32ZYXPZXUQ===="
    for declared, strict, lenient in ((plain, True, True), (hyphen, False, True), (b32, False, True), ("sha1:X", False, False)):
        assert one(spark, dg.digest_matches("c", "d", True), c=b"hello world", d=declared) is strict
        assert one(spark, dg.digest_matches("c", "d"), c=b"hello world", d=declared) is lenient
    assert one(spark, dg.digest_matches("c", "d"), c=b"x", d="md5:abc") is None


@pytest.mark.parametrize("block, end", [
    (b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nBody starts here", 45), (b"GET / HTTP/1.1\r\nHost: test\r\n\r\n", 30),
    (b"GET / HTTP/1.1\r\nHost: test\r\n\r\nbody", 30), (b"Header: value\r\n\r\n", 17), (b"Header: value\n\n", None), (b"none", None), (b"a\r\r\n\r\n", 6),
])
def test_header_end(spark, block, end):
    assert one(spark, http.header_end("c"), c=block) == end


@pytest.mark.parametrize("scheme, block, uri", [
    ("http", b"GET /index.html HTTP/1.0\r\nHost: example.com\r\n\r\n", "http://example.com/index.html"), ("https", b"GET / HTTP/1.1\r\nHost: foo.com\r\n\r\n", "https://foo.com/"),
    ("http", b"GET http://a.b/c HTTP/1.1\r\nHost: foo.com\r\n\r\n", "http://a.b/c"), ("https", b"GET / HTTP/1.1\r\n\r\n", None), ("https", b"Host: x\r\n\r\n", None),
])
def test_request_target_uri(spark, scheme, block, uri):
    assert one(spark, http.request_target_uri("s", "c"), s=scheme, c=block) == uri


def test_http_bodies(spark):
    body = b"some text " * 50
    chunked = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\n"
    cases = [
        (head + b"\r\n" + body, body), (head + b"Content-Length: 4\r\n\r\n" + body, b"some"), (head + b"Content-Length: 9999\r\n\r\nshort", None),
        (head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked, b"hello world"), (head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked[:-9], None),
        (b"HTTP/1.1 204 No\r\n\r\nxx", b""), (head + b"Content-Encoding: gzip\r\n\r\n" + gzip.compress(body), body), (head + b"Content-Encoding: deflate\r\n\r\n" + zlib.compress(body), body),
        (head + b"Content-Encoding: zstd\r\n\r\n" + zstandard.ZstdCompressor().compress(body), body), (head + b"Content-Encoding: gzip\r\n\r\nnot", None), (b"junk", None),
    ]
    df = spark.createDataFrame([(k, bytearray(b)) for k, (b, _) in enumerate(cases)], "k int, c binary")
    got = {r.k: r.p for r in http.with_payload(df, "c", "p", decode=True).collect()}
    for k, (_, want) in enumerate(cases):
        assert (None if got[k] is None else bytes(got[k])) == want, k


def test_headers(spark):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html \r\nX-A: 1:2\r\nx-a: later\r\nnocolon\r\n\r\n"
    assert one(spark, http.http_headers("c"), c=block) == {"content-type": "text/html", "x-a": "1:2"}
    assert one(spark, http.status_code("c"), c=block) == 200
    m = {"WARC-Type": "response", "warc-type": "last"}
    assert one(spark, text.header_get("m", "WARC-TYPE"), m=m) in ("last", "response")
    assert one(spark, text.header_del("m", "Warc-Type"), m=m) == {}
    assert tuple(one(spark, text.split_key_value("s"), s="Key:  v:w ")) == ("Key", "v:w")
    assert one(spark, text.split_key_value("s"), s=":v") is None


@pytest.mark.parametrize("n, shown", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (int(1.5 * 1024**4), "1.5 TB"), (617728, "603.2 KB")])
def test_format_bytes(spark, n, shown):
    assert one(spark, text.format_bytes("n"), n=n) == shown


@pytest.mark.parametrize("uri, disposition, name", [
    ("http://a/b/c.html?x=1", "", "c.html?x=1"), ("http://a/b/", "", "b"), ("http://a", 'attachment; filename="x/y.txt"', "x_y.txt"), ("http://a/f", "attachment; filename=z.bin", "z.bin"),
    ("http://a/f", "attachment; ;;=", "f.pdf"), ("http://a/f.pdf", "attachment; ;;=", "f.pdf"), ("", "", "."), ("http://a/" + "n" * 300 + ".txt", "", "n" * 251 + ".txt"),
])
def test_output_name(spark, uri, disposition, name):
    assert one(spark, text.output_name("u", "d"), u=uri, d=disposition) == name


def test_small_text_functions(spark):
    assert one(spark, text.hashed_name("n", "d"), n="a.html", d="sha1:FKXGYNOJJ7H3IFO35FPUBC445EPOQRXN") == "a[C445EPOQRXN].html"
    assert [one(spark, text.escapes_folder("p"), p=p) for p in ("a/../b", "../x", "a/../../b", "/x", "..")] == [False, True, True, True, True]
    assert one(spark, text.next_serial("n"), n=100_000) == 1 and one(spark, text.format_serial("n"), n=6) == "00006"
    assert [one(spark, text.size_exceeded("n", 2.0), n=n) for n in (1 << 20, 3 << 20)] == [False, True]
    assert one(spark, F.unix_timestamp(text.parse_ts14("s")), s="20220320002518") == 1647735918 and one(spark, text.parse_ts14("s"), s="nope") is None
    assert one(spark, text.format_date(F.timestamp_micros("n")), n=1_500_000) == "1970-01-01T00:00:01.5Z"
    assert one(spark, http.is_http_request("s"), s="GET / HTTP/1.1") and not one(spark, http.is_http_request("s"), s="GETS / HTTP/1.1")
    assert one(spark, text.url_host("u"), u="http://me@h:80/p?q#f") == "h:80"
