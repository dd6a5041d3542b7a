import base64
import gzip
import hashlib
import time
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm.cover_tree import CoverTree, Search, met_share, top_inner_products
from loomgraph.llm.warc import RESPONSE, derivatives, identity, outlinks, page_parts, parsed, plain_text, read_warc, responses, serialised, unchunked


def brute(ids, points, queries, k):
    out = []
    for q in queries:
        s = sorted(((-int(points[q] @ points[j]), ids[j]) for j in range(len(ids)) if ids[j] != ids[q]))[:k]
        out += [(ids[q], r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


def test_search_equals_brute_force():
    r = np.random.default_rng(0)
    for n, d, spread in ((3, 2, 3), (300, 4, 3), (900, 8, 200), (700, 3, 1)):
        points = r.integers(-spread, spread + 1, (n, d)) + 50 * r.integers(0, 3, (n, 1))
        ids = r.permutation(n).astype(np.int64)
        q = np.arange(0, n, 7)
        s = Search(CoverTree(points[q], 8), ids[q], CoverTree(points, 8), ids, 5)
        s.run()
        got = [(int(s.query_ids[i]), j + 1, int(s.id[i, j]), int(s.score[i, j])) for i in range(len(q)) for j in range(5) if s.score[i, j] > -np.inf]
        assert sorted(got) == brute(ids.tolist(), points, q.tolist(), 5)


def test_radii_cover():
    r = np.random.default_rng(1)
    t = CoverTree(r.normal(size=(500, 5)), 16)
    todo, leaves = [t.root], 0
    while todo:
        n = todo.pop()
        assert (np.sqrt(((t.points[n.lo : n.hi] - n.centre) ** 2).sum(axis=1)) <= n.radius + 1e-9).all()
        assert not n.children or [n.lo, *[c.hi for c in n.children]] == [*[c.lo for c in n.children], n.hi]
        leaves += not n.children
        todo += n.children
    assert leaves > 5 and sorted(t.order.tolist()) == list(range(500))


def test_top_inner_products(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=6)], i) for i in range(260)] + [(300, None, 0), (301, [], 0), (302, [1.0, None] + [0.0] * 4, 0), (303, [float("nan")] * 6, 0), (304, [float("inf")] * 6, 0), (305, [1.0, 2.0], 0), (None, [1.0] * 6, 0)]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<float>, score int")
    q = F.col("vec_id") % 50 == 0
    got = sorted(tuple(x) for x in top_inner_products(df, q, vectors=64, queries=3).collect())
    points = np.floor(256 * np.asarray([x[1] for x in rows[:260]], np.float32).astype(np.float64)).astype(np.int64)
    assert got == brute(list(range(260)), points, [i for i in range(260) if i % 50 == 0], 5)
    assert top_inner_products(df.limit(0), q).count() == 0
    same = df.withColumn("embedding", F.when(F.col("vec_id") % 3 == 1, F.array(*[F.lit(1.0)] * 6)).otherwise(F.col("embedding")))  # a third of all rows alike: one cell, in blocks
    points = np.array([[256] * 6 if i % 3 == 1 else p for i, p in enumerate(points.tolist())])
    for ways in ({"vectors": 16, "queries": 2, "sample": 40}, {"vectors": 64, "sample": 3}):
        assert sorted(tuple(x) for x in top_inner_products(same, q, **ways).collect()) == brute(list(range(260)), points, [i for i in range(260) if i % 50 == 0], 5)
    two = df.where("vec_id IN (0, 1)")
    assert [tuple(x)[:3] for x in top_inner_products(two, q).collect()] == [(0, 1, 1)]


def test_cells_and_nodes_are_pruned_on_clustered_vectors(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    points = centres[r.integers(0, 40, 4000)] + 0.05 * r.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    q = F.col("vec_id") % 50 == 0
    assert met_share(df, q, vectors=100, sample=800) < 0.2
    whole = np.floor(256 * points).astype(np.int64)
    ids = np.arange(4000)
    asked = ids % 50 == 0
    s = Search(CoverTree(whole[asked], 16), ids[asked], CoverTree(whole, 16), ids, 5)
    s.run()
    assert s.scored < 0.5 * asked.sum() * 4000
    got = sorted(tuple(x) for x in top_inner_products(df, q, vectors=100, sample=800).collect())
    assert got == brute(ids.tolist(), whole, ids[asked].tolist(), 5)


class Text(HTMLParser):
    """Words of a page by another way: a parser that skips silent elements."""

    def __init__(self):
        super().__init__()
        self.silent, self.words, self.links = 0, [], []

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style", "head")
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.links.append(href)

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.silent:
            self.words += data.split()


PAGE = '<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x > y --><script>var t="</p>";</script><p>One <b>two</b></p><p>three &lt;four&gt; &#233;</p><a href="/x?a=1&amp;b=2">link</a> <a href=\'y\'>z</a></body></html>'


def test_plain_text():
    p = Text()
    p.feed(PAGE)
    assert plain_text(PAGE).split() == p.words == ["One", "two", "three", "<four>", "é", "link", "z"]
    assert plain_text("") == "" and plain_text("<script>never closed") == "" and plain_text("a < b") == "a < b"


def test_text_of_all_pages_equals_a_parser(spark):
    """Words and links of every given page, against the standard library's parser."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert len(pages) > 100
    for page in pages:
        p = Text()
        p.feed(page or "")
        p.close()
        assert " ".join(plain_text(page or "").split()) == " ".join(" ".join(p.words).split())
        assert outlinks(page or "") == list(dict.fromkeys(p.links))


def test_hostile_pages_take_linear_time():
    for piece in ("<a ", "<a href=", "<a href='", "<title>", "<", "</", "<!--", "<!", "<script>", "<p", "&#1", "&", " ", "\n", "<a href=\"", "</title ", "<head>", "<a >", "<script></script >"):
        page = piece * (10_000_000 // len(piece))
        began = time.perf_counter()
        page_parts(page)
        assert time.perf_counter() - began < (12 if piece in ("<a >", "<p", "<head>", "<script></script >", "&") else 4), piece
    assert page_parts("<a href=" + " " * 100 + "x>y</a>")[2] == ["x"]
    assert plain_text("&#" + "1" * 9000 + ";&#x" + "f" * 9000 + "&#00000000065;&#xZ") == "\ufffd\ufffdA&#xZ"
    began = time.perf_counter()
    assert identity("Content-Encoding:" + " a " * 300_000, b"x") == b"x"
    assert unchunked(b" " * 20 + b"-14\r\nabc\r\n") == b"" and unchunked(b"1_0\r\nabc") == b"" and unchunked(b"f" * 40 + b"\r\nabc") == b""
    assert unchunked(b"2\r\nab\r\n+2\r\ncd\r\n") == b"ab" and unchunked(b"a" * 10_000_000) == b""
    bomb = gzip.compress(b"x" * 1_000_000)
    assert identity("Content-Encoding: gzip", bomb, 999_999) == bomb and len(identity("Content-Encoding: gzip", bomb, 1_000_000)) == 1_000_000
    assert identity("Content-Encoding: gzip", gzip.compress(b"a") + gzip.compress(b"b")) == b"ab"
    assert not list(parsed(b"WARC/1.1\r\n" + b"x" * 3_000_000))
    assert time.perf_counter() - began < 10


def test_pages_that_end_in_the_middle():
    assert page_parts("<html><head><title>a\n b</title><body>x<p>y") == ("x\ny", "a b", [])
    assert page_parts("a<b c<!-- d") == ("a<b c", None, []) and page_parts("a <!-- b") == ("a", None, [])
    assert page_parts("<head>a<title>t") == ("", None, []) and page_parts("x<STYLE>p</style >y<a-b>z") == ("x\nyz", None, [])
    assert page_parts("<a href=1>p</a><!-- <a href=2> --><script><a href=3></script><A HREF='4&amp;'>q<a href=1>") == ("p\nq", None, ["1", "4&"])


def test_derivatives(spark, tmp_path):
    rows = [(1, "http://a/", PAGE), (2, None, "<p>x</p>"), (3, "http://c/", None), (4, "http://d/", ""), (4, "http://d/", ""), (5, "http://e/", "<p>" + "long " * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    src = responses(df, F.col("url"), F.col("html"), F.col("page_id"))
    out = derivatives(src, "source_key").collect()
    assert len(out) == 2 * len(rows)
    ids = {r.source_key: r.record_id for r in src.collect()}
    by = {(r.source_key, r.record_type): r for r in out}
    for (key, kind), r in by.items():
        (headers, block), = parsed(r.record)
        other = by[key, "conversion" if kind == "metadata" else "metadata"]
        assert headers["WARC-Refers-To"] == r.refers_to == ids[key] and headers["WARC-Concurrent-To"] == other.record_id
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() == r.block_digest
        assert block == r.block and int(headers["Content-Length"]) == r.content_length == len(block)
        assert ("WARC-Target-URI" in headers) == (r.target_uri is not None)
    meta = by[1, "metadata"].block.decode()
    assert "title: A & B\r\n" in meta and "outlink: /x?a=1&b=2\r\n" in meta and "source-http-content-type: text/html; charset=utf-8\r\n" in meta and f"source-payload-length: {len(PAGE.encode())}\r\n" in meta
    assert by[3, "conversion"].block == b"" and len(by[5, "conversion"].block) == 5 * 50000 - 1
    assert derivatives(src.limit(0)).count() == 0


def test_read_warc_round_trip(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n" + "<p>\xe9t\xe9</p>".encode("latin-1")
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a/", "WARC-Date": "2020-01-01T00:00:00Z", "WARC-Payload-Digest": "sha1:ABC"}
    data = serialised(head | {"WARC-Type": "warcinfo"}, b"x") + serialised(head, http)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "b.warc").write_bytes(data)
    src = read_warc(spark, str(tmp_path))
    assert src.columns == [x.split()[0] for x in RESPONSE.split(", ")] and src.count() == 2
    out = derivatives(src).where("record_type = 'conversion'").collect()
    assert {(r.block.decode(), r.source_payload_digest, r.refers_to) for r in out} == {("été", "sha1:ABC", "<urn:uuid:1>")}


def test_odd_charsets_codings_and_torn_files(spark, tmp_path):
    page = "<p>été</p>".encode()
    chunked = b"4\r\n" + page[:4] + b"\r\n" + f"{len(page) - 4:x}".encode() + b"\r\n" + page[4:] + b"\r\n0\r\n\r\n"
    cases = [(c, page) for c in ("charset=undefined", "charset=idna", "charset=hex", "charset=none-such", "charset=utf-8")]
    cases += [("Content-Encoding: gzip", gzip.compress(page)), ("Content-Encoding: deflate", zlib.compress(page)), ("Transfer-Encoding: chunked", chunked), ("Content-Encoding: gzip", page), ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", b"%x\r\n" % len(gzip.compress(page)) + gzip.compress(page) + b"\r\n0\r\n\r\n")]
    rows = [(f"<urn:{i}>", None, None, None, "HTTP/1.1 200 OK\r\n" + (h if ":" in h else f"Content-Type: text/html; {h}"), p) for i, (h, p) in enumerate(cases)]
    out = derivatives(spark.createDataFrame(rows, RESPONSE)).where("record_type = 'conversion'").collect()
    assert len(out) == len(rows) and {r.block.decode() for r in out if r.refers_to != "<urn:1>"} == {"été"}
    nameless = [(None, None, "d", None, "", bytes([65 + i])) for i in range(3)]
    assert len({r.record_id for r in derivatives(spark.createDataFrame(nameless, RESPONSE)).collect()}) == 6
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>"}
    whole = serialised(head, b"HTTP/1.1 200 OK\r\n\r\n" + page)
    odd = b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    assert len(list(parsed(whole + odd + whole + whole[:-20]))) == 2
    assert len(list(parsed(gzip.compress(whole) + gzip.compress(odd) + gzip.compress(whole)[:40]))) == 1
    assert len(list(parsed(gzip.compress(whole) * 3))) == 3 and not list(parsed(b"")) and not list(parsed(b"\x1f\x8bxx"))
    big = serialised(head, b"x" * 5_000_000)
    assert [len(b) for _, b in parsed(gzip.compress(big) * 2)] == [5_000_000] * 2
    (tmp_path / "torn.warc.gz").write_bytes(gzip.compress(whole) + gzip.compress(whole)[:30])
    assert read_warc(spark, str(tmp_path)).count() == 1
