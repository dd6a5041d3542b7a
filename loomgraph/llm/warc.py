"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response yields two records that name it (WARC-Refers-To) and each other
(WARC-Concurrent-To): the metadata record keeps the source's WARC and HTTP
headers, digests, title and links; the conversion record is the page as text.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bounded

# Elements whose content is no text, and elements that end a line.
SILENT = ("script", "style", "noscript", "template")
BLOCK = frozenset("p div br li ul ol dl dt dd h1 h2 h3 h4 h5 h6 tr td th table article section nav header footer main aside body blockquote pre hr form figure figcaption".split())
#: What begins a comment or a tag; group 1 is an end tag's slash, group 2 the name.
OPEN = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>]*)|/?[!?])")
CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*SILENT, "title")}
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
SPACE, LINES = re.compile(r"[^\S\n]+"), re.compile(r"\s*\n\s*")
LONG_NUMBER = re.compile(r"&#(?:([0-9]{8,})|([xX])([0-9a-fA-F]{7,}));?")
#: Bytes of a record's header, and of a payload with its codings undone, beyond which they do not count as such.
HEADER_MOST, UNPACKED_MOST = 1 << 20, 256 << 20


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same parts always give the same id, so a task that runs again writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def _shortened(m: re.Match) -> str:
    digits = (m[1] or m[3]).lstrip("0")
    return f"&#{m[2] or ''}{digits or '0'};" if len(digits) < 8 else "&#x110000;"


def unescaped(text: str) -> str:
    """Character references resolved; a number beyond any character is U+FFFD, however many digits it has."""
    return html.unescape(LONG_NUMBER.sub(_shortened, text) if "&#" in text else text)


def page_parts(page: str) -> tuple[str, str | None, list[str]]:
    """Text, title and links of a page, in one pass that never goes back.

    Text: comments, the head, scripts, styles and the like gone, blocks on
    lines of their own, character references resolved. A comment or silent
    element that nothing ends goes on to the page's end; a tag goes to the next
    `>`, and where there is none, `<` is text. The head ends with its end tag
    or the body. Links: of a elements outside comments and silent elements,
    each once. The title is the first one that is closed.
    """
    out: list[str] = []
    links: dict[str, None] = {}
    title, sought, in_head, at = None, False, False, 0
    while m := OPEN.search(page, at):
        lt, name = m.start(), (m[2] or "").lower()
        if not in_head:
            out.append(page[at:lt])
        if m[0] == "<!--":
            end = page.find("-->", lt + 4)
            if end < 0:
                at = len(page)
                break
            at = end + 3
            continue
        end = page.find(">", m.end())
        if end < 0:  # no tag and no end of a comment any more
            comment = page.find("<!--", lt)
            if not in_head:
                out.append(page[lt : comment if comment >= 0 else len(page)])
            at = len(page)
            break
        at = end + 1
        if m[1]:
            in_head = in_head and name != "head"
        elif name in CLOSE and name != "title":
            shut = CLOSE[name].search(page, at)
            at = shut.end() if shut else len(page)
            out.append("\n")
        elif name == "title" and not sought:
            shut, sought = CLOSE[name].search(page, at), True
            title = page[at : shut.start()] if shut else None
        elif name == "a" and (href := HREF.search(page, m.end(), end + 1)):
            links[unescaped(href[1] or href[2] or href[3] or "")] = None
        elif name == "head":
            in_head = True
        if name in BLOCK:
            in_head = in_head and name != "body"
            out.append("\n")
    if not in_head:
        out.append(page[at:])
    text = LINES.sub("\n", SPACE.sub(" ", unescaped("".join(out)))).strip()
    return text, None if title is None else " ".join(unescaped(title).split()), list(links)


def plain_text(page: str) -> str:
    return page_parts(page)[0]


def outlinks(page: str) -> list[str]:
    return page_parts(page)[2]


CHUNK_SIZE = re.compile(rb"[0-9a-fA-F]{1,15}")


def unchunked(data: bytes) -> bytes:
    """The body of a chunked transfer; what follows a torn chunk, or a size that is no plain hexadecimal number, is lost."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        size = data[at : min(end, at + 4096)].split(b";")[0].strip()
        n = int(size, 16) if CHUNK_SIZE.fullmatch(size) else 0
        if not n:
            break
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def unpacked(data: bytes, wbits: int, most: int) -> bytes:
    """Compressed data, member by member; ValueError beyond `most` bytes."""
    out, size = [], 0
    while data:
        d = zlib.decompressobj(wbits)
        out.append(d.decompress(data, most + 1 - size))
        size += len(out[-1])
        if size > most:
            raise ValueError("more than is unpacked")
        if wbits != 31 or d.unused_data[:2] != b"\x1f\x8b":
            break
        data = d.unused_data
    return b"".join(out)


def identity(headers: str, payload: bytes, most: int = UNPACKED_MOST) -> bytes:
    """The payload without the transfer and content codings its headers name; as it is where they are unknown, do not hold, or would make more than `most` bytes of it."""
    fields = [(k.strip().lower(), v) for k, _, v in (x.partition(":") for x in headers.splitlines())]
    codings = [(k, c.strip().lower()) for k, v in fields if k in ("content-encoding", "transfer-encoding") for c in v.split(",")]
    for _, coding in sorted(codings, key=lambda c: c[0] != "transfer-encoding"):
        try:
            if coding == "chunked":
                payload = unchunked(payload)
            elif coding in ("gzip", "x-gzip"):
                payload = unpacked(payload, 31, most)
            elif coding == "deflate":
                payload = unpacked(payload, 15 if payload[:1] == b"\x78" else -15, most)
        except (zlib.error, ValueError):
            break
    return payload


def decoded(headers: str, payload: bytes) -> str:
    """Payload as text: the charset of the headers, else of the page's first kilobytes, else UTF-8; UTF-8 too where the charset is none."""
    payload = identity(headers, payload)
    m = CHARSET.search(headers.encode("utf-8", "replace")) or CHARSET.search(payload[:2048])
    try:
        return payload.decode(m[1].decode() if m else "utf-8", "replace")
    except (LookupError, ValueError):  # unknown, or a codec of another kind: UnicodeError is a ValueError
        return payload.decode("utf-8", "replace")


def serialised(headers: dict[str, str | None], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def unzipped(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes in pieces, its gzip members (if any) decompressed one after the other; ends where a member is torn."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    try:
        while at < len(view):
            d = zlib.decompressobj(31)
            while not d.eof and at < len(view):
                piece = view[at : at + step]
                yield d.decompress(piece, 8 * step)
                while d.unconsumed_tail and not d.eof:
                    yield d.decompress(d.unconsumed_tail, 8 * step)
                at += len(piece) - len(d.unused_data)
    except zlib.error:
        return


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file's bytes, gzipped or not, one at a time; a torn last record and records without a length are passed over."""
    held, pieces = bytearray(), unzipped(data)

    def more(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while (at := held.find(b"WARC/")) < 0 or (end := held.find(b"\r\n\r\n", at)) < 0:
            if at < 0:
                del held[: max(0, len(held) - 4)]
            elif len(held) - at > HEADER_MOST:  # no header is so long
                del held[: at + 5]
                continue
            if not more(len(held) + 1):
                return
        headers = dict(x.split(": ", 1) for x in held[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        size = headers.get("Content-Length", "")
        if not size.strip().isdigit():
            del held[: end + 4]
            continue
        stop = end + 4 + int(size)
        if not more(stop):
            return
        yield headers, bytes(held[end + 4 : stop])
        del held[:stop]


#: Response records: what read_warc gives and derivatives takes.
RESPONSE = "record_id string, target_uri string, date string, payload_digest string, http_headers string, payload binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of the WARC files under a path. A file is read by one task, which holds it as it is stored (gzipped) and unzips it record by record."""

    names, kinds = [x.split()[0] for x in RESPONSE.split(", ")], [pa.string()] * 5 + [pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for data in batch.column(0):
                for h, block in parsed(data.as_py()):
                    if h.get("WARC-Type") == "response":
                        head, _, body = block.partition(b"\r\n\r\n")
                        rows.append((h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), h.get("WARC-Date"), h.get("WARC-Payload-Digest"), head.decode("utf-8", "replace"), body))
                        size += len(block)
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(run, RESPONSE)


def responses(df: DataFrame, url: Column, body: Column, key: Column, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages, and `key` with each."""
    payload = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    name = F.md5(F.concat_ws("\x00", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), F.sha1(payload)).cast("binary"))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return df.select(
        key.alias("source_key"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"), url.alias("target_uri"),
        F.lit(date).alias("date"), F.lit(None).cast("string").alias("payload_digest"), head.alias("http_headers"), payload.alias("payload"),
    )


def _derive(row: dict) -> list[tuple]:
    payload, http = row["payload"] or b"", row["http_headers"] or ""
    page = decoded(http, payload)
    source, uri, date = row["record_id"], row["target_uri"], row["date"]
    payload_digest = row["payload_digest"] or digest(payload)
    ids = {k: record_id(k, source or "", uri or "", *(() if source else (date or "", payload_digest))) for k in ("metadata", "conversion")}
    text, title, links = page_parts(page)
    names = [("source-record-id", source), ("source-date", date), ("source-payload-digest", payload_digest), ("source-payload-length", str(len(payload)))]
    names += [("source-http-status", http.split("\r\n")[0])] + [(f"source-http-{k.lower()}", v) for k, _, v in (x.partition(": ") for x in http.split("\r\n")[1:]) if v]
    names += [("title", title)] + [("outlink", x) for x in links]
    fields = "".join(f"{k}: {' '.join(filter(None, map(str.strip, v.splitlines())))}\r\n" for k, v in names if v is not None).encode("utf-8", "replace")
    out = []
    for kind, other, content, block in (("metadata", "conversion", "application/warc-fields", fields), ("conversion", "metadata", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        block_digest = digest(block)
        headers = {
            "WARC-Type": kind, "WARC-Record-ID": ids[kind], "WARC-Date": date, "WARC-Refers-To": source, "WARC-Target-URI": uri, "WARC-Concurrent-To": ids[other],
            "WARC-Refers-To-Date": date, "WARC-Source-Payload-Digest": payload_digest, "WARC-Block-Digest": block_digest, "Content-Type": content,
        }
        out.append((kind, ids[kind], source, ids[other], uri, date, content, len(block), block_digest, payload_digest, http, len(links), block, serialised(headers, block)))
    return out


FIELDS = (
    ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
    ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("source_payload_digest", pa.string()), ("source_http_headers", pa.string()),
    ("n_outlinks", pa.int64()), ("block", pa.binary()), ("record", pa.binary()),
)


def derivatives(df: DataFrame, key_col: str | None = None) -> DataFrame:
    """Two rows for each response record: its metadata and its conversion, with block and serialised record.

    df has the columns of RESPONSE; key_col, if given, is carried along. A null
    payload is an empty page; a null URI or date leaves its header out; a
    digest that the source has is kept, a missing one computed over the payload
    as it came. Transfer and content codings are undone for the text. A charset
    that is none counts as UTF-8. A coded payload of more than UNPACKED_MOST
    bytes, unpacked, is read as it came; see page_parts for torn pages. Both records' ids follow from the source's id
    and URI, and where it has no id from date and digest too. Repeated
    responses give repeated records with the same ids. Other columns are not
    read; an empty table gives an empty result. No shuffle.
    """
    bounded(df.sparkSession)
    names = [x.split()[0] for x in RESPONSE.split(", ")]
    types = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    key = [F.col(key_col).alias("source_key")] if key_col else [F.lit(None).cast("string").alias("source_key")]
    kind = df.schema[key_col].dataType.simpleString() if key_col else "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [_derive(r) for r in part.to_pylist()]
                keys = part.column(0).take(pa.array([i for i, r in enumerate(rows) for _ in r], pa.int64()))
                cols = list(zip(*(x for r in rows for x in r), strict=True))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True)]], ["source_key", *[n for n, _ in FIELDS]])

    out = df.select(*key, *names).mapInArrow(run, f"source_key {kind}, " + ", ".join(f"{n} {types[t]}" for n, t in FIELDS))
    return out if key_col else out.drop("source_key")
