"""BPE encoding and decoding by tree concatenation.

A long text is halved until its leaves are short. Leaves are encoded side by
side, by as many threads as a task has cores; then neighbours are joined
bottom-up. At each
join only a window around it is encoded again, growing until both sides agree:
it starts and ends where the left and the right half already have a token
boundary that holds in the joined text as well.

Such a place is one of two kinds. A *class edge* is a position where the
pre-tokenizer ends a piece whatever stands around it; encoding may start or
stop there. Inside one unsplit run (letters, digits, signs or white space) the
window must reproduce the half's own token next to the boundary: BPE is right
for a run if and only if it is right for every pair of neighbouring tokens, and
each pair then lies within one of three correct encodings.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator
from concurrent.futures import Executor, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bounded
from loomgraph.llm.bpe import Codec, codec

#: Characters of a leaf, and of the first window on each side of a join.
LEAF, WINDOW = 4096, 32
#: No window starts or ends closer to the join: longer than any contraction or special string.
MARGIN = 16


def _kind(c: str) -> str:
    if c.isspace():
        return "S"
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "P"


def _edge(text: str, i: int) -> bool:
    """Whether the pre-tokenizer ends a piece at i in any text that holds these neighbours."""
    a, b = _kind(text[i - 1]), _kind(text[i])
    if a in "LN":
        return a != b
    if a == "P":
        return b in "NS"
    return text[i] == " " and i + 1 < len(text) and _kind(text[i + 1]) != "S"


def _inside(text: str, i: int) -> bool:
    """Whether i lies within one run, so that a window may cut it there if the tokens agree."""
    a, b = _kind(text[i - 1]), _kind(text[i])
    return a == b and (b in "LN" or i + 1 < len(text) and _kind(text[i + 1]) == b)


class Half:
    """A part of a text with its packed ids and the bytes of each token."""

    def __init__(self, lo: int, hi: int, ids: array):
        self.lo, self.hi, self.ids = lo, hi, ids


class Tree:
    """Joins the halves of one text."""

    def __init__(self, c: Codec, text: str):
        self.c, self.text = c, text

    def join(self, a: Half, b: Half) -> Half:
        text, c, r = self.text, self.c, WINDOW
        while True:
            s, left = self._left(a, r)
            e, right = self._right(b, r)
            ids = array("I", c.encode(text[s:e]))
            ok_left = s == a.lo or self._edge_at(s) or len(left) < len(a.ids) and ids[:1] == a.ids[len(left) : len(left) + 1]
            ok_right = e == b.hi or self._edge_at(e) or len(right) < len(b.ids) and ids[-1:] == b.ids[len(b.ids) - len(right) - 1 : len(b.ids) - len(right)]
            if ok_left and ok_right:
                return Half(a.lo, b.hi, left + ids + right)
            r *= 2

    def _edge_at(self, i: int) -> bool:
        return _edge(self.text, i) and not self._in_special(i)

    def _in_special(self, i: int) -> bool:
        return any(self.text.find(s, max(0, i - len(s) + 1), i + len(s) - 1) >= 0 for s in self.c.special)

    def _left(self, a: Half, r: int) -> tuple[int, array]:
        """Where the window starts in the left half, at most about r characters back, and the ids before it."""
        n = self.c.lengths
        at, k = a.hi, len(a.ids)
        back = 0  # bytes that the walked tokens cover, of which whole characters are taken off at
        data = b""
        fall = None
        while k > 0:
            k -= 1
            data = self.c.pieces[a.ids[k]] + data
            back += n[a.ids[k]]
            if data and (data[0] & 0xC0) == 0x80:
                continue  # inside a character
            at -= len(data.decode("utf-8", "replace"))
            data = b""
            far = a.hi - at
            if far < MARGIN or at <= a.lo:
                continue
            if self._edge_at(at):
                return at, a.ids[:k]
            if far >= r and fall is None and _inside(self.text, at) and not self._in_special(at):
                fall = at, a.ids[:k]
            if fall is not None and far >= 2 * r:
                return fall
        return a.lo, array("I")

    def _right(self, b: Half, r: int) -> tuple[int, array]:
        at, k, data, fall = b.lo, 0, b"", None
        while k < len(b.ids):
            data += self.c.pieces[b.ids[k]]
            k += 1
            try:
                at += len(data.decode())
            except UnicodeDecodeError:
                continue
            data = b""
            far = at - b.lo
            if far < MARGIN or at >= b.hi:
                continue
            if self._edge_at(at):
                return at, b.ids[k:]
            if far >= r and fall is None and _inside(self.text, at) and not self._in_special(at):
                fall = at, b.ids[k:]
            if fall is not None and far >= 2 * r:
                return fall
        return b.hi, array("I")


def leaves(text: str, leaf: int) -> list[tuple[int, int]]:
    """The text's leaves: halves of halves, each at most `leaf` characters."""
    spans, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            spans.append((lo, hi))
        else:
            mid = (lo + hi) // 2
            todo += [(mid, hi), (lo, mid)]
    return spans


def encode_tree(c: Codec, text: str, leaf: int = LEAF, pool: Executor | None = None) -> bytes:
    """Packed ids of one text; its leaves side by side where a pool is given (encoding leaves the interpreter's lock)."""
    if len(text) <= leaf or not c.splits:
        return c.encode(text)
    tree = Tree(c, text)
    spans = leaves(text, leaf)
    row = [Half(lo, hi, array("I", ids)) for (lo, hi), ids in zip(spans, (pool.map if pool else map)(lambda s: c.encode(text[s[0] : s[1]]), spans), strict=True)]
    while len(row) > 1:
        row = [tree.join(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0].ids.tobytes()


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit) and the decoded text of every whole text.

    Ids are those of the tokenizers library without added special tokens,
    truncation or padding; special strings inside a text become their special
    ids. A null text is empty: no ids, an empty decoded text. Repeated rows
    each give a row; other columns, whatever their names, are not read; an
    empty table gives an empty result. Texts of any length take memory in
    proportion to the longest one; its leaves are encoded by as many threads as
    a task has cores (spark.task.cpus). No shuffle.
    """
    bounded(df.sparkSession)
    cores = int(df.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        pool = ThreadPoolExecutor(cores) if cores > 1 else None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            lo, held, ids, back = 0, 0, [], []
            for i, text in enumerate(texts):
                packed = encode_tree(c, text.as_py() or "", leaf, pool)
                ids.append(packed)
                back.append(c.decode(packed))
                held += len(packed)
                if held > 16 << 20 or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([keys.slice(lo, i + 1 - lo), pa.array(ids, pa.binary()), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])
                    lo, held, ids, back = i + 1, 0, [], []

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
