"""Lexical retrieval packing.

Documents are cut into full windows; what is left of each is packed with
lexical neighbours. Document frequencies and lengths are counted over the whole
corpus. Remainders are laid out in the order of their highest-weighted terms
and cut into shards of neighbours in that order, so that documents which share
rare words share a shard at any size of the corpus; a term that very many share
is split by the next one. Each shard holds an inverted index with BM25 weights.
A seed document asks it for unused neighbours, which greedily fill its window:
whole ones in the order of their score, then the best one that is left, cut to
fit; what is cut off stays in the index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from loomgraph.llm.arrow import bounded, tidy
from loomgraph.llm.bpe import codec
from loomgraph.session import Stored

#: UTF-8 bytes of text a shard holds: about 4,000 documents, one index in one task's memory.
SHARD_BYTES = 12 << 20
#: Highest-weighted terms of a seed that make its query; neighbours that are looked at before one is cut.
QUERY_TERMS, LOOK = 16, 32
#: Highest-weighted terms that order the documents.
DEALT_BY = 3
K1, B = 1.2, 0.75


def terms_of(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, token and frequency of each distinct token of each part; the parts' lengths."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.int64)
    key = (np.repeat(np.arange(len(parts), dtype=np.int64), sizes) << 32) | flat
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(key))).astype(np.float32)
    return (key[first] >> 32).astype(np.int32), (key[first] & 0xFFFFFFFF).astype(np.uint32), tf, sizes


@dataclass
class Corpus:
    """What BM25 knows of all documents."""

    idf: np.ndarray
    mean: float

    @staticmethod
    def of(n: int, tokens: int, df: np.ndarray) -> Corpus:
        return Corpus(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), max(1.0, tokens / max(1, n)))

    def weights(self, doc: np.ndarray, token: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        norm = K1 * (1 - B + B * sizes / self.mean)
        return self.idf[token] * tf * (K1 + 1) / (tf + norm[doc].astype(np.float32))


class Index:
    """BM25 over the token ids of a shard's remainders (terms are token ids)."""

    def __init__(self, parts: list[np.ndarray], corpus: Corpus):
        self.n = len(parts)
        doc, token, tf, sizes = terms_of(parts)
        weight = corpus.weights(doc, token, tf, sizes)
        df = np.bincount(token)
        self.terms = np.flatnonzero(df).astype(np.uint32)
        place, df = np.cumsum(df > 0) - 1, df[self.terms]
        term = place[token].astype(np.uint16 if len(self.terms) <= 1 << 16 else np.int64)  # short numbers sort by radix
        # by document: its terms, best first; by term: its documents
        best = np.argsort((doc.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - weight.astype(np.float32).view(np.uint32)), kind="stable")  # weights are positive, so their bits sort as they do
        starts = np.searchsorted(doc, np.arange(self.n + 1))
        self.query = [term[best[a : min(a + QUERY_TERMS, b)]].tolist() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        by_term = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[by_term], weight[by_term]
        self.at = np.concatenate([[0], np.cumsum(df)])
        self.score = np.zeros(self.n, np.float32)

    def neighbours(self, seed: int, unused: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` unused documents that share a query term, best first, ties to the earlier one."""
        s = self.score
        s[:] = 0
        for t in self.query[seed]:
            a, b = self.at[t], self.at[t + 1]
            s[self.docs[a:b]] += self.weights[a:b]
        s *= unused
        s[seed] = 0
        found = np.flatnonzero(s)
        if len(found) > most:
            cut = np.partition(s[found], len(found) - most)[len(found) - most]
            found = found[s[found] >= cut]
        return found[np.argsort(-s[found], kind="stable")][:most]


def pack(parts: list[np.ndarray], length: int, corpus: Corpus) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (document, first token within its part, tokens); every token lies in one window."""
    index = Index(parts, corpus)
    left = np.fromiter(map(len, parts), np.int64, len(parts))
    size = left.copy()  # what is left of a part is its tail
    unused = (left > 0).astype(np.float32)
    at = 0
    while True:
        while at < len(parts) and not left[at]:
            at += 1
        if at == len(parts):
            return
        room, window, seed = length, [], at

        def take(i: int, n: int, window: list = window) -> None:
            window.append((i, int(size[i] - left[i]), n))
            left[i] -= n
            if not left[i]:
                unused[i] = 0

        n = int(min(room, left[seed]))
        take(seed, n)
        room -= n
        while room and unused.any():
            near = index.neighbours(seed, unused, LOOK).tolist()
            if not near:  # nothing shares a word with the seed: the next documents in order
                while at < len(parts) and not left[at]:
                    at += 1
                near = [at]
            for i in near:
                if left[i] <= room:
                    n = int(left[i])
                    take(i, n)
                    room -= n
            if room:
                i = next((i for i in near if left[i]), None)
                if i is not None and len(near) < LOOK or i is not None and left[i] > room:
                    n = int(min(room, left[i]))
                    take(i, n)
                    room -= n
        yield window


def _tokenize(tokenizer: str, length: int, end_id: int, with_ids: bool):
    """A row for each document: its token count, the checksums (and ids) of its full windows, and the ids of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            tokens, sums, full, rest = [], [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py()) + end
                cut = len(ids) // (4 * length) * 4 * length
                tokens.append(len(ids) // 4)
                sums.append([zlib.crc32(memoryview(ids)[i : i + 4 * length]) for i in range(0, cut, 4 * length)])
                full.append(ids[:cut] if with_ids else None)
                tail = np.frombuffer(ids, np.uint32, offset=cut)
                rest.append(tail.astype(np.uint16).tobytes() if len(c.pieces) <= 1 << 16 else tail.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(full, pa.binary()), pa.array(rest, pa.binary())], ["doc_id", "doc_tokens", "sums", "full", "rest"])

    return run


def _parts(rest: pa.Array | pa.ChunkedArray, wide: bool) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32 if wide else np.uint16).astype(np.uint32) for x in rest.to_pylist()]


def _frequencies(wide: bool):
    """For each partition: documents by token; under -1 the documents, under -2 their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, size = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            _, token, _, sizes = terms_of(_parts(batch.column(0), wide))
            more = np.bincount(token, minlength=len(df))
            more[: len(df)] += df
            df, n, size = more, n + len(sizes), size + int(sizes.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1, -2], pa.int32()), pa.array([*df[some].tolist(), n, size], pa.int64())], ["token", "n"])

    return run


def _keyed(wide: bool, corpus: Corpus):
    """Adds each document's highest-weighted terms, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, token, tf, sizes = terms_of(_parts(batch.column(4), wide))
            rank = corpus.weights(doc, token, tf, sizes).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | token  # weights are positive, so their bits sort as they do
            rank = np.append(rank, np.uint64(0))  # where a remainder at the end is empty
            starts = np.searchsorted(doc, np.arange(len(sizes)))
            keys = []
            for _ in range(DEALT_BY):
                best = np.maximum.reduceat(rank, starts)
                keys.append(pa.array((best & np.uint64(0xFFFFFFFF)).astype(np.int64)))
                rank[:-1][rank[:-1] == best[doc]] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys], [*batch.schema.names, *KEYS])

    return run


KEYS = [f"t{i}" for i in range(DEALT_BY)]


def _pack_shard(length: int, wide: bool, with_ids: bool, kind: pa.DataType, corpus: Corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        ids, tokens, sums, full = (held.column(i).to_pylist() for i in range(4))
        parts = _parts(held.column(4), wide)
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i], tokens[i], parts[i].tobytes()))
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        done = 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [kind, *[pa.int64()] * 6, *([pa.binary()] if with_ids else [])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names[: len(kinds)])
            rows.clear()
            return out

        for i in order:
            for k, crc in enumerate(sums[i]):
                more = (full[i][4 * k * length : 4 * (k + 1) * length],) if with_ids else ()
                rows.append((ids[i], k * length, length, crc, tokens[i], base + done, 0, *more))
                done += 1
            if len(rows) > 20_000:
                yield batch()
        parts = [parts[i] for i in order]
        for window in pack(parts, length, corpus):
            offset = 0
            for j, at, n in window:
                i = order[j]
                piece = parts[j][at : at + n].tobytes()
                rows.append((ids[i], tokens[i] - len(parts[j]) + at, n, zlib.crc32(piece), tokens[i], base + done, offset, *((piece,) if with_ids else ())))
                offset += n
            done += 1
            if len(rows) > 20_000:
                yield batch()
        if rows:
            yield batch()

    return run


def pack_documents(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1,
    shard_bytes: int = SHARD_BYTES, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` tokens.

    A document is its text's ids and `end_id`. Each piece: doc_id, start (in
    the document), length, ids_crc32 (of its ids as little-endian unsigned
    32-bit numbers), doc_tokens, sequence_id, offset (in the sequence), and the
    packed ids themselves if with_ids. Every token lies in exactly one piece;
    in each shard all sequences but the last are full.

    A null text is empty: its document is the end alone. Repeated rows are
    documents of their own. Other columns, whatever their names, are not read;
    an empty table gives an empty result. A shard's place and order depend on
    ids and texts only, so a task that runs again gives the same sequences. A
    seed's query is its QUERY_TERMS highest-weighted terms, and its neighbours
    are sought in its own shard. The driver gets a row for each token of the
    vocabulary.
    """
    return pack_keyed(*keyed_documents(df, tokenizer, id_col, text_col, length, end_id, shard_bytes, with_ids))


def keyed_documents(df: DataFrame, tokenizer: str, id_col: str, text_col: str, length: int, end_id: int, shard_bytes: int, with_ids: bool) -> tuple:
    """Tokenised documents in shards of lexical neighbours, and what pack_keyed needs to know."""
    bounded(df.sparkSession)
    spark = df.sparkSession
    field = df.schema[id_col]
    kind = field.dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    wide = len(codec(tokenizer).pieces) > 1 << 16
    layout = f"doc_id {kind}, doc_tokens long, sums array<long>, full binary, rest binary"
    tokens = Stored(docs.mapInArrow(tidy(_tokenize(tokenizer, length, end_id, with_ids)), layout), "packing-tokens")
    cut = tokens.read()
    counts = dict(cut.select("rest").mapInArrow(tidy(_frequencies(wide)), "token int, n long").groupBy("token").agg(F.sum("n")).collect())
    df = np.zeros(max([0, *counts]) + 1, np.int64)
    for token, n in counts.items():
        if token >= 0:
            df[token] = n
    corpus = Corpus.of(counts.get(-1, 0), counts.get(-2, 0), df)
    # written with its keys, since the sort looks at its rows twice
    keyed = Stored(cut.mapInArrow(tidy(_keyed(wide, corpus)), layout + "".join(f", {k} long" for k in KEYS)), "packing-keys").read().withColumn("row", F.monotonically_increasing_id())
    tokens.drop()
    # rows that only their place in the stored table tells apart can still be parted
    return keyed.repartitionByRange(shards, *KEYS, F.xxhash64("doc_id", "doc_tokens"), "row").drop(*KEYS, "row"), field, length, wide, with_ids, corpus


def pack_keyed(dealt: DataFrame, field: StructField, length: int, wide: bool, with_ids: bool, corpus: Corpus) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    out = f"doc_id {field.dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return dealt.mapInArrow(tidy(_pack_shard(length, wide, with_ids, to_arrow_type(field.dataType), corpus)), out)
