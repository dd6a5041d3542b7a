"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of 1-, 2- and 3-grams are mixed by weights that
depend on how often the context was seen. The weights are learned by
expectation-maximisation on held-out counts: for each training token of the
corpus, the counts of its own document are deleted from those of the corpus.

Counting. A *chunk* is a bounded number of neighbouring documents, stored once
as token streams over its own vocabulary. Each chunk sends its distinct n-grams
(sorted 64-bit hashes, packed) to the buckets of the hash space; each bucket
adds up its n-grams over all chunks and sends every chunk the totals of the
n-grams it asked for, in the order it asked. So a chunk is scored with exact
corpus counts, and no task ever holds the corpus's vocabulary: what moves grows
with the input, and no key is hot, since a chunk names an n-gram once. A chunk
writes to at most FAN buckets: where the hash space has more, the n-grams of
every FAN chunks are first added up by the hash's first bits, and these sums ask
on in the same way; the totals come back by the same route. Each token's counts
are then stored, and both learning and scoring read only those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bounded, free, tidy
from loomgraph.session import Stored

ORDER = 3
#: Bytes of text in a chunk.
CHUNK_BYTES = 8 << 20
#: Single words keep 64 bits of their hash, longer n-grams SPARE more than it takes to number the corpus's tokens
#: (64 at most), so that at every size an n-gram shares its hash with another by chance 2**-SPARE or less.
SPARE = 20
#: Binary logarithm of the buckets that a chunk, or a sum of chunks, writes to.
FAN_BITS = 12
#: The end of a text and what stands before its start; neither can be a word.
END, START = 0x5C0DE0FE2D000001, 0x5C0DE0FE2D000002
BINS, SPAN = 240, 30.0


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _pack(x: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences, byte planes together, compressed."""
    import zstandard

    d = np.diff(x, prepend=x.dtype.type(0)) if x.dtype == np.uint64 else x
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(len(x), -1).T) if len(x) else d.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    x = np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)
    return np.cumsum(x, dtype=np.uint64) if kind is np.uint64 else x


@dataclass
class Chunk:
    """Token streams of some documents. words: sorted hashes; tokens: positions in words; sizes: tokens of each document."""

    ids: list
    held: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    tokens: np.ndarray
    bits: int
    _grams: dict = field(default_factory=dict)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def gram(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct k-grams (sorted hashes) and each token's position among them."""
        if k == 1:
            return self.words, self.tokens
        if k not in self._grams:
            h = self.words[self.tokens]
            g = h
            for back in range(1, k):
                before = np.full(len(h), START, np.uint64)
                before[back:] = h[:-back]
                for j in range(back):
                    at = self.starts[self.sizes > j] + j
                    before[at] = START
                g = _mix(before, g)
            self._grams[k] = np.unique(g >> np.uint64(64 - self.bits) << np.uint64(64 - self.bits), return_inverse=True)
        return self._grams[k]

    def counts(self, k: int) -> np.ndarray:
        """How often each distinct k-gram stands in documents that are not held out."""
        keys, at = self.gram(k)
        return np.bincount(at[np.repeat(~self.held, self.sizes)], minlength=len(keys)).astype(np.uint32)

    def own(self, k: int) -> np.ndarray:
        """For each token, how often its k-gram stands in its own document."""
        keys, at = self.gram(k)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        _, inv, n = np.unique(doc * len(keys) + at, return_inverse=True, return_counts=True)
        return n[inv]


def _chunks(chunk_bytes: int):
    def row(ids: list, held: list, texts: list[bytes], k: int) -> pa.RecordBatch:
        from xxhash import xxh3_64_intdigest

        sizes = np.zeros(len(texts), np.int64)
        parts = []
        for i, t in enumerate(texts):
            words = t.lower().split()  # of bytes: A-Z only; at space and 0x09 to 0x0D
            sizes[i] = len(words) + 1
            h = np.empty(len(words) + 1, np.uint64)
            h[:-1] = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
            h[-1] = END
            parts.append(h)
        words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
        name = (TaskContext.get().partitionId() << 24) + k
        cols = [
            pa.array([name]), pa.array([int(sizes.sum())]), pa.array([int(sizes[~np.asarray(held, bool)].sum())]), pa.array([int((~np.asarray(held, bool)).sum())]),
            pa.array([held], pa.list_(pa.bool_())), pa.array([sizes.astype(np.int32).tobytes()]),
            pa.array([_pack(words)]), pa.array([_pack(tokens.astype(np.uint32))]),
        ]
        return pa.RecordBatch.from_arrays([*cols[:4], pa.array([ids]) if not isinstance(ids, pa.Array) else pa.ListArray.from_arrays([0, len(ids)], ids), *cols[4:]], ["chunk", "n", "n_train", "docs", "ids", "held", "sizes", "words", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        held, texts, size, k = [], [], 0, 0
        for batch in batches:
            lo = 0
            for i in range(batch.num_rows):
                t = batch.column(2)[i].as_py() or b""
                texts.append(t)
                held.append(bool(batch.column(1)[i].as_py()))
                size += len(t)
                if size >= chunk_bytes:
                    ids.append(batch.column(0).slice(lo, i + 1 - lo))
                    yield row(pa.concat_arrays(ids), held, texts, k)
                    ids, held, texts, size, k, lo = [], [], [], 0, k + 1, i + 1
            if lo < batch.num_rows:
                ids.append(batch.column(0).slice(lo))
        if texts:
            yield row(pa.concat_arrays(ids), held, texts, k)

    return run


def _chunk_of(r: dict, bits: int) -> Chunk:
    return Chunk(r["ids"], np.asarray(r["held"], bool), np.frombuffer(r["sizes"], np.int32).astype(np.int64), _unpack(r["words"], np.uint64), _unpack(r["tokens"], np.uint32).astype(np.int64), bits)


#: The node that is asked, the chunk or node that asks, and what it asks for.
ASKED = "node long, k int, sender long, grams binary, counts binary"
#: Totals for a sender, in the order it asked; seen: n-grams with a count, named once for each node.
TOLD = "sender long, k int, node long, counts binary, seen long"


def _rows(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in kinds.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, of[t]) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _split(keys: np.ndarray, counts: np.ndarray, sender: int, k: int, group: int, bits: int) -> list[tuple]:
    """Sorted n-grams for the nodes of a level: the group of the sender and the first bits of the hash."""
    first = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else []
    return [((group << bits) + int(first[lo]), k, sender, _pack(keys[lo:hi]), _pack(counts[lo:hi])) for lo, hi in zip(starts, [*starts[1:], len(first)], strict=True)]


def _group(sender: int, groups: int) -> int:
    return int(_mix(np.array([sender], np.uint64), np.uint64(1))[0] % np.uint64(groups))


def _ask(bits: int, groups: int, order: int, gram_bits: int):
    """Each chunk's distinct n-grams with its own training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = _chunk_of(r, gram_bits)
                for k in range(1, order + 1):
                    yield _rows(_split(c.gram(k)[0], c.counts(k), r["chunk"], k, _group(r["chunk"], groups), bits), ASKED)
                    c._grams.clear()

    return run


def _by_node(use):
    """What `use` makes of (node, k) and its rows, which come one after the other; no more than one node's are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["node"], r["k"]) != of:
                    if held:
                        yield use(*of, held)
                    of, held = (r["node"], r["k"]), []
                held.append(r)
        if held:
            yield use(*of, held)

    return run


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows by their node's number, so that no task gets several while others get none; a node's rows stand together."""
    return rows.repartitionById(tasks, (F.col("node") % tasks).cast("int")).sortWithinPartitions("node", "k")


def _summed(asked: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What each row asked for, the distinct n-grams, their sums, and the place of each asked one among them."""
    grams = [_unpack(r["grams"], np.uint64) for r in asked]
    n = np.concatenate([_unpack(r["counts"], np.uint32) for r in asked])
    keys, at = np.unique(np.concatenate(grams), return_inverse=True)
    return grams, keys, np.bincount(at, n, minlength=len(keys)).astype(np.uint32), at


def _answers(node: int, k: int, asked: list[dict], grams: list[np.ndarray], each: np.ndarray, seen: int) -> pa.RecordBatch:
    ends = np.cumsum([len(g) for g in grams]).tolist()
    rows = [(r["sender"], k, node, _pack(each[hi - len(g) : hi]), 0 if i else seen) for i, (r, g, hi) in enumerate(zip(asked, grams, ends, strict=True))]
    return _rows(rows, TOLD)


def _tell(node: int, k: int, asked: list[dict]) -> pa.RecordBatch:
    """Totals of a bucket's n-grams, for every sender in the order it asked."""
    grams, _, total, at = _summed(asked)
    return _answers(node, k, asked, grams, total[at], int((total > 0).sum()))


def _ask_on(bits: int, groups: int):
    """A node's sums, for the nodes of the next level."""

    def use(node: int, k: int, asked: list[dict]) -> pa.RecordBatch:
        _, keys, total, _ = _summed(asked)
        return _rows(_split(keys, total, node, k, _group(node, groups), bits), ASKED)

    return use


def _pass_back(node: int, k: int, rows: list[dict]) -> pa.RecordBatch:
    """The totals that came back to a node, for its own senders."""
    asked = [r for r in rows if r["grams"] is not None]
    told = sorted((r for r in rows if r["grams"] is None), key=lambda r: r["part"])
    grams, _, _, at = _summed(asked)
    total = np.concatenate([_unpack(r["counts"], np.uint32) for r in told])
    return _answers(node, k, asked, grams, total[at], sum(r["seen"] for r in told))


def levels(bits: int, chunks: int, fan_bits: int) -> list[tuple[int, int]]:
    """(bits, groups) of each level of nodes; the last has all bits and one group."""
    out, done = [], min(bits, fan_bits)
    while done < bits:
        out.append((done, max(1, -(-chunks >> fan_bits * (len(out) + 1)))))
        done = min(bits, done + fan_bits)
    return [*out, (bits, 1)]


def _totals(asked: DataFrame, route: list[tuple[int, int]], tasks: int) -> Stored:
    """TOLD for every row of `asked`, whose nodes are those of the first level of the route."""
    if len(route) == 1:
        return Stored(_dealt(asked, tasks).mapInArrow(tidy(_by_node(_tell)), TOLD), "lm-totals")
    kept = Stored(asked, "lm-asked")
    told = _totals(_dealt(kept.read(), tasks).mapInArrow(tidy(_by_node(_ask_on(*route[1]))), ASKED), route[1:], tasks)
    null = lambda kind: F.lit(None).cast(kind)
    mine = kept.read().select("node", "k", "sender", "grams", "counts", null("long").alias("part"), null("long").alias("seen"))
    back = told.read().select(F.col("sender").alias("node"), "k", null("long").alias("sender"), null("binary").alias("grams"), "counts", F.col("node").alias("part"), "seen")
    out = Stored(_dealt(mine.unionByName(back), tasks).mapInArrow(tidy(_by_node(_pass_back)), TOLD), "lm-totals")
    kept.drop(), told.drop()
    return out


def bucket_of(count: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for unseen, then by powers of two."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


@dataclass
class Mixture:
    """Sizes of the training corpus and the learned weight of each order above 1, by context bucket."""

    tokens: int
    vocabulary: int
    documents: int
    weights: dict[int, np.ndarray] = field(default_factory=dict)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.tokens + self.vocabulary + 1)

    def probability(self, counts: dict[int, np.ndarray], contexts: dict[int, np.ndarray], order: int) -> np.ndarray:
        """The mixture up to `order`, given each token's n-gram and context counts."""
        p = self.unigram(counts[1])
        for k in range(2, order + 1):
            w = self.weights[k][bucket_of(contexts[k])]
            p = w * _share(counts[k], contexts[k]) + (1 - w) * p
        return p


def _share(count: np.ndarray, context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, count / np.maximum(context, 1), 0.0)


def learn(hist: np.ndarray, logs: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights by bucket, by EM on tokens counted by bucket and binned ratio of share to lower order (first bin: share 0); logs: the sums of the ratios' binary logarithms.

    Bucket 0 has weight 0; one that no token reaches lies between its neighbours.
    """
    ratio = np.where(hist > 0, np.exp2(logs / np.maximum(hist, 1)), 0.0)
    ratio[:, 0] = 0.0
    w = np.full(len(hist), 0.5)
    for _ in range(rounds):
        gain = w[:, None] * ratio / (w[:, None] * ratio + 1 - w[:, None])
        w = (hist * gain).sum(axis=1) / np.maximum(hist.sum(axis=1), 1)
        w = np.clip(w, 0.0, 0.9999)
    w[0] = 0.0
    some = hist.sum(axis=1) > 0
    return np.where(some, w, np.interp(np.arange(len(w)), np.flatnonzero(some), w[some]) if some.any() else 0.0)


def _counted(order: int, gram_bits: int, kind: pa.DataType):
    """Gathers a partition's rows by chunk; each chunk's documents with every token's n-gram counts, in the corpus and in its own document."""
    def use(c: Chunk, told: dict[int, dict[int, bytes]]) -> pa.RecordBatch:
        counts, own = [], []
        for k in range(1, order + 1):
            total = np.concatenate([_unpack(told[k][b], np.uint32) for b in sorted(told[k])])
            counts.append(_pack(total[c.gram(k)[1]]))
            own.append(_pack(c.own(k).astype(np.uint32)))
            c._grams.clear()
        cols = [pa.array([c.ids], pa.list_(kind)), pa.array([c.held.tolist()], pa.list_(pa.bool_())), pa.array([c.sizes.astype(np.int32).tobytes()]), pa.array([counts], pa.list_(pa.binary())), pa.array([own], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(cols, ["ids", "held", "sizes", "counts", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, dict] = {}
        told: dict[int, dict[int, dict[int, bytes]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["k"] is None:
                    rows[r["chunk"]] = r
                else:
                    told.setdefault(r["chunk"], {}).setdefault(r["k"], {})[r["node"]] = r["counts"]
        for name in sorted(rows):
            yield use(_chunk_of(rows.pop(name), gram_bits), told.pop(name))

    return run


@dataclass
class Tokens:
    """Some documents' tokens with their counts by order, as _counted stores them."""

    ids: list
    held: np.ndarray
    sizes: np.ndarray
    counts: list[bytes]
    own: list[bytes]

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @property
    def train(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)

    def seen(self, m: Mixture, order: int, deleted: bool) -> tuple[dict, dict]:
        """Each token's n-gram and context counts; deleted: without those of its own document, if that is in training."""
        counts, contexts = {}, {}
        for k in range(1, order + 1):
            counts[k] = _unpack(self.counts[k - 1], np.uint32).astype(np.int64)
            if deleted:
                counts[k] -= np.where(self.train, _unpack(self.own[k - 1], np.uint32), 0)
        for k in range(2, order + 1):  # the context's count is that of the (k-1)-gram that ends one token before
            x = np.empty_like(counts[k - 1])
            x[1:] = counts[k - 1][:-1]
            x[self.starts] = m.documents - (~self.held if deleted else 0)
            contexts[k] = x
        return counts, contexts


def _each(use):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield use(Tokens(r["ids"], np.asarray(r["held"], bool), np.frombuffer(r["sizes"], np.int32).astype(np.int64), r["counts"], r["own"]))

    return run


def _together(chunks: DataFrame, told: DataFrame, tasks: int) -> DataFrame:
    a = chunks.select("chunk", F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("binary").alias("counts"), "ids", "held", "sizes", "words", "tokens")
    kinds = dict(a.dtypes)
    b = told.select(F.col("sender").alias("chunk"), "k", "node", "counts", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("ids", "held", "sizes", "words", "tokens")])
    return a.unionByName(b).repartition(tasks, "chunk")


def lm_scores(
    df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
    chunk_bytes: int = CHUNK_BYTES, bucket_tokens: int = 1 << 20, fan_bits: int = FAN_BITS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every whole text.

    Rows where `held_out` is true are scored but not learned from. Tokens:
    words, A-Z in lower case, then one end. base_score is the add-one unigram
    model, score the interpolated model of `order`, whose weights are learned
    on every training token. A null text is empty: its only token is the end.
    Repeated rows count and score each. A long text is one chunk. Other
    columns, whatever their names, are not read; an empty table gives an empty
    result; with nothing to learn from, every token is unknown. No score
    depends on how the rows lie in files. bucket_tokens: tokens of the corpus
    for each bucket of the hash space.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bounded(df.sparkSession)
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    kind = id_type.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("binary").alias("text"))
    layout = f"chunk long, n long, n_train long, docs long, ids array<{kind}>, held array<boolean>, sizes binary, words binary, tokens binary"
    stored = Stored(docs.mapInArrow(_chunks(chunk_bytes), layout), "lm-chunks")
    chunks = stored.read()
    n, n_train, n_docs, n_chunks = chunks.agg(F.sum("n"), F.sum("n_train"), F.sum("docs"), F.count("*")).first()
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not n_chunks:
        return spark.createDataFrame([], out)
    gram_bits = min(64, SPARE + n.bit_length())
    parts = max(n // bucket_tokens, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = max(3, (parts - 1).bit_length())
    route = levels(bits, n_chunks, fan_bits)
    told = _totals(chunks.mapInArrow(_ask(*route[0], order, gram_bits), ASKED), route, 1 << bits)
    vocabulary = told.read().where("k = 1").agg(F.sum("seen")).first()[0]
    free(spark)
    m = Mixture(n_train, vocabulary, n_docs)
    known = f"ids array<{kind}>, held array<boolean>, sizes binary, counts array<binary>, own array<binary>"
    tokens = Stored(_together(chunks, told.read(), n_chunks).mapInArrow(_counted(order, gram_bits, to_arrow_type(id_type)), known), "lm-tokens").read()
    stored.drop(), told.drop()
    free(spark)
    for k in range(2, order + 1):
        m.weights[k] = learn(*_histogram(tokens, m, k))

    def score(t: Tokens) -> pa.RecordBatch:
        counts, contexts = t.seen(m, order, False)
        base, p = np.log10(m.unigram(counts[1])), np.log10(m.probability(counts, contexts, order))
        at = t.starts
        cols = [pa.array(t.held), pa.array(t.sizes), pa.array(np.add.reduceat((counts[1] > 0).astype(np.int64), at)), pa.array(np.full(len(at), n_train)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(p, at))]
        return pa.RecordBatch.from_arrays([pa.array(t.ids, to_arrow_type(id_type)), *cols], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return tokens.mapInArrow(_each(score), out)


def _histogram(tokens: DataFrame, m: Mixture, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All training tokens by context bucket and binned ratio, under deleted counts, and their summed logarithms. Its size is fixed: 64 buckets of BINS + 1."""

    def count(t: Tokens) -> pa.RecordBatch:
        counts, contexts = t.seen(m, k, True)
        lower = m.probability(counts, contexts, k - 1)
        ratio = _share(counts[k], contexts[k]) / lower
        log = np.log2(np.maximum(ratio, 1e-12))
        cell = np.where(ratio > 0, np.clip((log + SPAN) / (2 * SPAN) * BINS, 0, BINS - 1).astype(np.int64) + 1, 0)
        cell += bucket_of(contexts[k]) * (BINS + 1)
        cells, at, n = np.unique(cell[t.train], return_inverse=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n), pa.array(np.bincount(at, log[t.train], minlength=len(cells)))], ["cell", "n", "logs"])

    hist, logs = np.zeros(64 * (BINS + 1)), np.zeros(64 * (BINS + 1))
    for r in tokens.mapInArrow(_each(count), "cell long, n long, logs double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("logs").alias("logs")).collect():
        hist[r.cell], logs[r.cell] = r.n, r.logs
    return hist.reshape(64, BINS + 1), logs.reshape(64, BINS + 1)
