"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint has a bit set where more than half of its shingles' hashes
have it set. Two fingerprints link at `most` (4) or fewer differing bits.

Candidates. The 64 bits form `blocks` blocks; fingerprints that differ in at
most 4 bits agree on at least blocks - 4 whole blocks, so they meet under at
least one choice of that many blocks. Within a bucket a pivot table holds each
fingerprint's Hamming distances to many reference fingerprints. By the triangle
inequality no coordinate of a linked pair differs by more than 4, so pairs are
discarded by their largest coordinate difference; survivors are verified.

Only distinct fingerprints enter, and a bucket yields a spanning forest of its
links, not all pairs: components need no more.

keep_one_similar goes the same way to another end, sets of Jaccard similarity
0.8: fingerprints of 192 bits, buckets of sampled bits, a pivot table that
keeps distances byte by byte, and the sets themselves to verify what is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bounded, columnwise, free, tidy
from loomgraph.operators.components import connected_components
from loomgraph.session import Stored

SEED, WORDS, MOST = 42, 4, 4
#: keep_one_similar: words of a shingle, and the percentage of shingles that near copies share at least.
COPY_WORDS, SIMILAR = 5, 80
#: Words of 64 bits of the fingerprint by which near copies are sought.
COPY_FP = 3
#: Probability that one bit tells two sets of Jaccard 0.8 apart: their angle over pi.
APART = math.acos(2 * SIMILAR / (100 + SIMILAR)) / math.pi
#: Computed probability that a pair at Jaccard 0.8 agrees on one table's bits at least.
MEET = 0.9996
#: Parts of the reference fingerprints, one byte each; a table of distances has them for every byte.
BYTE_PIVOTS = (0b00000000, 0b00001111, 0b00110011, 0b01010101, 0b01101001)
#: Runs of a table up to this length are compared pair by pair, vectorised over all of them.
RUN = 256
#: Fingerprints that one shard of a table holds; tables that are dealt at once, the first two times fewer.
SHARD, DEALT, FIRST = 1 << 17, 160, (2, 14)
#: Reference fingerprints of the table.
PIVOTS = 16
#: Runs up to this length are compared pair by pair, vectorised over all of them.
SHORT = 12
#: Rows of a bucket that one task compares; larger buckets are cut into pieces, and every two pieces meet.
PIECE = 4096
#: Bytes of sets that one piece holds.
PIECE_BYTES = 16 << 20


def pivots(n: int = PIVOTS) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of one text's shingles in order, repeats included; none without words."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()  # of bytes: A-Z only; at space and 0x09 to 0x0D
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(tokens))
    spans = zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in spans), np.uint64, len(tokens) - k + 1)


def fingerprint_of(text: bytes, words: int = WORDS) -> int:
    """Unsigned fingerprint of one text's UTF-8 bytes; 0 without words."""
    return majority(shingle_hashes(text, words))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """Fingerprint as a signed 64-bit number of a text column; 0 for null and for texts without words."""

    @columnwise("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint_of(t or b"", words) for t in texts.to_pylist()), np.uint64, len(texts)).view(np.int64))

    return run.asNondeterministic()(text.cast("binary"))


def blocks_for(n: int) -> int:
    """Blocks so that a bucket of unrelated fingerprints stays small: 6 (keys of 21 bits) to 64 million, then 7 and 8."""
    return 6 if n < 1 << 26 else 7 if n < 1 << 31 else 8


def masks(blocks: int, agree: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, agree)]


class Forest:
    """Union-find over the positions of one bucket."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _near(table: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Which pairs the pivot table cannot discard: a few coordinates first, the rest for what is left."""
    left = np.arange(len(i))
    for lo in range(0, table.shape[1], 4):
        part = np.abs(table[i[left], lo : lo + 4] - table[j[left], lo : lo + 4]).max(axis=1, initial=0)
        left = left[part <= most]
    return left


def links(fps: np.ndarray, most: int = MOST, pivot: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints (positions).

    Each fingerprint within `most // 2` bits of an earlier centre joins that
    centre's ball; all of a ball are linked. Balls can be linked only if their
    centres are within 2 * most; those not yet connected are compared member by
    member through the pivot table.
    """
    forest, out, balls = Forest(len(fps)), [], []
    rest = np.arange(len(fps))
    while len(rest):
        d = np.bitwise_count(fps[rest] ^ fps[rest[0]])
        ball = rest[d <= most // 2]
        balls.append(ball)
        for m in ball[1:].tolist():
            if forest.join(int(ball[0]), m):
                out.append((int(ball[0]), m))
        rest = rest[d > most // 2]
    centres = np.fromiter((b[0] for b in balls), np.int64, len(balls))
    at = fps[centres]
    table = np.bitwise_count(fps[:, None] ^ (pivots() if pivot is None else pivot)[None, :]).astype(np.int16)
    for x in range(len(balls)):
        d = np.bitwise_count(at[x + 1 :] ^ at[x])
        for y in (np.flatnonzero(d <= 2 * (most // 2) + most) + x + 1).tolist():
            if forest.root(int(centres[x])) == forest.root(int(centres[y])):
                continue
            for m in balls[x].tolist():  # a row of one ball against the other
                other = balls[y]
                left = _near(table, np.full(len(other), m), other, most)
                hit = left[np.bitwise_count(fps[other[left]] ^ fps[m]) <= most]
                if len(hit):
                    forest.join(m, int(other[hit[0]]))
                    out.append((m, int(other[hit[0]])))
                    break
    return out


def _bucket_links(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; both arrays sorted by key."""
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int16)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(keys)))
    run = np.repeat(size, size)
    a, b = [], []
    short = run <= SHORT
    for step in range(1, SHORT):
        i = np.flatnonzero(short[:-step] & (keys[:-step] == keys[step:])) if len(keys) > step else np.zeros(0, np.int64)
        if not len(i):
            break
        left = i[_near(table, i, i + step, most)]
        left = left[np.bitwise_count(fps[left] ^ fps[left + step]) <= most]
        a.append(fps[left]), b.append(fps[left + step])
    for s, n in zip(starts[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
        part = fps[s : s + n]
        if found := links(part, most):
            i, j = np.asarray(found).T
            a.append(part[i]), b.append(part[j])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _keys(agree: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, m in enumerate(agree):
                x = (fps & np.uint64(m)) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                key = (x ^ (x >> np.uint64(29))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], ["key", "fp"])

    return run


def _meet(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        key = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
        fps = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held]).view(np.uint64)
        by = np.lexsort((fps, key))
        a, b = _bucket_links(key[by], fps[by], most)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].view(np.int64)), pa.array(pair[:, 1].view(np.int64))], ["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, n: int, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect whatever is connected among distinct fingerprints (one column, n rows)."""
    spark = fps.sparkSession
    blocks = blocks_for(n)
    agree = masks(blocks, blocks - most)
    rows = fps.toDF("fp").mapInArrow(tidy(_keys(agree)), "key long, fp long")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(agree) // 400_000)
    hot = rows.groupBy("key").count().where(F.col("count") > PIECE).withColumn("pieces", F.ceil(F.col("count") * 2 / PIECE).cast("int")).drop("count")
    cut = rows.join(hot, "key", "left")
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces"))
    other = F.explode(F.when(F.col("pieces").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.select("key", "fp", "pieces", piece.alias("piece"), other.alias("other"))
    of = F.when(F.col("pieces").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("piece", "other"), F.greatest("piece", "other")))
    return cut.select(of.alias("key"), "fp").repartition(tasks, "key").mapInArrow(tidy(_meet(most)), "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most: int = MOST) -> DataFrame:
    """One row for each row of df: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id among all documents that links reach,
    the document's own included. Shingles are of `words` words of the whole
    text, repeats included; a shorter text is one shingle; null and wordless
    texts have fingerprint 0 and link like any other. Equal fingerprints meet
    once, so exact copies cost nothing here. Repeated rows each give a row; a
    null id never is a component's id unless the component has no other.
    Columns besides id and text, whatever their names, are not read; an empty
    table gives an empty result.
    """
    bounded(df.sparkSession)
    stored = Stored(df.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")), "fingerprints")
    table = stored.read()
    firsts = table.groupBy("fp").agg(F.min("doc_id").alias("first"))
    own = Stored(firsts, "distinct-fingerprints").read()
    links = fingerprint_links(own.select("fp"), own.count(), most)
    # nodes in the order of their first document, so that a component's root names its smallest id
    node = F.struct(F.col("first").isNull().alias("none"), "first", "fp")
    for side in ("a", "b"):
        links = links.join(own.select(F.col("fp").alias(side), node.alias(f"{side}_node")), side)
    linked = connected_components(links.select("a_node", "b_node")).select("node.fp", F.col("root.first").alias("least"))
    of = own.join(linked, "fp", "left").select("fp", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    of = Stored(of, "component-ids").read()  # so that the next join starts at its own exchange and AQE can split what many copies share
    return table.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def names(words: np.ndarray) -> np.ndarray:
    """A 64-bit name of each wide fingerprint (rows); two that share one are only held against each other once more."""
    x = np.zeros(len(words), np.uint64)
    for w in words.T:
        x = mixed((x ^ w) + np.uint64(0x9E3779B97F4A7C15))
    return x


def sketch_of(text: bytes) -> tuple[int, int, list[int], bytes, int]:
    """Digest of a text's set of five-word shingles, its fingerprint's first word, the others, the set (sorted 32-bit hashes), the fingerprint's name."""
    from xxhash import xxh3_64_intdigest

    u = np.unique(shingle_hashes(text, COPY_WORDS))
    signed = lambda x: np.uint64(x).view(np.int64).item()
    if not len(u):
        return 0, 0, [], b"", 0
    salt = pivots(COPY_FP)
    words = [majority(u), *(majority(mixed(u + x)) for x in salt[1:])]
    name = names(np.asarray([words], np.uint64))[0]
    return signed(xxh3_64_intdigest(u.tobytes())), signed(words[0]), list(map(signed, words[1:])), np.unique(u >> np.uint64(32)).astype("<u4").tobytes(), signed(name)


def sketch(text: Column) -> Column:
    @columnwise("key long, fp long, more array<long>, shingles binary, name long")
    def run(texts: pa.Array) -> pa.Array:
        cols = list(zip(*(sketch_of(t or b"") for t in texts.to_pylist()), strict=True)) or [[], [], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "fp", "more", "shingles", "name"])

    return run.asNondeterministic()(text.cast("binary"))


def radius(bits: int) -> int:
    """Bits by which fingerprints at Jaccard 0.8 differ: the mean and five deviations."""
    return round(bits * APART + 5 * math.sqrt(bits * APART * (1 - APART)))


class PivotTable:
    """Distances of wide fingerprints (rows of 64-bit words) to the reference fingerprints, byte by byte.

    In each byte no pivot's two distances differ by more than the two
    fingerprints do, so the largest differences, added up over the bytes, are
    at most their Hamming distance: a pair whose sum is over the radius is
    discarded without a loss. Distances over all 192 bits at once discard
    nothing at this radius: unrelated fingerprints are about equally far from
    any reference.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        of = np.bitwise_count(np.arange(256, dtype=np.uint8)[None, :] ^ np.asarray(BYTE_PIVOTS, np.uint8)[:, None]).astype(np.int8)
        at = np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1)
        self.far = [x[at].view(np.uint64) for x in of]
        self.most = radius(64 * words.shape[1])

    def bound(self, i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        """What the table says each pair differs by at least."""
        most = None
        for x in self.far:
            d = x.take(i, axis=0).view(np.int8)
            d -= x.take(j, axis=0).view(np.int8)
            np.abs(d, out=d)
            most = d if most is None else np.maximum(most, d, out=most)
        total = np.zeros(len(i), np.uint64)
        for x in most.view(np.uint64).T:  # a byte holds 8 at most, so the sum of eight fits one
            total += (x * np.uint64(0x0101010101010101)) >> np.uint64(56)
        return total

    def near(self, i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        """Places of the pairs within the radius: those the table cannot discard, verified."""
        left = np.flatnonzero(self.bound(i, j) <= self.most)
        other = self.words[j] if np.isscalar(j) else self.words[j[left]]
        return left[np.bitwise_count(self.words[i[left]] ^ other).sum(axis=1, dtype=np.int64) <= self.most]


@lru_cache(maxsize=64)
def meets(bits: int, tables: int, of: int = 64 * COPY_FP) -> float:
    """Probability that two sets of Jaccard 0.8 agree on all of some table's bits, for as many bits of a fingerprint, drawn anew for each table."""
    at = lambda h: math.comb(of, h) * APART**h * (1 - APART) ** (of - h)
    return sum(at(h) * (1 - (1 - math.comb(of - h, bits) / math.comb(of, bits)) ** tables) for h in range(of + 1))


def tables_for(n: int) -> np.ndarray:
    """Masks (tables x words) of the bits that each table's keys take: 14 of them to a million fingerprints, then one more for each doubling."""
    bits = max(14, math.ceil(math.log2(max(1, n))) - 6)
    tables = 8
    while meets(bits, tables) < MEET:
        tables += 8
    r = np.random.Generator(np.random.PCG64(SEED))
    drawn = np.zeros((tables, 64 * COPY_FP), np.uint8)
    for row in drawn:
        row[r.permutation(64 * COPY_FP)[:bits]] = 1
    return np.packbits(drawn, axis=1, bitorder="little").view("<u8")


def _table_keys(words: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return names(words & mask[None, :])


def _groups(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that links (i, j) reach, for each of n."""
    of = np.arange(n)
    while len(i):
        low = np.minimum(of[i], of[j])
        np.minimum.at(of, of[i], low)
        np.minimum.at(of, of[j], low)
        while (of[of] != of).any():
            of = of[of]
        apart = of[i] != of[j]
        i, j = i[apart], j[apart]
    return of


def candidates(keys: np.ndarray, words: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of parts that connect whatever is connected by pairs of equal key within the radius; all arrays sorted by key.

    part numbers what is connected already, from 0; without it each position is
    a part. Positions of one part are not held against each other. A pair is a
    part and the smallest that it reaches.
    """
    n, table = len(keys), PivotTable(words)
    part = np.arange(n) if part is None else part
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, n))
    a, b = [], []
    i, step = np.flatnonzero(np.repeat(size, size) <= RUN), 1
    while len(i := i[i + step < n]) and len(i := i[keys[i] == keys[i + step]]):
        apart = i[part[i] != part[i + step]]
        for lo in range(0, len(apart), 4096):  # what a processor's cache holds
            some = apart[lo : lo + 4096]
            hit = some[table.near(some, some + step)]
            a.append(hit), b.append(hit + step)
        step += 1
    for s, m in zip(starts[size > RUN].tolist(), size[size > RUN].tolist(), strict=True):
        rest, queue = np.arange(s, s + m), []
        while len(rest):  # spreads from one part to all that it reaches; those reached are held against the rest only
            if not queue:
                reached = part[rest] == part[rest[0]]
            else:
                x = queue.pop()
                hit = rest[table.near(rest, x)]
                if not len(hit):
                    continue
                a.append(np.full(len(hit), x)), b.append(hit)
                reached = np.isin(part[rest], part[hit])
            queue += rest[reached].tolist()
            rest = rest[~reached]
    none, parts = np.zeros(0, np.int64), int(part.max(initial=-1)) + 1
    of = _groups(parts, part[np.concatenate([none, *a])], part[np.concatenate([none, *b])])
    other = np.flatnonzero(of != np.arange(parts))
    return of[other], other


def _deal_copies(masks: np.ndarray, shards: int):
    """For each table and shard the fingerprints whose keys fall there, packed; those that have a root come first, with it."""

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.concatenate([np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]], axis=1) for b in held]).view(np.uint64)
        root = pa.chunked_array([b.columns[-1] for b in held])
        single = root.is_null().to_numpy()
        words, root = words[np.argsort(single, kind="stable")], root.drop_null().to_numpy()
        blocks, packed, roots = [], [], []
        for t, mask in enumerate(masks):
            shard = _table_keys(words, mask) % np.uint64(shards)
            by = np.argsort(shard, kind="stable")
            at = np.searchsorted(shard[by], np.arange(shards + 1))
            for k in range(shards):
                if at[k] < at[k + 1]:
                    blocks.append(t * shards + k)
                    mine = by[at[k] : at[k + 1]]
                    packed.append(words[mine].tobytes())
                    roots.append(root[mine[mine < len(root)]].tobytes())
            if len(blocks) >= 8 or t + 1 == len(masks):
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(packed, pa.binary()), pa.array(roots, pa.binary())], ["block", "words", "roots"])
                blocks, packed, roots = [], [], []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD:
                yield from dealt(held)
                held = []
        if held:
            yield from dealt(held)

    return run


def _meet_copies(masks: np.ndarray, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for block, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(block, []).append(packed)
        for block in sorted(held):
            packed, roots = zip(*held.pop(block), strict=True)
            words = np.frombuffer(b"".join(packed), np.uint64).reshape(-1, COPY_FP)
            root = names(words).view(np.int64)
            start = 0
            for x, known in zip(packed, roots, strict=True):
                root[start : start + len(known) // 8] = np.frombuffer(known, np.int64)
                start += len(x) // (8 * COPY_FP)
            keys = _table_keys(words, masks[block // shards])
            by = np.argsort(keys, kind="stable")
            node, part = np.unique(root[by], return_inverse=True)
            i, j = candidates(keys[by], words[by], part)
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).view(np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names(words).view(np.int64))], [*batch.schema.names, "name"])


def copy_groups(fps: DataFrame, n: int) -> DataFrame:
    """(node, root): names of the fingerprints that candidate pairs connect, of n distinct ones (columns of words).

    Tables are dealt a few first. What they connect goes into the next by its
    root, so that those yield only links between groups, each the same from
    every table that has it: a large group's links number about its members,
    not its members times the tables.
    """
    spark = fps.sparkSession
    masks, partitions = tables_for(n), int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = fps.mapInArrow(tidy(_named), ", ".join(f"{c} long" for c in (*fps.columns, "name")))
    groups, lo, few = None, 0, list(FIRST)
    while lo < len(masks):
        some = masks[lo : lo + (few.pop(0) if few else DEALT)]
        lo += len(some)
        shards = max(-(-n // SHARD), -(-partitions // len(some)))
        tasks = max(partitions, n * len(some) // 2_000_000)
        if groups is None:
            rows = fps.withColumn("root", F.lit(None).cast("long"))
        else:
            rows = named.join(groups.withColumnRenamed("node", "name"), "name", "left").select(*fps.columns, "root")
        dealt = rows.mapInArrow(tidy(_deal_copies(some, shards)), "block long, words binary, roots binary")
        found = dealt.repartition(tasks, "block").mapInArrow(tidy(_meet_copies(some, shards)), "a long, b long").distinct()
        found = Stored(found, "copy-candidates").read()
        free(spark)  # of the tables' shuffle
        if groups is None or not found.isEmpty():
            known = found if groups is None else found.union(groups.where("node <> root").select("root", "node"))
            groups = Stored(connected_components(known), "copy-groups").read()
    return groups


def set_links(fps: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (positions) that connect whatever is connected among non-empty sets of Jaccard similarity SIMILAR or more.

    Of each set fps holds the fingerprint: a word, or a row of words.

    Two such sets share one of the rarest elements of each: as many as may be
    missing, and one. Sets that do so meet; the pivot table and the
    fingerprints discard pairs, and what survives is counted out. Pairs already
    connected are passed over, so a group of copies costs no square.
    """
    n, out = len(sets), []
    size = np.fromiter(map(len, sets), np.int64, n)
    start = np.cumsum(size) - size
    _, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(count))
    row = np.repeat(np.arange(n), size)
    of = of[np.lexsort((place[of], row))]
    may_miss = size - (SIMILAR * size + 99) // 100
    rare = np.flatnonzero((np.arange(len(of)) - start[row] <= may_miss[row]) & (count[of] > 1))
    by = np.lexsort((row[rare], of[rare]))
    holders = row[rare][by]
    at = np.empty(len(by), np.int64)
    at[by] = np.arange(len(by))  # of each rare element of each set, its place among the element's holders
    first = np.searchsorted(of[rare][by], of[rare])
    bound = np.searchsorted(row[rare], np.arange(n + 1))
    table = PivotTable(fps.reshape(n, -1))
    part_of, met, mine = np.arange(n), np.zeros(n, bool), np.zeros(len(count), bool)
    for i in range(1, n):
        for k in range(bound[i], bound[i + 1]):
            met[holders[first[k] : at[k]]] = True
        meet = np.flatnonzero(met[:i])
        if not len(meet):
            continue
        met[meet] = False
        meet = meet[100 * np.minimum(size[meet], size[i]) >= SIMILAR * np.maximum(size[meet], size[i])]
        meet = meet[table.near(meet, i)]
        mine[of[start[i] : start[i] + size[i]]] = True
        step = 1
        while len(meet):
            now, meet = meet[:step], meet[step:]
            held = mine[np.concatenate([of[start[j] : start[j] + size[j]] for j in now.tolist()])]
            both = np.add.reduceat(held, np.cumsum(size[now]) - size[now], dtype=np.int64)
            for j in now[100 * both >= SIMILAR * (size[now] + size[i] - both)].tolist():
                if part_of[i] != part_of[j]:
                    out.append((j, i))
                    part_of[part_of == part_of[j]] = part_of[i]
            meet, step = meet[part_of[meet] != part_of[i]], 2 * step
        mine[of[start[i] : start[i] + size[i]]] = False
    return out


def _meet_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In runs of equal blocks the links from each component's smallest key to its others; holds one run at a time."""

    def linked(keys: list[int], fps: list[int], more: list[list[int]], sets: list[bytes]) -> pa.RecordBatch:
        words = np.asarray([[x, *y] for x, y in zip(fps, more, strict=True)], np.int64).view(np.uint64)
        found = set_links(words, [np.frombuffer(x, "<u4") for x in sets]) if len(keys) > 1 else []
        order = np.argsort(np.asarray(keys, np.int64), kind="stable")
        at = np.argsort(order)
        i, j = at[np.asarray(found, np.int64).reshape(-1, 2)].T
        of = _groups(len(keys), i, j)  # of places in the order of keys, so a group's smallest is its root
        pairs = [(keys[order[of[k]]], keys[order[k]]) for k in np.flatnonzero(of != np.arange(len(keys))).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    block, held = None, ([], [], [], [])
    for batch in batches:
        for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != block:
                yield linked(*held)
                block, held = b, ([], [], [], [])
            for column, x in zip(held, row, strict=True):
                column.append(x)
    yield linked(*held)


def similar_roots(own: DataFrame) -> DataFrame:
    """(node, root) of distinct sets that links connect, the roots' own rows left out at times: rows of key, fp, more, shingles and name.

    Fingerprints that agree on all bits of a table meet there, the pivot table
    discards pairs, and what it leaves within the radius is a candidate. The
    sets that candidates connect are a group; only they are shipped, each once,
    and every link is verified. Larger groups than PIECE members or PIECE_BYTES
    are cut into pieces, and every two pieces meet; only then are there links
    of one component in several blocks, which have to be connected.
    """
    spark = own.sparkSession
    own = own.where(F.octet_length("shingles") > 0)
    words = [F.col("fp"), *(F.col("more")[i].alias(f"w{i}") for i in range(COPY_FP - 1))]
    fps = Stored(own.select(*words).distinct(), "copy-fingerprints").read()
    roots = copy_groups(fps, fps.count()).select(F.col("node").alias("name"), "root")
    member = own.select("key", "name", F.octet_length("shingles").cast("long").alias("bytes")).join(roots, "name", "left")
    member = member.select("key", "bytes", F.coalesce("root", "name").alias("group"))
    groups = member.groupBy("group").agg(F.count("*").alias("n"), F.sum("bytes").alias("all")).where("n > 1")
    pieces = F.ceil(F.greatest(F.col("n") / PIECE, F.col("all") / PIECE_BYTES)).cast("int")
    met = member.join(groups.select("group", pieces.alias("pieces")), "group")
    stored = Stored(met, "group-members")
    free(spark)
    met = stored.read()
    total, most = met.agg(F.sum(F.col("bytes") * F.col("pieces")), F.max("pieces")).first()
    total = total or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PIECE_BYTES)
    piece = F.pmod(F.xxhash64("key", F.lit(2)), F.col("pieces")).cast("int")
    met = met.join(own.select("key", "fp", "more", "shingles"), "key").withColumn("piece", piece)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    block = F.xxhash64("group", F.least("piece", "other"), F.greatest("piece", "other"))
    met = met.select(block.alias("block"), "key", "fp", "more", "shingles").repartition(tasks, "block").sortWithinPartitions("block")
    found = Stored(met.mapInArrow(tidy(_meet_sets), "a long, b long").distinct(), "similar-pairs").read()
    stored.drop()
    free(spark)  # of the shuffles that gathered the sets
    return connected_components(found) if (most or 0) > 1 else found.select(F.col("b").alias("node"), F.col("a").alias("root"))


def keep_one_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of df for each component, with df's columns: that of the smallest id, null ids last, then of the smallest hash of the text.

    Documents link when the Jaccard similarity of their sets of five-word
    shingles is 0.8 or more; texts without words link with each other. Pairs
    meet where their fingerprints agree on all bits of one of many tables (a
    pair at 0.8 does with probability MEET), pass the pivot table, and every
    link is verified on the sets. Equal sets are one node. Rows leave a bucket
    as links that connect, never as all its pairs. Of
    rows that repeat both id and text one stays. No column's name clashes; an
    empty table gives an empty result.
    """
    bounded(df.sparkSession)
    version = F.xxhash64(F.col(text_col))
    rows = df.select(F.col(id_col).alias("doc_id"), version.alias("version"), sketch(F.col(text_col)).alias("s")).select("doc_id", "version", "s.*")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("first")
    own = Stored(rows.groupBy("key").agg(first, *[F.first(c).alias(c) for c in ("fp", "more", "shingles", "name")]), "distinct-sets").read()
    free(df.sparkSession)
    roots = similar_roots(own).withColumnRenamed("node", "key")
    stay = own.select("key", "first").join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
    stay = Stored(stay.select("first.doc_id", "first.version"), "staying").read()
    same = lambda x: F.col("row")[id_col].eqNullSafe(x["doc_id"]) & (F.col("of_text") == x["version"])
    kept = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), version.alias("of_text"))
    kept = kept.join(stay, same(stay), "left_semi")
    again = df.select(F.col(id_col).alias("doc_id"), version.alias("version")).groupBy("doc_id", "version").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "version")
    again = Stored(again, "repeated-rows").read()
    if not again.isEmpty():
        one = kept.join(again, same(again), "left_semi").groupBy(F.col("row")[id_col], "of_text").agg(F.first("row").alias("row"))
        kept = kept.join(again, same(again), "left_anti").select("row").unionByName(one.select("row"))
    return kept.select("row.*")
