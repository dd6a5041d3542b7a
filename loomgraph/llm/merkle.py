"""Merkle manifest of a dataset: a tree of digests over rows, with each row's path to the root.

Leaves of a group, in order, stand in runs of three; each run's digests give
the digest above them, until one is left. The tree is built by blocks of 3^7
leaves that stand at multiples of 3^7: a task goes through a block in
postorder, returns its digest and adds to the leaves below, on the way back,
the digests beside their path. Block digests are the leaves of the next,
2187 times smaller, traversal; the digests of the groups those of the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from loomgraph.session import Stored

RUN = 3
#: Levels of a block.
HEIGHT = 7


def H(parts: list[bytes]) -> bytes:
    """Lower-case hexadecimal SHA-256 of what the parts give in a row."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def levels(n: int) -> int:
    """Levels above n leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // RUN), out + 1
    return out


def traverse(leaves: list[bytes], height: int) -> tuple[bytes, list[list[bytes]]]:
    """The digest of a block, `height` levels above its leaves, and for each leaf the digests beside its path, lowest first."""
    beside: list[list[bytes]] = [[] for _ in leaves]

    def at(lo: int, h: int) -> bytes:
        if h == 0:
            return leaves[lo]
        span = RUN ** (h - 1)
        starts = range(lo, min(lo + RUN * span, len(leaves)), span)
        below = [at(s, h - 1) for s in starts]
        for i, s in enumerate(starts):
            others = below[:i] + below[i + 1 :]
            if others:
                for own in beside[s : s + span]:
                    own += others
        return H(below)

    return at(0, height), beside


def fold(leaf: bytes, place: int, n: int, beside: Iterator[bytes]) -> bytes:
    """The digest above a leaf at `place` of n, with what stands beside its path."""
    while n > 1:
        size = min(RUN, n - place // RUN * RUN)
        others = [next(beside) for _ in range(size - 1)]
        k = place % RUN
        leaf, place, n = H(others[:k] + [leaf] + others[k:]), place // RUN, -(-n // RUN)
    return leaf


def field(value: Column) -> Column:
    """A value as the manifest has it: - for null, else its UTF-8 byte count, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def placed(leaves: DataFrame, order: list[str], name: str) -> Stored:
    """leaves (g, digest and more) with `place`, from 0 in the order of its group g, and `n`, the group's size.

    Rows are sorted once by ranges of (g, order, digest), so that a group with
    most of the rows lies in many tasks; each task numbers what it has of a
    group, and the counts, one a task and group, say where it starts. Rows
    alike in all of these are told apart by a number of their own.
    """
    keys = ["g", *order, "digest", "tie"]
    rows = leaves.withColumn("tie", F.monotonically_increasing_id())
    cut = rows.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("task", F.spark_partition_id())
    schema = StructType([*cut.drop("tie").schema.fields, StructField("k", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("g").dictionary_encode(null_encoding="encode")
            names, g = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            k = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
            if last == (names[g[0]],):
                k[: starts[1] if len(starts) > 1 else len(g)] += seen
            last, seen = (names[g[-1]],), int(k[-1]) + 1
            kept = batch.select([c for c in batch.schema.names if c != "tie"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(k, pa.int64())], [*kept.schema.names, "k"])

    numbered = Stored(cut.mapInArrow(number, schema), f"{name}-sorted")
    by_task = numbered.read().groupBy("task", "g").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("g")  # a row for each task that has the group
    start = F.coalesce(F.sum("c").over(w.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = Stored(by_task.select(F.col("task").alias("t"), F.col("g").alias("h"), start.alias("start"), F.sum("c").over(w).alias("n")), f"{name}-starts")
    rows = numbered.read()
    out = rows.join(starts.read(), (rows["task"] == F.col("t")) & rows["g"].eqNullSafe(F.col("h")))
    done = Stored(out.withColumn("place", F.col("start") + F.col("k")).drop("task", "t", "h", "start", "k"), f"{name}-placed")
    numbered.drop()
    starts.drop()
    return done


def blocks(nodes: DataFrame, name: str, height: int) -> Stored:
    """nodes (g, place, n, digest and more) with `beside`, what stands beside their path within their block, `block` and the block's digest `above`.

    A block's rows, 3^height at most, are dealt by group and block and read in order.
    """
    most = RUN**height
    dealt = nodes.withColumn("block", F.expr(f"place div {most}")).repartition("g", "block").sortWithinPartitions("g", "block", "place")
    schema = StructType([*dealt.schema.fields, StructField("beside", BinaryType()), StructField("above", StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            whole, held = split(held)
            yield from done(whole)
        if held is not None:
            yield from done(held)

    def bounds(t: pa.Table) -> np.ndarray:
        b, p = t.column("block").to_numpy(), t.column("place").to_numpy()
        # places ascend within a block; a new block, or a new group with the same block number, begins anew
        return np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (p[1:] != p[:-1] + 1)])) if len(b) else np.array([], int)

    def split(t: pa.Table) -> tuple[pa.Table, pa.Table | None]:
        at = bounds(t)
        return (t.slice(0, at[-1]), t.slice(at[-1])) if len(at) else (t, None)

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        digests, sizes, at = t.column("digest").to_pylist(), t.column("n").to_numpy(), [*bounds(t).tolist(), t.num_rows]
        beside: list[bytes] = []
        above: list[str] = []
        for lo, hi in zip(at, at[1:], strict=False):
            n = int(sizes[lo])
            top, own = traverse([x.encode() for x in digests[lo:hi]], height if n > most else levels(n))
            beside += [bytes.fromhex(b"".join(x).decode()) for x in own]
            above += [top.decode()] * (hi - lo)
        out = t.append_column("beside", pa.array(beside, pa.binary())).append_column("above", pa.array(above, pa.string()))
        yield from out.combine_chunks().to_batches()

    return Stored(dealt.mapInArrow(walk, schema), f"{name}-blocks")


def tree(leaves: DataFrame, order: list[str], name: str, height: int = HEIGHT) -> DataFrame:
    """leaves (g, digest and more) with place, n, `beside`, all that stands beside their path within their group, and the group's digest `top`."""
    block = RUN**height
    passes = [blocks(placed(leaves, order, name).read(), f"{name}-0", height)]
    most = passes[0].read().agg(F.max("n")).first()[0] or 0
    while most > block:  # as often as the largest group needs
        up = passes[-1].read().where((F.col("n") > block) & (F.col("place") == F.col("block") * block))
        n = F.ceil(F.col("n") / F.lit(block)).cast("long")
        passes.append(blocks(up.select("g", F.col("block").alias("place"), n.alias("n"), F.col("above").alias("digest")), f"{name}-{len(passes)}", height))
        most = -(-most // block)
    upper = None
    for p in reversed(passes):
        rows = p.read()
        if upper is None:
            rows = rows.withColumnRenamed("above", "top")
        else:
            u = upper.select(F.col("g").alias("h"), F.col("place").alias("p"), F.col("beside").alias("more"), "top")
            rows = rows.join(u, rows["g"].eqNullSafe(F.col("h")) & (F.col("block") == F.col("p")), "left")
            rows = rows.withColumn("beside", F.concat("beside", F.coalesce("more", F.lit(b"")))).withColumn("top", F.coalesce("top", "above")).drop("h", "p", "more", "above")
        upper = rows.drop("block")
    return upper


def merkle_manifest(df: DataFrame, tampered: Column, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", height: int = HEIGHT) -> DataFrame:
    """One row per row of df: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of `fields`; leaves stand by id in their group,
    groups by name (null first, bytewise) below the root. tampered: of which
    rows the text is folded without its newlines, to see that the root tells.
    Nulls in a field stand as -; a null id comes first and is not tampered
    with unless `tampered` is true of it. Rows of one id are ordered by their
    leaves; rows alike in every field have one leaf and each a place of their
    own. Columns besides `fields` are not read; an empty table gives an empty
    result.
    """
    c = {f: F.col(f"`{f}`") for f in fields}
    fake = {**c, text_col: F.regexp_replace(c[text_col], "\n", "")}
    changed = F.coalesce(tampered, F.lit(False)) & F.coalesce(F.contains(c[text_col], F.lit("\n")), F.lit(False))
    leaves = Stored(df.select(
        F.col(f"`{group_col}`").cast("string").alias("g"), F.col(f"`{id_col}`").alias("doc_id"), leaf_digest(*c.values()).alias("digest"),
        F.when(changed, leaf_digest(*fake.values())).alias("fake"),
    ), "merkle-leaves")
    low = Stored(tree(leaves.read(), ["doc_id"], "merkle", height), "merkle-groups")
    tops = low.read().where("place = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("digest"))
    high = Stored(tree(tops, ["name"], "merkle-top", height).select("name", F.col("place").alias("p"), F.col("n").alias("m"), F.col("beside").alias("more"), F.col("top").alias("root")), "merkle-root")
    rows = low.read()
    out = rows.join(high.read(), rows["g"].eqNullSafe(F.col("name")), "left")
    return out.select("doc_id", "digest", "fake", "place", "n", "beside", "top", "p", "m", "more", "root").mapInArrow(_verify, RESULT.replace("doc_id", f"doc_id {out.schema['doc_id'].dataType.simpleString()}"))


RESULT = "doc_id, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        proofs, folded = [], []
        own = [b.column(c).to_pylist() for c in ("digest", "fake", "place", "n", "beside", "p", "m", "more")]
        for leaf, fake, place, n, beside, p, m, more in zip(*own, strict=True):
            path = (beside + more).hex().encode()
            proofs.append(hashlib.sha256(path).hexdigest())
            steps = iter([path[i : i + 64] for i in range(0, len(path), 64)])
            folded.append(fold(fold((fake or leaf).encode(), place, n, steps), p, m, steps).decode())
        root = b.column("root")
        out = [b.column("doc_id"), b.column("digest"), b.column("top"), root, pa.array(proofs, pa.string()), pa.array(folded, pa.string())]
        yield pa.RecordBatch.from_arrays([*out, pa.compute.equal(out[5], root)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
