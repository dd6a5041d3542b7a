"""Filter interaction audit: what five filters remove in each of the 120 orders they can be applied in.

A document's failures are one of 32 sets. For each set and each order a table,
computed once, names the step that removes the document (5: none does). An
Arrow function looks every document's 120 steps up and counts part, order,
step and label with np.bincount; only those counts are shuffled and summed.

What a filter fails alone and in all follows from the same counts: in an order
that begins with it, it removes all that fail it; in one that ends with it,
what fails nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bounded
from loomgraph.session import Stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
UPPER = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
#: A text is hot if more than one row in so many has it.
HOT = 1000
#: Parts whose counts a task holds before it hands them on (23 KB each).
PARTS_HELD = 256


def first_failures() -> np.ndarray:
    """By set of failures (bit i: filter i) and order: the step, from 0, of the first filter that fails, 5 if none does."""
    out = np.full((1 << len(FILTERS), len(ORDERS)), len(FILTERS), np.int64)
    for o, order in enumerate(ORDERS):
        for step in reversed(range(len(order))):
            fails = np.arange(len(out)) >> FILTERS.index(order[step]) & 1 == 1
            out[fails, o] = step
    return out


def text_failures(text: bytes) -> int:
    """The filters A to D that a text fails, as bits: under 50 words, few distinct words, many capitals, a mark."""
    words = text.split()  # of bytes: at \x20 and \x09 to \x0D
    n_chars = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    capitals = len(text) - len(text.translate(None, UPPER))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * n_chars) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3


def measured(df: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, doc_id, failures A to D as bits, and a digest of the text, for every row; texts go no further."""
    bounded(df.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("t").to_pylist()]
            fails = pa.array([text_failures(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), fails, digests], ["part", "doc_id", "fails", "digest"])

    rows = df.select(F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    return rows.mapInArrow(measure, "part string, doc_id long, fails int, digest binary")


def removals(rows: DataFrame) -> DataFrame:
    """rows: part, fails (0 to 31) and label (0 to 3). Per part and order: n, by step (0 to 5) and label, as one array of 24."""
    steps, n_orders, cells = first_failures(), len(ORDERS), 6 * 4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def handed_on() -> pa.RecordBatch:
            parts = np.repeat(np.array(list(held), object), n_orders)
            n = np.concatenate(list(held.values())).reshape(-1, cells)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * cells), pa.array(n.ravel()))
            out = pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(np.tile(np.arange(n_orders, dtype=np.int32), len(held))), lists], ["part", "o", "n"])
            held.clear()
            return out

        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            names, part = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            kinds, times = np.unique((part * 32 + batch.column("fails").to_numpy()) * 4 + batch.column("label").to_numpy(), return_counts=True)
            for k, name in enumerate(names):
                of = kinds // 128 == k
                fails, label = kinds[of] // 4 % 32, kinds[of] % 4
                at = (np.arange(n_orders) * 6 + steps[fails]) * 4 + label[:, None]
                n = np.bincount(at.ravel(), np.repeat(times[of], n_orders), n_orders * cells).astype(np.int64)
                held[name] = held[name] + n if name in held else n
                if len(held) >= PARTS_HELD:
                    yield handed_on()
        if held:
            yield handed_on()

    partial = rows.mapInArrow(count, "part string, o int, n array<long>")
    return partial.groupBy("part", "o").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(cells)])


def filter_audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is an empty one; a null part counts with the empty string. A
    row fails E if another row of the table has the same text and a smaller
    id; a null id is smaller than none and larger than none. Repeated rows
    count each. A document with several label rows is good, or toxic, if one
    of them says so; one without labels is neither. Other columns, whatever
    their names, are not read; an empty table gives an empty result.

    Texts are read once. Rows of about 60 bytes get the first id of their text:
    by a broadcast where one text has over a HOT-th of all rows (fewer than HOT
    can), by a shuffle of the rest; then their labels. A row for each part and
    order leaves a task of the audit.
    """
    rows = Stored(measured(df, id_col, text_col, part_col), "audit-rows").read()
    first = Stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"), "audit-repeated").read()
    often = F.col("times") > rows.count() / HOT
    hot, rest = F.broadcast(first.where(often).select("digest", "first")), first.where(~often).select("digest", "first")
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    label = labels.groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id")).agg((said("quality") + 2 * said("toxic")).alias("label")).where("label > 0")
    of = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(rest, "digest", "left")).join(label, "doc_id", "left")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    n = removals(of.select("part", (F.col("fails") + 16 * late).alias("fails"), F.coalesce("label", F.lit(0)).alias("label")))
    return by_step(n)


def _sum(cells: list[int]) -> Column:
    return sum((F.col(f"n{i}") for i in cells[1:]), F.col(f"n{cells[0]}"))


def by_step(n: DataFrame) -> DataFrame:
    """The report out of the counts that removals() gives."""
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("o") + 1)
    later = lambda s: _sum([4 * j + k for j in range(s + 1, 6) for k in range(4)])  # noqa: E731  removed by a later step, or never
    steps = F.array(*[
        F.struct(F.lit(s + 1).alias("step"), later(s).alias("kept"), _sum([4 * s + k for k in range(4)]).alias("removed"), _sum([4 * s + 1, 4 * s + 3]).alias("good_lost"), _sum([4 * s + 2, 4 * s + 3]).alias("toxic_lost"))
        for s in range(5)
    ])
    rows = n.select("part", order.alias("filter_order"), F.explode(steps).alias("s")).select("part", "filter_order", "s.*")
    rows = rows.withColumn("filter", F.col("filter_order").substr(F.col("step"), F.lit(1)))
    one = Window.partitionBy("part", "filter")  # 120 rows
    alone = lambda step: F.max(F.when(F.col("step") == step, F.col("removed"))).over(one)
    return rows.select(
        "part", "filter_order", "step", "kept", "removed", (alone(1) - F.col("removed")).alias("redundant"), alone(5).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(one).alias("shapley"),
    )
