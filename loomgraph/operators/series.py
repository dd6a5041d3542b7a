"""Operators over ordered rows: running sums, islands, ledgers, keyed state in batch form."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cumulative(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Running sum within groups."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def islands(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Spans merged where they overlap or touch (start <= last end + 1), with how many went in."""
    w = Window.partitionBy(*by).orderBy(start, end)
    last = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(last.isNull() | (F.col(start) > last + 1), 1).otherwise(0))
    return marked.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_isle")


def sessions(df: DataFrame, by: str, ts: str, gap: str) -> DataFrame:
    """Sessions: a pause of `gap` or more starts a new one; an event table's own window operator, so partial sessions merge before the shuffle."""
    out = df.groupBy(by, F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return out.drop("w")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """T5: each key's first row: what a stateful deduplication lets through."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def buckets(df: DataFrame, ts: str) -> DataFrame:
    """Counters by month and by ISO week."""
    t = F.col(ts)
    month = df.groupBy(F.date_format(t, "yyyy-MM").alias("bucket")).agg(F.count("*").alias("n"))
    week = df.groupBy(F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), t), F.weekofyear(t)).alias("bucket")).agg(F.count("*").alias("n"))
    return month.union(week)


def followed(cards: DataFrame, edits: DataFrame, by: str, minutes: int = 30) -> DataFrame:
    """Edits that follow a card of the same key within its life and before the next card; each card counts an edit's kind once.

    cards and edits: (by, id, ts); edits also kind. Batch form of keyed state
    with expiry: the latest card before each edit is found by one running
    window over both kinds of rows, no range join.
    """
    a = cards.select(by, "ts", F.col("id").alias("card"), F.lit(None).cast("long").alias("edit"), F.lit(None).cast("string").alias("kind"))
    b = edits.select(by, "ts", F.lit(None).cast("long").alias("card"), F.col("id").alias("edit"), "kind")
    w = Window.partitionBy(by).orderBy("ts", F.coalesce("edit", "card")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("card").isNotNull(), F.struct("card", F.col("ts").alias("at"))), ignorenulls=True).over(w)
    hit = a.union(b).withColumn("l", last).where("edit IS NOT NULL AND l IS NOT NULL")
    fresh = hit.where(F.col("ts") <= F.col("l.at") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return first_per_key(fresh.select(by, F.col("l.card").alias("card"), "edit", "kind", "ts"), ["card", "kind"], ["ts", "edit"])


def confidence_interval(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a share."""
    p = hits / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def upper_medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """Of each group the element at floor(n / 2) of its sorted values; groups are counted by value first and never gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(by)
    upto = counts.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("all", F.sum("k").over(w))
    return upto.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(by).agg(F.min(value).alias("upper_median"))


def rule_of_three(hits: Column, n: Column) -> Column:
    """Upper bound of a rate never seen in n tries."""
    return F.when((hits == 0) & (n > 0), F.least(F.lit(1.0), 3 / n))


def cliffs_delta(values: DataFrame, by: str, value: str, one: str, other: str) -> DataFrame:
    """Share of pairs in which group `one` is above group `other`, less the share in which it is below; from ranks, without making the pairs."""
    counts = values.where(F.col(by).isin(one, other) & F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(by) == one).alias("n1"), F.count_if(F.col(by) == other).alias("n2"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)  # over distinct values
    below = counts.withColumn("below", F.coalesce(F.sum("n2").over(w), F.lit(0)))
    out = below.agg(F.sum(F.col("n1") * F.col("below")).alias("wins"), F.sum(F.col("n1") * F.col("n2")).alias("ties"), F.sum("n1").alias("a"), F.sum("n2").alias("b"))
    pairs = F.col("a") * F.col("b")
    return out.select(F.when(pairs > 0, (2 * F.col("wins") + F.col("ties") - pairs) / pairs).alias("delta"))


def paired_interval(pairs: DataFrame, a: str, b: str, z: float = 1.959963984540054) -> DataFrame:
    """Mean difference of pairs with its normal interval."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count("d").alias("n"))
    half = z * F.col("sd") / F.sqrt("n")
    return d.select("mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"), "n")


#: A prime below 2^31 and a primitive root of it: powers of the root are the bootstrap's factors.
PRIME, ROOT = 2**31 - 1, 48271


def poisson_steps(most: int = 8) -> list[float]:
    """A uniform number above so many of these counts so often as a Poisson variable of mean 1 is at most `most`."""
    out, total, term = [], 0.0, math.exp(-1)
    for k in range(1, most + 1):
        total += term
        out.append(total)
        term /= k
    return out


def bootstrap_interval(values: DataFrame, value: str, key: str, rounds: int = 200, share: float = 0.05) -> DataFrame:
    """Percentile interval of a mean by a Poisson bootstrap: in each round a row counts as often as a hash of its key says, so no row moves and any order gives the same.

    Each batch adds up all rounds; a row for each round leaves it. Null values
    and keys do not count.
    """
    head = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    hashed = values.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(value).cast("double").alias("v"), (head % PRIME).alias("h"))
    factors, steps = [pow(ROOT, k, PRIME) for k in range(1, rounds + 1)], poisson_steps()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sums, times = [], []
            for f in factors:
                n = np.searchsorted(steps, (h * f % PRIME + 0.5) / PRIME)
                sums.append(float(v @ n))
                times.append(int(n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(range(1, rounds + 1), pa.int32()), pa.array(sums), pa.array(times, pa.int64())], ["round", "s", "n"])

    means = hashed.mapInArrow(add, "round int, s double, n long").groupBy("round").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(share / 2)).alias("lo"), F.percentile("mean", F.lit(1 - share / 2)).alias("hi"))


def scored(found: DataFrame, truth: DataFrame, by: str, key: str) -> DataFrame:
    """Precision and recall of each group's found set against its true set; 0 where a set is empty."""
    f, t = found.select(by, key).distinct().withColumn("f", F.lit(1)), truth.select(by, key).distinct().withColumn("t", F.lit(1))
    both = f.join(t, [by, key], "full").groupBy(by).agg(F.count("f").alias("found"), F.count("t").alias("true"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("hit"))
    share = lambda n: F.when(F.col(n) > 0, F.col("hit") / F.col(n)).otherwise(0.0)
    return both.select(by, "found", "true", "hit", share("found").alias("precision"), share("true").alias("recall"))
