"""Streaming counterparts of the incremental operators.

Each takes a streaming DataFrame with an event-time column `ts` and gives a
streaming DataFrame, or a function for foreachBatch; the batch operators in
operators.series give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def flag_once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """T5: each key once within the watermark's reach; state is dropped behind it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def month_counts(events: DataFrame) -> DataFrame:
    """Counters by month and kind; for update or complete mode, as months are no fixed windows."""
    return events.groupBy(F.date_format("ts", "yyyy-MM").alias("bucket"), "kind").agg(F.count("*").alias("n"))


def window_counts(events: DataFrame, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts; a window is final once the watermark has passed it."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n")


def sessions(events: DataFrame, by: str, gap: str, late: str) -> DataFrame:
    """Sessions per key; a session is final once the watermark is a gap behind its last event."""
    s = events.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def followed(rows: DataFrame, by: str, minutes: int = 30) -> DataFrame:
    """(key, card, edit, kind) when an edit follows the key's last card within its life, each kind once a card.

    rows: key, id, kind (`card` or an edit's kind), ts. The state of a key is
    its last card; it expires with the card. Rows of one batch are taken in
    the order of time.
    """
    life = minutes * 60_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        card, at, done = state.get if state.exists else (None, None, "")
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples():
            ms = int(r.ts.timestamp() * 1000)
            if r.kind == "card":
                card, at, done = int(r.id), ms, ""
            elif card is not None and ms <= at + life and r.kind not in done.split("\0"):
                out.append((key[0], card, int(r.id), r.kind))
                done += "\0" + r.kind
        if card is not None:
            state.update((card, at, done))
            mark = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(at + life, mark) + 1)
        yield pd.DataFrame(out, columns=[by, "card", "edit", "kind"])

    kind = rows.schema[by].dataType.simpleString()
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, card long, edit long, kind string", "card long, at long, done string", "append", GroupStateTimeout.EventTimeTimeout)


def upsert(path: str, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the newest row of each key in a table at `path`.

    A batch replaces the rows of its keys in a new generation of the table,
    named by the batch, so a batch that runs again writes the same generation.
    The pointer file is moved last.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, path, number)
        rows = batch if old is None else old.unionByName(batch)
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col(version)).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{path}/generation={number}")

    return write


def current(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The table that upsert keeps: its newest generation (before a batch, if one is named)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("generation=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = [n for n in done if before is None or n < before]
    return spark.read.parquet(f"{path}/generation={max(done)}") if done else None


def stale(listing: DataFrame, known: DataFrame) -> DataFrame:
    """T4: files whose size, time or hash differ from what is known, and those that are new."""
    keys = [c for c in ("file", "size", "mtime", "hash") if c in listing.columns and c in known.columns]
    return listing.join(known.select(keys), keys, "left_anti")


def recompute(candidates: DataFrame, dirty: DataFrame) -> DataFrame:
    """Files that mention a label whose definition changed: (file, label) against (label)."""
    return candidates.join(dirty.select("label").distinct(), "label", "left_semi").select("file").distinct()
