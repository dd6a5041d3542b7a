"""Sharding by histogram sort: shards are ranges of a key, cut so that their bytes are near equal.

The key is a digest of the text, then one of the id, so that equal texts stand
together and a text that fills half the table can still be cut between ids.
Cuts are found without sorting: each round counts, over all partitions, the
exact bytes below probes inside the intervals that still hold a cut, and goes on
in the cells around the targets; when every cut is settled, rows are exchanged
once and numbered. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import Stored

SHARDS = 16
#: An interval is divided into at most 2^BITS cells in a round.
BITS = 10
#: Of a shard's bytes, one in so many may be missed to keep equal texts in one shard.
TOLERANCE = 100
#: A shard of more rows is numbered in as many pieces as hold so many.
PIECE_ROWS = 200_000
#: The key's columns: text, id, and a number that tells rows alike in both apart.
KEY = ("th", "rh", "tie")

#: A place between rows: rows whose key is at or above it come after.
Cut = tuple[int, int, int]


def digest60(value: Column) -> Column:
    """The first 60 bits of the MD5 of a value's decimal or UTF-8 form; of null, those of no bytes."""
    text = F.coalesce(value.cast("string"), F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


@dataclass
class Interval:
    """Rows with key columns `equal` and the next one from lo to hi; `below` bytes come before them."""

    equal: tuple[int, ...]
    lo: int
    hi: int
    below: int
    targets: list[int] = field(default_factory=list)

    def cell(self) -> Column:
        """The number of the cell a row falls into, null outside the interval."""
        at = F.col(KEY[len(self.equal)])
        holds = reduce(Column.__and__, [F.col(c) == v for c, v in zip(KEY, self.equal, strict=False)], at.between(self.lo, self.hi))
        return F.when(holds, F.shiftright(at - F.lit(self.lo), max(0, (self.hi - self.lo).bit_length() - BITS)))


def cuts(rows: DataFrame, targets: list[int], slack: int) -> dict[int, Cut]:
    """For each target, a number of bytes, the cut nearest to it.

    Among the rows of the equal texts that hold the target that is the start or
    the end of them, if it is within `slack` bytes, and else the start or the
    end of the row that holds it. A round is one aggregation over rows; 1,024
    sums for each interval, of which there are as many as targets at most, come
    to the driver.
    """
    ends = rows.agg(F.min("th"), F.max("th")).first()
    out: dict[int, Cut] = {}
    todo = [Interval((), ends[0], ends[1], 0, sorted(set(targets)))] if ends[0] is not None else []
    while todo:
        code = F.coalesce(*[x.cell() + F.lit(j << BITS) for j, x in enumerate(todo)])
        seen = rows.select(code.alias("code"), "size", *KEY).where("code IS NOT NULL")
        cells = seen.groupBy("code").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{f.__name__}") for c in KEY for f in (F.min, F.max)]).orderBy("code").collect()
        below, found = {j: x.below for j, x in enumerate(todo)}, []
        for c in cells:
            x, start = todo[c.code >> BITS], below[c.code >> BITS]
            end = below[c.code >> BITS] = start + c.bytes
            inside = [t for t in x.targets if start <= t < end]
            if not inside:
                continue
            lo, hi = [c[f"{k}_min"] for k in KEY], [c[f"{k}_max"] for k in KEY]
            if not x.equal and lo[0] == hi[0]:  # one text
                out |= {t: (lo[0], -1, -1) if t - start <= end - t else (lo[0] + 1, -1, -1) for t in inside if min(t - start, end - t) <= slack}
            if c.n == 1:
                out = {t: (*lo[:2], lo[2] + (t - start > end - t)) for t in inside} | out
            inside = [t for t in inside if t not in out]
            if inside:
                same = next(i for i in range(len(KEY)) if lo[i] != hi[i])
                found.append(Interval(tuple(lo[:same]), lo[same], hi[same], start, inside))
        todo = found
    return out


def _at_or_above(cut: Cut) -> Column:
    th, rh, tie = (F.col(c) for c in KEY)
    return (th > cut[0]) | ((th == cut[0]) & ((rh > cut[1]) | ((rh == cut[1]) & (tie >= cut[2]))))


def shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS, tolerance: int = TOLERANCE, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per row of df: doc_id, size, text_crc32, law (bytes), shard, slot, grown_shard (null).

    size: the text's UTF-8 bytes plus 1; a null text has none, as an empty one.
    Every shard's bytes are within 2 / tolerance of an equal share, or within
    the largest row of it where that is more; equal texts share a shard unless
    they would break this. Rows alike in id and text are told apart by a number
    given to them once. A null id counts as one without digits. Fewer rows
    than shards leave shards empty; an empty table gives an empty result. Other
    columns are not read.

    slot: by key within a shard; in a shard of more than `piece_rows` rows, by
    key within pieces dealt by a hash of the id, piece after piece, so that no
    task numbers more.
    """
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    whole = F.coalesce(text, F.lit("")).cast("binary")
    keyed = Stored(df.select(
        doc_id.alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"),
        digest60(text).alias("th"), digest60(doc_id).alias("rh"), F.monotonically_increasing_id().alias("tie"),
    ), "shard-keys").read()
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    targets = [total * i // n_shards for i in range(1, n_shards)]
    found = cuts(keyed, targets, total // (n_shards * tolerance))
    shard = reduce(Column.__add__, [_at_or_above(found[t]).cast("int") for t in targets if t in found], F.lit(0))
    pieces = max(1, -(-n // (n_shards * piece_rows)))
    dealt = keyed.select("*", shard.alias("shard"), F.pmod(F.xxhash64("rh", "tie"), F.lit(pieces)).alias("piece"))
    slot = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(*KEY)).cast("long") - 1
    out = dealt.withColumn("slot", slot)
    if pieces > 1:
        before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each piece
        starts = dealt.groupBy("shard", "piece").count().select("shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
        out = out.join(starts, ["shard", "piece"]).withColumn("slot", F.col("slot") + F.col("start"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
