"""Substring deduplication by hashing lines, their clauses, or paragraphs.

Texts are cut into units; units are normalised and hashed; digests are grouped
over the whole corpus; the earliest ranked occurrence of each digest stays. A
later occurrence goes with the run of neighbouring units that all occurred
before, if the run has at least `min_words` words: formulae of a few words,
which texts share by chance, stay where they are. Offsets are those of the
original text.

Digests are computed once and laid out in the order of rank. A *stretch* of
neighbouring documents knows its own repeats, so that only its first
occurrences meet those of other stretches: a line that every document has
travels once for each stretch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bounded, columnwise, free, tidy
from loomgraph.session import Stored

#: Words of a run of repeated units from which on it is removed.
MIN_WORDS = 15
#: Units of a stretch.
STRETCH = 1 << 18
#: A digest with over 1 / HOT of the repeated units, and over MEETING of them, is dealt out in pieces.
HOT, MEETING = 1000, 1000
#: What ends a unit; white space after it is the unit's. A clause ends at a line's end too.
ENDS = {"line": r"\n", "paragraph": r"\n\n", "clause": r"\n|[.!?,;:|][ \t\r\x0b\x0c]+"}


def units(text: bytes, end: re.Pattern) -> Iterator[tuple[int, list[bytes]]]:
    """Where each unit of a text ends, and its words (of bytes: parted at space and 0x09 to 0x0D)."""
    at = 0
    for m in end.finditer(text):
        yield m.end(), text[at : m.end()].split()
        at = m.end()
    if at < len(text):
        yield len(text), text[at:].split()


def _digests(unit: str):
    @columnwise("binary")
    def run(texts: pa.Array) -> pa.Array:
        from xxhash import xxh3_128_digest

        end = re.compile(ENDS[unit].encode())
        return pa.array([None if t is None else b"".join([xxh3_128_digest(b" ".join(w)) for _, w in units(t.lower(), end) if w]) for t in texts.to_pylist()], pa.binary())

    return run.asNondeterministic()


def _firsts(kinds: tuple[pa.DataType, pa.DataType]):
    """Numbers the documents of a partition sorted by rank; each one's units that are new to its stretch, and its other units."""

    def stretch(held: list[tuple], base: int) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(d for _, _, d in held), "<i8").reshape(-1, 2)
        sizes = np.array([len(d) // 16 for _, _, d in held], np.int64)
        starts = np.cumsum(sizes) - sizes
        by = np.lexsort((flat[:, 1], flat[:, 0]))  # stable: a digest's first occurrence comes first
        new = np.zeros(len(flat), bool)
        if len(by):
            new[by[np.concatenate([[True], (flat[by[1:]] != flat[by[:-1]]).any(axis=1)])]] = True
        pos = (np.arange(len(flat)) - np.repeat(starts, sizes)).astype(np.int32)
        doc = np.repeat(np.arange(len(held)), sizes)

        def lists(values: np.ndarray, of: np.ndarray) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(held)))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

        ids = [pa.array([h[i] for h in held], kinds[i]) for i in (0, 1)]
        cols = [pa.array(base + np.arange(len(held))), *ids, *(lists(x[new], doc[new]) for x in (flat[:, 0], flat[:, 1], pos)), lists(pos[~new], doc[~new])]
        return pa.RecordBatch.from_arrays(cols, ["rank", "doc", "version", "h1", "h2", "pos", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, last, size = TaskContext.get().partitionId() << 33, None, 0
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if row[:2] == last:  # the same document again
                    continue
                last = row[:2]
                held.append(row)
                size += len(row[2]) // 16
                if size >= STRETCH:
                    yield stretch(held, base)
                    base, held, size = base + len(held), [], 0
        if held:
            yield stretch(held, base)

    return run


def repeated_units(df: DataFrame, id_col: str, text_col: str, unit: str) -> DataFrame:
    """(doc, version, units): ordinals of the units with a word whose digest an earlier ranked unit has.

    Rank: document id (nulls first), then a hash of the text, then position. A
    digest's first occurrence is a pre-aggregated minimum; only digests seen
    twice go on. A digest with over 1 / HOT of all repeated units is cut into
    pieces before the join, so no common line is one task's.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    field = df.schema[id_col]
    kind = field.dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc"), _version(F.col(text_col)).alias("version"), _digests(unit)(F.col(text_col).cast("binary")).alias("digests")).where("digests is not null")
    layout = f"rank long, doc {kind}, version long, h1 array<long>, h2 array<long>, pos array<int>, known array<int>"
    ranked = Stored(rows.orderBy(F.asc_nulls_first("doc"), "version").mapInArrow(tidy(_firsts((to_arrow_type(field.dataType), pa.int64()))), layout), "ranked-units")
    all_units = ranked.read().select("rank", F.explode(F.arrays_zip("h1", "h2", "pos")).alias("u")).select("rank", "u.*")
    seen = all_units.groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1")
    stored = Stored(seen, "repeated-units")
    seen = stored.read()
    total = seen.agg(F.sum("n")).first()[0] or 0
    share = max(MEETING, -(-total // HOT))
    hot = F.broadcast(seen.where(F.col("n") > share).select("h1", "h2", F.ceil(F.col("n") / share).alias("pieces")))  # under HOT rows: their counts add up to at most the total
    zero = F.lit(0).cast("long")
    spread = seen.join(hot, ["h1", "h2"], "left").select("h1", "h2", "first", F.explode(F.sequence(zero, F.coalesce("pieces", F.lit(1).cast("long")) - 1)).alias("piece"))
    dealt = all_units.join(hot, ["h1", "h2"], "left").select("h1", "h2", "rank", "pos", F.coalesce(F.pmod(F.xxhash64("rank"), F.col("pieces")), zero).alias("piece"))
    later = dealt.join(spread, ["h1", "h2", "piece"]).where(F.col("rank") > F.col("first")).groupBy("rank").agg(F.collect_list("pos").alias("met"))
    none = F.array().cast("array<int>")
    both = ranked.read().select("rank", "doc", "version", "known").join(later, "rank", "left").select("doc", "version", F.array_sort(F.concat("known", F.coalesce("met", none))).alias("units"))
    marks = Stored(both.where(F.size("units") > 0), "unit-marks").read()
    ranked.drop(), stored.drop()
    free(spark)
    return marks


def _version(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def _cutter(unit: str, min_words: int):
    fields = "text binary, cut boolean, n_units int, n_removed int, removed array<struct<start:int,end:int>>"

    def cut(texts: pa.Array, repeated: pa.Array) -> pa.Array:
        pattern = re.compile(ENDS[unit].encode())
        rows = []
        for text, marks in zip(texts.to_pylist(), repeated.to_pylist(), strict=True):
            if text is None:
                rows.append((None, False, 0, 0, []))
                continue
            flagged = set(marks or ())
            kept, spans, n, done = [], [], 0, 0  # done: the text up to here is kept or cut
            run, open_at, closed_at, at, worded = [0, 0], None, 0, 0, 0  # run: units and words of the run that began at open_at

            def close() -> None:
                nonlocal n, done
                if run[1] >= min_words:
                    kept.append(text[done:open_at])
                    spans.append((open_at, closed_at))
                    n, done = n + run[0], closed_at

            for stop, words in units(text, pattern):
                if words:
                    if worded in flagged:
                        if open_at is None:
                            open_at, run = at, [0, 0]
                        run[0] += 1
                        run[1] += len(words)
                        closed_at = stop
                    elif open_at is not None:
                        close()
                        open_at = None
                    worded += 1
                at = stop
            if open_at is not None:
                close()
            kept.append(text[done:])
            chars, last, where = [], 0, 0
            for a, b in spans:
                where += len(text[last:a].decode("utf-8", "replace"))
                size = len(text[a:b].decode("utf-8", "replace"))
                chars.append({"start": where, "end": where + size})
                where, last = where + size, b
            rows.append((b"".join(kept), bool(spans), worded, n, chars))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = (pa.binary(), pa.bool_(), pa.int32(), pa.int32(), span)
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["text", "cut", "n_units", "n_removed", "removed"])

    @F.arrow_udf(fields)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from tidy(lambda both: (cut(*b) for b in both))(batches)

    return run.asNondeterministic()


#: Columns that substring_dedup adds.
ADDED = ("cut", "n_units", "n_removed", "removed")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "clause", min_words: int = MIN_WORDS) -> DataFrame:
    """df with `text` cut, and cut (whether anything went), n_units (those with a word), n_removed and removed (spans of the original text, in characters).

    unit: "clause" (ends at a line's end, and at white space after one of
    .!?,;:|), "line" or "paragraph". Units equal each other with A-Z in lower
    case and runs of white space as one space. min_words: words of a run of
    repeated units from which on it goes; 1 removes every repeat. Rows that
    repeat both id and text are one document and all keep what the first
    occurrence keeps; a null id ranks first. A null text stays null, an empty
    one empty; a text may become empty, its row stays. A long text is one row
    of one task. Columns of df come first, as they were but for the text; those
    named like an added column are replaced by it, and no other name clashes.
    An empty table gives an empty result.
    """
    bounded(df.sparkSession)
    marks = repeated_units(df, id_col, text_col, unit)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(row.alias("row"), F.col(id_col).alias("doc"), _version(F.col(text_col)).alias("version"))
    found = marks.toDF("of_doc", "of_version", "units")
    both = rows.join(found, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version")), "left")
    done = both.select("row", _cutter(unit, min_words)(F.col("row")[text_col].cast("binary"), F.col("units")).alias("done"))
    keep = [F.col("done.text").cast("string").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns if c not in ADDED]
    return done.select(*keep, *[F.col("done")[c].alias(c) for c in ADDED])
