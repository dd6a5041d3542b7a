"""Extraction that reads again only what an edit may have changed.

Beside its symbols and edges, what each file's edges rest on is kept: the names
it mentions, and every path its imports looked at, whether a file was there or
not. After an edit a file is read again if it is changed; its edges are worked
out again if a name it mentions means other symbols than before, or a path it
looked at was changed, added or removed. All else is carried over, and the
result is that of a reading from scratch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import edges as edge_rules
from loomgraph.operators.extraction import consulted_paths, symbols
from loomgraph.session import Stored


@dataclass
class Reading:
    """What is kept of a tree: files (file, hash), symbols, names (file, name), paths (file, path) and edges (file, src, dst, kind, weight); how many files were read and how many resolved."""

    files: DataFrame
    symbols: DataFrame
    names: DataFrame
    paths: DataFrame
    edges: DataFrame
    n_read: int
    n_resolved: int


def _hashed(files: DataFrame) -> DataFrame:
    return files.select("file", F.sha2(F.concat_ws("\x00", "language", F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("hash"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, f"reading-{name}").read()


def _read(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, names and paths of files."""
    s = _kept(symbols(files), "symbols")
    m = edge_rules.mentions(files, s)
    names = _kept(m.select("file", F.explode(F.array("name", "object", "base")).alias("name")).where("name IS NOT NULL").distinct(), "names")
    return s, names, _kept(consulted_paths(edge_rules.imports_of(files)), "paths")


def read(files: DataFrame, packages: DataFrame | None = None) -> Reading:
    """A tree (file, text, language) from scratch."""
    files = _kept(files.select("file", "text", "language"), "files")
    s, names, paths = _read(files, files)
    e = _kept(edge_rules.edges(files, s, packages, by_file=True), "edges")
    n = files.count()
    return Reading(_kept(_hashed(files), "hashes"), s, names, paths, e, n, n)


def refresh(before: Reading, files: DataFrame, packages: DataFrame | None = None) -> Reading:
    """The tree as it is now. Packages must be those of the reading before, but for new files'."""
    files = _kept(files.select("file", "text", "language"), "files")
    hashes = _kept(_hashed(files), "hashes")
    old = before.files.select("file", F.col("hash").alias("was"))
    touched = _kept(hashes.join(old, "file", "full").where("was IS NULL OR hash IS NULL OR was <> hash").select("file", F.col("hash").isNotNull().alias("there")), "touched")
    again = files.join(touched.where("there"), "file", "left_semi")
    s, names, paths = _read(again, files)
    rest = lambda df: df.join(touched, "file", "left_anti")
    now = _kept(rest(before.symbols).unionByName(s), "symbols")
    all_names, all_paths = _kept(rest(before.names).unionByName(names), "names"), _kept(rest(before.paths).unionByName(paths), "paths")
    # labels that mean something else: of symbols that only one of the readings has
    of = ["label", "id", "owner", "local", "kind"]
    sides = before.symbols.join(touched, "file", "left_semi").select(*of, F.lit(1).alias("side")).union(s.select(*of, F.lit(2).alias("side")))
    moved = sides.groupBy(*of).agg(F.bit_or("side").alias("side")).where("side < 3").select(F.col("label").alias("name")).distinct()
    there = touched.where("there").select("file")
    dirty = there.union(all_names.join(moved, "name", "left_semi").select("file")).union(all_paths.join(touched.select(F.col("file").alias("path")), "path", "left_semi").select("file")).distinct()
    dirty = _kept(dirty, "dirty")
    fresh = edge_rules.edges(files.join(dirty, "file", "left_semi"), now, packages, by_file=True, tree=files)
    e = _kept(before.edges.join(touched, "file", "left_anti").join(dirty, "file", "left_anti").unionByName(fresh), "edges")
    return Reading(hashes, now, all_names, all_paths, e, there.count(), dirty.count())
