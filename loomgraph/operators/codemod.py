"""Consolidation as edits: what to cut and to rewrite so that one symbol of a group stays.

Edits are rows (group, file, start, end, old, new) of character offsets in a
file's text. They are planned for many groups at once; a group that cannot be
edited without guessing is refused with a reason, and so are groups whose edits
run into each other's. Applied and taken back they give the text as it was.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.lexing import masked_text
from loomgraph.operators.extraction import resolve_imports
from loomgraph.session import Stored

FOUND = "array<struct<group string, start int, end int, old string, new string, place string>>"
SPEC = re.compile(r"^\s*(?:import|export)\b[^\n]*?\bfrom\s+(['\"])([^'\"\n]+)\1", re.M)


def _lines(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1]


def occurrences(text: str, language: str, wanted: list[dict]) -> list[dict]:
    """Of one file: the spans to cut (from line to line) and every place of the names to rewrite, in code, in a value or in a comment. wanted: (group, cut_from, cut_to) or (group, old, new)."""
    code, values = masked_text(text, language), masked_text(text, language, keep_values=True)
    starts, out = _lines(text), []
    cuts = []
    for w in wanted:
        if w["cut_from"] is not None:
            a, b = starts[min(w["cut_from"] - 1, len(starts) - 1)], starts[min(w["cut_to"], len(starts) - 1)]
            a, b = min(a, len(text)), min(b, len(text))
            cuts.append((a, b))
            out.append({"group": w["group"], "start": a, "end": b, "old": text[a:b], "new": "", "place": "cut"})
    for w in wanted:
        for m in re.finditer(rf"(?<![\w$]){re.escape(w['old'])}(?![\w$])", text) if w["old"] else ():
            a, b = m.span()
            if any(lo <= a and b <= hi for lo, hi in cuts):
                continue
            place = "code" if code[a:b] == w["old"] else "value" if values[a:b] == w["old"] else "comment"
            out.append({"group": w["group"], "start": a, "end": b, "old": w["old"], "new": w["new"], "place": place})
    return out


def _relative(target, file):
    """The way from a file's directory to another file, as an import says it."""
    a = F.slice(F.split(file, "/"), F.lit(1), F.size(F.split(file, "/")) - 1)
    b = F.split(target, "/")
    shared = F.aggregate(F.sequence(F.lit(1), F.least(F.size(a), F.size(b) - 1)), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(n))
    shared = F.when(F.least(F.size(a), F.size(b) - 1) > 0, shared).otherwise(0)
    up = F.size(a) - shared
    rest = F.array_join(F.slice(b, shared + 1, F.size(b)), "/")
    return F.concat(F.when(up == 0, "./").otherwise(F.repeat(F.lit("../"), up)), rest)


def merge_edits(files: DataFrame, symbols: DataFrame, edges: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q32: (edits, refused) of groups (group, id, canonical): keep each group's canonical symbol and drop its others.

    files: (file, text, language); symbols: (id, file, label, line, end);
    edges: (src, dst, kind). The others' lines are cut; where their name is
    another, it is rewritten in the code of the files that held, call or import
    them; import lines that name the file of a symbol cut are turned to the
    canonical's. Refused, with the reason: groups of one symbol, a name that
    more symbols have, a name inside a string, edits that overlap another
    group's. Comments stay.
    """
    s = symbols.select("id", "file", "label", "line", "end")
    members = groups.select("group", "id", "canonical").distinct().join(s, "id")
    kept = members.where("id = canonical").select("group", F.col("file").alias("to_file"), F.col("label").alias("new"))
    lost = members.where("id <> canonical").join(kept, "group")
    cuts = lost.select("group", "file", F.col("line").alias("cut_from"), F.col("end").alias("cut_to"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    renamed = lost.where("label <> new")
    many = symbols.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    ambiguous = renamed.join(many, "label", "left_semi").select("group", F.lit("name of several symbols").alias("reason"))
    users = edges.where("kind IN ('call', 'import', 'ref', 'inherit', 'test')").join(lost.select("group", F.col("id").alias("dst"), "label", "new"), "dst")
    at = users.join(s.select(F.col("id").alias("src"), F.col("file")), "src", "left").withColumn("file", F.coalesce("file", F.expr("substring_index(src, ':<', 1)")))
    touched = at.select("group", "file").union(lost.select("group", "file")).distinct()
    renames = touched.join(renamed.select("group", F.col("label").alias("old"), "new").distinct(), "group").select("group", "file", F.lit(None).cast("int").alias("cut_from"), F.lit(None).cast("int").alias("cut_to"), "old", "new")

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array, languages: pa.Array, wanted: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("group", pa.string()), ("start", pa.int32()), ("end", pa.int32()), *[(c, pa.string()) for c in ("old", "new", "place")]]))
        return pa.array([occurrences(t or "", x or "js", w) for t, x, w in zip(texts.to_pylist(), languages.to_pylist(), wanted.to_pylist(), strict=True)], kind)

    wanted = cuts.union(renames).groupBy("file").agg(F.collect_list(F.struct("group", "cut_from", "cut_to", "old", "new")).alias("wanted"))  # of one file
    found = files.join(wanted, "file").select("file", F.explode(find("text", "language", "wanted")).alias("e")).select("file", "e.*").distinct()
    found = Stored(found, "edit-places").read()
    edits = found.where("place IN ('cut', 'code')").drop("place").unionByName(_turned(files, lost, touched))
    edits = Stored(edits, "edits").read()
    values = found.where("place = 'value'").select("group", F.lit("name inside a string").alias("reason"))
    single = groups.join(lost.select("group").distinct(), "group", "left_anti").select("group", F.lit("fewer than two symbols").alias("reason"))
    order = Window.partitionBy("file").orderBy("start", "end", "group").rowsBetween(Window.unboundedPreceding, -1)
    met = edits.withColumn("before", F.max(F.struct("end", "group")).over(order)).where("before.end > start AND before.group <> group")
    overlap = met.select(F.explode(F.array("group", "before.group")).alias("group"), F.lit("edits overlap another group's").alias("reason"))
    refused = single.union(ambiguous).union(values).union(overlap).groupBy("group").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))
    return edits.join(refused.select("group"), "group", "left_anti").select("group", "file", "start", "end", "old", "new"), refused


def _turned(files: DataFrame, lost: DataFrame, touched: DataFrame) -> DataFrame:
    """Edits of import specifiers: in touched files, on lines that name a lost or the canonical symbol, a relative specifier of a file that a symbol is cut from."""

    @F.arrow_udf("array<struct<start int, end int, spec string, line string>>")
    def specs(texts: pa.Array, languages: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("spec", pa.string()), ("line", pa.string())]))
        clean = [masked_text(t or "", x or "js", keep_values=True) for t, x in zip(texts.to_pylist(), languages.to_pylist(), strict=True)]
        return pa.array([[{"start": m.start(2), "end": m.end(2), "spec": m[2], "line": m[0]} for m in SPEC.finditer(t)] for t in clean], kind)

    said = files.where("language = 'js'").join(touched.select("file").distinct(), "file", "left_semi").select("file", F.explode(specs("text", "language")).alias("s")).select("file", "s.*").where(F.col("spec").startswith("."))
    target = resolve_imports(said.select("file", "spec").distinct(), files.select("file")).where("target IS NOT NULL")
    hit = said.join(target, ["file", "spec"]).join(lost.select("group", F.col("file").alias("target"), "label", "new", "to_file").distinct(), "target").join(touched, ["group", "file"], "left_semi")
    clause = F.regexp_replace("line", r"^\s*(?:import|export)\b|\bfrom\s+['\"][^'\"\n]*['\"]$", " ")  # its own words are no names: a symbol may be called `from`
    names = F.regexp_extract_all(clause, F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))
    hit = hit.where((F.array_contains(names, F.col("label")) | F.array_contains(names, F.col("new"))) & (F.col("target") != F.col("to_file")) & (F.col("file") != F.col("to_file")))
    return hit.select("file", "group", "start", "end", F.col("spec").alias("old"), _relative(F.col("to_file"), F.col("file")).alias("new")).distinct()


def applied(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files with the edits made; an edit whose old text is not there, or that overlaps another, is an error."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, edits_ in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            parts, at = [], 0
            for e in sorted(edits_ or [], key=lambda e: (e["start"], e["end"])):
                if e["start"] < at or text[e["start"] : e["end"]] != e["old"]:
                    raise ValueError(f"an edit does not fit at {e['start']}: {e['old']!r}")
                parts += [text[at : e["start"]], e["new"]]
                at = e["end"]
            out.append(None if text is None else "".join(parts) + text[at:])
        return pa.array(out, pa.string())

    lists = edits.groupBy("file").agg(F.collect_set(F.struct("start", "end", "old", "new")).alias("edits"))  # of one file
    return files.join(lists, "file", "left").withColumn("text", run("text", "edits")).select(files.columns)


def reverted(edits: DataFrame) -> DataFrame:
    """The edits that take `edits` back, by the offsets of the text they gave."""
    order = Window.partitionBy("file").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    one = edits.select("file", "start", "end", "old", "new").distinct()
    shift = F.coalesce(F.sum(F.length("new") - F.length("old")).over(order), F.lit(0))
    return one.select("file", (F.col("start") + shift).cast("int").alias("start"), (F.col("start") + shift + F.length("new")).cast("int").alias("end"), F.col("new").alias("old"), F.col("old").alias("new"))
