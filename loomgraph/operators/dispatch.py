"""Method calls through a receiver, in seven languages.

A call on the object itself means a method of its class; a call on a parameter
whose declared type is a plain name means a method of that type. What a file
says is read by a table of patterns; which method is meant is a join, over the
classes' ancestors too where these are known: the nearest one that has the
method counts, and where several are as near, none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.lexing import masked_text
from loomgraph.functions.paths import is_test_file
from loomgraph.session import checkpoint

NAME = r"[A-Za-z_$][\w$]*"
DOTTED = rf"(?<![\w$.)\]])({NAME})\s*\??\.\s*({NAME})\s*\("


@dataclass(frozen=True)
class Dispatch:
    """call: receiver and method; own: names of the object itself; bare: a call without receiver that means it; typed: parameters, with groups name and type (or names, several of one type); receiver: the object's name in a declaration."""

    call: str
    own: tuple[str, ...] = ()
    bare: str = ""
    typed: str = ""
    receiver: str = ""


TYPED_BEFORE = rf"(?:^|,)\s*(?:@\w+\s+)*(?:(?:final|ref|out|in|this|params)\s+)*(?P<type>[A-Za-z_]\w*)\s+(?P<name>{NAME})\s*(?==[^,]*|,|$)"
TABLE = {
    "rb": Dispatch(r"(?<![\w.)\]])(self)\s*\.\s*([A-Za-z_]\w*[?!]?)(?![\w=]|\s*=[^=~])", ("self",), bare=r"(?<![\w.:@$&])([a-z_]\w*[?!]?)\("),
    "php": Dispatch(r"(?<![\w>:])\$(\w+)\s*\??->\s*([A-Za-z_]\w*)\s*\(", ("this",), typed=r"(?:^|,)\s*(?:#\[[^\]]*\]\s*)?(?:(?:public|private|protected|readonly)\s+)*\??(?P<type>[A-Za-z_]\w*)\s+&?(?:\.\.\.)?\$(?P<name>\w+)"),
    "py": Dispatch(DOTTED, ("self", "cls"), typed=r"(?:^|,)\s*(?P<name>[A-Za-z_]\w*)\s*:\s*(?P<type>[A-Za-z_]\w*)\s*(?=[,=]|$)"),
    "go": Dispatch(DOTTED, typed=r"(?:^|,)\s*(?P<names>(?:[A-Za-z_]\w*\s*,\s*)*[A-Za-z_]\w*)\s+\*?(?P<type>[A-Za-z_]\w*)\s*(?=,|$)", receiver=r"^\s*func\s+\(\s*([A-Za-z_]\w*)\s"),
    "rs": Dispatch(DOTTED, ("self",), typed=r"(?:^|,)\s*(?:mut\s+)?(?P<name>[A-Za-z_]\w*)\s*:\s*(?:&\s*(?:'\w+\s+)?)?(?:mut\s+)?(?P<type>[A-Za-z_]\w*)\s*(?=,|$)"),
    "java": Dispatch(DOTTED, ("this",), typed=TYPED_BEFORE),
    "cs": Dispatch(DOTTED, ("this",), typed=TYPED_BEFORE),
}
INTENT = "array<struct<scope string, type string, method string, own boolean>>"


def parameters(lines: list[str], at: int, name: str) -> str:
    """What stands in the brackets after a declared name, over as many lines as it takes; '' if nothing closes them."""
    m = re.search(rf"(?<![\w$]){re.escape(name)}\s*(?:<[^>]*>)?\s*\(", lines[at])
    if not m:
        return ""
    text, depth = [], 0
    for i in range(at, len(lines)):
        for c in lines[i][m.end() - 1 :] if i == at else lines[i] + " ":
            depth += {"(": 1, ")": -1}.get(c, 0)
            if depth == 0:
                return "".join(text)[1:]
            text.append(c)
    return ""


def dispatched(text: str, language: str, ranges: list[dict]) -> Iterator[tuple[str, str, str, bool]]:
    """Of one file's masked text: the symbol a call stands in, the type it goes to, the method, whether the type is the symbol's own. ranges: its symbols (id, label, kind, owner, line, end)."""
    table = TABLE.get(language)
    if table is None:
        return
    lines, inner = text.split("\n"), {}
    for r in sorted((r for r in ranges if r["kind"] != "class"), key=lambda r: (r["line"], -r["end"])):
        for i in range(r["line"], min(r["end"], len(lines)) + 1):
            inner[i] = r
    known: dict[str, tuple[set[str], dict[str, str]]] = {}
    for i, r in sorted(inner.items()):
        if r["id"] not in known:
            first = lines[r["line"] - 1]
            own = set(table.own) | ({m[1]} if table.receiver and (m := re.match(table.receiver, first)) else set())
            types: dict[str, str] = {}
            for m in re.finditer(table.typed, parameters(lines, r["line"] - 1, r["label"])) if table.typed else ():
                of = m.groupdict()
                types |= {n.strip(): of["type"] for n in (of.get("name") or of.get("names") or "").split(",")}
            known[r["id"]] = own, types
        own, types = known[r["id"]]
        x = lines[i - 1]
        for m in re.finditer(table.call, x):
            if m[1] in own:
                if r["owner"]:
                    yield r["id"], r["owner"], m[2], True
            elif m[1] in types:
                yield r["id"], types[m[1]], m[2], False
        for m in re.finditer(table.bare, x) if table.bare and r["owner"] else ():
            if not (i == r["line"] and m[1] == r["label"]):
                yield r["id"], r["owner"], m[1], True


def intents(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, file, type, method, own) of calls through a receiver in (file, text, language), each once. Other languages and null texts have none."""

    @F.arrow_udf(INTENT)
    def read(texts: pa.Array, languages: pa.Array, ranges: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("scope", pa.string()), ("type", pa.string()), ("method", pa.string()), ("own", pa.bool_())]))
        rows = zip(texts.to_pylist(), languages.to_pylist(), ranges.to_pylist(), strict=True)
        return pa.array([[dict(zip(("scope", "type", "method", "own"), t, strict=True)) for t in dict.fromkeys(dispatched(masked_text(t or "", x or ""), x or "", r or []))] for t, x, r in rows], kind)

    ranges = symbols.groupBy("file").agg(F.collect_list(F.struct("id", "label", "kind", "owner", "line", "end")).alias("ranges"))  # of one file
    found = files.where(F.col("language").isin(*TABLE)).select("file", "text", "language").join(ranges, "file")
    return found.select("file", F.explode(read("text", "language", "ranges")).alias("i")).select(F.col("i.scope").alias("src"), "file", "i.type", "i.method", "i.own")


def ranked_ancestors(inherits: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(id, ancestor, distance) of classes along edges (src, dst), each pair by its shortest way. Rounds are as many as the deepest hierarchy; a class that inherits itself ends its way there."""
    up = inherits.where("src <> dst").select(F.col("src").alias("ancestor"), F.col("dst").alias("next")).distinct()
    front = checkpoint(up.select(F.col("ancestor").alias("id"), F.col("next").alias("ancestor"), F.lit(1).alias("distance")))
    out = front
    for k in range(2, most_rounds + 2):
        new = front.join(up, "ancestor").where("id <> next").select("id", F.col("next").alias("ancestor"), F.lit(k).alias("distance")).distinct()
        front = checkpoint(new.join(out, ["id", "ancestor"], "left_anti"))
        if front.isEmpty():
            return out
        out = checkpoint(out.union(front))
    raise ValueError(f"classes inherit over more than {most_rounds} steps")


def dispatch_edges(calls: DataFrame, symbols: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind, weight) of intents(): a method of the object's own class in its file, or of a type that one file defines.

    With ancestors (ids of classes, from ranked_ancestors), a method that the
    class itself lacks is the one of the nearest ancestor that has it. A type
    of several files, a method nobody has, and one that several nearest
    ancestors have give no edge.
    """
    methods = symbols.where("owner IS NOT NULL").groupBy("file", F.col("owner").alias("type"), F.col("label").alias("method")).agg(F.min_by("id", "line").alias("dst"))
    # a type's home: where its methods stand (its class may be another file's); without methods, its class
    homes = methods.select("type", "file").union(symbols.where("kind = 'class'").select(F.col("label").alias("type"), "file")) if ancestors is not None else methods.select("type", "file")
    one = homes.distinct().groupBy("type").agg(F.count("*").alias("n"), F.min("file").alias("at")).where("n = 1").drop("n")
    placed = calls.join(one, "type", "left").withColumn("at", F.when(F.col("own"), F.col("file")).otherwise(F.col("at"))).where("at IS NOT NULL")
    target = methods.withColumnRenamed("file", "at")
    hit = placed.join(target, ["at", "type", "method"], "left")
    found = hit.where("dst IS NOT NULL").select("src", "file", "dst", "at")
    if ancestors is not None:
        classes = symbols.where("kind = 'class'").groupBy(F.col("file").alias("at"), F.col("label").alias("type")).agg(F.min("id").alias("id"))
        above = symbols.where("kind = 'class'").select(F.col("id").alias("ancestor"), F.col("file").alias("to_file"), F.col("label").alias("to_type"))
        reach = hit.where("dst IS NULL").select("src", "file", "at", "type", "method").join(classes, ["at", "type"]).join(ancestors, "id").join(above, "ancestor")
        reach = reach.join(methods.select(F.col("file").alias("to_file"), F.col("type").alias("to_type"), "method", "dst"), ["to_file", "to_type", "method"])
        near = reach.groupBy("src", "file", "at", "type", "method").agg(F.min(F.struct("distance", "dst")).alias("first"), F.collect_set(F.struct("distance", "dst")).alias("all"))  # of one hierarchy
        near = near.where(F.size(F.filter("all", lambda x: x["distance"] == F.col("first.distance"))) == 1)
        found = found.union(near.join(symbols.select(F.col("id").alias("dst"), F.col("file").alias("to")), F.col("first.dst") == F.col("dst")).select("src", "file", "dst", F.col("to").alias("at")))
    kind = F.when(is_test_file(F.col("file")) & ~is_test_file(F.col("at")), "test").otherwise("call")
    return found.where("src <> dst").select("src", "dst", kind.alias("kind"), F.lit(1).alias("weight")).distinct()
