"""Edges between symbols: what source text mentions, resolved name by name.

A file is read once for its mentions: calls, arguments, bases, instance tests,
each with the symbol whose body it stands in and whether a parameter around it
binds the name. What a mention means is settled by joins: what the file's
imports bind, then the file's own symbols, then the only symbol of that name in
the package; anything else is dropped, never guessed.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.lexing import masked_text
from loomgraph.functions.paths import is_test_file, role_of
from loomgraph.operators.extraction import KEYWORDS, resolve_imports
from loomgraph.operators.resolution import default_export, import_bindings
from loomgraph.session import Stored

NAME = r"[A-Za-z_$][\w$]*"
#: A call with what is named before it: dots in front, the chain of members, the name.
CALL = re.compile(rf"(?<![\w$])(\.*)((?:{NAME}\.)*)({NAME})\s*\(")
# What else mentions a name, and lines that only declare one.
ARGUMENT = re.compile(r"[(,]\s*([A-Za-z_$][\w$]*)\s*(?=[,)])")
EXTENDS = re.compile(r"\bclass\s+[A-Za-z_$][\w$]*\s+extends\s+([A-Za-z_$][\w$]*)")
CS_BASE = re.compile(r"\b(?:class|struct|record)\s+[A-Za-z_]\w*(?:<[^>]*>)?\s*:\s*([A-Za-z_][\w.]*)")
PY_BASES = re.compile(r"^\s*class\s+[A-Za-z_]\w*\s*\(([^)]*)\)")
INSTANCE = re.compile(r"\binstanceof\s+([A-Za-z_$][\w$]*)")
STUB = re.compile(r"^\s*(?:(?:public|private|protected|static|readonly|abstract|override|async)\s+)*[A-Za-z_$][\w$]*\s*\([^;{]*\)\s*(?::[^{;]*)?;\s*$")
#: Names shorter than this are resolved in their own file only.
SHORT = 3
MENTION = "array<struct<line int, form string, name string, object string, base string, scope string, bound boolean>>"


def _signature_words(lines: list[str], at: int, name: str) -> tuple[set[str], int]:
    """Words in the brackets after a declaration's name, over as many lines as they take; the last of these lines."""
    words: set[str] = set()
    line, start = at, lines[at].find("(", lines[at].find(name) + len(name))
    depth = 0
    while start >= 0 and line < len(lines):
        for i in range(start, len(lines[line])):
            depth += {"(": 1, ")": -1}.get(lines[line][i], 0)
            if depth <= 0:
                words.update(re.findall(NAME, lines[line][start:i]))
                return words, line
        words.update(re.findall(NAME, lines[line][start:]))
        line, start = line + 1, 0
    return words, at if start < 0 else line - 1


def mentioned(text: str, language: str, ranges: list[dict]) -> list[dict]:
    """What one file's masked text mentions. ranges: its symbols (id, label, kind, line, end)."""
    lines = text.split("\n")
    scopes = sorted(ranges, key=lambda r: (r["line"], -r["end"], r["id"]))
    inner: list[int | None] = [None] * (len(lines) + 2)
    above, bound, declares, silent = [], [], set(), set()
    for k, r in enumerate(scopes):
        above.append(inner[r["line"]])
        for i in range(r["line"], min(r["end"], len(lines)) + 1):
            inner[i] = k
        words, last = _signature_words(lines, r["line"] - 1, r["label"])
        bound.append(words)
        declares.add((r["label"], r["line"]))
        silent.update(range(r["line"], last + 2))
    out: list[dict] = []

    def add(line: int, form: str, name: str, object_: str | None = None, base: str | None = None) -> None:
        if form in ("call", "ref", "inherit") and (name in KEYWORDS or (name, line) in declares):
            return
        k = scope = inner[line]
        shadowed = False
        while k is not None and not shadowed:
            shadowed, k = name in bound[k], above[k]
        out.append({"line": line, "form": form, "name": name, "object": object_, "base": base, "scope": None if scope is None else scopes[scope]["id"], "bound": shadowed})

    for line, x in enumerate(lines, 1):
        if language == "py":
            if m := PY_BASES.match(x):
                for part in (p.strip() for p in m[1].split(",")):
                    if "=" not in part and (b := re.fullmatch(r"(?:.*\.)?([A-Za-z_]\w*)", part)):
                        add(line, "inherit", b[1])
        else:
            for m in EXTENDS.finditer(x):
                add(line, "inherit", m[1])
            for m in CS_BASE.finditer(x) if language == "cs" else ():
                if last := m[1].split(".")[-1]:
                    add(line, "inherit", last)
        if not (inner[line] is not None and scopes[inner[line]]["kind"] == "class" and STUB.match(x)):
            for m in CALL.finditer(x):
                chain = m[2].split(".")[:-1]
                if chain:
                    add(line, "member", m[3], chain[-1], chain[-2] if len(chain) > 1 else None)
                elif len(m[1]) != 1:
                    add(line, "call", m[3])
            for m in ARGUMENT.finditer(x) if line not in silent else ():
                add(line, "ref", m[1])
        for m in INSTANCE.finditer(x):
            add(line, "instance", m[1])
    return out


def mentions(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, language, line, form, name, object, base, scope, bound) of (file, text, language); scope is null at a file's top level. A null text mentions nothing."""

    @F.arrow_udf(MENTION)
    def read(texts: pa.Array, languages: pa.Array, ranges: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("line", pa.int32()), *[(c, pa.string()) for c in ("form", "name", "object", "base", "scope")], ("bound", pa.bool_())]))
        rows = zip(texts.to_pylist(), languages.to_pylist(), ranges.to_pylist(), strict=True)
        return pa.array([mentioned(masked_text(t or "", x or "js"), x or "js", r or []) for t, x, r in rows], kind)

    ranges = symbols.groupBy("file").agg(F.collect_list(F.struct("id", "label", "kind", "line", "end")).alias("ranges"))  # of one file
    found = files.select("file", "text", "language").join(ranges, "file", "left").select("file", "language", F.explode(read("text", "language", "ranges")).alias("m"))
    return found.select("file", "language", "m.*")


def _without_comments(files: DataFrame) -> DataFrame:
    @F.arrow_udf("string")
    def bare(texts: pa.Array, languages: pa.Array) -> pa.Array:
        return pa.array([masked_text(t or "", x or "js", keep_values=True) for t, x in zip(texts.to_pylist(), languages.to_pylist(), strict=True)], pa.string())

    return files.select("file", bare("text", "language").alias("text"))


def imports_of(files: DataFrame) -> DataFrame:
    """(file, spec) of the files' imports; comments import nothing."""
    return import_bindings(_without_comments(files)).select("file", F.col("target").alias("spec")).distinct()


def bound_names(files: DataFrame, symbols: DataFrame, tree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What imports bind: (file, local, id) of symbols and (file, local, target) of whole files. tree: all files that imports may mean, if more than `files`.

    A name means the exported symbol of the file that its import resolves to, a
    default that file's default export; a namespace or a required module the
    file itself, and so does a default without a symbol.
    """
    tree = files if tree is None else tree
    b = import_bindings(_without_comments(files))
    at = resolve_imports(b.select("file", F.col("target").alias("spec")).distinct(), tree.select("file")).where("target IS NOT NULL").select("file", F.col("spec").alias("said"), F.col("target").alias("at"))
    b = b.withColumnRenamed("target", "said").join(at, ["file", "said"])
    own = symbols.where("owner IS NULL").select(F.col("file").alias("at"), F.col("label").alias("imported"), "id")
    meant = tree.join(b.where("form <> 'named' OR imported = 'default'").select(F.col("at").alias("file")).distinct(), "file", "left_semi")
    chosen = default_export(_without_comments(meant), symbols.select("file", F.col("label").alias("name"))).select(F.col("file").alias("at"), F.col("name").alias("imported"))
    default = chosen.join(own, ["at", "imported"]).select("at", F.lit("default").alias("imported"), "id")
    named = b.join(own.union(default.select("at", "imported", "id")), ["at", "imported"]).groupBy("file", "local").agg(F.min("id").alias("id"))
    return named, b.where("form <> 'named'").groupBy("file", "local").agg(F.min("at").alias("target"))


def ladder(files: DataFrame, symbols: DataFrame, aliases: DataFrame, namespaces: DataFrame, packages: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """Every mention with the symbol it means, `dst`, or `why` it means none: unknown, bound, short, ambiguous, role.

    files: (file, text, language); packages: (file, package); a file without
    one is of the package ''. The guards, for names that neither the imports
    nor the file itself explain: a parameter's name around the place; names
    under three letters; symbols inside function bodies of other files; of Ruby
    and PHP another file's methods; arguments of product files that would reach
    tests or the like.
    """
    m = Stored(mentions(files, symbols), "mentions").read()
    home = (files if tree is None else tree).select("file").join(packages.select("file", "package").distinct(), "file", "left").select("file", F.coalesce("package", F.lit("")).alias("package"))
    local = aliases.select("file", F.col("local").alias("name"), F.col("id").alias("alias"))
    own = symbols.groupBy("file", F.col("label").alias("name")).agg(F.max_by("id", F.struct("line", "id")).alias("own"))
    every = symbols.where("NOT local").select("file", "owner", "id", F.col("label").alias("name")).join(home, "file")
    free = F.col("owner").isNull()
    only = every.groupBy("package", "name").agg(
        F.countDistinct("id").alias("n"), F.min("id").alias("only"), F.min("file").alias("only_file"),
        F.countDistinct(F.when(free, F.col("id"))).alias("n_free"), F.min(F.when(free, F.col("id"))).alias("only_free"), F.min(F.when(free, F.col("file"))).alias("only_free_file"),
    )
    plain = m.where("form IN ('call', 'ref', 'inherit')").join(home, "file").join(local, ["file", "name"], "left").join(own, ["file", "name"], "left").join(only, ["package", "name"], "left")
    receiver = F.col("language").isin("rb", "php")
    n, one, one_file = (F.when(receiver, F.col(b)).otherwise(F.col(a)) for a, b in (("n", "n_free"), ("only", "only_free"), ("only_file", "only_free_file")))
    known, guarded = F.coalesce("alias", "own"), F.col("form").isin("call", "ref")
    odd = (F.col("form") == "ref") & (role_of(F.col("file")) == "product") & (role_of(one_file) != "product")
    why = (
        F.when(known.isNotNull(), None).when(guarded & F.col("bound"), "bound").when(guarded & (F.length("name") < SHORT), "short")
        .when(F.coalesce(n, F.lit(0)) == 0, "unknown").when(n > 1, "ambiguous").when(odd, "role")
    )
    plain = plain.select("file", "line", "scope", "form", "name", F.when(why.isNull(), F.coalesce(known, one)).alias("dst"), why.alias("why"))
    return plain.unionByName(_members(m, symbols, local, namespaces))


def _members(m: DataFrame, symbols: DataFrame, local: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Mentions through an imported file or a class: x.m(), x.m.call(), X.m() and instanceof X."""
    whole = namespaces.select("file", F.col("local").alias("object"), "target")
    member = symbols.where("owner IS NULL").groupBy(F.col("file").alias("target"), F.col("label").alias("name")).agg(F.min("id").alias("dst"))
    through = F.when(F.col("name").isin("call", "apply") & F.col("base").isNotNull(), F.array(F.struct("object", "name"), F.struct(F.col("base").alias("object"), F.col("object").alias("name")))).otherwise(F.array(F.struct("object", "name")))
    calls = m.where("form = 'member'").select("file", "line", "scope", F.explode(through).alias("t")).select("file", "line", "scope", "t.*")
    calls = calls.join(whole, ["file", "object"]).join(member, ["target", "name"], "left").select("file", "line", "scope", F.lit("call").alias("form"), "name", "dst")
    classes = symbols.where("kind = 'class'")
    own = classes.groupBy("file", F.col("label").alias("name")).agg(F.max_by("id", F.struct("line", "id")).alias("own"))
    alias = local.join(classes.select(F.col("id").alias("alias")), "alias", "left_semi")
    named = m.where("form IN ('member', 'instance')").select("file", "line", "scope", F.when(F.col("form") == "member", F.col("object")).otherwise(F.col("name")).alias("name"))
    refs = named.join(alias, ["file", "name"], "left").join(own, ["file", "name"], "left").where("coalesce(alias, own) IS NOT NULL").select("file", "line", "scope", F.lit("ref").alias("form"), "name", F.coalesce("alias", "own").alias("dst"))
    return calls.union(refs).withColumn("why", F.when(F.col("dst").isNull(), "unknown"))


def edges(
    files: DataFrame, symbols: DataFrame, packages: DataFrame | None = None, aliases: DataFrame | None = None, namespaces: DataFrame | None = None,
    by_file: bool = False, tree: DataFrame | None = None,
) -> DataFrame:
    """(src, dst, kind, weight) of what the files mention, each pair and kind once, no loops.

    src is the symbol around the place, file:<module> at the top level. A call
    or argument in a test file that means a symbol elsewhere is a test edge.
    Without aliases and namespaces they are what the files' imports bind.
    by_file: with the file that mentions it in front. tree: all files that
    `symbols` are of, where `files` are only those to read.
    """
    if aliases is None or namespaces is None:
        aliases, namespaces = bound_names(files, symbols, tree)
    if packages is None:
        packages = (files if tree is None else tree).select("file", F.lit("").alias("package"))
    hit = ladder(files, symbols, aliases, namespaces, packages, tree).where("dst IS NOT NULL").join(symbols.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst")
    src = F.coalesce("scope", F.concat("file", F.lit(":<module>")))
    kind = F.when((F.col("form") != "inherit") & is_test_file(F.col("file")) & ~is_test_file(F.col("dst_file")), "test").otherwise(F.col("form"))
    return hit.select(*["file"] * by_file, src.alias("src"), "dst", kind.alias("kind"), F.lit(1).alias("weight")).where("src <> dst").distinct()
