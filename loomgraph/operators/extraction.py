"""Symbols and edges out of source text.

Line rules are built-in expressions. The stateful parts of a language (strings
that span lines, bodies that end at a brace) run in Arrow functions over whole
files.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.lexing import masked_text

# Declarations by language: kind, pattern. Groups: name; in, the space before it; owner; shown, what makes it exported.
DECLARATIONS = {
    "py": (("function", r"^(?P<in>\s*)(?:async\s+)?def\s+(?P<name>[A-Za-z_]\w*)"), ("class", r"^\s*class\s+(?P<name>[A-Za-z_]\w*)")),
    "js": (
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)"),
        ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*=(?!\s*\(\()\s*(?:async\s*)?(?:function\b|\*?\s*\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)"),
        ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[A-Za-z_$][\w$]*)"),
        ("method", r"^\s{2,}(?:(?:public|private|protected|static|readonly|async|get|set)\s+)*(?:\*\s*)?(?P<name>[A-Za-z_$][\w$]*)\s*\([^;]*\)(?:\s*:\s*[^{;=]+)?\s*\{"),
        ("field", r"^\s{2,}(?:public\s+|private\s+|protected\s+|readonly\s+|static\s+)*(?P<name>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"),
    ),
    "go": (
        ("method", r"^\s*func\s+\((?P<owner>[^)]*)\)\s+(?P<name>[A-Za-z_]\w*)"), ("function", r"^\s*func\s+(?P<name>[A-Za-z_]\w*)"), ("class", r"^\s*type\s+(?P<name>[A-Za-z_]\w*)\s+(?:struct|interface)\b"),
    ),
    "rs": (
        ("function", r"^(?P<in>\s*)(?P<shown>pub(?:\([a-z]+\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:const\s+)?fn\s+(?P<name>[A-Za-z_]\w*)"),
        ("class", r"^\s*(?P<shown>pub(?:\([a-z]+\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:const\s+)?(?:struct|enum|trait)\s+(?P<name>[A-Za-z_]\w*)"),
    ),
    "java": (
        ("class", r"^\s*(?:@[\w.$]+(?:\([^)]*\))?\s+)?(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record)\s+(?P<name>[A-Za-z_$][\w$]*)"),
        ("method", r"^\s+(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>]+>\s+)?(?:[\w$<>\[\],.?\s]+?\s+)?(?P<name>[A-Za-z_$][\w$]*)\s*\([^;{]*\)\s*(?:throws\s+[\w$,.\s]+)?\{"),
    ),
    "cs": (
        ("class", r"^\s*(?:\[[^\]]*\]\s*)?(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref)\s+)*(?:class|interface|struct|record|enum)\s+(?P<name>[A-Za-z_][\w]*)"),
        ("method", r"^\s+(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|extern|unsafe|new|partial)\s+)+(?:[\w<>\[\],.?\s]+?\s+)?(?P<name>[A-Za-z_][\w]*)\s*\([^;{]*\)\s*(?:where\s+[^{]+)?(?:\{|=>|$)"),
    ),
    "rb": (("class", r"^\s*(?:class|module)\s+(?P<name>[A-Z]\w*)"), ("function", r"^(?P<in>\s*)def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!]?)")),
    "php": (
        ("class", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(?P<name>[A-Za-z_]\w*)"),
        ("function", r"^(?P<in>\s*)(?:(?:public|protected|private|static|final|abstract)\s+)*function\s+&?\s*(?P<name>[A-Za-z_]\w*)\s*\("),
    ),
    "kt": (
        ("class", r"^\s*(?:(?:public|private|internal|protected|open|final|abstract|sealed|data|inner|enum|annotation|value)\s+)*(?:class|object|interface)\s+(?P<name>[A-Za-z_]\w*)"),
        ("function", r"^(?P<in>\s*)(?:(?:public|private|internal|protected|open|override|final|abstract|suspend|inline|operator|infix|tailrec|external|actual|expect)\s+)*fun\s+(?:<[^>]+>\s+)?(?:(?P<owner>[A-Za-z_][\w.]*)\.)?(?P<name>[A-Za-z_]\w*)\s*\("),
    ),
    "swift": (
        ("class", r"^\s*(?:(?:public|open|internal|fileprivate|private|final|indirect)\s+)*(?:class|struct|enum|protocol|extension|actor)\s+(?P<name>[A-Za-z_]\w*)"),
        ("function", r"^(?P<in>\s*)(?:(?:public|open|internal|fileprivate|private|final|static|class|override|mutating|nonmutating|convenience|required|dynamic|@\w+(?:\([^)]*\))?)\s+)*func\s+(?P<name>[A-Za-z_]\w*)\s*[(<]"),
    ),
}
# Words that are no names of symbols, of any language and of one.
KEYWORDS = frozenset("if for while switch catch return function typeof await new super constructor else do try finally class import export const let var async yield case in of instanceof delete void throw with print".split())
CONTROL = {
    "java": frozenset("if for while switch catch try do synchronized assert return throw new else".split()),
    "cs": frozenset("if for foreach while switch catch try do using lock fixed return throw new else".split()),
}
# What makes a declaration exported where the pattern does not say; languages whose names may be keywords of another.
SHOWN = {"js": r"\bexport\b", "java": r"\bpublic\b", "cs": r"\bpublic\b", "swift": r"\b(?:public|open)\b"}
HIDDEN = {"php": r"\b(?:private|protected)\b", "kt": r"\b(?:private|internal)\b"}
ANY_NAME = ("go", "rs")
IMPL = re.compile(r"^impl(?:\s*<[^>]*>)?\s+(?:.*?\bfor\s+)?([A-Za-z_]\w*)")
# Calls that leave no name behind.
DYNAMIC = r"""\[[A-Za-z_$][\w$]*\]\s*\(|\bgetattr\s*\(|require\s*\(\s*[^'"`)\s]|\.emit\s*\(|globalThis\s*\[|window\s*\["""
def body_end(lines: list[str], start: int, language: str) -> int:
    """Last line of the body that starts on a line (both from 0), of masked lines."""
    if language in ("py", "rb"):
        base, end = len(lines[start]) - len(lines[start].lstrip()), start
        for i in range(start + 1, len(lines)):
            if lines[i].strip():
                if len(lines[i]) - len(lines[i].lstrip()) <= base:
                    return i if language == "rb" and re.match(r"\s*end\b", lines[i]) else end
                end = i
        return end
    depth = paren = 0
    opened = False
    for i in range(start, len(lines)):
        for c in lines[i]:
            if c in "()":
                paren = max(0, paren + (1 if c == "(" else -1))
            elif not paren and c in "{}":
                depth += 1 if c == "{" else -1
                opened |= c == "{"
                if opened and depth <= 0:
                    return i
        if not opened and lines[i].rstrip().endswith(";"):
            return i
    return len(lines) - 1


def declared(text: str, language: str) -> list[dict]:
    """The symbols of one file's masked text in the order of their lines: label, kind, owner, line, end, exports, place (owner and label, told apart by the line where a file has it twice), and whether it lies inside a function's body."""
    lines = text.split("\n")
    rules = [(kind, re.compile(p)) for kind, p in DECLARATIONS.get(language, DECLARATIONS["js"])]
    impls = [(m[1], i, next((j for j in range(i + 1, len(lines)) if lines[j].startswith("}")), len(lines) - 1)) for i, x in enumerate(lines) if language == "rs" and (m := IMPL.match(x))]
    out, classes, functions, places = [], [], [], set()
    for i, x in enumerate(lines):
        kind, m = next(((k, m) for k, p in rules if (m := p.match(x))), (None, None))
        if m is None:
            continue
        of, name = m.groupdict(), m["name"]
        if name in CONTROL.get(language, ()) or language not in ANY_NAME and name in KEYWORDS:
            continue
        classes = [c for c in classes if c[2] >= i]  # bodies that are over own nothing any more
        around = next((c[0] for c in reversed(classes) if c[1] < i), None)
        owner = of.get("owner")
        if owner is not None:
            last = re.search(r"([A-Za-z_]\w*)\s*$", re.sub(r"\[[^\]]*\]", "", owner).replace("*", "").strip())
            owner = last[1] if last else None
        if kind == "field" and around is None:
            continue
        if kind == "function" and (of.get("in") or owner) and (language != "rb" or around):
            kind = "method"
        kind = "method" if kind == "field" else kind
        if kind == "method" and owner is None:
            owner = next((t for t, a, b in reversed(impls) if a < i <= b), None) if language == "rs" else around
        shown = bool(of["shown"]) if "shown" in of else name[:1].isupper() if language == "go" else not re.search(HIDDEN[language], x) if language in HIDDEN else bool(re.search(SHOWN[language], x)) if language in SHOWN else True
        end = body_end(lines, i, language)
        functions = [f for f in functions if f[1] >= i]
        nested = any(a < i and end <= b for a, b in functions)
        if kind == "class":
            classes.append((name, i, end))
        else:
            functions.append((i, end))
        place = f"{owner}.{name}" if owner else name
        place = f"{place}@{i + 1}" if place in places else place
        places.add(place)
        out.append({"label": name, "kind": kind, "owner": owner, "line": i + 1, "end": end + 1, "exports": shown and not (language == "js" and kind == "method"), "place": place, "local": nested})
    return out


def mask(text: Column, language: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        return pa.array([None if t is None else masked_text(t, x or "js") for t, x in zip(texts.to_pylist(), languages.to_pylist(), strict=True)], pa.string())

    return run(text, language)


FOUND = "array<struct<label string, kind string, owner string, line int, end int, exports boolean, place string, local boolean>>"


def symbols(files: DataFrame) -> DataFrame:
    """(id, file, label, kind, owner, line, end, loc, exports, local) of (file, text, language); local: inside a function's body. Masked text goes in, so strings declare nothing.

    A method's owner is its receiver's or implementation's type, else the class
    around it; ids are file:owner.label, file:label without an owner, and end
    with @line where a file would have one twice. A null text has no symbols.
    """

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array, languages: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("owner", pa.string()), ("line", pa.int32()), ("end", pa.int32()), ("exports", pa.bool_()), ("place", pa.string()), ("local", pa.bool_())]))
        return pa.array([declared(masked_text(t or "", x or "js"), x or "js") for t, x in zip(texts.to_pylist(), languages.to_pylist(), strict=True)], kind)

    s = files.select("file", F.explode(find("text", "language")).alias("s"))
    return s.select(F.concat_ws(":", "file", "s.place").alias("id"), "file", "s.label", "s.kind", "s.owner", "s.line", "s.end", (F.col("s.end") - F.col("s.line") + 1).alias("loc"), "s.exports", "s.local")


def innermost(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """X11: for each (file, line) the id of the innermost range (id, file, line, end) around it; the later start wins."""
    r = ranges.select("file", F.col("id").alias("rid"), F.col("line").alias("s"), F.col("end").alias("e"))
    hit = lines.join(r, "file").where("line BETWEEN s AND e")
    return hit.groupBy(*lines.columns).agg(F.max_by("rid", F.struct("s", "rid")).alias("id"))


def owners(symbols_: DataFrame) -> DataFrame:
    """Each method's class or type."""
    return symbols_.where("kind = 'method' AND owner IS NOT NULL").select("file", "label", "line", "owner")


def signature(line: Column, name: Column) -> Column:
    """Parameter names on a declaration's own line; null if the list does not close there."""
    inside = F.regexp_extract(line, r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)", 1)
    parts = F.transform(F.split(inside, r",(?![^\[{(]*[\]})])"), lambda p: F.regexp_extract(p, r"^\s*(?:\*\*?|\.\.\.)?\s*([A-Za-z_$][\w$]*)\s*(?:[:=\s].*)?$", 1))
    return F.when(line.rlike(r"\([^()]*(?:\([^()]*\)[^()]*)*\)"), F.filter(parts, lambda p: p != ""))


def candidates(base: Column) -> Column:
    """Paths a relative import may stand for, in order."""
    ext = ("", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", "/index.js", "/index.mjs", "/index.ts", "/index.tsx")
    return F.array(*[F.concat(base, F.lit(e)) for e in ext])


def consulted_paths(imports: DataFrame) -> DataFrame:
    """(file, spec, pos, path) of (file, spec): the paths that a relative import looks at, in order, whether a file is there or not."""
    parts = F.concat(F.slice(F.split("file", "/"), F.lit(1), F.size(F.split("file", "/")) - 1), F.split("spec", "/"))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return imports.where(F.col("spec").startswith(".")).select("file", "spec", F.posexplode(candidates(F.array_join(folded, "/"))).alias("pos", "path"))


def resolve_imports(imports: DataFrame, known: DataFrame) -> DataFrame:
    """(file, spec) with the first candidate that is a file; relative specs only, others stay unresolved."""
    hit = consulted_paths(imports).join(known.select(F.col("file").alias("path")).distinct(), "path").groupBy("file", "spec").agg(F.min_by("path", "pos").alias("target"))
    return imports.join(hit, ["file", "spec"], "left")


def resolve_modules(imports: DataFrame, known: DataFrame) -> DataFrame:
    """(file, module) of dotted modules by path suffix: two or more parts anywhere (shortest path wins), one part only at the top or under src."""
    stem = F.regexp_replace(F.regexp_replace("file", r"\.py$", ""), "/__init__$", "")
    k = known.where(F.col("file").endswith(".py")).select(F.col("file").alias("target"), F.split(stem, "/").alias("p"))
    tails = k.select("target", F.size("p").alias("depth"), F.element_at("p", 1).alias("top"), F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.array_join(F.slice("p", i, 99), ".").alias("module"), (i == 1).alias("whole"), ((i == 2) & (F.element_at("p", 1) == "src")).alias("src")))).alias("t"))
    cand = tails.select("target", "t.module", "t.whole", "t.src").where("instr(module, '.') > 0 OR whole OR src")
    hit = imports.select("file", "module").distinct().join(cand, "module").groupBy("file", "module").agg(F.min_by("target", F.struct(F.length("target"), "target")).alias("target"))
    return imports.join(hit, ["file", "module"], "left")


def dynamic_files(files: DataFrame) -> DataFrame:
    """Files whose calls a static map cannot see."""
    return files.where(F.col("text").rlike(DYNAMIC)).select("file")


def closure_locals(symbols_: DataFrame) -> DataFrame:
    """Symbols whose lines lie strictly inside a function of the same file."""
    return symbols_.where("local")


def package_of(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(file, package): the nearest directory above a file that has a manifest; '' at the top."""
    parts = F.split("file", "/")
    up = files.select("file", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir")))).alias("d"))
    hit = up.select("file", "d.depth", F.col("d.dir").alias("dir")).join(manifests.select("dir").distinct(), "dir").groupBy("file").agg(F.max_by("dir", "depth").alias("package"))
    return files.select("file").join(hit, "file", "left").select("file", F.coalesce("package", F.lit("")).alias("package"))
