"""Names across files: bindings of imports, re-exports, default exports, public API, typed receivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import is_test_file
from loomgraph.operators.graph import closure
from loomgraph.session import checkpoint

NAME = r"[A-Za-z_$][\w$]*"
# The forms of a default export, in the order in which they count.
DEFAULTS = (
    r"export\s+default\s+(?:abstract\s+)?(?:async\s+)?(?:class|function\s*\*?)\s+([A-Za-z_$][\w$]*)",
    r"export\s*\{[^}]*?\b([A-Za-z_$][\w$]*)\s+as\s+default\b",
    r"export\s+default\s+([A-Za-z_$][\w$]*)\s*;",
    r"module\.exports\s*=\s*([A-Za-z_$][\w$]*)\s*;",
)
#: An import statement: its clause and what it names.
IMPORT = rf"\bimport\s+([\w$*{{}},\s]+?)\s+from\s+['\"]([^'\"]+)['\"]"
REQUIRE = rf"\b(?:const|let|var)\s+({NAME}|\{{[^}}]*\}})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)"


def default_export(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, name) of each file's default export: the first form whose name is a symbol of the file. files: (file, text); symbols: (file, name)."""
    forms = F.posexplode(F.array(*[F.regexp_extract("text", p, 1) for p in DEFAULTS])).alias("form", "name")
    found = files.select("file", forms).where("name <> ''").join(symbols.select("file", "name").distinct(), ["file", "name"], "left_semi")
    return found.groupBy("file").agg(F.min_by("name", "form").alias("name"))


def import_bindings(files: DataFrame) -> DataFrame:
    """(file, local, imported, target, form) of every name that an import or require binds; form: default, namespace or named."""
    every = lambda p, form: F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda s: F.struct(F.regexp_extract(s, p, 1).alias("clause"), F.regexp_extract(s, p, 2).alias("target"), F.lit(form).alias("way")))
    said = files.select("file", F.explode(F.concat(every(IMPORT, "import"), every(REQUIRE, "require"))).alias("s")).select("file", "s.*")
    braces = F.regexp_extract("clause", r"\{([^}]*)\}", 1)
    outside = F.trim(F.regexp_replace(F.regexp_replace("clause", r"\{[^}]*\}", ""), r"^[\s,]+|[\s,]+$", ""))
    said = said.withColumn("named", F.filter(F.transform(F.split(braces, ","), lambda x: F.trim(x)), lambda x: x != "")).withColumn("rest", F.filter(F.transform(F.split(outside, ","), lambda x: F.trim(x)), lambda x: x != ""))
    parts = F.concat(
        F.transform("named", lambda x: F.struct(F.element_at(F.split(x, r"\s+as\s+|\s*:\s*"), -1).alias("local"), F.element_at(F.split(x, r"\s+as\s+|\s*:\s*"), 1).alias("imported"), F.lit("named").alias("form"))),
        F.transform("rest", lambda x: F.struct(
            F.element_at(F.split(x, r"\s+as\s+"), -1).alias("local"), F.when(x.startswith("*") | (F.col("way") == "require"), "*").otherwise("default").alias("imported"),
            F.when(x.startswith("*") | (F.col("way") == "require"), "namespace").otherwise("default").alias("form"),
        )),
    )
    return said.select("file", "target", F.explode(parts).alias("b")).select("file", "b.local", "b.imported", "target", "b.form").distinct()


def resolve_re_exports(wanted: DataFrame, symbols: DataFrame, renames: DataFrame, stars: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(file, name, at_file, at_name): the symbol that each wanted export (file, name) stands for; the unknown are left out.

    symbols: (file, name); renames: (file, name, target, orig); stars: (file,
    pos, target). A file's own symbol comes first, then its renamed re-export,
    then its star re-exports in order, each followed to its end before the
    next: so of all ways that end at a symbol the first in that order counts.
    A way that meets itself ends. Rounds are the longest way; each ends in a
    checkpoint, and a state is followed on only by its first way so far.
    """
    here = symbols.select("file", "name").distinct()
    hops = renames.select("file", "name", "target", "orig").distinct()
    on = stars.select("file", F.col("pos").cast("int"), "target")
    front = wanted.select("file", "name").distinct().select("file", "name", F.col("file").alias("at_file"), F.col("name").alias("at_name"), F.array().cast("array<int>").alias("way"), F.array(F.concat_ws(":", "file", "name")).alias("met"))
    found, best = None, None
    at = lambda df: df.withColumnRenamed("file", "at_file").withColumnRenamed("name", "at_name")
    for _ in range(most_rounds):
        front = checkpoint(front)
        if front.isEmpty():
            break
        hit = front.join(at(here), ["at_file", "at_name"], "left_semi").select("file", "name", "way", "at_file", "at_name")
        found = checkpoint(hit if found is None else found.union(hit))
        first = front.groupBy("file", "name", "at_file", "at_name").agg(F.min("way").alias("best"))
        best = checkpoint(first if best is None else best.union(first).groupBy("file", "name", "at_file", "at_name").agg(F.min("best").alias("best")))
        open_ = front.join(at(here), ["at_file", "at_name"], "left_anti")
        step = lambda rank: F.concat("way", F.array(rank)).alias("way")
        by_name = open_.join(at(hops), ["at_file", "at_name"]).select("file", "name", F.col("target").alias("at_file"), F.col("orig").alias("at_name"), step(F.lit(0)), "met")
        by_star = open_.join(on.withColumnRenamed("file", "at_file"), "at_file").select("file", "name", F.col("target").alias("at_file"), "at_name", step(F.col("pos") + 1), "met")
        key = F.concat_ws(":", "at_file", "at_name")
        new = by_name.union(by_star).where(~F.array_contains("met", key)).withColumn("met", F.concat("met", F.array(key)))
        new = new.groupBy("file", "name", "at_file", "at_name").agg(F.min(F.struct("way", "met")).alias("w")).select("file", "name", "at_file", "at_name", "w.*")
        front = new.join(best, ["file", "name", "at_file", "at_name"], "left").where("best is null or way < best").select("file", "name", "at_file", "at_name", "way", "met")
    if found is None:
        return front.select("file", "name", "at_file", "at_name")
    return found.groupBy("file", "name").agg(F.min(F.struct("way", "at_file", "at_name")).alias("w")).select("file", "name", "w.at_file", "w.at_name")


def public_api(nodes: DataFrame, entry_files: DataFrame, re_exports: DataFrame) -> DataFrame:
    """Ids that a package offers: exported symbols, no modules, of the entry files and of files these re-export, and re-exported single symbols.

    entry_files: (file); re_exports: (file, target, name), name null for a whole file.
    """
    whole = re_exports.where("name is null").select(F.col("file").alias("src"), F.col("target").alias("dst"))
    start = entry_files.select(F.col("file").alias("id")).distinct()
    files = start.union(closure(whole, start, reverse=False).select("id")).distinct().withColumnRenamed("id", "file")
    offered = nodes.where("exports AND kind <> 'module'")
    one = re_exports.where("name is not null").join(files, "file", "left_semi").select(F.col("target").alias("file"), F.col("name").alias("label"))
    return offered.join(files, "file", "left_semi").select("id").union(offered.join(one, ["file", "label"], "left_semi").select("id")).distinct()


def typed_receivers(intents: DataFrame, methods: DataFrame) -> DataFrame:
    """Call edges of x.m() where x's type is known. intents: (src, src_file, type, method); methods: (id, file, owner, label).

    The type must be defined in exactly one file and have the method there;
    anything else is dropped, never guessed. A test file's call is a test.
    """
    known = methods.groupBy("owner").agg(F.countDistinct("file").alias("n"), F.first("file").alias("file")).where("n = 1").select(F.col("owner").alias("type"), F.col("file").alias("at"))
    target = methods.select(F.col("id").alias("dst"), F.col("file").alias("at"), F.col("owner").alias("type"), F.col("label").alias("method")).groupBy("at", "type", "method").agg(F.min("dst").alias("dst"))
    hit = intents.join(known, "type").join(target, ["at", "type", "method"]).where("src <> dst")
    kind = F.when(is_test_file(F.col("src_file")) & ~is_test_file(F.col("at")), "test").otherwise("call")
    return hit.select("src", "dst", kind.alias("kind"), F.lit(1).alias("weight")).distinct()


def append_edges(edges: DataFrame, more: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ("src", "dst", "kind")) -> DataFrame:
    """Edges and those of `more` whose ends are nodes, that are no loops, and whose keys are new; keys without kind for imports."""
    ends = nodes.select("id").distinct()
    new = more.where("src <> dst").join(ends.toDF("src"), "src", "left_semi").join(ends.toDF("dst"), "dst", "left_semi")
    new = new.join(edges.select(*keys).distinct(), list(keys), "left_anti").groupBy(*keys).agg(*[F.min(c).alias(c) for c in edges.columns if c not in keys])
    return edges.unionByName(new.select(edges.columns))


# Fixed value: a domain whose name holds one of these is a catch-all.
CATCH_ALL = r"(?i)misc|loose|unassigned"


def top_dir(file: Column) -> Column:
    """A file's first directory; (root) where the first part is a file's name."""
    first = F.substring_index(file, "/", 1)
    return F.when(first.rlike(r"\.[^.]+$"), "(root)").otherwise(first)


def declarations_out(nodes: DataFrame) -> DataFrame:
    """Nodes that take part in findings: no modules, nothing from declaration files; an absent, empty or catch-all domain is the file's first directory."""
    named = F.col("domain").isNotNull() & (F.col("domain") != "") & ~F.col("domain").rlike(CATCH_ALL)
    return nodes.where(~F.col("file").endswith(".d.ts") & (F.col("kind") != "module")).withColumn("domain", F.when(named, F.col("domain")).otherwise(top_dir(F.col("file"))))


#: Columns that a page about the graph does not show.
HIDDEN = ("t3", "signature", "mtime", "hash", "body")


def pruned(nodes: DataFrame) -> DataFrame:
    """What a report embeds of the nodes."""
    return nodes.drop(*HIDDEN)


def zero_caller_caveat(fan_in: Column, public: Column, exports: Column, dynamic: Column) -> Column:
    """Why no caller may mean nothing: public API before exported before dynamic calls in the file."""
    return F.when(fan_in > 0, "").when(public, "public API: callers may be outside").when(exports, "exported: callers may be outside").when(dynamic, "dynamic calls in this file").otherwise("no caller found")
