"""Readers of the files that graphs, coverage, churn and hunks come from.

Text is read by Spark's own sources and split into rows by built-in
expressions; every reader takes a path (or paths) that Spark can list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.sources.adapters import EDGE_SCHEMA, NODE_SCHEMA, normalize

# Directories that hold other people's code, and extensions that are source.
VENDORED = ("node_modules", ".git", "dist", "build", "out", "coverage", "vendor", "target", "__pycache__", ".venv", "venv")
EXTENSIONS = ("js", "mjs", "cjs", "jsx", "ts", "tsx", "py", "rb", "go", "rs", "java", "cs", "php", "swift", "kt", "kts", "mts", "cts", "json")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of source files below a path, vendored directories left out; file is relative."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/") + "/"
    rel = F.expr(f"substring(path, instr(path, '{root}') + {len(root)})")
    keep = rel.rlike(r"\.(" + "|".join(EXTENSIONS) + ")$") & ~rel.rlike(r"(^|/)(" + "|".join(x.replace(".", r"\.") for x in VENDORED) + ")/")
    return raw.where(keep).select(rel.alias("file"), F.decode("content", "UTF-8").alias("text"))


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: nodes and edges of {nodes: [...], edges: [{from, to, kind, weight}]}, defaults filled in."""
    node = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in NODE_SCHEMA.split(", "))
    schema = f"nodes array<struct<{node}>>, edges array<struct<`from`: string, `to`: string, kind: string, weight: int>>"
    g = spark.read.schema(schema).json(path, multiLine=True)
    edges = g.select(F.inline("edges")).toDF(*[c.split()[0] for c in EDGE_SCHEMA.split(", ")])
    return normalize(g.select(F.inline("nodes")), edges)


def tail(spark: SparkSession, path: str, schema: str, order: str, n: int) -> DataFrame:
    """The last n rows of a JSON-lines ledger; torn lines are passed over."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").where(F.col(order).isNotNull()).orderBy(F.desc(order)).limit(n)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line): a file's lines in order. One row a file is split, so a file's order never rests on partitions."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return whole


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, hits): most hits of each line over the records of a file."""
    rows = _lines(spark, path).withColumn("line", F.trim("line"))
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    record = F.sum(F.when(F.col("line") == "end_of_record", 1).otherwise(0)).over(w)
    rows = rows.withColumn("record", record)
    in_record = Window.partitionBy("path", "record").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    source = F.last(F.when(F.col("line").startswith("SF:"), F.regexp_replace(F.trim(F.substring("line", 4, 10_000)), r"\\", "/")), ignorenulls=True).over(in_record)
    hit = rows.withColumn("file", source).where(F.col("line").rlike(r"^DA:\d+,-?\d+") & F.col("file").isNotNull())
    return hit.groupBy("file", F.regexp_extract("line", r"^DA:(\d+)", 1).cast("int").alias("line")).agg(F.max(F.regexp_extract("line", r",(-?\d+)", 1).cast("long")).alias("hits"))


def istanbul(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, hits) of statement ranges exploded to lines."""
    place = "struct<start: struct<line: int>, `end`: struct<line: int>>"
    kind = f"map<string, struct<statementMap: map<string, {place}>, s: map<string, long>>>"
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("file", "r"))
    st = doc.select("file", F.col("r.s").alias("s"), F.explode("r.statementMap").alias("sid", "at")).where("at.start.line IS NOT NULL")
    rows = st.select("file", F.coalesce(F.col("s")[F.col("sid")], F.lit(0)).alias("hits"), F.explode(F.sequence("at.start.line", F.greatest("at.start.line", F.coalesce("at.end.line", "at.start.line")))).alias("line"))
    return rows.groupBy(F.regexp_replace("file", r"\\", "/").alias("file"), "line").agg(F.max("hits").alias("hits"))


def churn(spark: SparkSession, path: str) -> DataFrame:
    """(file, commits) from the text of `log --name-only --format=%H`."""
    line = spark.read.text(path).select(F.trim("value").alias("file"))
    return line.where((F.col("file") != "") & ~F.col("file").rlike("^[0-9a-f]{40}$")).groupBy("file").agg(F.count("*").alias("commits"))


def diff_hunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, end) of the new side's hunks of a unified diff; a pure removal touches its line."""
    rows = _lines(spark, path)
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    file = F.last(F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.*)$", 1)), ignorenulls=True).over(w)
    at = lambda g: F.regexp_extract("line", r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@", g)
    hunk = rows.withColumn("file", file).where(F.col("line").rlike(r"^@@ -\S+ \+\d+") & (F.col("file") != "/dev/null"))
    start, n = at(1).cast("int"), F.when(at(2) == "", 1).otherwise(F.expr("try_cast(regexp_extract(line, '^@@ -\\\\S+ \\\\+(\\\\d+)(?:,(\\\\d+))? @@', 2) AS int)"))
    return hunk.select("file", start.alias("start"), (start + F.greatest(n, F.lit(1)) - 1).alias("end"))


def named_hunks(spark: SparkSession, spec: str) -> DataFrame:
    """file[:start[-end]], comma-separated; no lines: the whole file."""
    one = spark.createDataFrame([(spec,)], "spec string").select(F.explode(F.split("spec", ",")).alias("s")).select(F.trim("s").alias("s")).where("s <> ''")
    has = F.col("s").rlike(r":\d+(-\d+)?$")
    num = lambda g: F.expr(f"try_cast(regexp_extract(s, ':(\\\\d+)(?:-(\\\\d+))?$', {g}) AS int)")
    return one.select(F.when(has, F.regexp_replace("s", r":\d+(-\d+)?$", "")).otherwise(F.col("s")).alias("file"), num(1).alias("start"), F.coalesce(num(2), num(1)).alias("end"))


def bodies(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, body): each node's lines of its file (file, text)."""
    lines = F.split("text", "\r?\n")
    return nodes.join(sources, "file").select("id", F.array_join(F.slice(lines, F.col("line"), F.greatest("loc", F.lit(1))), "\n").alias("body"))


def manifest_entries(spark: SparkSession, path: str) -> DataFrame:
    """Files that a package manifest names: main, module, and every string of bin and exports."""
    doc = spark.read.text(path, wholetext=True)
    one = lambda key: F.array_compact(F.array(F.get_json_object("value", f"$.{key}")))
    names = F.concat(one("main"), one("module"), *[F.regexp_extract_all(F.coalesce(F.get_json_object("value", f"$.{k}"), F.lit("")), F.lit(r'(?::\s*|^)"?(\.{0,2}/?[^"{}:,]+\.[cm]?[jt]sx?)"?'), F.lit(1)) for k in ("bin", "exports")])
    return doc.select(F.explode(names).alias("file")).select(F.regexp_replace("file", r"^\./", "").alias("file")).distinct()


def ctags(spark: SparkSession, path: str) -> DataFrame:
    """(file, label, kind, line) out of tag files of JSON lines. What is no JSON, no tag or has no name is passed over; a tag without a line stands on line 1, one without a kind is a symbol."""
    rows = spark.read.schema("_type string, name string, path string, line int, kind string").json(path)
    tag = (F.col("_type") == "tag") & (F.col("name") != "") & F.col("path").isNotNull()
    return rows.where(tag).select(F.regexp_replace("path", r"^\./", "").alias("file"), F.col("name").alias("label"), F.coalesce("kind", F.lit("symbol")).alias("kind"), F.coalesce("line", F.lit(1)).alias("line"))


def tagged_symbols(symbols: DataFrame, tags: DataFrame) -> DataFrame:
    """(file, label, kind, line) of all files: a file's tags where it has any, else what the line rules found."""
    own = symbols.join(tags.select("file").distinct(), "file", "left_anti")
    return tags.select("file", "label", "kind", "line").union(own.select("file", "label", "kind", "line"))


# Host files whose command strings name scripts, and what counts as such a name.
HOST_FILES = ("hooks/hooks.json", ".claude-plugin/plugin.json")
SCRIPT = r"[\w@${}./-]+\.(?:mjs|cjs|js)"


def flat_strings(rows: DataFrame, most_depth: int = 64) -> DataFrame:
    """(of, value) of every string inside a VARIANT: rows are (of, v), objects and arrays opened level by level, whatever their nesting; other values are passed over. Deeper than most_depth raises."""
    spark, level, out = rows.sparkSession, rows.select("of", "v").where("v IS NOT NULL"), None
    for _ in range(most_depth):
        kind = F.schema_of_variant("v")
        said = level.where(kind == "STRING").select("of", F.col("v").cast("string").alias("value"))
        out = said if out is None else out.union(said)
        inner = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        if inner.isEmpty():
            return out
        level = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("of", F.col("value").alias("v"))
    raise ValueError(f"values nested deeper than {most_depth}")


def manifest_files(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(file, manifest) of the files that manifests (path, text) name: main, bin and exports of every package.json, however nested; the scripts in host files at the top.

    A name means the file itself or one below the manifest's directory; the
    first manifest by name counts. What is no JSON names nothing.
    """
    at = F.regexp_replace("path", r"/?[^/]*$", "")
    doc = manifests.where(F.substring_index("path", "/", -1) == "package.json").select(F.struct(F.col("path"), at.alias("dir")).alias("of"), F.try_parse_json("text").alias("v"))
    parts = [doc.select("of", F.try_variant_get("v", f"$.{k}", "variant").alias("v")) for k in ("main", "bin", "exports")]
    named = flat_strings(parts[0].where(F.schema_of_variant("v") == "STRING").union(parts[1]).union(parts[2])).select("of.path", "of.dir", "value")
    scripts = manifests.where(F.col("path").isin(*HOST_FILES)).select("path", F.lit(None).cast("string").alias("dir"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SCRIPT), F.lit(0))).alias("value"))
    clean = F.regexp_replace(F.regexp_replace("value", r"^\./", ""), r"\$\{[A-Z_]+\}/", "")
    wanted = named.union(scripts).withColumn("clean", clean).where("clean <> ''").select("path", F.explode(F.array("clean", F.when(F.col("dir") != "", F.concat_ws("/", "dir", "clean")))).alias("file")).where("file IS NOT NULL")
    return wanted.join(files.select("file").distinct(), "file").groupBy("file").agg(F.min("path").alias("manifest"))


def coverage_of(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Covered and hits of each node: body lines before the declaration line; null where the file was never seen."""
    inside = nodes.join(lines.withColumnRenamed("line", "at"), "file").where((F.col("at") >= F.col("line")) & (F.col("at") <= F.col("line") + F.greatest("loc", F.lit(1)) - 1))
    body = F.max(F.when(F.col("at") > F.col("line"), F.col("hits")))
    got = inside.groupBy("id").agg(F.coalesce(body, F.max("hits")).alias("hits"))
    return nodes.join(got, "id", "left").withColumn("covered", F.col("hits") > 0)
