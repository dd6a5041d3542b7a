"""Source trees made of a table's texts: a file for each document, its names the document's words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.extraction import KEYWORDS
from loomgraph.session import table

#: Lines of a file: {1} to {8} are its words, {a} and {b} functions of two other files of its directory.
LINES = (
    "import {{ {a} as {6} }} from './f{i}.js'; // import {{ {1} }} from './f{i}.js'",
    "import * as {7} from './f{j}.js';",
    "export class C_{8} extends C_{4} {{",
    "  {1}(p_q, {2}) {{ return {3}(p_q, {5}, {2}); }}",
    "}}",
    "/* {2}({3}) */",
    "export function {2}({3}, q_r) {{",
    "  {3}(q_r); {4}({1}, '{5}(', {5});",
    "  function in_{8}() {{ {4}(); }}",
    "  return {7}.{b}({6}) instanceof C_{8} ? C_{4}.{1}() : `{5}( ${{{6}(1)}}`;",
    "}}",
    "{6}({1});",
)
DYNAMIC_LINE = "handlers[{1}](2);"


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, w, file, package): of documents with eight different words (three letters and more of a to z, none a keyword) the words in their order; two in seven files are tests and benchmarks."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0)), lambda x: ~x.isin(*sorted(KEYWORDS))))
    k = F.col("doc_id")
    package = F.concat(F.lit("pkg"), (k % 5).cast("string"))
    kind = F.when(k % 7 == 0, "tests").when(k % 7 == 1, "bench").otherwise("src")
    d = table(spark, sf_dir, "documents").select(k.alias("k"), w.alias("w"), package.alias("package"), F.concat_ws("/", package, kind, F.concat(F.lit("f"), k.cast("string"), F.lit(".js"))).alias("file"))
    return d.where(F.size("w") >= 8)


def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, w, file, package, a, b, text, language) of these documents. The files 35 and 70 documents back stand in the same directory; a and b are their functions, `none` where there is no such file."""
    d = document_words(spark, sf_dir)
    back = lambda n, name: d.select((F.col("k") + n).alias("k"), F.col("w")[1].alias(name))
    d = d.join(back(35, "a"), "k", "left").join(back(70, "b"), "k", "left").withColumns({c: F.coalesce(c, F.lit("none")) for c in ("a", "b")})
    text = F.lit("\n".join(LINES).replace("{{", "\x01").replace("}}", "\x02"))
    dynamic = F.when(F.col("k") % 3 == 0, F.lit("\n" + DYNAMIC_LINE)).otherwise("")
    text = F.concat(text, dynamic)
    for name, value in [*[(str(i + 1), F.col("w")[i]) for i in range(8)], ("a", F.col("a")), ("b", F.col("b")), ("i", (F.col("k") - 35).cast("string")), ("j", (F.col("k") - 70).cast("string"))]:
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return d.select("k", "w", "file", "package", "a", "b", F.translate(text, "\x01\x02", "{}").alias("text"), F.lit("js").alias("language"))


#: The same in DuckDB: T(k, w, file, package, role, fi, fj, a, b); fi and fj are the two files' names, null where they are missing.
TREE_SQL = f"""W AS (SELECT doc_id AS k, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]{{3,}}'), lambda x: x NOT IN ({", ".join(f"'{x}'" for x in sorted(KEYWORDS))})) AS u FROM documents),
V AS (SELECT k, list_filter(u, lambda x, i: list_position(u, x) = i) AS w, 'pkg' || k % 5 AS package, CASE k % 7 WHEN 0 THEN 'tests' WHEN 1 THEN 'bench' ELSE 'src' END AS role FROM W),
X AS (SELECT k, w, package, role, package || '/' || role || '/f' || k || '.js' AS file FROM V WHERE len(w) >= 8),
T AS (SELECT X.*, i.file AS fi, j.file AS fj, coalesce(i.w[2], 'none') AS a, coalesce(j.w[2], 'none') AS b FROM X LEFT JOIN X i ON i.k = X.k - 35 LEFT JOIN X j ON j.k = X.k - 70)"""

#: A class in each of seven languages, by extension: {8} is its name, {c} its base's, {d} the type of a parameter; {1}, {2} its methods, {m} one of the type's, {h} one of the base's.
CLASSES = {
    "rb": "class T_{8} < T_{c}\n  def {1}(p)\n    self.{2}\n    {h}(1)\n    p.{m}(2)\n  end\n  def {2}\n  end\nend\n",
    "php": "<?php\nclass T_{8} extends T_{c} {\n  function {1}(?T_{d} $p) {\n    $this->{2}();\n    $this->{h}(1);\n    $p->{m}(2); // $this->{m}()\n  }\n  function {2}() {\n  }\n}\n",
    "py": "class T_{8}(T_{c}):\n    def {1}(self, p: T_{d}):\n        self.{2}()\n        self.{h}(1)\n        p.{m}(2)  # self.{m}()\n\n    def {2}(self):\n        pass\n",
    "go": "type T_{8} struct {\n}\nfunc (r *T_{8}) {1}(p *T_{d}) {\n\tr.{2}()\n\tr.{h}(1)\n\tp.{m}(2)\n}\nfunc (r T_{8}) {2}() {\n}\n",
    "rs": "struct T_{8};\nimpl T_{8} {\n    fn {1}(&self, p: &mut T_{d}) {\n        self.{2}();\n        self.{h}(1);\n        p.{m}(2);\n    }\n    fn {2}(&self) {\n    }\n}\n",
    "java": "class T_{8} extends T_{c} {\n    void {1}(T_{d} p) {\n        this.{2}();\n        this.{h}(1);\n        p.{m}(2);\n    }\n    void {2}() {\n    }\n}\n",
    "cs": "class T_{8} : T_{c} {\n    public void {1}(T_{d} p) {\n        this.{2}();\n        this.{h}(1);\n        p.{m}(2);\n    }\n    public void {2}() {\n    }\n}\n",
}


def class_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, file, text, language): a class for each document, its language by the number. The base is the class 49 documents back (Object where there is none), the parameter's type that 98 back; both are of the same language."""
    d = document_words(spark, sf_dir)
    back = lambda n, names: d.select((F.col("k") + n).alias("k"), *[F.col("w")[i].alias(c) for c, i in names.items()])
    d = d.join(back(49, {"c": 7, "h": 1}), "k", "left").join(back(98, {"d": 7, "m": 0}), "k", "left")
    d = d.withColumns({c: F.coalesce(c, F.lit("Object" if c in "cd" else "none")) for c in "chdm"})
    kinds = list(CLASSES)
    language = F.element_at(F.array(*map(F.lit, kinds)), (F.col("k") % len(kinds) + 1).cast("int"))
    text = F.element_at(F.array(*map(F.lit, CLASSES.values())), (F.col("k") % len(kinds) + 1).cast("int"))
    for name, value in [(str(i), F.col("w")[i - 1]) for i in (1, 2, 8)] + [(c, F.col(c)) for c in "chdm"]:
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return d.select("k", F.concat(F.lit("t"), F.col("k").cast("string"), F.lit("."), language).alias("file"), text.alias("text"), language.alias("language"))
