"""Concept search: which symbols an idea, in words, may mean.

An inverted index is stored once: for every stem that a node's label, owner,
file, path or domain has, a row, in folders by the stem's first letters; and
what weighs a node, a row each. A query reads the folders of its words alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import split_name, stem
from loomgraph.session import Stored

# Words that carry no meaning in a query.
STOP = (
    "a an the is are was were be been being do does did how what where when which who why in on at of for to from with and or not it its this that these those there "
    "we you i my our your can could should would will happen happens"
).split()
# What a word is worth by where it is found, the first place counts; roles' and other factors.
WORTH = (("label", 3.0), ("begins", 1.5), ("owner", 1.5), ("file", 2.0), ("path", 1.0), ("domain", 0.75))
WHOLE_LABEL, EXPORTED, MODULE, PRODUCT = 4.0, 1.25, 0.4, 1.2
ROLES = {"test": 0.6, "fixture": 0.6, "generated": 0.5, "bench": 0.5, "example": 0.5}
#: Letters of a stem that name its folder; the beginning of a label's word is looked for from BEGINS letters on.
HEAD, BEGINS = 2, 3


def stems(text: Column) -> Column:
    return F.transform(split_name(text), stem)


def query_words(text: Column) -> Column:
    """The words of a query that mean something, as stems, each once."""
    return F.array_distinct(F.transform(F.filter(split_name(text), lambda w: ~w.isin(*STOP)), stem))


@dataclass
class SearchIndex:
    """words (head, word, id, label, owner, file, path, domain) and nodes (id, joined, factor, role)."""

    words: Stored
    nodes: Stored

    def drop(self) -> None:
        self.words.drop()
        self.nodes.drop()


def build_index(nodes: DataFrame, edges: DataFrame) -> SearchIndex:
    """Index of nodes (id, label, kind, file, exports, domain, role). Nulls are empty; edges count by distinct callers and importers."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    tail = F.substring_index(F.col("id"), ":", -1)
    last = F.regexp_replace(F.substring_index(text("file"), "/", -1), r"\.[^.]+$", "")
    above = F.regexp_replace(text("file"), r"[^/]*$", "")
    places = {"label": stems(text("label")), "owner": F.when(tail == F.col("label"), stems(text("label"))).otherwise(stems(tail)), "file": stems(last), "path": stems(above), "domain": stems(text("domain"))}
    each = nodes.select("id", F.explode(F.array(*[F.struct(F.lit(p).alias("place"), words.alias("words")) for p, words in places.items()])).alias("t"))
    found = each.select("id", "t.place", F.explode("t.words").alias("word"))
    words = found.groupBy("id", "word").agg(*[F.max(F.col("place") == F.lit(p)).alias(p) for p in places])
    words = words.select(F.substring("word", 1, HEAD).alias("head"), "word", "id", *places)
    degree = edges.where("kind IN ('call', 'import')").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("kind", "src").alias("degree"))
    factor = F.when(F.col("exports"), EXPORTED).otherwise(1.0) * F.when(F.col("kind") == "module", MODULE).otherwise(1.0) * (1 + F.least(F.coalesce("degree", F.lit(0)), F.lit(20)) / 40)
    weighed = nodes.join(degree, "id", "left").select("id", F.array_join(stems(text("label")), "").alias("joined"), factor.alias("factor"), "role")
    return SearchIndex(Stored(words.repartition("head"), "search-words", by="head"), Stored(weighed, "search-nodes"))


def find(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """(query, id, score) of all nodes that a query (query, text) has a word in common with.

    A word is worth what the first place that has it is worth; the sum, with a
    bonus where the words are the label, is cut by the share of the query's
    words that were found and weighed by exports, kind, role and callers. A
    query that asks for tests takes no role into account. Queries without a
    word that means something find nothing.
    """
    q = queries.select("query", query_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    asked = q.select("query", F.explode("words").alias("asked")).withColumn("of", F.substring("asked", 1, HEAD))
    w = index.words.read()
    begins = (F.length("asked") >= BEGINS) & F.col("label") & F.startswith(F.col("word"), F.col("asked"))
    same = F.col("word") == F.col("asked")
    met = w.join(asked, (w["head"] == F.col("of")) & (same | begins))
    at = {"label": same & F.col("label"), "begins": begins, **{p: same & F.col(p) for p in ("owner", "file", "path", "domain")}}
    by_word = met.groupBy("query", "id", "asked").agg(*[F.max(c).alias(f"in_{p}") for p, c in at.items()])
    worth = F.coalesce(*[F.when(F.col(f"in_{p}"), v) for p, v in WORTH])
    hits = by_word.groupBy("query", "id").agg(F.sum(worth).alias("base"), F.count("*").alias("matched"))
    whole = q.select("query", F.size("words").alias("n"), F.array_join("words", "").alias("whole"), F.arrays_overlap("words", F.array(F.lit("test"), F.lit("spec"))).alias("tests"))
    role = F.when(F.col("tests"), 1.0)
    for name, v in ROLES.items():
        role = role.when(F.col("role") == name, v)
    base = F.col("base") + F.when(F.col("joined") == F.col("whole"), WHOLE_LABEL).otherwise(0.0)
    score = base * F.col("matched") / F.col("n") * F.col("factor") * role.otherwise(PRODUCT)
    return hits.join(whole, "query").join(index.nodes.read(), "id").select("query", "id", F.round(score, 6).alias("score"))
