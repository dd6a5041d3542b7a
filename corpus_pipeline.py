"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all rows that the one before kept. The driver writes every
stage's rows as Parquet and reads them again; run() does the same through the
shared folder, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.language_id import language_id
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.quality_rules import keep_good
from loomgraph.llm.simhash import keep_one_similar
from loomgraph.llm.substring_dedup import substring_dedup
from loomgraph.session import Stored, ship, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: no letter, or unlike every learned language."""
    ship(spark)
    fitted = language_id(docs, docs)
    return docs.where(fitted(F.col("text"))["accepted"])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects."""
    ship(spark)
    return keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more) the document with the smallest id."""
    ship(spark)
    return keep_one_similar(docs)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; n_chars follows the text. A document of which nothing is left goes."""
    ship(spark)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    d = substring_dedup(docs.select("doc_id", "text", rest.alias("rest")))
    d = d.where(~(F.col("cut") & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    of = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col("rest")[c] for c in docs.columns if c not in ("doc_id", "text")}
    if "n_chars" in of:
        of["n_chars"] = F.when(F.col("cut"), F.length("text").cast("long")).otherwise(of["n_chars"])
    return d.select(*[of[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    ship(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("simhash", one_of_each),
    ("substring_dedup", no_repeats),
    ("packing", packed),
]

#: Tokens, models and fingerprints are beyond SQL; the tests hold the pipeline against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}").read()
    return STAGES[-1][1](spark, docs, sf_dir)
