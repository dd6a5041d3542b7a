"""The operators' queries over the driver's tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import sql
from loomgraph.llm.bpe_codec import encode_decode
from loomgraph.llm.cover_tree import top_inner_products
from loomgraph.llm.filter_audit import filter_audit
from loomgraph.llm.language_id import language_id
from loomgraph.llm.lm_scoring import lm_scores
from loomgraph.llm.merkle import merkle_manifest
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.quality_rules import quality_rules
from loomgraph.llm.sharding import shards
from loomgraph.llm.simhash import near_duplicates
from loomgraph.llm.substring_dedup import substring_dedup
from loomgraph.llm.token_counts import token_counts
from loomgraph.llm.warc import derivatives, responses
from loomgraph.session import ship, table

BPE_50K = "byte_bpe_50k.json"


def op1_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the passages that earlier documents have; the removed spans as start-end;... in characters."""
    ship(spark)
    out = substring_dedup(table(spark, d, "documents").select("doc_id", "text"))
    span = F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"]))
    return out.withColumn("removed", F.array_join(span, ";"))


def op2_packing(spark: SparkSession, d: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, lexical neighbours together."""
    ship(spark)
    return pack_documents(table(spark, d, "documents"), public_tokenizers.path(BPE_50K))


def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    """Predicts every document's language; learns from those whose id's crc32 mod 3 is not 1."""
    ship(spark)
    docs = table(spark, d, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    fitted = language_id(docs.where(~F.coalesce(held_out, F.lit(False))), docs)
    v = docs.select("doc_id", held_out.alias("held_out"), fitted(F.col("text")).alias("v"))
    return v.select("doc_id", "held_out", "v.lang_pred", "v.score", "v.bits", "v.accepted")


def op9_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Counts, base and verdict of the cascade for every document."""
    ship(spark)
    return quality_rules(table(spark, d, "documents")).drop("rejected_by")


def op4_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Scores every document; learns from those whose id's crc32 mod 7 is not 2."""
    ship(spark)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_scores(table(spark, d, "documents"), held_out)


def op5_simhash(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and component of every document."""
    ship(spark)
    return near_duplicates(table(spark, d, "documents"))


def op6_warc(spark: SparkSession, d: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    ship(spark)
    pages = responses(table(spark, d, "pages"), F.col("url"), F.col("html"), F.col("page_id"))
    out = derivatives(pages, "source_key").withColumnRenamed("source_key", "page_id")
    return out.withColumn("text", F.decode("block", "UTF-8")).drop("block", "record")  # of either record: the fields, or the page as text


def op7_cover_tree(spark: SparkSession, d: str) -> DataFrame:
    """The 5 highest inner products of every vector whose id is divisible by 50."""
    ship(spark)
    return top_inner_products(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_bpe_codec(spark: SparkSession, d: str) -> DataFrame:
    """Encodes and decodes every document; digests of both."""
    ship(spark)
    out = encode_decode(table(spark, d, "documents"), public_tokenizers.path(BPE_50K))
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Bytes and tokens of every document."""
    ship(spark)
    return token_counts(table(spark, d, "documents"), public_tokenizers.path(BPE_50K))


def op11_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    """What five filters remove from every source, in all their orders."""
    ship(spark)
    return filter_audit(table(spark, d, "documents"), table(spark, d, "labels"))


def op12_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every document's leaf, path digest and fold; of ids whose crc32 is even the text is folded without newlines."""
    ship(spark)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle_manifest(table(spark, d, "documents"), tampered)


def op13_sharding(spark: SparkSession, d: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return shards(table(spark, d, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_cover_tree": op7_cover_tree,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_sharding": op13_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": sql.substring_dedup(),
    "op7_cover_tree": sql.top_inner_products(),
    "op9_quality_rules": sql.quality_rules(),
    "op11_filter_audit": sql.filter_audit(),
    "op12_merkle_manifest": sql.merkle_manifest(),
    "op13_sharding": sql.sharding(),
}
