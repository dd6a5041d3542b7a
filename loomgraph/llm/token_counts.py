"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bounded, columnwise, slices
from loomgraph.llm.bpe import Codec, codec, safe_cut


def _parts(text: str, longest: int, special: re.Pattern | None) -> Iterator[str]:
    """A text cut at its special strings, which stand alone, and what is long between them at safe boundaries."""
    for piece in special.split(text) if special else (text,):
        lo = 0
        while lo < len(piece):
            hi = len(piece) if len(piece) - lo <= longest or special and special.fullmatch(piece) else safe_cut(piece, lo + longest)
            yield piece[lo:hi]
            lo = hi


def _count_bpe(c: Codec, texts: list[str | None], batch_bytes: int, longest: int) -> np.ndarray:
    counts = np.zeros(len(texts), np.int64)
    owners: list[int] = []
    parts: list[str] = []
    special = re.compile("(" + "|".join(map(re.escape, c.special)) + ")") if c.special else None
    for i, t in enumerate(texts):
        if t:
            for p in _parts(t, longest, special) if c.splits and len(t) > longest else (t,):
                owners.append(i)
                parts.append(p)
    sizes = np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in parts), np.int64, len(parts))
    for lo, hi in slices(sizes, batch_bytes):
        np.add.at(counts, owners[lo:hi], c.lengths_of(parts[lo:hi]))
    return counts


def _count_pieces(path: str, texts: list[str | None], batch_bytes: int) -> np.ndarray:
    model = _pieces(path)
    counts = np.zeros(len(texts), np.int64)
    sizes = np.fromiter((len((t or "").encode()) for t in texts), np.int64, len(texts))
    for lo, hi in slices(sizes, batch_bytes):
        ids = model.encode([t or "" for t in texts[lo:hi]], num_threads=1)
        counts[lo:hi] = [len(x) for x in ids]
    return counts


_MODELS: dict[str, object] = {}


def _pieces(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def token_counts(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
    batch_bytes: int = 1 << 20, longest: int = 1 << 16,
) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has more than `limit` tokens.

    tokenizer: a .json file of the tokenizers library or a .model file of
    sentencepiece, readable on every executor. Only lengths leave the Arrow
    function. Batches are balanced by bytes; a text over `longest` characters
    is cut at its special strings and at safe boundaries (see bpe), so the sum
    over its parts is its count. A .model file's texts are never cut: no safe
    boundary is known there.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each give a
    row. Columns besides id and text, whatever their names, are not read. An
    empty table gives an empty result. No shuffle: rows stay in their input
    splits, which Spark balances by bytes.
    """
    bounded(df.sparkSession)
    pieces = tokenizer.endswith(".model")

    @columnwise("long")
    def count(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        if pieces:
            return pa.array(_count_pieces(tokenizer, rows, batch_bytes))
        return pa.array(_count_bpe(codec(tokenizer), rows, batch_bytes, longest))

    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        df.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
