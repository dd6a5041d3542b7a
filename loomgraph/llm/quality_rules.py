"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a sample; then the rules run
in the order of rejection per cost, and a document meets no rule after the
first that rejects it. The order changes the time taken and the rule that is
named, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bounded, columnwise, tidy

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
WINDOW = 8


class Doc:
    """Measures of one text; each is taken at most once, and only if a rule asks for it."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()  # of bytes: at space and 0x09 to 0x0D, nothing else

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, SPACES + CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def upper_share(self) -> float:
        """Capitals among the ASCII letters."""
        upper = len(self.text) - len(self.text.translate(None, UPPER))
        lower = len(self.text) - len(self.text.translate(None, LOWER))
        return upper / max(1, upper + lower)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines)) if b"\n" in self.text else 0

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 8-word windows that the text holds twice or more, all their places counted."""
        n = len(self.words) - WINDOW + 1
        if n < 2:
            return 0
        h = np.fromiter(map(hash, self.words), np.int64, len(self.words)).view(np.uint64)
        if not _repeats(_windows(h, n)):
            return 0  # equal windows have equal hashes, so there is none
        ids: dict[bytes, int] = {}
        exact = [ids.setdefault(w, len(ids)) for w in self.words]
        seen: dict[tuple[int, ...], int] = {}
        keys = [tuple(exact[i : i + WINDOW]) for i in range(n)]
        for k in keys:
            seen[k] = seen.get(k, 0) + 1
        twice = np.fromiter((seen[k] > 1 for k in keys), bool, n)
        cover = np.zeros(len(self.words) + 1, np.int64)
        cover[:n] += twice
        cover[WINDOW:] -= twice
        return int((np.cumsum(cover)[:-1] > 0).sum())


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + n]
    return out


def _repeats(x: np.ndarray) -> bool:
    x = np.sort(x)
    return bool((x[1:] == x[:-1]).any())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


#: Rules of the base: their failure alone rejects.
BASE = (
    Rule("too_few_words", lambda d: d.n_words < 20),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 30 * d.n_words),
)
#: Wide limits: they reject what is plainly no prose.
RULES = (
    *BASE,
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("capitals", lambda d: d.upper_share > 0.6),
    Rule("shouting", lambda d: 10 * d.text.count(b"!!") > 3 * d.n_words),
)


def plan(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = 2000) -> tuple[Rule, ...]:
    """The rules in the order of rejection per cost, as estimated on about `rows` rows, drawn row by row with a share that follows from the table's size.

    Every rule runs on a fresh measure of every sampled text; only each
    rule's seconds and rejections leave the executors. A rule that rejects
    nothing in the sample goes last, cheap ones first. An empty sample leaves
    the given order.
    """
    bounded(df.sparkSession)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for i, r in enumerate(rules):
                    began = time.perf_counter()
                    hits[i] += bool(r.rejects(Doc(text or b"")))
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(spent), pa.array(hits, pa.int64())], ["rule", "spent", "hits"])

    share = min(1.0, rows / max(1, df.count()))  # the count reads no column
    sample = df.where(F.rand(9) < share).select(F.col(text_col).cast("binary").alias("text"))
    got = sample.mapInArrow(tidy(tried), "rule int, spent double, hits long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("hits").alias("hits")).collect()
    rank = {r.rule: (-r.hits / max(r.spent, 1e-9), r.spent) for r in got}
    return tuple(rules[i] for i in sorted(range(len(rules)), key=lambda i: (*rank.get(i, (0.0, 0.0)), i)))


def verdict(order: tuple[Rule, ...], counts: bool = True) -> Callable[[Column], Column]:
    """A function of a binary text column: struct of the counts, base_failed, kept and rejected_by.

    counts: whether the counts and base_failed are wanted for every text; they
    are null where not, so that the cascade alone decides what is measured.
    """
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"

    @columnwise(fields)
    def judge(texts: pa.Array) -> pa.Array:
        cols: list[list] = [[] for _ in range(8)]
        for text in texts.to_pylist():
            d = Doc(text or b"")
            by = next((r.name for r in order if r.rejects(d)), None)
            failed = any(r.rejects(d) for r in BASE) if counts else None
            measured = (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words) if counts else (None,) * 5
            for c, v in zip(cols, (*measured, failed, by is None and not failed, by), strict=True):
                c.append(v)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in fields.split(", ")])

    return judge.asNondeterministic()  # so that it runs once a row


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, counts: bool = True) -> DataFrame:
    """One row for each row of df: doc_id, the counts, base_failed, kept and the first rule that rejected.

    A null text has no words, so the base rejects it. Repeated rows each give a
    row; columns besides id and text, whatever their names, are not read; an
    empty table gives an empty result. Texts are measured whole. No shuffle but
    that of the sample's sums.
    """
    judge = verdict(plan(df, text_col, rules), counts)
    return df.select(F.col(id_col).alias("doc_id"), judge(F.col(text_col).cast("binary")).alias("v")).select("doc_id", "v.*")


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that no rule rejects, with df's columns."""
    judge = verdict(plan(df, text_col, rules), counts=False)
    return df.where(judge(F.col(text_col).cast("binary"))["kept"])
