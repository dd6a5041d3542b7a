"""Language identification by interpolated Kneser-Ney character models.

One model for each language, fitted on a bounded sample of labelled rows. Its
n-grams lie in sorted arrays of 64-bit hashes, shared by all languages: each
entry holds one value per language. A text's language is the one with the
lowest cross-entropy per character; a text whose lowest is above what that
language's own texts show is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bounded, slices, tidy

#: Characters of an n-gram; bits of a symbol, so that an n-gram's code has ORDER * BITS = 24.
ORDER, BITS = 4, 6
#: Symbol 0 is whatever is no letter; the most frequent letters of the sample have their own, others share one by their block.
OWN_LETTERS = 48
#: Bounds of the fitting sample: rows of a language, characters of a language.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 4_000_000
#: Lengths, in counted positions, for which the rejection is calibrated; each on so many pieces at least.
LENGTHS, PIECES = tuple(1 << k for k in range(13)), 100
UNKNOWN = "und"


def _hash(codes: np.ndarray, order: int) -> np.ndarray:
    x = codes.astype(np.uint64) + np.uint64(order << 56)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def symbols(letters: list[int]) -> np.ndarray:
    """Symbol of each code point of lower-cased text."""
    table = np.zeros(0x110000, np.uint8)
    shared = 2**BITS - 1 - OWN_LETTERS
    alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    points = np.flatnonzero(alpha)
    table[points] = OWN_LETTERS + 1 + (points >> 7) % shared
    table[np.asarray(letters, np.int64)] = np.arange(1, len(letters) + 1)
    return table


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each counted position, and how many positions each text has.

    Every text starts after ORDER - 1 symbols 0. A position counts unless it is
    no letter after no letter, so runs of spaces and signs weigh as one.
    """
    pad = ORDER - 1
    parts = [points(t) for t in texts]
    sizes = np.fromiter((len(p) + pad for p in parts), np.int64, len(parts))
    row = np.zeros(int(sizes.sum()), np.uint32)
    at = np.cumsum(sizes) - sizes
    for a, p in zip(at.tolist(), parts, strict=True):
        row[a + pad : a + pad + len(p)] = table[p]
    codes = row.copy()
    for k in range(1, ORDER):
        codes[k:] |= row[:-k] << np.uint32(BITS * k)
    counted = row > 0
    counted[1:] |= row[:-1] > 0
    starts = np.zeros(len(row), bool)
    starts[np.concatenate([at + j for j in range(pad)]).astype(np.int64)] = True
    counted &= ~starts
    ends = np.concatenate([[0], np.cumsum(counted)])
    n = ends[at + sizes] - ends[at]
    return codes[counted], n


@dataclass
class Model:
    """Kneser-Ney models of all languages.

    For each order k: `keys[k]` sorted hashes of k-grams, `alpha[k]` their
    discounted shares, `hist[k]` sorted hashes of their histories and
    `gamma[k]` the weights of the lower order, a column for each language.
    """

    langs: list[str]
    letters: list[int]
    keys: list[np.ndarray] = field(default_factory=list)
    alpha: list[np.ndarray] = field(default_factory=list)
    hist: list[np.ndarray] = field(default_factory=list)
    gamma: list[np.ndarray] = field(default_factory=list)
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """log2 probability of each n-gram's last symbol in each language."""
        p = np.full((len(codes), len(self.langs)), 2.0**-BITS)
        for k in range(1, ORDER + 1):
            gram = codes & np.uint32((1 << (BITS * k)) - 1)
            g = _find(self.hist[k - 1], self.gamma[k - 1], _hash(gram >> np.uint32(BITS), k), 1.0)
            p = g * p + _find(self.keys[k - 1], self.alpha[k - 1], _hash(gram, k), 0.0)
        return np.log2(p).astype(np.float32)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, absent: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), absent)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], absent)


def _counts(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """k-grams with their counts for k = 1 to ORDER: as seen at the highest order, by distinct symbols before them below."""
    top = np.unique(codes, return_counts=True)
    out = [top]
    for k in range(ORDER - 1, 0, -1):
        out.append(np.unique(out[-1][0] & np.uint32((1 << (BITS * k)) - 1), return_counts=True))
    return out[::-1]


def fit(samples: dict[str, list[str]]) -> Model:
    """Fit on texts by language; a fifth of each language's texts only calibrates the rejection."""
    langs = sorted(k for k, v in samples.items() if any(c.isalpha() for t in v for c in t))
    seen: dict[int, int] = {}
    for k in langs:
        for t in samples[k]:
            u, n = np.unique(points(t), return_counts=True)
            for c, m in zip(u.tolist(), n.tolist(), strict=True):
                seen[c] = seen.get(c, 0) + m
    letters = [c for c in sorted(seen, key=lambda c: (-seen[c], c)) if chr(c).isalpha()][:OWN_LETTERS]
    model = Model(langs, letters)
    table = symbols(letters)
    parts = {k: ([t for i, t in enumerate(samples[k]) if i % 5 or len(samples[k]) < 5], [t for i, t in enumerate(samples[k]) if not i % 5]) for k in langs}
    tables = [_counts(grams(parts[k][0], table)[0]) for k in langs]
    for order in range(1, ORDER + 1):
        a, g = [], []
        for t in tables:
            codes, n = t[order - 1]
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            h, first, size = np.unique(codes >> np.uint32(BITS), return_index=True, return_counts=True)
            total = np.add.reduceat(n, first) if len(n) else n
            a.append((codes, (n - d) / np.repeat(total, size)))
            g.append((h, d * size / total))
        for cols, keys, values, absent in ((a, model.keys, model.alpha, 0.0), (g, model.hist, model.gamma, 1.0)):
            every = np.unique(np.concatenate([c for c, _ in cols])) if cols else np.zeros(0, np.uint32)
            v = np.full((len(every), len(langs)), absent)
            for j, (c, x) in enumerate(cols):
                v[np.searchsorted(every, c), j] = x
            hashed = _hash(every, order)
            by = np.argsort(hashed)
            keys.append(hashed[by])
            values.append(v[by])
    model.limit = np.array([limits(*_bits(model, j, grams(parts[k][1], table))) for j, k in enumerate(langs)]).reshape(len(langs), len(LENGTHS))
    return model


def _bits(model: Model, j: int, of: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = of
    return -model.log2(codes)[:, j].astype(np.float64), n


def limits(bits: np.ndarray, n: np.ndarray) -> list[float]:
    """For each of LENGTHS a limit to the cross-entropy of a language's own texts: above the highest that its calibration texts show over so many positions in a row, by as much as that is above their median.

    bits: of each position; n: positions of each text. A longer text averages
    over more positions, so it stays below. A length of too few pieces takes
    the shorter one's limit; without any the limit is that of no evidence.
    """
    ends, out = np.concatenate([[0], np.cumsum(bits)]), []
    starts = np.cumsum(n) - n
    for length in LENGTHS:
        count = n // length
        first = np.repeat(starts, count) + length * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        h = (ends[first + length] - ends[first]) / length
        out.append(float(2 * h.max() - np.median(h)) if len(h) >= PIECES else out[-1] if out else float("inf"))
    return out


class Scorer:
    """Scores texts; n-grams met once are kept in a table that their code addresses."""

    def __init__(self, model: Model):
        self.model, self.table = model, symbols(model.letters)
        self.at = np.zeros(1 << (ORDER * BITS), np.int32)  # 1 and the place in rows; pages that no code falls into take no memory
        self.rows = np.zeros((0, len(model.langs)), np.float32)

    def values(self, codes: np.ndarray) -> np.ndarray:
        at = self.at[codes]
        new = codes[at == 0]
        if len(new):
            new = np.unique(new)
            self.at[new] = np.arange(len(self.rows), len(self.rows) + len(new), dtype=np.int32) + 1
            self.rows = np.concatenate([self.rows, self.model.log2(new)])
            at = self.at[codes]
        return at - 1

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per position, by text and language; positions of each text."""
        codes, n = grams(texts, self.table)
        at = self.values(codes)
        ends = np.cumsum(n)
        out = np.zeros((len(texts), len(self.model.langs)))
        some = n > 0
        for j in range(out.shape[1]):
            if some.any():
                out[some, j] = -np.add.reduceat(self.rows[:, j][at], (ends - n)[some], dtype=np.float64) / n[some]
        return out, n


FIELDS = "lang_pred string, score double, bits double, accepted boolean"


def classifier(model: Model, bc) -> Column:
    @F.arrow_udf(FIELDS)
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(bc.value)  # one a task: what it has learned of n-grams goes with it
        yield from tidy(lambda texts: (_classify(scorer, t) for t in texts))(batches)

    return classify


def _classify(s: Scorer, texts: pa.Array) -> pa.Array:
    m = s.model
    lang, score, bits, ok = [], [], [], []
    sizes = np.asarray(pc.binary_length(texts).fill_null(0))
    for lo, hi in slices(sizes, 2 << 20):
        part = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
        h, n = s.score(part)
        for i in range(hi - lo):
            if not m.langs or n[i] == 0:
                lang.append(UNKNOWN), score.append(0.0), bits.append(None), ok.append(False)
                continue
            j = int(np.argmin(h[i]))
            p = np.exp2((h[i, j] - h[i]) * min(float(n[i]), 200.0))
            lang.append(m.langs[j]), score.append(float(1 / p.sum())), bits.append(float(h[i, j]))
            ok.append(bool(h[i, j] <= m.limit[j, min(int(n[i]).bit_length(), len(LENGTHS)) - 1]))
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(ok, pa.bool_())], [x.split()[0] for x in FIELDS.split(", ")])


def sample(df: DataFrame, text_col: str, lang_col: str, key: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Distinct texts by language, picked by a hash of `key`, whole: about `rows` of each, and in the order of that hash no more once they have `chars` characters.

    This is the bounded sample the models are fitted on. No text is cut, so one
    longer than `chars` stands alone. Every language is learned; the driver gets
    its name and count.
    """
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    named = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    there = {r.lang: r.n for r in named.collect()}
    if not there:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in there.items() for x in (k, min(1.0, rows / n))])[F.col(lang_col)]
    by = F.xxhash64(key)
    picked = known.where(F.pmod(by, F.lit(1 << 20)) < share * (1 << 20)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), by.alias("by"))
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("by", "text").rowsBetween(Window.unboundedPreceding, -1))
    picked = picked.distinct().withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < chars)
    out: dict[str, dict[str, None]] = {k: {} for k in there}
    for r in picked.select("lang", "text").collect():
        out[r.lang][r.text] = None
    return {k: sorted(v) for k, v in out.items()}


def language_id(train: DataFrame, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """The function of a text column that gives struct(lang_pred, score, bits, accepted), fitted on `train`.

    lang_pred is `und` with score 0, not accepted, where the text is null or has
    no letter, or where nothing could be learned (no labelled text). Otherwise
    it is the learned language of lowest cross-entropy; ties go to the smaller
    name. score is that language's share of the likelihoods over at most 200
    characters' worth of evidence. accepted says whether the cross-entropy is
    within the limit that the calibration fifth of that language sets for texts
    of this length. Rows that repeat are learned once and each predicted. Only text and language of
    `train` are read; columns of other names don't matter.
    """
    bounded(df.sparkSession)
    model = fit(sample(train, text_col, lang_col, F.col(id_col)))
    bc = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's size
    return classifier(model, bc)


def predict(df: DataFrame, fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), fitted(F.col(text_col)).alias("v")).select("doc_id", "v.*")
