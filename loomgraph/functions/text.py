"""Functions of source text and identifiers, built-in expressions throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tokens leave out, and words that skeletons keep.
DROPPED = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "new", "const", "let", "var", "async", "else", "try", "finally", "class", "case", "of", "in", "throw")
KEPT = {
    "js": ("if", "else", "for", "while", "do", "switch", "case", "default", "break", "continue", "return", "function", "class", "new", "typeof", "instanceof", "const", "let", "var", "of", "in", "try", "catch", "finally", "throw", "await", "async", "yield", "extends", "super", "this", "null", "true", "false", "void", "delete", "import", "export", "from", "static", "get", "set"),
    "py": ("if", "elif", "else", "for", "while", "def", "class", "return", "try", "except", "finally", "raise", "with", "as", "import", "from", "and", "or", "not", "in", "is", "lambda", "pass", "yield", "await", "async", "None", "True", "False", "global", "nonlocal", "del", "assert"),
}
# Tokens of a skeleton.
SKELETON = r"""`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\d+\.?\d*|[A-Za-z_$][\w$]*|===|!==|>>>|<<=|>>=|\*\*|\.\.\.|&&|\|\||\?\?|\?\.|=>|==|!=|<=|>=|\+\+|--|\+=|-=|\*=|\/=|&&|[-+*/%=<>!&|^~?:;,.(){}\[\]]"""
# Comments, line comments going first, so that a block comment which one of them cuts off stays open; tokens of a body.
LINE_COMMENT, BLOCK_COMMENT = r"\/\/[^\n]*", r"\/\*[\s\S]*?\*\/"
TOKENS = r"[a-z_$][\w$]*|[{}();=><!+\-*/%]"
# Strings by kind of quotes, one alternative each: DuckDB's patterns, which the results are held against, know no back-references.
STRINGS = r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`"""
SHINGLE = 3
BODY_LINES = 400


def capped(body: Column, lines: int = BODY_LINES) -> Column:
    """A body's first lines; the bound is part of the similarity's definition."""
    return F.array_join(F.slice(F.split(body, "\n"), 1, lines), "\n")


def without_comments(body: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(body, LINE_COMMENT, " "), BLOCK_COMMENT, " ")


def tokens(body: Column) -> Column:
    """M1: identifiers and operators in lower case; comments gone, strings as one word, keywords left out."""
    clean = F.lower(F.regexp_replace(without_comments(body), f"(?s){STRINGS}", " STR "))
    return F.filter(F.regexp_extract_all(clean, F.lit(TOKENS), F.lit(0)), lambda t: ~t.isin(*DROPPED))


def shingles(words: Column, k: int = SHINGLE) -> Column:
    """M2: distinct runs of k words; none where there are fewer."""
    n = F.size(words) - k + 1
    at = lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), at))).otherwise(F.array().cast("array<string>"))


def skeleton(body: Column, language: str = "js") -> Column:
    """M3: tokens with names as ID, numbers as NUM, strings as STR; keywords and operators stay."""
    clean = F.regexp_replace(body, r"#[^\n]*", " ") if language == "py" else without_comments(body)
    kept = KEPT[language]
    first = lambda t: F.substring(t, 1, 1)
    word = lambda t: (
        F.when(first(t).isin("`", '"', "'"), "STR").when(first(t).rlike("[0-9]"), "NUM").when(first(t).rlike("[A-Za-z_$]") & ~t.isin(*kept), "ID").otherwise(t)
    )
    return F.transform(F.regexp_extract_all(clean, F.lit(SKELETON), F.lit(0)), word)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def split_name(name: Column) -> Column:
    """Lower-case parts of an identifier: at case changes, digits' ends and anything that is no letter or digit."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda x: x != "")


def stem(word: Column) -> Column:
    """Plural, participle and agent endings off, so that a query and a name meet."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    first = (
        F.when((n > 5) & word.endswith("ing"), cut(3)).when((n > 4) & (word.endswith("ed") | word.endswith("es") | word.endswith("er")), cut(2))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), cut(1)).otherwise(word)
    )
    bare = F.when((F.length(first) > 4) & first.endswith("e"), F.substring(first, F.lit(1), F.length(first) - 1)).otherwise(first)
    return F.when((n > 4) & word.endswith("ies"), F.concat(cut(3), F.lit("y"))).otherwise(bare)


def complexity(body: Column, language: str = "js") -> Column:
    """1 and the decisions outside comments and strings."""
    clean = without_comments(body)
    if language == "py":
        clean = reduce(lambda b, p: F.regexp_replace(b, p, " "), (r"'''[\s\S]*?'''", r'"""[\s\S]*?"""', r"#[^\n]*"), body)
    s = F.regexp_replace(clean, STRINGS, " ")
    if language == "py":
        return 1 + F.regexp_count(s, F.lit(r"\b(?:if|elif|for|while|except|and|or)\b"))
    rest = F.regexp_replace(s, r"\?\?|\?\.", " ")
    return 1 + F.regexp_count(s, F.lit(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?")) + F.regexp_count(rest, F.lit(r"\?"))


def nesting(body: Column) -> Column:
    """Deepest nesting of braces outside comments and strings; a fold over the braces alone."""
    s = F.regexp_replace(without_comments(body), STRINGS, " ")
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    step = lambda a, c: F.struct(F.when(c == "{", a["d"] + 1).otherwise(F.greatest(a["d"] - 1, F.lit(0))).alias("d"), F.greatest(a["m"], F.when(c == "{", a["d"] + 1).otherwise(F.lit(0))).alias("m"))
    return F.aggregate(F.regexp_extract_all(s, F.lit("[{}]"), F.lit(0)), zero, step, lambda a: a["m"])


def suggestion_tier(label: Column, wanted: str) -> Column:
    """5 equal, 4 prefix, 3 part, 2 shared word, 1 at most two edits, else 0; case aside."""
    low, w = F.lower(label), wanted.lower()
    long = (F.length(low) >= 3) & F.lit(len(w) >= 3)
    words = split_name(F.lit(wanted))
    return (
        F.when(low == w, 5).when(long & (low.startswith(w) | F.lit(w).startswith(low)), 4).when(long & (low.contains(w) | F.lit(w).contains(low)), 3)
        .when(F.arrays_overlap(split_name(label), words), 2).when(long & (F.levenshtein(low, F.lit(w), 2) >= 0), 1).otherwise(0)
    )
