"""Functions of paths: roles, languages, directories, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a path says about its role, first match wins.
TEST_PATHS = r"(?:^|/)(?:tests?|__tests__|spec)/|(?:\.test\.|\.spec\.|_test\.|_spec\.)|(?:^|/)src/test/|(?:Tests?|Spec)\.(?:java|cs|php|swift|kt)$"
ROLE_PATHS = (
    ("test", TEST_PATHS),
    ("fixture", r"(^|/)(fixtures?|__fixtures__|__mocks__|mocks?)/"),
    ("example", r"(^|/)(examples?|samples?|demos?|playgrounds?|playground|sandbox|e2e)/"),
    ("bench", r"(^|/)(benchmarks?|bench|perf)/"),
    ("generated", r"\.(min|bundle)\.[cm]?js$|(^|/)(generated|__generated__)/"),
)
ROLES = ("product", *[r for r, _ in ROLE_PATHS])
# Language by extension; any other file counts as javascript.
LANGUAGES = {
    "py": "python", "rs": "rust", "go": "go", "java": "java", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "json": "json",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
}
#: Names of the line rules by language.
SYNTAX = {"python": "py", "rust": "rs", "csharp": "cs", "ruby": "rb", "kotlin": "kt", "javascript": "js", "typescript": "js"}


def is_test_file(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike(TEST_PATHS)


def role_of(path: Column) -> Column:
    """Role of a path; product where nothing matches."""
    out = F.lit("product")
    for role, pattern in reversed(ROLE_PATHS):
        out = F.when(F.coalesce(path, F.lit("")).rlike(pattern), role).otherwise(out)
    return out


def role_sql(path: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(coalesce({path}, ''), '{p}') THEN '{r}'" for r, p in ROLE_PATHS)
    return f"CASE {cases} ELSE 'product' END"


def language_of(path: Column) -> Column:
    """By the extension as it is written."""
    ext = F.regexp_extract(path, r"\.(\w+)$", 1)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext], F.lit("javascript"))


def syntax_of(path: Column) -> Column:
    """Which line rules a file's symbols are found by."""
    language = language_of(path)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SYNTAX.items() for x in kv])[language], language)


def glob_regex(glob: str) -> str:
    """`**` crosses directories, `*` and `?` do not."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = glob[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def override_role(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Role by the first glob that matches, else by the path. An unknown role is an error."""
    for glob, role in rules:
        if role not in ROLES:
            raise ValueError(f"unknown role {role!r} for {glob!r}")
    out = role_of(path)
    for glob, role in reversed(rules):
        out = F.when(path.rlike(glob_regex(glob)), role).otherwise(out)
    return out


def dir2(path: Column) -> Column:
    """The first two directories of a path; (root) for a file without one."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n == 1, F.lit("(root)")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), n - 1)), "/"))


def dir2_sql(path: str) -> str:
    p = f"string_split({path}, '/')"
    return f"CASE WHEN len({p}) = 1 THEN '(root)' ELSE array_to_string(list_slice({p}, 1, least(2, len({p}) - 1)), '/') END"
