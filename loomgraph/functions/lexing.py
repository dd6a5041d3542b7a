"""Comments and strings of eleven languages, told from code by a table and a stack.

Every language is a few rows: what opens a comment or string, what closes it,
whether a backslash escapes, what opens code inside it. The stack holds the
strings whose inner code is being read, so nesting has no limit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Literal:
    """A comment or string: open and close are patterns (close may use the opener's groups as {1}); inner opens code that `}}` (or `)`) ends."""

    open: str
    close: str
    escapes: bool = True
    inner: str = ""
    lines: bool = True
    comment: bool = False


def _comment(open_: str, close: str) -> Literal:
    return Literal(open_, close, False, comment=True)


LINE, BLOCK = _comment(r"//", r"(?=\n)"), _comment(r"/\*", r"\*/")
HASH = _comment(r"#", r"(?=\n)")
SINGLE, DOUBLE = Literal(r"'", r"'", lines=False), Literal(r'"', r'"', lines=False)
CHAR = Literal(r"'(?=\\|[^'\n]')", r"'", lines=False)
TRIPLE = Literal(r'"""', r'"""', False)
LANGUAGES: dict[str, tuple[Literal, ...]] = {
    "js": (LINE, BLOCK, Literal(r"`", r"`", inner=r"\$\{"), SINGLE, DOUBLE),
    "py": (
        HASH, Literal(r"(?i:\b(?:rf|fr|f))('''|\"\"\")", "{1}", inner=r"\{\{|\{"), Literal(r"(?i:\b(?:rf|fr|f))(['\"])", "{1}", inner=r"\{\{|\{", lines=False),
        Literal(r"(?i:\b(?:rb|br|r|b|u))?('''|\"\"\")", "{1}"), Literal(r"(?i:\b(?:rb|br|r|b|u))?(['\"])", "{1}", lines=False),
    ),
    "rb": (_comment(r"(?m:^=begin\b)", r"(?m:^=end\b[^\n]*)"), HASH, Literal(r"'", r"'"), Literal(r'"', r'"', inner=r"#\{"), Literal(r"`", r"`", inner=r"#\{")),
    "php": (LINE, BLOCK, _comment(r"#(?!\[)", r"(?=\n)"), Literal(r"'", r"'"), Literal(r'"', r'"', inner=r"\{(?=\$)")),
    "go": (LINE, BLOCK, Literal(r"`", r"`", False), CHAR, DOUBLE),
    "rs": (LINE, BLOCK, Literal(r'\bb?r(#*)"', '"{1}', False), CHAR, Literal(r'"', r'"')),
    "java": (LINE, BLOCK, TRIPLE, CHAR, DOUBLE),
    "cs": (
        LINE, BLOCK, TRIPLE, Literal(r'(?:\$@|@\$)"', r'"(?!")', False, inner=r"\{\{|\{"), Literal(r'@"', r'"(?!")', False), Literal(r'\$"', r'"', inner=r"\{\{|\{", lines=False), CHAR, DOUBLE,
    ),
    "kt": (LINE, BLOCK, Literal(r'"""', r'"""', False, inner=r"\$\{"), CHAR, Literal(r'"', r'"', inner=r"\$\{", lines=False)),
    "swift": (LINE, BLOCK, Literal(r'"""', r'"""', inner=r"\\\("), Literal(r'"', r'"', inner=r"\\\(", lines=False)),
}
LANGUAGES["kotlin"] = LANGUAGES["kt"]
#: A regular expression may begin after these, or after one of these words.
BEFORE_REGEX = frozenset("(,=:[!&|?{};~+-*%<>^\n")
BEFORE_REGEX_WORDS = re.compile(r"\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|instanceof|yield|await)$")
REGEX = re.compile(r"/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
HEREDOC = {"rb": re.compile(r"<<([~-]?)(['\"`]?)([A-Za-z_]\w*)\2"), "php": re.compile(r"<<<()[ \t]*(['\"]?)([A-Za-z_]\w*)\2")}


@lru_cache(maxsize=None)
def _code(language: str) -> tuple[re.Pattern, tuple[Literal, ...], tuple[int, ...]]:
    """A pattern for whatever matters in code, the literals, and the group number of each."""
    literals = LANGUAGES.get(language, LANGUAGES["js"])
    parts, at, n = [], [], 0
    for x in literals:
        n += 1
        at.append(n)
        parts.append(f"({x.open})")
        n += re.compile(x.open).groups
    brackets = r"[{}()\n/]" if language not in HEREDOC else r"[{}()\n]|<<"
    return re.compile("|".join([*parts, brackets])), literals, tuple(at)


@lru_cache(maxsize=4096)
def _inside(literal: Literal, group: str) -> re.Pattern:
    close = literal.close.replace("{1}", re.escape(group))
    stops = [r"\\[\s\S]" if literal.escapes else "", f"(?P<inner>{literal.inner})" if literal.inner else "", f"(?P<close>{close})", r"(?P<line>\n)" if not literal.lines else "", r'""' if literal.close.endswith('(?!")') else ""]
    if literal.inner.startswith("\\\\"):
        stops = stops[1:2] + stops[:1] + stops[2:]  # the opener of inner code is itself an escape
    if literal.close.endswith('(?!")'):
        stops = stops[-1:] + stops[:-1]
    return re.compile("|".join(s for s in stops if s))


def masked_text(text: str, language: str, keep_values: bool = False) -> str:
    """Comments and strings blanked; every other character keeps its place and every line its number.

    Code inside strings (templates, interpolations) stays. keep_values: only
    comments are blanked. What nothing closes goes on to the end, a string of
    one line to the line's end. Takes time in proportion to the text.
    """
    out: list[str] = []
    code, literals, groups = _code(language)
    stack: list[tuple[Literal, str, int, str]] = []  # strings that the code being read stands in, with the depth of brackets outside and the bracket that ends it
    pending: list[tuple[str, bool]] = []  # here-documents that begin on the next line
    at, depth, n = 0, 0, len(text)

    def blank(lo: int, hi: int, keep: bool) -> None:
        part = text[lo:hi]
        out.append(part if keep else re.sub(r"[^\n]", " ", part))

    def read(x: Literal, group: str, lo: int) -> int:
        """Through a literal from lo, just after its opener, to its end or to code inside."""
        nonlocal depth
        pattern, pos = _inside(x, group), lo
        while True:
            m = pattern.search(text, pos)
            if m is None:
                blank(lo, n, keep_values and not x.comment)
                return n
            if m.lastgroup == "close" or m.lastgroup == "line":
                end = m.end() if m.lastgroup == "close" else m.start()
                blank(lo, end, keep_values and not x.comment)
                return end
            opener = m[0]
            if m.lastgroup == "inner" and opener != "{{":
                blank(lo, m.end(), keep_values)
                stack.append((x, group, depth, ")" if opener.endswith("(") else "}"))
                depth = 0
                return m.end()
            pos = m.end()

    while at < n:
        m = code.search(text, at)
        if m is None:
            out.append(text[at:])
            break
        out.append(text[at : m.start()])
        k = next((i for i, g in enumerate(groups) if m[g] is not None), None)
        if k is not None:
            x = literals[k]
            inner = [m[groups[k] + 1 + j] for j in range(re.compile(x.open).groups)]
            blank(m.start(), m.end(), keep_values and not x.comment)
            at = read(x, (inner[0] or "") if inner else "", m.end())
            continue
        c, at = m[0], m.end()
        if c in "{(":
            depth += 1
        elif c in "})":
            if stack and depth == 0 and c == stack[-1][3]:
                x, group, depth, _ = stack.pop()
                blank(m.start(), m.end(), keep_values)
                at = read(x, group, m.end())
                continue
            depth = max(0, depth - 1)
        elif c == "/" and language not in ("py", "rb", "php"):
            before = text[max(0, at - 41) : at - 1].rstrip(" \t")
            r = REGEX.match(text, m.start()) if language == "js" and (not before or before[-1] in BEFORE_REGEX or BEFORE_REGEX_WORDS.search(before)) else None
            if r:
                blank(m.start(), r.end(), keep_values)
                at = r.end()
                continue
        elif c == "<<":
            h = HEREDOC[language].match(text, m.start())
            if h and (language == "php" or h[1] or h[2] or h[3][0].isupper()):
                pending.append((h[3], language == "php" or h[1] != ""))
                blank(m.start(), h.end(), keep_values)
                at = h.end()
                continue
        out.append(c)
        if c == "\n" and pending:
            for name, indented in pending:
                end = re.compile(rf"^{'[ \t]*' if indented else ''}{name}\b", re.M).search(text, at)
                stop = end.end() if end else n
                blank(at, stop, keep_values)
                at = stop
            pending.clear()
    return "".join(out)
