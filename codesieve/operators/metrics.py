"""Per-file metrics, all computed on the file's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import SQL_WHITESPACE as WS
from codesieve.functions.text import rx, sql_string

# What a comment line starts with.
COMMENT_PREFIXES = {
    ("python", "ruby", "r", "bash", "powershell"): ["#"],
    ("javascript", "typescript", "java", "go", "rust", "cpp", "c", "csharp", "swift", "kotlin", "scala"): ["//", "/*"],
    ("php",): ["//", "/*", "#"],
    ("sql",): ["--", "/*"],
}
DEFAULT_COMMENT_PREFIXES = ["#", "//"]

# What counts as a function, class or decision in JavaScript and TypeScript, case ignored. Each
# with a literal that it needs: a text without it is not searched.
JS_FUNCTIONS = {
    r"function\s+\w+": "function", r"const\s+\w+\s*=\s*\(": "const", r"let\s+\w+\s*=\s*\(": "let",
    r"var\s+\w+\s*=\s*\(": "var", r"=>": "=>", r"async\s+function": "async",
}
JS_CLASSES = {r"class\s+\w+": "class"}
JS_DECISIONS = {
    r"\bif\s*\(": "if", r"\belse\s+if\s*\(": "else", r"\bwhile\s*\(": "while", r"\bfor\s*\(": "for", r"\bswitch\s*\(": "switch",
    r"\bcase\s+": "case", r"\bcatch\s*\(": "catch",
}
# Fixed value: a ternary operator; counted by ternaries(), since searching for it takes time in the square of a line.
JS_TERNARY = r"\?\s*.*\s*:"

METRICS = [
    "lines_of_code", "blank_lines", "comment_lines", "cyclomatic_complexity", "functions", "classes", "file_size",
    "file_hash",
]


def _count_lines(test: str) -> str:
    return f"size(filter(lines, line -> {test}))"


def blank_lines() -> Column:
    return F.expr(f"cast({_count_lines(f"ltrim({WS}, line) = ''")} as bigint)")


def comment_lines() -> Column:
    def starting_with(prefixes):
        return _count_lines(" OR ".join(f"startswith(ltrim({WS}, line), {sql_string(p)})" for p in prefixes))

    arms = " ".join(
        f"WHEN language IN ({', '.join(map(sql_string, languages))}) THEN {starting_with(prefixes)}"
        for languages, prefixes in COMMENT_PREFIXES.items())
    return F.expr(f"cast(CASE {arms} ELSE {starting_with(DEFAULT_COMMENT_PREFIXES)} END as bigint)")


def ternaries(lines: str = "lines") -> str:
    """SQL: how often JS_TERNARY is found in the text of ``lines``, in one pass over them.

    A question mark looks at the rest of its line, or if that is blank at the next line that is not. A match ends at
    a colon that opens the next non-blank line after that, else at the last colon of the line looked at. So a line
    decides at most one match, once the next non-blank line's first character is known. The state: matches so far;
    of the last line: a question mark with text behind it, a colon behind that, a question mark at the end.
    """
    text = f"ltrim({WS}, line)"
    joins = "s.asks AND startswith(body, ':')"
    rest = f"concat(CASE WHEN s.open AND NOT ({joins}) THEN '?' ELSE '' END, CASE WHEN {joins} THEN substring(body, 2) ELSE body END)"
    after = "substring(t, position('?', t) + 1)"
    state = f"""named_struct(
        'n', s.n + CASE WHEN s.asks AND (s.colon OR startswith(body, ':')) THEN 1 ELSE 0 END,
        'asks', contains(t, '?') AND ltrim({WS}, {after}) != '',
        'colon', contains(t, '?') AND contains({after}, ':'),
        'open', endswith(rtrim({WS}, t), '?'))"""
    step = f"element_at(transform(array({rest}), t -> {state}), 1)"
    return f"""aggregate(
        filter(transform({lines}, line -> {text}), body -> body != ''),
        named_struct('n', 0, 'asks', false, 'colon', false, 'open', false),
        (s, body) -> {step},
        s -> s.n + CASE WHEN s.asks AND s.colon THEN 1 ELSE 0 END)"""


def python_or_js(python: str, patterns: dict[str, str], more: str = "0") -> Column:
    """A number from parser facts for Python; for JavaScript the matches of every pattern, and ``more``, summed.

    Overlaps between patterns count twice. Letters are folded as the patterns fold them: K and S have foreign forms.
    """
    matches = " + ".join(
        f"CASE WHEN contains(folded, {sql_string(literal)}) THEN regexp_count(content, {sql_string(rx(p, True))}) ELSE 0 END"
        for p, literal in patterns.items())
    counted = f"element_at(transform(array(translate(lower(content), '\u017f\u212a', 'sk')), folded -> {matches}), 1)"
    return F.expr(f"""cast(CASE WHEN language = 'python' THEN {python}
        WHEN language IN ('javascript', 'typescript') THEN {counted} + {more} ELSE 0 END as bigint)""")


def with_metrics(scanned: DataFrame) -> DataFrame:
    """Add the metric columns to a scanned frame (needs ``content``, ``lines``, ``language``, ``facts``, ``size``, ``hash``)."""
    points = "aggregate(facts.functions, 0, (total, f) -> total + f.decision_points)"
    return scanned.withColumns({
        "lines_of_code": F.size("lines").cast("long"),
        "blank_lines": blank_lines(),
        "comment_lines": comment_lines(),
        "cyclomatic_complexity": python_or_js(
            points, JS_DECISIONS, f"CASE WHEN contains(content, '?') THEN {ternaries()} ELSE 0 END"),
        "functions": python_or_js("size(facts.functions)", JS_FUNCTIONS),
        "classes": python_or_js("size(facts.classes)", JS_CLASSES),
        "file_size": F.col("size"),
        "file_hash": F.col("hash"),
    })
