"""The rule scan: every rule of a pack over every line of every file, in one narrow pass.

The scan keeps one row per file and adds an ``issues`` array. Scores, metrics and suggestions of a
file are then plain expressions on that row, and the only shuffle of a whole review is the partial
aggregate per repository. ``issues()`` explodes the array where a table of issues is wanted.

How the expression is laid out, since it runs once per line:

* a CASE on the file's dialect picks the rules, so a line meets only the rules of its language;
* rules that need the same literal share one substring test, and their regular expressions run only
  on lines that pass it;
* a hit is a small (rule, line) struct; messages and severities are filled in for hits alone, from
  one constant array.

The expression is put together as SQL text: rules are SQL predicates, and a pack is parsed at once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import SQL_WHITESPACE as WS
from codesieve.functions.text import split_lines, sql_string
from codesieve.operators.syntax import syntax_facts
from codesieve.rules import DIALECTS, Rule, has
from codesieve.rules import rules as pack

ISSUE_SCHEMA = (
    "rule_id string, phase string, category string, type string, severity string, description string, "
    "line_no int, code string, tool string, confidence string, rule string"
)
ISSUES_TYPE = f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ISSUE_SCHEMA.split(', '))}>>"
_NO_RULES = "cast(array() as array<int>)"
_NO_HITS = "cast(array() as array<struct<rule: int, line_no: int, text: string, n: int>>)"

# Base names and keywords that mark YAML as Ansible.
ANSIBLE_NAMES = ["playbook.yml", "playbook.yaml", "site.yml", "site.yaml", "main.yml", "main.yaml"]
ANSIBLE_KEYWORDS = [
    "hosts:", "tasks:", "handlers:", "vars:", "roles:", "playbook:", "become:", "gather_facts:", "ansible_",
    "with_items:", "when:", "notify:", "register:",
]
ANSIBLE_MIN_KEYWORDS = 3


def is_ansible(path: str = "path", content: str = "content") -> Column:
    """Test on two columns: a playbook's base name, or enough Ansible keywords in the text."""
    names = ", ".join(sql_string(n) for n in ANSIBLE_NAMES)
    keywords = " + ".join(f"cast(contains({content}, {sql_string(k)}) as int)" for k in ANSIBLE_KEYWORDS)
    return F.expr(f"lower(substring_index({path}, '/', -1)) IN ({names}) OR {keywords} >= {ANSIBLE_MIN_KEYWORDS}")


def dialect() -> Column:
    """The rule set of a file: its language, with YAML split into plain and Ansible."""
    language = F.col("language")
    return (
        F.when(language.isin("javascript", "typescript"), "js")
        .when(language.isin("python", "java", "sql"), language)
        .when((language == "yaml") & is_ansible(), "ansible")
        .when(language == "yaml", "yaml")
        .otherwise("other")
    )


Numbered = list[tuple[int, Rule]]


def _hit(rule: int, line_no: str, text: str, n: str) -> str:
    return f"named_struct('rule', {rule}, 'line_no', cast({line_no} as int), 'text', {text}, 'n', cast({n} as int))"


def _matching_rules(numbered: Numbered) -> str:
    """Array of the rules that match ``line``, with nulls for the others; one test per group of ``needs``."""
    groups: dict[tuple[str, ...], Numbered] = {}
    for index, rule in numbered:
        groups.setdefault(rule.needs, []).append((index, rule))
    parts = []
    for needs, members in groups.items():
        found = "array(" + ", ".join(
            f"CASE WHEN {rule.when} THEN {index} END" if rule.when else str(index) for index, rule in members) + ")"
        if needs:
            test = " AND ".join(has(literal) for literal in needs)
            found = f"CASE WHEN {test} THEN {found} ELSE {_NO_RULES} END"
        parts.append(found)
    if not parts:
        return _NO_RULES
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _by_dialect(numbered: Numbered, compile, nothing: str) -> str:
    """CASE over the dialects that some of the rules are limited to."""
    arms = []
    for name in DIALECTS:
        chosen = [(n, r) for n, r in numbered if name in r.dialects]
        if chosen:
            arms.append(f"WHEN dialect = '{name}' THEN {compile(chosen)}")
    return f"CASE {' '.join(arms)} ELSE {nothing} END" if arms else nothing


def _line_hits(numbered: Numbered) -> str:
    """Hits of all line rules, as one expression over the array of lines."""
    everywhere = _matching_rules([(n, r) for n, r in numbered if not r.dialects])
    somewhere = _by_dialect(numbered, _matching_rules, _NO_RULES)
    # most lines match nothing and are dropped before anything is built for them
    return f"""flatten(transform(
        filter(
            transform(lines, (line, pos) -> named_struct(
                'line', line, 'pos', pos, 'rules', array_compact(concat({everywhere}, {somewhere})))),
            x -> size(x.rules) > 0),
        x -> transform(array_sort(x.rules), rule -> named_struct(
            'rule', rule, 'line_no', x.pos + 1, 'text', x.line, 'n', length(x.line)))))"""


def _file_hits(numbered: Numbered) -> str:
    found = [f"CASE WHEN {rule.when} THEN {_hit(index, '1', sql_string(''), rule.count)} END" for index, rule in numbered]
    return f"array_compact(array({', '.join(found)}))"


def _syntax_hits(numbered: Numbered, per_node: bool) -> str:
    """Hits from parser facts: argument counts, long lines that carry code, syntax errors."""
    by_type = {rule.type: index for index, rule in numbered}
    parts = []
    if "too_many_arguments" in by_type:
        hit = _hit(by_type["too_many_arguments"], "f.line_no", "''", "f.n_args")
        parts.append(f"transform(filter(facts.functions, f -> f.n_args > 7), f -> {hit})")
    if "long_line" in by_type:
        length = "length(try_element_at(lines, n.line_no))"
        long = f"filter(facts.node_lines, n -> {length} > 120)"
        if per_node:
            long = f"flatten(transform({long}, n -> array_repeat(n, n.nodes)))"
        parts.append(f"transform({long}, n -> {_hit(by_type['long_line'], 'n.line_no', sql_string(''), length)})")
    if "syntax_error" in by_type:
        hit = _hit(by_type["syntax_error"], "facts.syntax_error.line_no", "facts.syntax_error.message", "null")
        parts.append(f"CASE WHEN facts.syntax_error IS NOT NULL THEN array({hit}) END")
    return "concat(" + ", ".join(f"coalesce({p}, {_NO_HITS})" for p in parts) + f", {_NO_HITS})"


def _issues(hits: str, selected: list[Rule]) -> str:
    """Hits to issues: attributes come from a constant array of the selected rules."""
    rows = json.dumps([
        {"rule_id": r.id, "phase": r.phase, "category": r.category, "type": r.type, "severity": r.severity,
         "message": r.message, "tool": r.tool, "quote": r.quote}
        for r in selected
    ]).replace("'", r"\u0027")
    fields = "rule_id: string, phase: string, category: string, type: string, severity: string, message: string, tool: string, quote: string"
    attributes = f"from_json({sql_string(rows)}, 'array<struct<{fields}>>')"
    return f"""transform(
        transform({hits}, h -> named_struct('h', h, 'r', element_at({attributes}, h.rule + 1))),
        x -> named_struct(
            'rule_id', x.r.rule_id, 'phase', x.r.phase, 'category', x.r.category, 'type', x.r.type,
            'severity', x.r.severity,
            'description', CASE
                WHEN contains(x.r.message, '{{n}}') THEN replace(x.r.message, '{{n}}', cast(x.h.n as string))
                WHEN contains(x.r.message, '{{text}}') THEN replace(x.r.message, '{{text}}', x.h.text)
                ELSE x.r.message END,
            'line_no', x.h.line_no,
            'code', CASE x.r.quote
                WHEN 'strip' THEN btrim(x.h.text, {WS})
                WHEN 'rstrip' THEN rtrim({WS}, x.h.text)
                WHEN 'head' THEN left(btrim(x.h.text, {WS}), 100)
                WHEN 'ellipsis' THEN concat(left(btrim(x.h.text, {WS}), 100), '...')
                WHEN 'empty' THEN '' END,
            'tool', x.r.tool, 'confidence', cast(null as string), 'rule', cast(null as string)))"""


def with_issues(
    files: DataFrame,
    profile: str = "core",
    categories=None,
    analysis_type: str = "full",
    per_node_long_lines: bool = False,
    ids=None,
) -> DataFrame:
    """Add ``lines``, ``dialect``, ``facts`` and ``issues`` to ``files(repo, path, language, content)``.

    ``ids`` limits the plan to some rules; without a rule on syntax, Python is not parsed for them.

    Rows with null content have no issues, except for the quick profile's unreadable-file issue.
    ``per_node_long_lines`` repeats a long Python line once per syntax node on it. Packs without
    language rules get no dialect and no parser facts.
    """
    chosen = pack(profile, categories, analysis_type)
    numbered = list(enumerate(r for r in chosen if ids is None or r.id in set(ids)))
    out = files
    if profile not in ("web", "interactive", "quick"):
        out = out.withColumn("dialect", dialect())
        out = out.withColumn("facts", syntax_facts(F.when(F.col("dialect") == "python", F.col("content"))))
    # split after the Python stage: rows waiting for it then carry the text only once
    out = out.withColumn("lines", split_lines(F.col("content")))
    if not numbered:
        return out.withColumn("issues", F.array().cast(ISSUES_TYPE))

    def scoped(scope):
        return [(n, r) for n, r in numbered if r.scope == scope]

    parts = [_line_hits(scoped("line"))]
    if scoped("file"):
        parts.append(_by_dialect(scoped("file"), _file_hits, _NO_HITS))
    if scoped("syntax"):
        parts.append(f"CASE WHEN dialect = 'python' THEN {_syntax_hits(scoped('syntax'), per_node_long_lines)} ELSE {_NO_HITS} END")
    unreadable = [f"array({_hit(n, '0', 'cast(null as string)', 'null')})" for n, _ in scoped("unreadable")]
    hits = f"CASE WHEN content IS NULL THEN {unreadable[0] if unreadable else _NO_HITS} ELSE concat({', '.join(parts)}) END"
    return out.withColumn("issues", F.expr(_issues(hits, [r for _, r in numbered])))


def issues(scanned: DataFrame, *keep: str) -> DataFrame:
    """One row per issue: the file's keys and the issue's columns."""
    keys = list(keep) or ["repo", "path", "language"]
    # the outer form keeps the optimizer from testing the size of the array, which would run the scan twice
    rows = scanned.select(*keys, F.explode_outer("issues").alias("i")).filter(F.col("i").isNotNull())
    return rows.select(*keys, "i.*")


def numbered_lines(files: DataFrame) -> DataFrame:
    """One row per line, counted from 1."""
    return files.select(
        *[c for c in files.columns if c not in ("content", "raw", "lines")],
        F.posexplode(split_lines(F.col("content"))).alias("pos", "line"),
    ).withColumn("line_no", F.col("pos") + 1).drop("pos")
