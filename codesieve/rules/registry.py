"""What a rule is, and how to add one.

A rule is data: id, category, severity, message, and ``when``, a Spark SQL predicate. Predicates see

* ``line``     the text of the line, and ``pos``, its place counted from 0 (line rules),
* ``content``  the text of the file, and ``lines``, all its lines.

Rules are compiled into one expression by :mod:`codesieve.operators.scan`, so adding a rule adds no
pass over the data::

    register(Rule("X01", "core", "quality", "quality", "long_call_chain", "low", "Long call chain",
                  "pattern_analysis", matches(r"(\\.\\w+\\(\\)){6,}"), dialects=("java",), needs=(".",)))
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from codesieve.functions.text import rx, sql_string

PROFILES = ("core", "web", "interactive", "quick")
CATEGORIES = ("security", "quality", "performance")

# Scan dialects: languages with the same rule set. Ansible is YAML that looks like a playbook.
DIALECTS = ("python", "js", "java", "sql", "yaml", "ansible", "other")


def matches(pattern: str, ignore_case: bool = False, column: str = "line") -> str:
    """Predicate: the regular expression, with Python's meaning, is found in the column."""
    return f"{column} rlike {sql_string(rx(pattern, ignore_case))}"


def follows(start: str, then: str, ignore_case: bool = False, text: str = "line") -> str:
    """Predicate: after the first place that matches ``start``, the rest satisfies ``then``, a predicate on ``rest``.

    What ``start.*then`` asks of a line, in one pass: if any place that starts has what must follow, the first one has.
    """
    rest = f"try_element_at(split({text}, {sql_string(rx(start, ignore_case))}, 2), 2)"
    return f"exists(array({rest}), rest -> coalesce({then}, false))"


def has(*words: str, column: str = "line") -> str:
    """Predicate: the column contains one of the words."""
    return "(" + " OR ".join(f"contains({column}, {sql_string(w)})" for w in words) + ")"


def has_any_case(*words: str, fold: str = "lower") -> str:
    """Predicate: the line contains one of the words once its case is folded; it is folded only once."""
    return f"exists(array({fold}(line)), folded -> {has(*words, column='folded')})"


@dataclass(frozen=True)
class Rule:
    id: str
    profile: str
    phase: str
    category: str
    type: str
    severity: str
    #: ``{n}`` becomes the line's length or ``count``, ``{text}`` the text of the hit
    message: str
    tool: str | None
    #: SQL predicate; empty where ``needs`` decides alone
    when: str = ""
    #: dialects the rule runs on; empty means all
    dialects: tuple[str, ...] = ()
    #: literals that every hit line contains; tested before ``when``
    needs: tuple[str, ...] = ()
    #: "line", "file", "syntax" (facts of the Python parser) or "unreadable"
    scope: str = "line"
    #: SQL of the number in the message of a file rule
    count: str = "cast(null as int)"
    #: how the line is quoted: strip, rstrip, head (100 characters), ellipsis, empty, none
    quote: str = "strip"


_RULES: dict[str, Rule] = {}


def register(rule: Rule) -> Rule:
    """Add a rule; its profile may be one of :data:`PROFILES` or a new one."""
    unknown = set(rule.dialects) - set(DIALECTS)
    if unknown:
        raise ValueError(f"unknown dialects {sorted(unknown)}; known: {DIALECTS}")
    if rule.id in _RULES:
        raise ValueError(f"rule {rule.id} is already registered")
    _RULES[rule.id] = rule
    return rule


def unregister(rule_id: str) -> None:
    _RULES.pop(rule_id, None)


def rules(profile: str = "core", categories: Iterable[str] | None = None, analysis_type: str = "full") -> list[Rule]:
    """Rules of a profile in id order.

    ``analysis_type`` is the category gate: ``full`` keeps every rule. A gated rule is not part of
    the plan at all.
    """
    wanted = set(CATEGORIES if categories is None else categories)
    if analysis_type != "full":
        wanted &= {analysis_type}
    return sorted((r for r in _RULES.values() if r.profile == profile and r.category in wanted), key=lambda r: r.id)
