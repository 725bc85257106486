"""The three language-blind packs: web, interactive and quick.

Fixed values throughout this file: keywords, types, severities and messages.
"""

from __future__ import annotations

from codesieve.functions.text import SQL_WHITESPACE as WS
from codesieve.functions.text import sql_string
from codesieve.rules.registry import Rule, has, has_any_case, register

_LONG = "Line length {n} exceeds 120 characters"
_ENUMERATE = "Consider using enumerate() instead of range(len())"
_EVAL_EXEC = "Dangerous eval/exec usage"


_LONGER = "length(line) > 120"
_NOT_COMMENT = f"NOT startswith(ltrim({WS}, line), '#')"
_QUOTE = "(contains(line, '\"') OR contains(line, decode(X'27', 'utf-8')))"


def _rule(id, profile, category, type, severity, message, when, needs=(), quote="none"):
    register(Rule(id, profile, category, category, type, severity, message, None, when, needs=needs, quote=quote))


def _starts(word):
    return f"startswith(ltrim({WS}, line), {sql_string(word)})"


# --- web -----------------------------------------------------------------------------------------
for _id, _word, _message in [
    ("R51", "password", "Hardcoded password detected"),
    ("R52", "api_key", "Hardcoded API key detected"),
    ("R53", "secret_key", "Hardcoded secret key detected"),
    ("R54", "access_token", "Hardcoded access token detected"),
]:
    _rule(_id, "web", "security", "hardcoded_credential", "high", _message,
          f"{has_any_case(_word)} AND {_QUOTE} AND {_NOT_COMMENT} AND NOT {has_any_case('input(')}",
          needs=("=",), quote="head")
for _id, _call, _message in [
    ("R55", "eval(", "Use of eval() function - potential code injection risk"),
    ("R56", "exec(", "Use of exec() function - potential code execution risk"),
    ("R57", "system(", "Use of system() function - potential command injection risk"),
    ("R58", "shell_exec(", "Use of shell_exec() function - potential command injection risk"),
]:
    _rule(_id, "web", "security", "dangerous_function", "high", _message,
          _NOT_COMMENT, needs=(_call,), quote="head")
_rule("R59", "web", "quality", "line_length", "low", _LONG, _LONGER, quote="ellipsis")
_rule("R60", "web", "quality", "todo_comment", "low", "TODO/FIXME comment found",
      has_any_case("TODO", "FIXME", "HACK", fold="upper"), quote="head")
_rule("R61", "web", "performance", "inefficient_loop", "medium", _ENUMERATE,
      has("for"), needs=("range(len(",), quote="head")

# --- interactive -----------------------------------------------------------------------------------
_rule("R62", "interactive", "security", "hardcoded_credential", "high", "Possible hardcoded credential",
      has_any_case("password", "secret", "key"), needs=("=",))
_rule("R63", "interactive", "security", "code_injection", "high", _EVAL_EXEC,
      has("eval(", "exec("), needs=("(",))
_rule("R64", "interactive", "quality", "line_length", "low", _LONG, _LONGER)
_rule("R65", "interactive", "performance", "inefficient_loop", "medium", _ENUMERATE,
      has("for") + " AND " + has("in"), needs=("range(len(",))

# --- quick -------------------------------------------------------------------------------------------
_rule("R66", "quick", "security", "hardcoded_credential", "high", "Possible hardcoded password",
      has_any_case("password"), needs=("=",))
_rule("R67", "quick", "security", "sql_injection", "high", "Potential SQL injection vulnerability",
      has("+", "format") + " AND " + has_any_case("sql"))
_rule("R68", "quick", "security", "code_injection", "high", _EVAL_EXEC,
      has("eval(", "exec("), needs=("(",))
_rule("R69", "quick", "quality", "line_length", "low", _LONG, _LONGER)
_rule("R70", "quick", "quality", "todo_comment", "low", "TODO/FIXME comment found",
      f"({_starts('TODO')} OR {_starts('FIXME')})")
# A file whose text could not be read; raised by the scan itself.
register(Rule("R71", "quick", "quality", "quality", "file_error", "medium",
              "Could not analyze file: content is not readable", None, scope="unreadable", quote="none"))
