"""The core pack: language-aware rules with three severities.

Fixed values throughout this file: patterns, keyword lists, types, severities and messages.
"""

from __future__ import annotations

from codesieve.functions.text import SQL_WHITESPACE as WS
from codesieve.functions.text import rx, sql_string
from codesieve.rules.registry import Rule, follows, has, has_any_case, matches, register


def _rule(id, phase, type, severity, message, when="", *, tool="pattern_analysis", category=None, **kw):
    register(Rule(id, "core", phase, category or phase, type, severity, message, tool, when, **kw))


# --- security, every language -------------------------------------------------------------------
for _id, _type, _severity, _message, _regex in [
    ("R01", "hardcoded_password", "high", "Hardcoded password found", r"""password\s*=\s*['"][^'"]+['"]"""),
    ("R02", "hardcoded_api_key", "high", "Hardcoded API key found", r"""api[_-]?key\s*=\s*['"][^'"]+['"]"""),
    ("R03", "hardcoded_secret", "high", "Hardcoded secret found", r"""secret\s*=\s*['"][^'"]+['"]"""),
    ("R04", "hardcoded_token", "medium", "Hardcoded token found", r"""token\s*=\s*['"][^'"]+['"]"""),
]:
    _rule(_id, "security", _type, _severity, _message, matches(_regex, True), needs=("=",))

# --- security, by language ----------------------------------------------------------------------
for _id, _type, _severity, _message, _regex, _dialect, _needs in [
    ("R05", "dangerous_eval", "high", "Use of eval() can lead to code injection", r"eval\s*\(", "python", "("),
    ("R06", "dangerous_exec", "high", "Use of exec() can lead to code injection", r"exec\s*\(", "python", "("),
    ("R07", "command_injection", "high", "Use of os.system() can lead to command injection",
     r"os\.system\s*\(", "python", "("),
    ("R09", "unsafe_deserialization", "high", "Pickle deserialization can execute arbitrary code",
     r"pickle\.loads?\s*\(", "python", "("),
    ("R10", "dangerous_eval", "high", "Use of eval() can lead to code injection", r"eval\s*\(", "js", "("),
    ("R11", "xss_risk", "medium", "innerHTML assignment can lead to XSS", r"innerHTML\s*=", "js", "="),
    ("R12", "xss_risk", "medium", "document.write() can lead to XSS", r"document\.write\s*\(", "js", "("),
    ("R13", "dynamic_function", "medium", "Dynamic function creation can be dangerous",
     r"new\s+Function\s*\(", "js", "("),
    ("R15", "sql_injection", "high", "Potential SQL injection via string formatting",
     r"""execute\s*\(\s*['"][^'"%]*+%[^'"]*+['"]""", "sql", "%"),
]:
    _rule(_id, "security", _type, _severity, _message, matches(_regex, True), dialects=(_dialect,), needs=(_needs,))

# the call's arguments end at the first closing bracket
_rule("R08", "security", "shell_injection", "high", "subprocess with shell=True can lead to shell injection",
      f"exists(split(line, '[)]'), part -> {follows(r'subprocess\.call\s*\(', matches(r'shell\s*=\s*True', True, 'rest'), True, 'part')})",
      dialects=("python",), needs=("(",))
# a plus sign between the line's first quote and its last one
_QUOTED = """exists(array(translate(line, '"', chr(39))), q -> contains(substring(
    q, position(chr(39), q) + 1, greatest(0, length(q) - position(chr(39), reverse(q)) - position(chr(39), q))), '+'))"""
_rule("R14", "security", "sql_injection", "high", "Potential SQL injection via string concatenation",
      f"""(contains(line, chr(39)) OR contains(line, '"')) AND {_QUOTED}""", dialects=("sql",), needs=("+",))

# --- quality, Python (from parser facts, see operators.syntax) -----------------------------------
_rule("R16", "quality", "too_many_arguments", "medium", "Function has {n} arguments (max recommended: 7)",
      tool="ast_analysis", dialects=("python",), scope="syntax", quote="none")
_rule("R17", "quality", "long_line", "low", "Line length {n} exceeds 120 characters",
      tool="ast_analysis", dialects=("python",), scope="syntax", quote="none")
_rule("R18", "quality", "syntax_error", "high", "Syntax error: {text}",
      tool="ast_analysis", dialects=("python",), scope="syntax", quote="none")

# --- quality, JavaScript and TypeScript ----------------------------------------------------------
_rule("R19", "quality", "console_statement", "low", "Console statement found (should be removed in production)",
      matches(r"console\.(log|debug|info|warn|error)"), dialects=("js",), needs=("console.",))
_rule("R20", "quality", "var_usage", "medium", "Use of var (prefer let/const)",
      matches(r"\bvar\s+\w+"), dialects=("js",), needs=("var",))
_rule("R21", "quality", "loose_equality", "medium", "Use of == (prefer === for strict equality)",
      matches(r"[^=!]==[^=]"), dialects=("js",), needs=("==",))

# --- quality, Java ---------------------------------------------------------------------------------
_rule("R22", "quality", "system_out_println", "low", "System.out.println found (use logging instead)",
      dialects=("java",), needs=("System.out.println",))
_rule("R23", "quality", "empty_catch", "high", "Empty catch block (should handle or log exception)",
      # the caught type ends at the first closing bracket, the block stands right behind it
      "exists(array(split(line, '[)]')), parts -> exists(transform(parts, (part, n) -> "
      f"{matches(r'catch\s*\(.', column='part')} AND {matches(r'^\s*\{\s*\}', column='coalesce(try_element_at(parts, n + 2), ' + sql_string('') + ')')}), hit -> hit))",
      dialects=("java",), needs=("catch", "}"))

# --- performance -------------------------------------------------------------------------------------
_rule("R24", "performance", "string_concatenation_in_loop", "medium",
      "String concatenation in loop (consider using join() or list)",
      has("for ", "while "), dialects=("python",), needs=("+=",))
_rule("R25", "performance", "list_comprehension_opportunity", "low",
      "Consider using list comprehension for better performance",
      follows(r"for\s+\w+\s+in\s+", matches(r":\s*\w++\.append\(", column="rest")), dialects=("python",), needs=(".append(",))
_rule("R26", "performance", "dom_query_in_loop", "medium", "DOM query in loop (cache the result outside loop)",
      has("for", "while") + " AND " + has("document.getElementById", "document.querySelector"),
      dialects=("js",), needs=("document.",))
_rule("R27", "performance", "inefficient_array_search", "low",
      "Consider using .includes() instead of .indexOf() for existence check",
      follows(r"\.indexOf\(", matches(r"\)\s*[><!]=?\s*-?1", column="rest")), dialects=("js",), needs=(".indexOf(",))

# --- security, YAML and Ansible ------------------------------------------------------------------------
_YAML = ("yaml", "ansible")
_ANSIBLE = ("ansible",)

_rule("R28", "security", "hardcoded_secret", "high", "Hardcoded secret or credential detected",
      matches(r"""(password|secret|key|token|api_key):\s*["']?[a-zA-Z0-9_\-+=\/]{8,}["']?""", True),
      tool="yaml_security_analysis", dialects=_YAML, needs=(":",))
_rule("R29", "security", "url_with_credentials", "high", "URL contains embedded credentials",
      follows(r"https?://[^:]+:[^@]", has("@", column="rest")), tool="yaml_security_analysis", dialects=_YAML, needs=("://", "@"))

_SECURITY_TOOL = "ansible_security_analysis"
_MODE = r"""mode:\s*["']?(\d+)["']?"""
_rule("R30", "security", "ansible_shell_injection", "high", "Potential shell injection via unescaped user input",
      has("shell:", "command:") + " AND " + has_any_case("user_input", "ansible_user", "item"),
      tool=_SECURITY_TOOL, dialects=_ANSIBLE, needs=("{{",))
_rule("R31", "security", "ansible_unsafe_sudo", "medium", "Use become instead of sudo in shell commands",
      follows(r"(?:shell|command):", has("sudo", column="rest")) + " AND NOT contains(content, 'become:')",
      tool=_SECURITY_TOOL, dialects=_ANSIBLE, needs=("sudo",))
_rule("R32", "security", "ansible_world_writable", "medium",
      "File/directory is world-writable, consider restricting permissions",
      # the first mode on the line counts
      f"""regexp_extract(line, {sql_string(rx(_MODE))}, 1) rlike '^..7$'""",
      tool=_SECURITY_TOOL, dialects=_ANSIBLE, needs=("mode:",))
_rule("R33", "security", "ansible_unquoted_src", "medium",
      "Use quote filter for dynamic file paths to prevent injection",
      has("{{") + " AND NOT " + matches(r"\|\s*quote"), tool=_SECURITY_TOOL, dialects=_ANSIBLE, needs=("src:",))
_rule("R34", "security", "ansible_debug_sensitive", "medium", "Debug statement might expose sensitive information",
      has("var:", "msg:") + " AND " + has_any_case("password", "secret", "key", "token"),
      tool=_SECURITY_TOOL, dialects=_ANSIBLE, needs=("debug:",))


# No "no_log:" near the first place in the file where the line's text occurs: the rest of that line
# before the text, the text itself, and 200 characters after it.
_LACKS_NO_LOG = r"""NOT contains(concat(
    substring_index(left(content, position(line, content) - 1), decode(X'0A', 'utf-8'), -1),
    substring(content, position(line, content), length(line) + 200)), 'no_log:')"""
_rule("R35", "security", "ansible_missing_no_log", "high", "Tasks with passwords should use no_log: true",
      # "user:" is part of "mysql_user:" and "postgresql_user:"
      has("user:") + " AND " + _LACKS_NO_LOG,
      tool=_SECURITY_TOOL, dialects=_ANSIBLE, needs=("password",))

# --- quality, YAML and Ansible -----------------------------------------------------------------------------
_rule("R36", "quality", "yaml_tabs", "medium", "YAML files should use spaces, not tabs for indentation",
      tool="yaml_analysis", dialects=_YAML, needs=("\t",), quote="rstrip")
_rule("R37", "quality", "trailing_whitespace", "low", "Remove trailing whitespace",
      f"rtrim({WS}, line) != line AND ltrim({WS}, line) != ''",
      tool="yaml_analysis", dialects=_YAML, quote="rstrip")
_rule("R38", "quality", "inconsistent_indentation", "medium",
      "YAML indentation should be consistent (multiples of 2 spaces)",
      f"startswith(line, ' ') AND ltrim({WS}, line) != '' AND (length(line) - length(ltrim({WS}, line))) % 2 != 0",
      tool="yaml_analysis", dialects=_YAML, quote="rstrip")

for _id, _literal, _message in [
    ("R39", "include:", "Use include_tasks or import_tasks instead of include"),
    ("R40", "sudo:", "Use become instead of sudo"),
    ("R41", "sudo_user:", "Use become_user instead of sudo_user"),
    ("R42", "always_run:", "Use check_mode instead of always_run"),
]:
    _rule(_id, "quality", "ansible_deprecated_syntax", "medium", _message,
          tool="ansible_analysis", dialects=_ANSIBLE, needs=(_literal,))
_rule("R43", "quality", "ansible_unquoted_variables", "medium",
      "Variables should be quoted to prevent YAML parsing issues",
      has("}}") + " AND " + follows(r":\s*\{\{", has("}}", column="rest"))
      + " AND NOT " + follows(r""":\s*["']\{\{""", matches(r"""\}\}["']""", column="rest")),
      tool="ansible_analysis", dialects=_ANSIBLE, needs=("{{",))
# A security issue found by the quality phase: it is in the summary but lowers neither score.
_rule("R44", "quality", "ansible_hardcoded_secret", "high", "Avoid hardcoding secrets, use vault or variables",
      matches(r"""(password|secret|key|token):\s*["']?[a-zA-Z0-9]+["']?""", True), category="security",
      tool="ansible_analysis", dialects=_ANSIBLE, needs=(":",))


_TASKS = "cast(size(split(content, '- name:', -1)) - 1 as int)"

_rule("R45", "quality", "ansible_missing_tasks", "high", "Playbook should have either tasks or roles section",
      has("hosts:", column="content") + " AND NOT " + has("tasks:", "roles:", column="content"),
      tool="ansible_analysis", dialects=_ANSIBLE, scope="file", quote="empty")
_rule("R46", "quality", "ansible_complex_playbook", "medium", "Playbook has {n} tasks, consider breaking into roles",
      f"{_TASKS} > 50", count=_TASKS,
      tool="ansible_analysis", dialects=_ANSIBLE, scope="file", quote="empty")
_rule("R47", "quality", "ansible_missing_documentation", "low",
      "Consider adding comments or description for better maintainability",
      has("- name:", column="content") + " AND NOT " + has("description:", "# ", column="content"),
      tool="ansible_analysis", dialects=_ANSIBLE, scope="file", quote="empty")

# --- performance, Ansible ---------------------------------------------------------------------------------------
_rule("R48", "performance", "ansible_inefficient_module", "medium",
      "Consider using specific Ansible modules instead of shell/command",
      has("shell:", "command:") + " AND " + has_any_case("apt ", "yum ", "pip ", "git clone", "systemctl"),
      tool="ansible_analysis", dialects=_ANSIBLE, needs=(":",))
_rule("R49", "performance", "ansible_missing_when", "low",
      "Consider adding when conditions to skip unnecessary tasks",
      # look ahead five lines; tasks at the very end of the file are let off
      "pos + 1 < size(lines) - 5 AND NOT exists(slice(lines, pos + 2, 5), ahead -> contains(ahead, 'when:'))",
      tool="ansible_analysis", dialects=_ANSIBLE, needs=("register:",))
_rule("R50", "performance", "ansible_deprecated_loop", "medium", "with_items is deprecated, use loop instead", tool="ansible_analysis", dialects=_ANSIBLE, needs=("with_items:",))
