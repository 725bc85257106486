"""SQL building blocks of the oracles: the derived tables and the rules, written for DuckDB."""

from __future__ import annotations


from workload.corpus import MANIFESTS, REPO_LANGUAGES, TOPICS, WORDS
from workload.snippets import EXTENSIONS, FOLDERS, SITE, SNIPPETS

# Python's whitespace, as a SQL string
WS = "'" + "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239,
                             8287, 12288])) + "'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else q(v) for v in values) + "]"


def rx(pattern: str, ci: bool = False) -> str:
    """A Python pattern for RE2, with Unicode classes."""
    pattern = pattern.replace(r"\s", r"[\s\x0b\x{85}\p{Z}]").replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\d", r"\p{Nd}")
    return q(("(?i)" if ci else "") + pattern)


def m(pattern: str, ci: bool = False, column: str = "line") -> str:
    return f"regexp_matches({column}, {rx(pattern, ci)})"


def has(*words: str, column: str = "line") -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


_SNIPPETS = ",\n".join(
    f"({q(ext)}, {len(texts)}, {k}, {q(text)})" for ext, texts in SNIPPETS.items() for k, text in enumerate(texts))
_SITE = " OR ".join(f"(d.ext = {q(e)} AND s.k = {k})" for e, k in SITE.items())

# Extensions and languages.
_LANGUAGES = """('.py','python'),('.pyw','python'),('.js','javascript'),('.jsx','javascript'),('.mjs','javascript'),
('.ts','typescript'),('.tsx','typescript'),('.java','java'),('.go','go'),('.rs','rust'),('.cpp','cpp'),('.cc','cpp'),
('.cxx','cpp'),('.c++','cpp'),('.hpp','cpp'),('.h','cpp'),('.c','c'),('.cs','csharp'),('.php','php'),('.rb','ruby'),
('.swift','swift'),('.kt','kotlin'),('.scala','scala'),('.r','r'),('.sql','sql'),('.sh','bash'),('.ps1','powershell'),
('.yml','yaml'),('.yaml','yaml'),('.json','json'),('.xml','xml'),('.html','html'),('.htm','html'),('.css','css'),
('.scss','scss'),('.less','less')"""

FILES = f"""
snippets(ext, n, k, body) AS (VALUES {_SNIPPETS}),
docs AS (
  SELECT doc_id, source, text, doc_id // 12 AS step, {sql_list(EXTENSIONS)}[CAST(doc_id % 12 + 1 AS INT)] AS ext FROM documents),
made AS (
  SELECT d.doc_id, d.source AS repo, d.step,
    {sql_list(FOLDERS)}[CAST(d.step % {len(FOLDERS)} + 1 AS INT)] ||
      CASE WHEN {_SITE} THEN 'play_' || d.doc_id || '/site' || d.ext ELSE 'doc_' || d.doc_id || d.ext END AS path,
    CASE WHEN d.ext = '.py' THEN '# ' || replace(d.text, chr(10), chr(10) || '# ') ELSE d.text END || chr(10) || s.body AS text,
    CASE WHEN d.ext = '.py' THEN s.k END AS py_snippet,
    len(string_split(d.text, chr(10))) AS prose_lines
  FROM docs d JOIN snippets s ON s.ext = d.ext AND s.k = d.step % s.n),
files AS (
  SELECT repo, path, py_snippet, prose_lines,
    CASE WHEN doc_id % 97 <> 5 THEN
      CASE WHEN doc_id % 89 = 7 THEN chr(0) ELSE '' END ||
      CASE WHEN step % 5 = 4 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END END AS raw
  FROM made
  UNION ALL
  SELECT regexp_extract(url, 'https?://([^/]+)', 1), 'page_' || page_id || '.html', NULL, NULL, html FROM pages),
languages(ext, language) AS (VALUES {_LANGUAGES}),
named AS (
  SELECT *, string_split(path, '/') AS parts, strlen(raw) AS size,
    list_extract(string_split(path, '/'), -1) AS base,
    regexp_extract(list_extract(string_split(path, '/'), -1), '^.+(\\.[^.]+)$', 1) AS suffix
  FROM files),
found AS (
  SELECT * FROM named
  WHERE NOT (
    len(list_filter(parts[1:len(parts) - 1], lambda d: d IN ('__pycache__', 'node_modules', '.git', '.vscode', '.idea')
      OR ends_with(d, '.pyc') OR ends_with(d, '.log') OR ends_with(d, '.tmp'))) > 0
    OR ends_with(path, '.pyc') OR ends_with(path, '.log') OR ends_with(path, '.tmp')
    OR len(list_filter(parts, lambda p: p IN ('venv', 'env', '.venv', 'dist', 'build'))) > 0)),
prepared AS MATERIALIZED (
  SELECT f.repo, f.path, f.base, f.size, f.raw, f.py_snippet, f.prose_lines, l.language,
    l.language IS NOT NULL AND f.raw IS NOT NULL AND NOT contains(f.raw[1:1024], chr(0)) AS analyzed,
    replace(replace(f.raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text
  FROM found f LEFT JOIN languages l ON l.ext = lower(f.suffix)),
"""

# Keywords that mark YAML as Ansible.
_KEYWORDS = ["hosts:", "tasks:", "handlers:", "vars:", "roles:", "playbook:", "become:", "gather_facts:", "ansible_",
             "with_items:", "when:", "notify:", "register:"]
_KEYWORD_SUM = " + ".join(f"CAST(contains(text, {q(k)}) AS INT)" for k in _KEYWORDS)

_MODE = r"""mode:\s*["']?(\d+)["']?"""

# Id, language group, predicate on a line.
LINE_RULES = [
    ("R01", "*", m(r"""password\s*=\s*['"][^'"]+['"]""", True)),
    ("R02", "*", m(r"""api[_-]?key\s*=\s*['"][^'"]+['"]""", True)),
    ("R03", "*", m(r"""secret\s*=\s*['"][^'"]+['"]""", True)),
    ("R04", "*", m(r"""token\s*=\s*['"][^'"]+['"]""", True)),
    ("R05", "python", m(r"eval\s*\(", True)),
    ("R06", "python", m(r"exec\s*\(", True)),
    ("R07", "python", m(r"os\.system\s*\(", True)),
    ("R08", "python", m(r"subprocess\.call\s*\([^)]*shell\s*=\s*True", True)),
    ("R09", "python", m(r"pickle\.loads?\s*\(", True)),
    ("R10", "js", m(r"eval\s*\(", True)),
    ("R11", "js", m(r"innerHTML\s*=", True)),
    ("R12", "js", m(r"document\.write\s*\(", True)),
    ("R13", "js", m(r"new\s+Function\s*\(", True)),
    ("R14", "sql", m(r"""['"].*\+.*['"]""", True)),
    ("R15", "sql", m(r"""execute\s*\(\s*['"][^'"]*%[^'"]*['"]""", True)),
    ("R19", "js", m(r"console\.(log|debug|info|warn|error)")),
    ("R20", "js", m(r"\bvar\s+\w+")),
    ("R21", "js", m(r"[^=!]==[^=]")),
    ("R22", "java", has("System.out.println")),
    ("R23", "java", m(r"catch\s*\([^)]+\)\s*\{\s*\}")),
    ("R24", "python", has("+=") + " AND " + has("for ", "while ")),
    ("R25", "python", m(r"for\s+\w+\s+in\s+.*:\s*\w+\.append\(")),
    ("R26", "js", m(r"document\.getElementById|document\.querySelector") + " AND " + has("for", "while")),
    ("R27", "js", m(r"\.indexOf\(.*\)\s*[><!]=?\s*-?1")),
    ("R28", "yaml", m(r"""(password|secret|key|token|api_key):\s*["']?[a-zA-Z0-9_\-+=\/]{8,}["']?""", True)),
    ("R29", "yaml", m(r"https?://[^:]+:[^@]+@")),
    ("R30", "ansible", m(r"(shell|command):") + " AND " + has("{{") + " AND " + has("user_input", "ansible_user", "item", column="lower(line)")),
    ("R31", "ansible", m(r"(shell|command):.*sudo") + " AND NOT contains(text, 'become:')"),
    ("R32", "ansible", f"regexp_matches(regexp_extract(line, {rx(_MODE)}, 1), '^..7$')"),
    ("R33", "ansible", has("src:") + " AND " + has("{{") + " AND NOT " + m(r"\|\s*quote")),
    ("R34", "ansible", has("debug:") + " AND " + has("var:", "msg:") + " AND " + has("password", "secret", "key", "token", column="lower(line)")),
    ("R35", "ansible", has("user:", "mysql_user:", "postgresql_user:") + " AND " + has("password") + """
      AND NOT contains(list_extract(string_split(text[1:strpos(text, line) - 1], chr(10)), -1)
        || substr(text, strpos(text, line), length(line) + 200), 'no_log:')"""),
    ("R36", "yaml", "contains(line, chr(9))"),
    ("R37", "yaml", f"rtrim(line, {WS}) <> line AND trim(line, {WS}) <> ''"),
    ("R38", "yaml", f"starts_with(line, ' ') AND trim(line, {WS}) <> '' AND (length(line) - length(ltrim(line, {WS}))) % 2 <> 0"),
    ("R39", "ansible", has("include:")),
    ("R40", "ansible", has("sudo:")),
    ("R41", "ansible", has("sudo_user:")),
    ("R42", "ansible", has("always_run:")),
    ("R43", "ansible", has("{{") + " AND " + has("}}") + " AND " + m(r":\s*\{\{.*\}\}") + " AND NOT " + m(r""":\s*["']\{\{.*\}\}["']""")),
    ("R44", "ansible", m(r"""(password|secret|key|token):\s*["']?[a-zA-Z0-9]+["']?""", True)),
    ("R48", "ansible", m(r"shell:|command:") + " AND " + has("apt ", "yum ", "pip ", "git clone", "systemctl", column="lower(line)")),
    ("R49", "ansible", has("register:") + " AND line_no < n_lines - 5 AND NOT when_ahead"),
    ("R50", "ansible", has("with_items:")),
]
_GROUP_TEST = {
    "*": "true", "python": "language = 'python'", "js": "language IN ('javascript', 'typescript')",
    "java": "language = 'java'", "sql": "language = 'sql'", "yaml": "language = 'yaml'", "ansible": "ansible",
}

# Id, phase, category, type, severity, tool, how the line is quoted, description.
RULES = """
('R01','security','security','hardcoded_password','high','pattern_analysis','strip','Hardcoded password found'),
('R02','security','security','hardcoded_api_key','high','pattern_analysis','strip','Hardcoded API key found'),
('R03','security','security','hardcoded_secret','high','pattern_analysis','strip','Hardcoded secret found'),
('R04','security','security','hardcoded_token','medium','pattern_analysis','strip','Hardcoded token found'),
('R05','security','security','dangerous_eval','high','pattern_analysis','strip','Use of eval() can lead to code injection'),
('R06','security','security','dangerous_exec','high','pattern_analysis','strip','Use of exec() can lead to code injection'),
('R07','security','security','command_injection','high','pattern_analysis','strip','Use of os.system() can lead to command injection'),
('R08','security','security','shell_injection','high','pattern_analysis','strip','subprocess with shell=True can lead to shell injection'),
('R09','security','security','unsafe_deserialization','high','pattern_analysis','strip','Pickle deserialization can execute arbitrary code'),
('R10','security','security','dangerous_eval','high','pattern_analysis','strip','Use of eval() can lead to code injection'),
('R11','security','security','xss_risk','medium','pattern_analysis','strip','innerHTML assignment can lead to XSS'),
('R12','security','security','xss_risk','medium','pattern_analysis','strip','document.write() can lead to XSS'),
('R13','security','security','dynamic_function','medium','pattern_analysis','strip','Dynamic function creation can be dangerous'),
('R14','security','security','sql_injection','high','pattern_analysis','strip','Potential SQL injection via string concatenation'),
('R15','security','security','sql_injection','high','pattern_analysis','strip','Potential SQL injection via string formatting'),
('R16','quality','quality','too_many_arguments','medium','ast_analysis','none','Function has {n} arguments (max recommended: 7)'),
('R17','quality','quality','long_line','low','ast_analysis','none','Line length {n} exceeds 120 characters'),
('R18','quality','quality','syntax_error','high','ast_analysis','none','Syntax error: invalid syntax (<unknown>, line {n})'),
('R19','quality','quality','console_statement','low','pattern_analysis','strip','Console statement found (should be removed in production)'),
('R20','quality','quality','var_usage','medium','pattern_analysis','strip','Use of var (prefer let/const)'),
('R21','quality','quality','loose_equality','medium','pattern_analysis','strip','Use of == (prefer === for strict equality)'),
('R22','quality','quality','system_out_println','low','pattern_analysis','strip','System.out.println found (use logging instead)'),
('R23','quality','quality','empty_catch','high','pattern_analysis','strip','Empty catch block (should handle or log exception)'),
('R24','performance','performance','string_concatenation_in_loop','medium','pattern_analysis','strip','String concatenation in loop (consider using join() or list)'),
('R25','performance','performance','list_comprehension_opportunity','low','pattern_analysis','strip','Consider using list comprehension for better performance'),
('R26','performance','performance','dom_query_in_loop','medium','pattern_analysis','strip','DOM query in loop (cache the result outside loop)'),
('R27','performance','performance','inefficient_array_search','low','pattern_analysis','strip','Consider using .includes() instead of .indexOf() for existence check'),
('R28','security','security','hardcoded_secret','high','yaml_security_analysis','strip','Hardcoded secret or credential detected'),
('R29','security','security','url_with_credentials','high','yaml_security_analysis','strip','URL contains embedded credentials'),
('R30','security','security','ansible_shell_injection','high','ansible_security_analysis','strip','Potential shell injection via unescaped user input'),
('R31','security','security','ansible_unsafe_sudo','medium','ansible_security_analysis','strip','Use become instead of sudo in shell commands'),
('R32','security','security','ansible_world_writable','medium','ansible_security_analysis','strip','File/directory is world-writable, consider restricting permissions'),
('R33','security','security','ansible_unquoted_src','medium','ansible_security_analysis','strip','Use quote filter for dynamic file paths to prevent injection'),
('R34','security','security','ansible_debug_sensitive','medium','ansible_security_analysis','strip','Debug statement might expose sensitive information'),
('R35','security','security','ansible_missing_no_log','high','ansible_security_analysis','strip','Tasks with passwords should use no_log: true'),
('R36','quality','quality','yaml_tabs','medium','yaml_analysis','rstrip','YAML files should use spaces, not tabs for indentation'),
('R37','quality','quality','trailing_whitespace','low','yaml_analysis','rstrip','Remove trailing whitespace'),
('R38','quality','quality','inconsistent_indentation','medium','yaml_analysis','rstrip','YAML indentation should be consistent (multiples of 2 spaces)'),
('R39','quality','quality','ansible_deprecated_syntax','medium','ansible_analysis','strip','Use include_tasks or import_tasks instead of include'),
('R40','quality','quality','ansible_deprecated_syntax','medium','ansible_analysis','strip','Use become instead of sudo'),
('R41','quality','quality','ansible_deprecated_syntax','medium','ansible_analysis','strip','Use become_user instead of sudo_user'),
('R42','quality','quality','ansible_deprecated_syntax','medium','ansible_analysis','strip','Use check_mode instead of always_run'),
('R43','quality','quality','ansible_unquoted_variables','medium','ansible_analysis','strip','Variables should be quoted to prevent YAML parsing issues'),
('R44','quality','security','ansible_hardcoded_secret','high','ansible_analysis','strip','Avoid hardcoding secrets, use vault or variables'),
('R45','quality','quality','ansible_missing_tasks','high','ansible_analysis','empty','Playbook should have either tasks or roles section'),
('R46','quality','quality','ansible_complex_playbook','medium','ansible_analysis','empty','Playbook has {n} tasks, consider breaking into roles'),
('R47','quality','quality','ansible_missing_documentation','low','ansible_analysis','empty','Consider adding comments or description for better maintainability'),
('R48','performance','performance','ansible_inefficient_module','medium','ansible_analysis','strip','Consider using specific Ansible modules instead of shell/command'),
('R49','performance','performance','ansible_missing_when','low','ansible_analysis','strip','Consider adding when conditions to skip unnecessary tasks'),
('R50','performance','performance','ansible_deprecated_loop','medium','ansible_analysis','strip','with_items is deprecated, use loop instead'),
('R51','security','security','hardcoded_credential','high',NULL,'head','Hardcoded password detected'),
('R52','security','security','hardcoded_credential','high',NULL,'head','Hardcoded API key detected'),
('R53','security','security','hardcoded_credential','high',NULL,'head','Hardcoded secret key detected'),
('R54','security','security','hardcoded_credential','high',NULL,'head','Hardcoded access token detected'),
('R55','security','security','dangerous_function','high',NULL,'head','Use of eval() function - potential code injection risk'),
('R56','security','security','dangerous_function','high',NULL,'head','Use of exec() function - potential code execution risk'),
('R57','security','security','dangerous_function','high',NULL,'head','Use of system() function - potential command injection risk'),
('R58','security','security','dangerous_function','high',NULL,'head','Use of shell_exec() function - potential command injection risk'),
('R59','quality','quality','line_length','low',NULL,'ellipsis','Line length {n} exceeds 120 characters'),
('R60','quality','quality','todo_comment','low',NULL,'head','TODO/FIXME comment found'),
('R61','performance','performance','inefficient_loop','medium',NULL,'head','Consider using enumerate() instead of range(len())'),
('R62','security','security','hardcoded_credential','high',NULL,'none','Possible hardcoded credential'),
('R63','security','security','code_injection','high',NULL,'none','Dangerous eval/exec usage'),
('R64','quality','quality','line_length','low',NULL,'none','Line length {n} exceeds 120 characters'),
('R65','performance','performance','inefficient_loop','medium',NULL,'none','Consider using enumerate() instead of range(len())'),
('R66','security','security','hardcoded_credential','high',NULL,'none','Possible hardcoded password'),
('R67','security','security','sql_injection','high',NULL,'none','Potential SQL injection vulnerability'),
('R68','security','security','code_injection','high',NULL,'none','Dangerous eval/exec usage'),
('R69','quality','quality','line_length','low',NULL,'none','Line length {n} exceeds 120 characters'),
('R70','quality','quality','todo_comment','low',NULL,'none','TODO/FIXME comment found'),
('R71','quality','quality','file_error','medium',NULL,'none','Could not analyze file: content is not readable')
"""

# what a parser sees in each Python snippet, worked out by hand; lines count from the snippet's first
PY_FUNCTIONS = """(1, 'area', 2, 8, 7), (1, 'fetch', 10, 2, 4), (1, 'outer', 19, 7, 1), (1, 'inner', 20, 1, 1), (6, 'decide', 1, 1, 17)"""
PY_CLASSES = "(1, 'Shape', 1)"
PY_IMPORTS = """(0, 'import', 'os', NULL, NULL, 1), (0, 'import', 'subprocess', NULL, NULL, 2),
(0, 'import', 'pickle', NULL, 'pk', 2), (0, 'from_import', 'os', 'path', 'p', 3), (0, 'from_import', 'os', 'sep', NULL, 3),
(7, 'from_import', '', 'sibling', NULL, 1), (7, 'from_import', 'pkg', '*', NULL, 2), (7, 'import', 'a.b.c', NULL, 'd', 3)"""
PY_LONG_LINES = "(3, 1, 140, 3)"  # snippet, line, length, nodes
PY_ERRORS = "(4, 2)"


def _line_hits(rules, tests) -> str:
    cases = ",\n    ".join(f"CASE WHEN {tests[g]} AND {p} THEN '{i}' END" for i, g, p in rules)
    return f"unnest(list_filter([{cases}], lambda r: r IS NOT NULL))"


_CODE = f"""CASE r.quote WHEN 'strip' THEN trim(h.line, {WS}) WHEN 'rstrip' THEN rtrim(h.line, {WS})
    WHEN 'head' THEN trim(h.line, {WS})[1:100] WHEN 'ellipsis' THEN trim(h.line, {WS})[1:100] || '...'
    WHEN 'empty' THEN '' END"""

CORE = FILES + f"""
rules(rule_id, phase, category, type, severity, tool, quote, description) AS (VALUES {RULES}),
texts AS MATERIALIZED (
  SELECT *, string_split(text, chr(10)) AS all_lines,
    language = 'yaml' AND (lower(base) IN ('playbook.yml', 'playbook.yaml', 'site.yml', 'site.yaml', 'main.yml', 'main.yaml')
      OR {_KEYWORD_SUM} >= 3) AS ansible
  FROM prepared WHERE analyzed),
numbered AS (
  SELECT * EXCLUDE (all_lines, raw), len(all_lines) AS n_lines, unnest(all_lines) AS line, unnest(range(1, len(all_lines) + 1)) AS line_no
  FROM texts),
ahead AS (
  SELECT *, CASE WHEN ansible THEN coalesce(bool_or(contains(line, 'when:')) OVER (
    PARTITION BY repo, path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), false) END AS when_ahead
  FROM numbered),
py_functions(py_snippet, name, at_line, n_args, points) AS (VALUES {PY_FUNCTIONS}),
py_classes(py_snippet, name, at_line) AS (VALUES {PY_CLASSES}),
py_imports(py_snippet, type, module, name, alias, at_line) AS (VALUES {PY_IMPORTS}),
py_long(py_snippet, at_line, n, nodes) AS (VALUES {PY_LONG_LINES}),
py_errors(py_snippet, at_line) AS (VALUES {PY_ERRORS}),
hits AS (
  SELECT repo, path, language, {_line_hits(LINE_RULES, _GROUP_TEST)} AS rule_id, line_no, line, NULL AS n FROM ahead
  UNION ALL SELECT repo, path, language, 'R16', prose_lines + f.at_line, '', f.n_args
    FROM texts JOIN py_functions f USING (py_snippet) WHERE f.n_args > 7
  UNION ALL SELECT repo, path, language, 'R17', prose_lines + f.at_line, '', f.n FROM texts JOIN py_long f USING (py_snippet)
  UNION ALL SELECT repo, path, language, 'R18', prose_lines + f.at_line, '', prose_lines + f.at_line
    FROM texts JOIN py_errors f USING (py_snippet)
  UNION ALL SELECT repo, path, language, 'R45', 1, '', NULL FROM texts
    WHERE ansible AND contains(text, 'hosts:') AND NOT contains(text, 'tasks:') AND NOT contains(text, 'roles:')
  UNION ALL SELECT repo, path, language, 'R46', 1, '', len(string_split(text, '- name:')) - 1 FROM texts
    WHERE ansible AND len(string_split(text, '- name:')) - 1 > 50
  UNION ALL SELECT repo, path, language, 'R47', 1, '', NULL FROM texts
    WHERE ansible AND contains(text, '- name:') AND NOT contains(text, 'description:') AND NOT contains(text, '# ')),
issues AS MATERIALIZED (
  SELECT h.repo, h.path, h.language, h.rule_id, r.phase, r.category, r.type, r.severity,
    replace(r.description, '{{n}}', CAST(h.n AS VARCHAR)) AS filled, r.description AS plain,
    CAST(h.line_no AS INT) AS line_no, {_CODE} AS code, r.tool
  FROM hits h JOIN rules r USING (rule_id)),
named_issues AS (SELECT * EXCLUDE (filled, plain), coalesce(filled, plain) AS description FROM issues),
"""


def _comments() -> str:
    def starts(*prefixes):
        return "list_filter(all_lines, lambda l: " + " OR ".join(f"starts_with(ltrim(l, {WS}), {q(p)})" for p in prefixes) + ")"

    return f"""len(CASE
      WHEN language IN ('python', 'ruby', 'r', 'bash', 'powershell') THEN {starts('#')}
      WHEN language IN ('javascript', 'typescript', 'java', 'go', 'rust', 'cpp', 'c', 'csharp', 'swift', 'kotlin', 'scala')
        THEN {starts('//', '/*')}
      WHEN language = 'php' THEN {starts('//', '/*', '#')}
      WHEN language = 'sql' THEN {starts('--', '/*')}
      ELSE {starts('#', '//')} END)"""


def _count(*patterns: str) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all(text, {rx(p, True)}))" for p in patterns) + ")"


_JS = "language IN ('javascript', 'typescript')"
METRICS = f"""
points AS (SELECT py_snippet, sum(points) AS points, count(*) AS functions FROM py_functions GROUP BY 1),
classes AS (SELECT py_snippet, count(*) AS classes FROM py_classes GROUP BY 1),
metrics AS MATERIALIZED (
  SELECT t.repo, t.path, t.language,
    CAST(len(all_lines) AS BIGINT) AS lines_of_code,
    CAST(len(list_filter(all_lines, lambda l: trim(l, {WS}) = '')) AS BIGINT) AS blank_lines,
    CAST({_comments()} AS BIGINT) AS comment_lines,
    CAST(CASE WHEN {_JS} THEN {_count(r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bwhile\s*\(", r"\bfor\s*\(", r"\bswitch\s*\(",
                                      r"\bcase\s+", r"\bcatch\s*\(", r"\?\s*.*\s*:")}
      ELSE coalesce(p.points, 0) END AS BIGINT) AS cyclomatic_complexity,
    CAST(CASE WHEN {_JS} THEN {_count(r"function\s+\w+", r"const\s+\w+\s*=\s*\(", r"let\s+\w+\s*=\s*\(", r"var\s+\w+\s*=\s*\(",
                                      r"=>", r"async\s+function")}
      ELSE coalesce(p.functions, 0) END AS BIGINT) AS functions,
    CAST(CASE WHEN {_JS} THEN {_count(r"class\s+\w+")} ELSE coalesce(c.classes, 0) END AS BIGINT) AS classes,
    CAST(size AS BIGINT) AS file_size, sha256(raw) AS file_hash
  FROM texts t LEFT JOIN points p USING (py_snippet) LEFT JOIN classes c USING (py_snippet)),
"""

SCORES = METRICS + """
lost AS (
  SELECT repo, path,
    sum(CASE WHEN phase = 'security' AND category = 'security' THEN
      CASE severity WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 5 END ELSE 0 END) AS s,
    sum(CASE WHEN phase = 'quality' AND category = 'quality' THEN
      CASE severity WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END ELSE 0 END) AS q,
    sum(CASE WHEN phase = 'performance' AND category = 'performance' THEN
      CASE severity WHEN 'high' THEN 20 WHEN 'medium' THEN 12 ELSE 5 END ELSE 0 END) AS p
  FROM named_issues GROUP BY repo, path),
scores AS MATERIALIZED (
  SELECT m.repo, m.path, m.language, m.cyclomatic_complexity,
    CAST(greatest(0, 100 - coalesce(s, 0)) AS DOUBLE) AS security_score,
    CAST(greatest(0, 100 - coalesce(q, 0)
      - CASE WHEN cyclomatic_complexity > 10 THEN least(20, cyclomatic_complexity - 10) ELSE 0 END
      - CASE WHEN lines_of_code > 500 THEN least(10, (lines_of_code - 500) // 100) ELSE 0 END) AS DOUBLE) AS quality_score,
    CAST(greatest(0, 100 - coalesce(p, 0)) AS DOUBLE) AS performance_score
  FROM metrics m LEFT JOIN lost l ON l.repo = m.repo AND l.path = m.path),
repo_files AS (SELECT repo, count(*) AS total_files FROM prepared GROUP BY repo),
repo_scores AS (SELECT repo, count(*) AS analyzed_files, avg(security_score) AS security, avg(quality_score) AS quality,
  avg(performance_score) AS performance FROM scores GROUP BY repo),
repo_issues AS (
  SELECT repo, count(*) AS total_issues, count(DISTINCT path) AS files_with_issues,
    count(*) FILTER (category = 'security') AS security_issues, count(*) FILTER (category = 'quality') AS quality_issues,
    count(*) FILTER (category = 'performance') AS performance_issues,
    count(*) FILTER (severity = 'high') AS high_issues, count(*) FILTER (severity = 'medium') AS medium_issues,
    count(*) FILTER (severity = 'low') AS low_issues
  FROM named_issues GROUP BY repo),
repo_languages AS (SELECT repo, language, count(*) AS n FROM scores GROUP BY repo, language),
repo_language_list AS (
  SELECT repo, string_agg(language, ', ' ORDER BY language) AS languages,
    arg_min(language, struct_pack(a := -n, b := language)) AS most_common
  FROM repo_languages GROUP BY repo),
rollup AS MATERIALIZED (
  SELECT f.repo, f.total_files, coalesce(s.analyzed_files, 0) AS analyzed_files, coalesce(i.files_with_issues, 0) AS files_with_issues,
    coalesce(s.security, 0.0) AS security_score, coalesce(s.quality, 0.0) AS quality_score,
    coalesce(s.performance, 0.0) AS performance_score, coalesce(i.total_issues, 0) AS total_issues,
    coalesce(i.security_issues, 0) AS security_issues, coalesce(i.quality_issues, 0) AS quality_issues,
    coalesce(i.performance_issues, 0) AS performance_issues, coalesce(i.high_issues, 0) AS high_issues,
    coalesce(i.medium_issues, 0) AS medium_issues, coalesce(i.low_issues, 0) AS low_issues,
    coalesce(l.languages, '') AS languages, coalesce(l.most_common, 'unknown') AS most_common_language,
    coalesce(i.security_issues, 0) > 0 AS has_security_issues,
    coalesce(i.high_issues, 0) > 0 OR coalesce(i.security_issues, 0) > 5 AS requires_attention
  FROM repo_files f LEFT JOIN repo_scores s USING (repo) LEFT JOIN repo_issues i USING (repo)
    LEFT JOIN repo_language_list l USING (repo)),
suggestions AS (
  SELECT s.repo, s.path, 0 AS ord, 'security' AS type, 'high' AS priority,
    'Use environment variables or secure configuration files for secrets' AS description, 'best_practices' AS category
    FROM scores s WHERE EXISTS (SELECT 1 FROM named_issues i WHERE i.repo = s.repo AND i.path = s.path
      AND i.type IN ('hardcoded_password', 'hardcoded_api_key'))
  UNION ALL SELECT repo, path, 1, 'refactoring', 'medium',
    'Consider breaking down complex functions into smaller, more manageable pieces', 'maintainability'
    FROM scores WHERE cyclomatic_complexity > 15
  UNION ALL SELECT s.repo, s.path, 2, 'modernization', 'medium',
    'Replace var with let/const for better scoping and immutability', 'modern_syntax'
    FROM scores s WHERE language IN ('javascript', 'typescript') AND EXISTS (
      SELECT 1 FROM named_issues i WHERE i.repo = s.repo AND i.path = s.path AND i.type = 'var_usage')),
"""

# Id, predicate on a line, for the language-blind profiles.
_NOT_COMMENT = f"NOT starts_with(ltrim(line, {WS}), '#')"


def _credential(word: str) -> str:
    return (f"contains(lower(line), '{word}') AND contains(line, '=') AND {_NOT_COMMENT} AND "
            f"(contains(line, '\"') OR contains(line, '''')) AND NOT contains(lower(line), 'input(')")


PROFILE_RULES = {
    "web": [
        ("R51", _credential("password")), ("R52", _credential("api_key")), ("R53", _credential("secret_key")),
        ("R54", _credential("access_token")),
        ("R55", has("eval(") + " AND " + _NOT_COMMENT), ("R56", has("exec(") + " AND " + _NOT_COMMENT),
        ("R57", has("system(") + " AND " + _NOT_COMMENT), ("R58", has("shell_exec(") + " AND " + _NOT_COMMENT),
        ("R59", "length(line) > 120"), ("R60", has("TODO", "FIXME", "HACK", column="upper(line)")),
        ("R61", has("for") + " AND " + has("range(len(")),
    ],
    "interactive": [
        ("R62", has("password", "secret", "key", column="lower(line)") + " AND " + has("=")),
        ("R63", has("eval(", "exec(")), ("R64", "length(line) > 120"),
        ("R65", has("for") + " AND " + has("in") + " AND " + has("range(len(")),
    ],
    "quick": [
        ("R66", "contains(lower(line), 'password') AND contains(line, '=')"),
        ("R67", "contains(lower(line), 'sql') AND " + has("+", "format")), ("R68", has("eval(", "exec(")),
        ("R69", "length(line) > 120"), ("R70", f"(starts_with(ltrim(line, {WS}), 'TODO') OR starts_with(ltrim(line, {WS}), 'FIXME'))"),
    ],
}
# Display names.
_NAMES = "('.py','Python'),('.js','JavaScript'),('.java','Java'),('.cpp','C++'),('.c','C'),('.cs','C#'),('.php','PHP'),('.rb','Ruby'),('.go','Go')"


def profile(name: str) -> str:
    """CTEs of one language-blind profile, up to ``named_issues``."""
    names = _NAMES + (",('.ts','TypeScript')" if name == "web" else "")
    keep = "WHERE len(list_filter(parts, lambda p: starts_with(p, '.'))) = 0" if name == "web" else ""
    hits = _line_hits([(i, "*", p) for i, p in PROFILE_RULES[name]], {"*": "true"})
    unreadable = "" if name != "quick" else "UNION ALL SELECT repo, path, language, 'R71', 0, NULL FROM chosen WHERE analyzed AND raw IS NULL"
    return FILES + f"""
rules(rule_id, phase, category, type, severity, tool, quote, description) AS (VALUES {RULES}),
code_names(suffix, language) AS (VALUES {names}),
chosen AS MATERIALIZED (
  SELECT n.repo, n.path, n.base, n.raw, coalesce(c.language, 'Unknown') AS language, c.language IS NOT NULL AS analyzed,
    replace(replace(n.raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text
  FROM named n LEFT JOIN code_names c USING (suffix) {keep}),
lines AS (
  SELECT repo, path, language, unnest(string_split(text, chr(10))) AS line,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
  FROM chosen WHERE analyzed AND raw IS NOT NULL),
hits AS (SELECT repo, path, language, {hits} AS rule_id, line_no, line FROM lines {unreadable}),
named_issues AS MATERIALIZED (
  SELECT h.repo, h.path, h.language, h.rule_id, r.phase, r.category, r.type, r.severity,
    CASE WHEN contains(r.description, '{{n}}') THEN replace(r.description, '{{n}}', CAST(length(h.line) AS VARCHAR))
      ELSE r.description END AS description,
    CAST(h.line_no AS INT) AS line_no, {_CODE} AS code, r.tool
  FROM hits h JOIN rules r USING (rule_id)),
"""


_W = "list_distinct(regexp_extract_all(text, '[A-Za-z]{3,}'))"


def _each(before: str, after: str, words: str, separator: str = "chr(10)") -> str:
    return f"array_to_string(list_transform({words}, lambda w: {q(before)} || w || {q(after)}), {separator})"


_LOWER = "list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Z]'))"
_UPPER = "list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))"
NL = "chr(10)"
MANIFEST_FILES = f"""
words AS (SELECT 'org/r' || (doc_id // 10) AS repo, {sql_list(MANIFESTS)}[CAST(doc_id % 10 + 1 AS INT)] AS path, text, {_W} AS w FROM documents),
manifests AS MATERIALIZED (
  SELECT repo, path, w, {_LOWER} AS small, {_UPPER} AS big,
    CASE WHEN ends_with(path, 'requirements.txt') THEN text || chr(10) || 'flask>=1.0' || chr(10) || '# comment' || chr(10)
        || '-r other.txt' || chr(10) || chr(10) || '  numpy == 1.2 ' || chr(10) || 'pkg~=1' || chr(10) || '!x' || chr(10)
      WHEN path = 'requirements-dev.txt' THEN {_each('', "<2 ; python_version > '3'", 'w')}
      WHEN path = 'go.mod' THEN 'module x' || chr(10) || 'require (' || chr(10) || '  in/block v1' || chr(10) || ')' || chr(10)
        || {_each('require example.com/', ' v1', 'w')}
    END AS text
  FROM words),
"""

REPOS = f"""
repos AS MATERIALIZED (
  SELECT p_partkey AS id, replace(p_name, ' ', '-') || '-' || p_partkey AS name,
    lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '-') || '-' || p_partkey AS full_name,
    CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN ''
      ELSE p_name || ' ' || {sql_list(WORDS)}[CAST(p_partkey % {len(WORDS)} + 1 AS INT)] END AS description,
    {sql_list(REPO_LANGUAGES)}[CAST(p_partkey % {len(REPO_LANGUAGES)} + 1 AS INT)] AS language,
    CASE WHEN p_partkey % 3 <> 0 THEN 'main' END AS default_branch,
    p_partkey % 5 = 0 AS private, p_partkey % 5 = 1 AS fork, CAST(p_size AS BIGINT) AS size,
    CAST(floor(p_retailprice) AS BIGINT) AS stargazers_count,
    [lower(p_type), {sql_list(TOPICS)}[CAST(p_partkey % {len(TOPICS)} + 1 AS INT)]] AS topics,
    strftime(DATE '1992-01-01' + CAST(p_partkey * 37 % 2500 AS INT), '%Y-%m-%dT00:00:00Z') AS updated_at,
    split_part(p_brand, '#', 1) AS owner_login, CASE WHEN p_partkey % 4 <> 0 THEN p_type || ' licence' END AS license,
    p_partkey % 6 <> 0 AS has_languages, p_type, p_brand, p_partkey,
    p_partkey % 2 = 0 AS has_issues, p_partkey % 3 = 0 AS has_wiki
  FROM part),
listed AS (SELECT * FROM repos WHERE NOT private AND NOT fork),
configs AS MATERIALIZED (
  SELECT split_part(full_name, '/', 1) AS owner, name, full_name, coalesce(language, 'unknown') AS language,
    coalesce(default_branch, 'main') AS default_branch, p_partkey, p_type FROM repos),
"""
