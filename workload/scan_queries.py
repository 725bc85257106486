"""Files, lines, rules, metrics, scores and rollups over the derived corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesieve.functions import levels, paths, text
from codesieve.operators import metrics, rollups, rule_tables, scan, scores, suggestions, topn
from codesieve.operators.syntax import syntax_rows
from codesieve.plans import digests, reports
from codesieve.plans.review import prepared_files, profile_review, review
from codesieve.sources.files import discover
from codesieve.sources.results import nested_file_results, read_results, replace_file_results
from workload.corpus import scratch, source_files, source_paths, table
from workload.oracle_base import CORE, FILES, SCORES, WS, profile, q
from workload.registry import query, with_ctes

ISSUE_COLUMNS = ["repo", "path", "language", "rule_id", "phase", "category", "type", "severity", "description", "line_no", "code", "tool"]
_ISSUES = ", ".join(ISSUE_COLUMNS)


def _prepared(spark, sf):
    return prepared_files(source_files(spark, sf))


def _results(spark, sf, **options):
    return review(source_files(spark, sf), **options)


# --- files ---------------------------------------------------------------------------------------
@query("file_discovery", with_ctes(FILES, "SELECT repo, path, CAST(size AS BIGINT) AS size FROM found"))
def _(spark, sf):
    return discover(source_files(spark, sf)).select("repo", "path", "size")


@query("file_preparation", with_ctes(FILES, """
    SELECT repo, path, language, analyzed, CAST(length(CASE WHEN analyzed THEN text END) AS INT) AS n_chars,
      md5(CASE WHEN analyzed THEN text END) AS content_md5, coalesce(sha256(raw), '') AS hash FROM prepared"""))
def _(spark, sf):
    return _prepared(spark, sf).select(
        "repo", "path", "language", "analyzed", F.length("content").alias("n_chars"),
        F.md5(F.encode("content", "UTF-8")).alias("content_md5"), "hash")


@query("file_size_limit", with_ctes(FILES, """
    SELECT repo, count(*) AS files, count(*) FILTER (analyzed AND size <= 3000) AS small_files FROM prepared GROUP BY repo"""))
def _(spark, sf):
    return prepared_files(source_files(spark, sf), max_size=3000).groupBy("repo").agg(
        F.count("*").alias("files"), F.count_if("analyzed").alias("small_files"))


# Fixed values in the next two: extensions and the names that are shown for them.
@query("file_names", with_ctes(FILES, """
    SELECT repo, path, lower(suffix) AS extension, l.language,
      CASE WHEN lower(suffix) IN ('.py','.js','.ts','.jsx','.tsx','.java','.go','.rs','.cpp','.c','.cs','.php','.rb',
        '.swift','.kt','.scala','.r','.sql','.sh','.ps1') THEN l.language ELSE 'unknown' END AS short_language,
      CASE suffix WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript' WHEN '.java' THEN 'Java'
        WHEN '.php' THEN 'PHP' WHEN '.rb' THEN 'Ruby' WHEN '.go' THEN 'Go' ELSE 'Unknown' END AS display_name,
      len(list_filter(parts, lambda p: starts_with(p, '.'))) > 0 AS hidden
    FROM named LEFT JOIN languages l ON l.ext = lower(suffix)"""))
def _(spark, sf):
    path = F.col("path")
    return source_paths(spark, sf).select(
        "repo", "path", paths.extension(path).alias("extension"), paths.language(path).alias("language"),
        paths.short_language(path).alias("short_language"), paths.display_language(path).alias("display_name"),
        paths.is_hidden(path).alias("hidden"))


@query("code_file_counts", with_ctes(FILES, """
    SELECT repo, count(*) FILTER (len(list_filter(parts, lambda p: starts_with(p, '.'))) = 0) AS web_files,
      count(*) FILTER (len(list_filter(parts, lambda p: starts_with(p, '.'))) = 0
        AND suffix IN ('.py','.js','.java','.cpp','.c','.cs','.php','.rb','.go','.ts')) AS web_code,
      count(*) AS quick_files, count(*) FILTER (suffix IN ('.py','.js','.java','.cpp','.c','.cs','.php','.rb','.go')) AS quick_code
    FROM named GROUP BY repo"""))
def _(spark, sf):
    path, shown = F.col("path"), ~paths.is_hidden(F.col("path"))
    return source_paths(spark, sf).groupBy("repo").agg(
        F.count_if(shown).alias("web_files"), F.count_if(shown & paths.has_code_extension(path, "web")).alias("web_code"),
        F.count("*").alias("quick_files"), F.count_if(paths.has_code_extension(path, "quick")).alias("quick_code"))


@query("ansible_files", with_ctes(CORE, "SELECT repo, path, ansible FROM texts WHERE language = 'yaml'"))
def _(spark, sf):
    return _prepared(spark, sf).filter("analyzed and language = 'yaml'").select(
        "repo", "path", scan.is_ansible().alias("ansible"))


@query("text_functions", f"""
    SELECT doc_id, trim(text, {WS})[1:100] AS snippet,
      CASE WHEN length(text) > 60 THEN text[1:60] || '...' ELSE text END AS short_text,
      CASE WHEN n_chars = 0 THEN '0 B' WHEN n_chars < 1024 THEN printf('%.1f B', round_even(n_chars::DOUBLE, 1))
        ELSE printf('%.1f KB', round_even(n_chars / 1024.0::DOUBLE, 1)) END AS readable,
      CASE WHEN doc_id % 101 >= 90 THEN '✅' WHEN doc_id % 101 >= 70 THEN '⚠️' ELSE '❌' END AS mark,
      array_to_string(list_transform(string_split(text, ','), lambda p: lower(trim(p, {WS}))), '|') AS parts
    FROM documents""")
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.snippet(t).alias("snippet"), text.truncate(t, 60).alias("short_text"),
        levels.readable_size(F.col("n_chars")).alias("readable"), levels.indicator(F.col("doc_id") % 101).alias("mark"),
        F.array_join(text.comma_list(t), "|").alias("parts"))


@query("safe_file_names", r"""
    WITH clean AS (SELECT doc_id, trim(translate(text, '<>:"/\|?*', '_________'), ' .') AS name FROM documents),
    cut AS (SELECT doc_id, CASE WHEN name = '' THEN 'untitled' ELSE name END AS name,
      CASE WHEN contains(ltrim(name, '.'), '.') THEN '.' || list_extract(string_split(name, '.'), -1) ELSE '' END AS ext FROM clean),
    parts AS (SELECT doc_id, name, ext, name[1:length(name) - length(ext)] AS stem, 255 - length(ext) AS room FROM cut)
    SELECT doc_id, CASE WHEN length(name) <= 255 THEN name
      WHEN room >= 0 THEN left(stem, room) || ext
      ELSE left(stem, greatest(0, length(stem) + room)) || ext END AS file_name FROM parts""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", paths.sanitize_filename(F.col("text")).alias("file_name"))


# --- lines and rules ----------------------------------------------------------------------------------
@query("numbered_lines", with_ctes(CORE, "SELECT repo, path, language, CAST(line_no AS INT) AS line_no, md5(line) AS line_md5 FROM numbered"))
def _(spark, sf):
    lines = scan.numbered_lines(_prepared(spark, sf).filter("analyzed"))
    return lines.select("repo", "path", "language", "line_no", F.md5(F.encode("line", "UTF-8")).alias("line_md5"))


@query("core_issues", with_ctes(CORE, f"SELECT {_ISSUES} FROM named_issues"))
def _(spark, sf):
    return scan.issues(scan.with_issues(_prepared(spark, sf))).select(*ISSUE_COLUMNS)


def _family(name: str, ids: list[str]):
    listed = ", ".join(q(i) for i in ids)

    @query(name, with_ctes(CORE, f"SELECT {_ISSUES} FROM named_issues WHERE rule_id IN ({listed})"))
    def _(spark, sf):
        return scan.issues(scan.with_issues(_prepared(spark, sf), ids=ids)).select(*ISSUE_COLUMNS)


def _ids(first: int, last: int) -> list[str]:
    return [f"R{n:02d}" for n in range(first, last + 1)]


_family("rules_secrets", _ids(1, 4))
_family("rules_python", [*_ids(5, 9), *_ids(16, 18), "R24", "R25"])
_family("rules_javascript", [*_ids(10, 13), *_ids(19, 21), "R26", "R27"])
_family("rules_sql_java", ["R14", "R15", "R22", "R23"])
_family("rules_yaml", ["R28", "R29", *_ids(36, 38)])
_family("rules_ansible_security", _ids(30, 35))
_family("rules_ansible_quality", [*_ids(39, 47)])
_family("rules_ansible_performance", ["R48", "R49", "R50"])


@query("issues_of_one_type", with_ctes(CORE, f"SELECT {_ISSUES} FROM named_issues WHERE category = 'performance'"))
def _(spark, sf):
    return scan.issues(scan.with_issues(_prepared(spark, sf), analysis_type="performance")).select(*ISSUE_COLUMNS)


@query("long_lines_per_node", with_ctes(CORE, """
    SELECT t.repo, t.path, CAST(t.prose_lines + l.at_line AS INT) AS line_no, l.nodes AS issues
    FROM texts t JOIN py_long l USING (py_snippet)"""))
def _(spark, sf):
    scanned = scan.with_issues(_prepared(spark, sf), per_node_long_lines=True)
    return scan.issues(scanned).filter("rule_id = 'R17'").groupBy("repo", "path", "line_no").agg(
        F.count("*").cast("int").alias("issues"))


def _profile_queries(name: str):
    @query(f"{name}_issues", with_ctes(profile(name), f"SELECT {_ISSUES} FROM named_issues"))
    def _(spark, sf):
        return scan.issues(profile_review(source_files(spark, sf), name)).select(*ISSUE_COLUMNS)

    points = scores.PROFILE_POINTS[name]
    sql_scores = ", ".join(f"CAST(greatest(0, 100 - {p} * count(i.path) FILTER (i.category = '{c}')) AS DOUBLE) AS {c}_score, "
                           f"count(i.path) FILTER (i.category = '{c}') AS {c}_issues" for c, p in points.items())

    @query(f"{name}_scores", with_ctes(
        profile(name) + """per_repo AS (SELECT repo, count(*) AS total_files, count(*) FILTER (analyzed) AS analyzed_files
          FROM chosen GROUP BY repo)""", f"""
        SELECT f.repo, f.total_files, f.analyzed_files, {sql_scores}
        FROM per_repo f LEFT JOIN named_issues i ON i.repo = f.repo GROUP BY f.repo, f.total_files, f.analyzed_files"""))
    def _(spark, sf):
        out = scores.profile_scores(profile_review(source_files(spark, sf), name), name)
        return out.select("repo", "total_files", "analyzed_files",
                          *[f"{c}_{what}" for c in points for what in ("score", "issues")])


for _name in ("web", "interactive", "quick"):
    _profile_queries(_name)


# id, language, pattern: more than 200 rows whose ids repeat; lines that start with two given syllables
_LANGUAGES = [None, "javascript", "java", "yaml", "sql"]
RULE_TABLE = [("T1", None, "token"), ("T2", "python", "import [a-z]+"), ("T3", "yaml", "^ +- name:"), ("T1", "java", "tok")] + [
    (f"S{n % 100}", _LANGUAGES[n % 5], f"^{a}{b}") for n, (a, b) in enumerate(
        (a, b) for a in "An Be De En Er Ha He In La On Re Th Ou Qu Un".split() for b in "an ch de en er he ie in nd on or re st th tion".split())]


def _table_hits() -> str:
    def test(language):
        return "true" if language is None else f"language = '{language}'"

    return ",\n    ".join(f"CASE WHEN {test(l)} AND regexp_matches(line, {q(p)}) THEN {n} END" for n, (_, l, p) in enumerate(RULE_TABLE))


@query("rule_table_scan", with_ctes(CORE + f"""
    rule_table(n, rule_id, pattern) AS (VALUES {', '.join(f"({n}, {q(i)}, {q(p)})" for n, (i, _, p) in enumerate(RULE_TABLE))}),
    table_hits AS (SELECT repo, path, line_no, unnest(list_filter([{_table_hits()}], lambda n: n IS NOT NULL)) AS n FROM numbered)""", """
    SELECT repo, path, CAST(line_no AS INT) AS line_no, rule_id, pattern FROM table_hits JOIN rule_table USING (n)"""))
def _(spark, sf):
    rule_table = spark.createDataFrame(RULE_TABLE, "rule_id string, language string, pattern string")
    lines = scan.numbered_lines(_prepared(spark, sf).filter("analyzed"))
    return rule_tables.scan_with_rule_table(lines, rule_table).select("repo", "path", "line_no", "rule_id", "pattern")


@query("python_syntax", with_ctes(CORE, """
    SELECT repo, path, 'function' AS kind, CAST(prose_lines + at_line AS INT) AS line_no, name, NULL AS module, n_args, points
      FROM texts JOIN py_functions USING (py_snippet)
    UNION ALL SELECT repo, path, 'class', CAST(prose_lines + at_line AS INT), name, NULL, NULL, NULL FROM texts JOIN py_classes USING (py_snippet)
    UNION ALL SELECT repo, path, 'import', CAST(prose_lines + at_line AS INT), name, module, NULL, NULL FROM texts JOIN py_imports USING (py_snippet)
    UNION ALL SELECT repo, path, 'syntax_error', CAST(prose_lines + at_line AS INT),
      'invalid syntax (<unknown>, line ' || (prose_lines + at_line) || ')', NULL, NULL, NULL
      FROM texts JOIN py_errors USING (py_snippet)"""))
def _(spark, sf):
    return syntax_rows(_prepared(spark, sf)).filter("kind <> 'node_line'").select(
        "repo", "path", "kind", "line_no", "name", "module", "n_args", F.col("decision_points").alias("points"))


# --- metrics, scores, suggestions --------------------------------------------------------------------------
@query("file_metrics", with_ctes(CORE + SCORES, f"SELECT repo, path, language, {', '.join(metrics.METRICS)} FROM metrics"))
def _(spark, sf):
    return _results(spark, sf).filter("analyzed").select("repo", "path", "language", *metrics.METRICS)


@query("file_scores", with_ctes(CORE + SCORES, """
    SELECT repo, path, security_score, quality_score, performance_score FROM scores"""))
def _(spark, sf):
    return _results(spark, sf).filter("analyzed").select("repo", "path", "security_score", "quality_score", "performance_score")


@query("repository_scores", with_ctes(CORE + SCORES, """
    SELECT repo, security_score AS security, quality_score AS quality, performance_score AS performance FROM rollup"""))
def _(spark, sf):
    return scores.repository_scores(_results(spark, sf))


@query("file_suggestions", with_ctes(CORE + SCORES, "SELECT repo, path, type, priority, description, category FROM suggestions"))
def _(spark, sf):
    return suggestions.suggestion_rows(_results(spark, sf)).select("repo", "path", "type", "priority", "description", "category")


@query("suggestions_of_one_type", with_ctes(CORE + SCORES, "SELECT repo, path, description FROM suggestions WHERE type = 'security' AND priority = 'high'"))
def _(spark, sf):
    return suggestions.suggestion_rows(_results(spark, sf), "security", "high").select("repo", "path", "description")


_ISSUE_TEXT = ["line_no", "rule_id", "phase", "category", "type", "severity", "description", "code", "tool"]
_SUGGESTION_TEXT = ["type", "priority", "description", "category"]


@query("nested_results", with_ctes(CORE + SCORES, f"""
    SELECT s.repo, s.path AS file_path, s.language, coalesce(i.issues, '') AS issues, {', '.join(f'm.{c}' for c in metrics.METRICS)},
      security_score AS security, quality_score AS quality, performance_score AS performance, coalesce(g.suggestions, '') AS suggestions
    FROM scores s JOIN metrics m ON m.repo = s.repo AND m.path = s.path
    LEFT JOIN (SELECT repo, path, string_agg(concat_ws('|', {', '.join(_ISSUE_TEXT)}), chr(10)
      ORDER BY concat_ws('|', {', '.join(_ISSUE_TEXT)})) AS issues FROM named_issues GROUP BY ALL) i ON i.repo = s.repo AND i.path = s.path
    LEFT JOIN (SELECT repo, path, string_agg(concat_ws('|', {', '.join(_SUGGESTION_TEXT)}), chr(10) ORDER BY concat_ws('|', {', '.join(_SUGGESTION_TEXT)}))
      AS suggestions FROM suggestions GROUP BY ALL) g ON g.repo = s.repo AND g.path = s.path"""))
def _(spark, sf):
    def as_text(column, fields):
        return F.array_join(F.array_sort(F.transform(column, lambda x: F.concat_ws("|", *[x[f] for f in fields]))), "\n").alias(column)

    return nested_file_results(_results(spark, sf)).select(
        "repo", "file_path", "language", as_text("issues", _ISSUE_TEXT), "metrics.*", "scores.*", as_text("suggestions", _SUGGESTION_TEXT))


@query("rescanned_results", with_ctes(CORE + """
    again AS (SELECT repo, path, language FROM prepared WHERE analyzed AND (NOT contains(repo, '1') OR language = 'python'))""", """
    SELECT a.repo, a.path AS file_path, a.language, coalesce(i.n, 0) AS issues
    FROM again a LEFT JOIN (SELECT repo, path, count(*) AS n FROM named_issues GROUP BY ALL) i ON i.repo = a.repo AND i.path = a.path"""))
def _(spark, sf):
    """A table of results; repositories with a 1 in their names are scanned again, with Python files alone, and take their old results' place."""
    files, folder = source_files(spark, sf), scratch(spark, "results")
    replace_file_results(review(files), folder, buckets=16)
    touched = files.filter(F.col("repo").contains("1"))
    replace_file_results(review(touched.filter(paths.language(F.col("path")) == "python")), folder, gone=touched.select("repo").distinct(), buckets=16)
    return read_results(spark, folder).select("repo", "file_path", "language", F.size("issues").cast("long").alias("issues"))



# --- rollups --------------------------------------------------------------------------------------------------
_ROLLUP = ["repo", "total_files", "analyzed_files", "files_with_issues", "security_score", "quality_score", "performance_score",
           "total_issues", "security_issues", "quality_issues", "performance_issues", "high_issues", "medium_issues",
           "low_issues", "most_common_language", "has_security_issues", "requires_attention"]
_TIER = """CASE WHEN high_issues > 0 THEN 'requires attention' WHEN total_issues > 10 THEN 'review recommended'
    WHEN total_issues > 0 THEN 'good with minor fixes' ELSE 'excellent' END AS recommendation"""


@query("repository_rollup", with_ctes(CORE + SCORES, f"SELECT {', '.join(_ROLLUP)}, languages, {_TIER} FROM rollup"))
def _(spark, sf):
    return rollups.repository_rollup(_results(spark, sf)).select(
        *_ROLLUP, F.concat_ws(", ", F.map_keys("languages")).alias("languages"), "recommendation")


@query("language_histogram", with_ctes(CORE + SCORES, "SELECT repo, language, n AS files FROM repo_languages"))
def _(spark, sf):
    return rollups.language_histogram(_results(spark, sf))


@query("language_lists", with_ctes(CORE + SCORES, "SELECT repo, languages FROM repo_language_list"))
def _(spark, sf):
    return rollups.language_names(_results(spark, sf)).select("repo", F.concat_ws(", ", "languages").alias("languages"))


@query("issue_types_per_file", with_ctes(CORE, "SELECT repo, path, type, count(*) AS issues FROM named_issues GROUP BY ALL"))
def _(spark, sf):
    return rollups.issue_type_counts(scan.with_issues(_prepared(spark, sf)))


@query("issues_by_category", with_ctes(CORE, "SELECT repo, category, count(*) AS issues FROM named_issues GROUP BY ALL"))
def _(spark, sf):
    return rollups.issues_by_category(scan.issues(scan.with_issues(_prepared(spark, sf)), "repo"))


@query("issue_cube", with_ctes(CORE, """
    SELECT repo, category, severity, CAST(grouping(repo, category, severity) AS INT) AS level, count(*) AS issues
    FROM named_issues GROUP BY ROLLUP (repo, category, severity)"""))
def _(spark, sf):
    return rollups.issue_cube(scan.issues(scan.with_issues(_prepared(spark, sf)), "repo"))


@query("summary", with_ctes(CORE + SCORES, """
    SELECT repo, total_issues, security_issues AS security, quality_issues AS quality, performance_issues AS performance,
      high_issues AS high, medium_issues AS medium, low_issues AS low, languages, most_common_language, 0::BIGINT AS total_dependencies,
      has_security_issues, requires_attention FROM rollup"""))
def _(spark, sf):
    out = rollups.summary(rollups.repository_rollup(_results(spark, sf)))
    return out.select(
        "repo", "summary.total_issues", "summary.issues_by_category.*", "summary.issues_by_severity.*",
        F.concat_ws(", ", "summary.languages_detected").alias("languages"), "summary.most_common_language", "summary.total_dependencies",
        "summary.has_security_issues", "summary.requires_attention")


# --- first n ------------------------------------------------------------------------------------------------------
def _first(n: int, keys: str, where: str = "true") -> str:
    return f"""SELECT repo, category, path, line_no, rule_id, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY path, line_no, rule_id) AS INT) AS rank
      FROM named_issues WHERE {where}) WHERE rank <= {n}"""


_FIRST = ["repo", "category", "path", "line_no", "rule_id", "rank"]


@query("first_issues", with_ctes(CORE, _first(10, "repo, category")))
def _(spark, sf):
    return topn.first_issues(scan.with_issues(_prepared(spark, sf)), 10).select(*_FIRST)


@query("focus_area_issues", with_ctes(CORE, _first(10, "repo, category", "severity IN ('high', 'medium') AND category IN ('security', 'performance')")))
def _(spark, sf):
    return digests.top_by_focus_area(scan.with_issues(_prepared(spark, sf)), ["security", "performance"]).select(*_FIRST)


@query("top_security_findings", with_ctes(CORE, _first(10, "repo", "severity = 'high' AND category = 'security'")))
def _(spark, sf):
    return digests.top_security(scan.with_issues(_prepared(spark, sf))).select(*_FIRST)


@query("top_suggestions", with_ctes(CORE + SCORES, """
    SELECT repo, priority, path, description, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY repo, priority ORDER BY path, ord) AS INT) AS rank FROM suggestions)
    WHERE rank <= 5"""))
def _(spark, sf):
    return digests.top_suggestions(_results(spark, sf)).select("repo", "priority", "path", "description", "rank")


@query("first_suggestions", with_ctes(CORE + SCORES, """
    SELECT repo, path, description, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY path, ord) AS INT) AS rank FROM suggestions) WHERE rank <= 3"""))
def _(spark, sf):
    return digests.top_suggestions(_results(spark, sf), 3, by_priority=False).select("repo", "path", "description", "rank")


@query("security_findings", with_ctes(CORE, """
    SELECT repo, path, line_no, rule_id, severity, severity = 'high' AS urgent FROM named_issues WHERE category = 'security'"""))
def _(spark, sf):
    found = scan.issues(scan.with_issues(_prepared(spark, sf), categories=["security"]))
    return found.select("repo", "path", "line_no", "rule_id", "severity", (F.col("severity") == "high").alias("urgent"))


@query("first_files", with_ctes(FILES, """
    SELECT repo, path FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS rank FROM found) WHERE rank <= 20"""))
def _(spark, sf):
    return topn.first_files(discover(source_paths(spark, sf)), 20).select("repo", "path")


def _section_sql(ctes: str, shown: int) -> str:
    return with_ctes(ctes, f"""
    SELECT repo, category, count(*) AS issues, CAST(greatest(0, count(*) - {shown}) AS BIGINT) AS more,
      string_agg('[' || upper(severity) || '] ' || list_extract(string_split(path, '/'), -1) || ':' || line_no || ' - ' || description,
        chr(10) ORDER BY rank) FILTER (rank <= {shown}) AS shown
    FROM (SELECT *, row_number() OVER (PARTITION BY repo, category ORDER BY path, line_no, rule_id) AS rank FROM named_issues)
    GROUP BY repo, category""")


@query("category_sections", _section_sql(CORE, 5))
def _(spark, sf):
    scanned = scan.with_issues(_prepared(spark, sf)).select("repo", "path", "issues")
    return reports.category_sections(scanned, 5).select("repo", "category", "issues", "more", F.concat_ws("\n", "shown").alias("shown"))


# --- digests and reports -----------------------------------------------------------------------------------------------
def _score(c: str) -> str:
    return f"printf('%.1f', round_even({c}_score, 1)) || '/100'"


def _tops(name: str, line: str, keys: str, order: str, source: str, where: str, n: int) -> str:
    return f"""{name} AS (SELECT repo, string_agg({line}, chr(10) ORDER BY rank) AS lines FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rank FROM {source} WHERE {where})
      WHERE rank <= {n} GROUP BY repo)"""


_BULLET = "'- **' || path || '**: ' || description"
_ORDER = "path, line_no, rule_id"
_NL2 = "chr(10) || chr(10)"


def _focus(category: str) -> str:
    return _tops(f"top_{category}", _BULLET, "repo", _ORDER, "named_issues",
                 f"category = '{category}' AND severity IN ('high', 'medium')", 10)


@query("review_digest", with_ctes(
    CORE + SCORES + _focus("security") + "," + _focus("performance"), f"""
    SELECT r.repo, concat_ws({_NL2}, '# Code Review for ' || r.repo,
      concat_ws(chr(10), '## Repository Overview', '- **Languages**: ' || r.languages,
        '- **Files Analyzed**: ' || analyzed_files || '/' || total_files,
        '- **Overall Scores**: Security: ' || {_score('security')} || ', Quality: ' || {_score('quality')} || ', Performance: ' || {_score('performance')}),
      '## Focus Areas' || chr(10) || 'security, performance, maintainability, style',
      '## Analysis Summary' || chr(10) || to_json({{'total_issues': total_issues,
        'issues_by_category': {{'security': security_issues, 'quality': quality_issues, 'performance': performance_issues}},
        'issues_by_severity': {{'high': high_issues, 'medium': medium_issues, 'low': low_issues}},
        'languages_detected': CASE WHEN r.languages = '' THEN [] ELSE string_split(r.languages, ', ') END,
        'most_common_language': most_common_language, 'total_dependencies': 0,
        'has_security_issues': has_security_issues, 'requires_attention': requires_attention}}),
      '## Key Issues Found',
      '### Security Issues' || chr(10) || s.lines, '### Performance Issues' || chr(10) || p.lines) AS digest
    FROM rollup r LEFT JOIN top_security s USING (repo) LEFT JOIN top_performance p USING (repo)"""))
def _(spark, sf):
    return digests.review_digest(_results(spark, sf))


@query("improvement_digest", with_ctes(
    CORE + SCORES + _tops("high", _BULLET, "repo", "path, ord", "suggestions", "priority = 'high'", 5) + ","
    + _tops("medium", _BULLET, "repo", "path, ord", "suggestions", "priority = 'medium'", 5), f"""
    SELECT r.repo, concat_ws({_NL2}, '# Improvement Suggestions for ' || r.repo,
      concat_ws(chr(10), '## Current Scores', '- Security: ' || {_score('security')}, '- Quality: ' || {_score('quality')},
        '- Performance: ' || {_score('performance')}),
      '## Focus Area: All Areas',
      concat_ws(chr(10), '## Key Metrics', '- Languages: ' || r.languages, '- Total Files: ' || total_files,
        '- Files with Issues: ' || files_with_issues),
      '## Improvement Opportunities',
      '### High Priority' || chr(10) || h.lines, '### Medium Priority' || chr(10) || m.lines) AS digest
    FROM rollup r LEFT JOIN high h USING (repo) LEFT JOIN medium m USING (repo)"""))
def _(spark, sf):
    return digests.improvement_digest(_results(spark, sf))


def _mark(c: str) -> str:
    return f"CASE WHEN {c}_score >= 90 THEN '✅' WHEN {c}_score >= 70 THEN '⚠️' ELSE '❌' END"


def _analysis(where: str) -> str:
    line = "rank || '. [' || upper(severity) || '] ' || path || ': ' || description"
    return with_ctes(
        CORE + SCORES + _tops("top", line, "repo", _ORDER, "named_issues", where, 10), f"""
    SELECT r.repo, {', '.join(f"{_score(c)} || ' ' || {_mark(c)} AS {c}" for c in ('security', 'quality', 'performance'))},
      total_files, analyzed_files, languages, {_TIER}, coalesce(t.lines, '') AS top_issues
    FROM rollup r LEFT JOIN top t USING (repo)""")


@query("analysis_report", _analysis("true"))
def _(spark, sf):
    return reports.analysis_report(_results(spark, sf))


@query("quality_report", _analysis("category = 'quality'"))
def _(spark, sf):
    return reports.analysis_report(_results(spark, sf), "quality")


def _profile_report(name: str):
    points, shown = scores.PROFILE_POINTS[name], reports.SHOWN[name]
    counts = ", ".join(f"count(i.path) FILTER (i.category = '{c}') AS {c}_issues" for c in points)
    final = ", ".join(f"CAST(greatest(0, 100 - {p} * {c}_issues) AS INT) AS {c}_score" for c, p in points.items())
    line = "'- [' || upper(severity) || '] ' || list_extract(string_split(path, '/'), -1) || ':' || line_no || ' - ' || description"
    tops = ",".join(_tops(
        f"top_{c}", line + (" || ' `' || code || '`'" if name == "web" and c == "security" else ""),
        "repo", _ORDER, "named_issues", f"category = '{c}'", shown) for c in points)
    sections = ", ".join(f"""concat_ws(chr(10), '{c.title()} issues: ' || {c}_issues, coalesce(t_{c}.lines, ''),
        CASE WHEN {c}_issues > {shown} THEN '... and ' || ({c}_issues - {shown}) || ' more {c} issues' END)""" for c in points)

    @query(f"{name}_report", with_ctes(
        profile(name) + f"""
        per_repo AS (SELECT repo, count(*) AS total_files, count(*) FILTER (analyzed) AS analyzed_files,
          string_agg(DISTINCT language, ', ' ORDER BY language) FILTER (analyzed) AS languages FROM chosen GROUP BY repo),
        counted AS (SELECT f.repo, total_files, analyzed_files, languages, {counts}
          FROM per_repo f LEFT JOIN named_issues i ON i.repo = f.repo GROUP BY ALL),
        scored AS (SELECT *, {final} FROM counted), {tops}""", f"""
        SELECT s.repo, concat_ws({_NL2}, 'Analysis results for ' || s.repo,
          concat_ws(chr(10), {', '.join(f"'{c.title()}: ' || {c}_score || '/100 ' || {_mark(c)}" for c in points)}),
          concat_ws(chr(10), 'Total files: ' || total_files, 'Analyzed files: ' || analyzed_files,
            'Languages: ' || coalesce(languages, 'None detected'),
            'Total issues: ' || ({' + '.join(f'{c}_issues' for c in points)})),
          {sections}) AS report
        FROM scored s {' '.join(f'LEFT JOIN top_{c} t_{c} ON t_{c}.repo = s.repo' for c in points)}"""))
    def _(spark, sf):
        return reports.profile_report(profile_review(source_files(spark, sf), name), name)


for _name in ("web", "interactive", "quick"):
    _profile_report(_name)
