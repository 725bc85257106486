"""Imports, dependencies, catalogue, listings, linter reports and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesieve.functions import levels
from codesieve.operators import catalog, dependencies, imports
from codesieve.operators.rollups import repository_rollup, summary
from codesieve.plans import digests
from codesieve.plans.materialize import materialize
from codesieve.plans.review import manifest_files, prepared_files, review
from codesieve.sources import linters, listings, repo_config, run_log
from codesieve.sources.files import with_text
from codesieve.sources.results import nested_repository_results
from workload import corpus
from workload.oracle_base import CORE, FILES, MANIFEST_FILES, REPOS, SCORES, WS, q, rx, sql_list
from workload.registry import query, with_ctes

# --- imports ----------------------------------------------------------------------------------------
# The patterns of import statements.
_JS_FROM = rx(r"""import\s+(\*\s+as\s+\w+|\w+|\{[^}]+\})\s+from\s+['"]([^'"]+)['"]""")
_JS_BARE = rx(r"""import\s+['"]([^'"]+)['"]""")
_JS_REQUIRE = rx(r"""const\s+(\w+|\{[^}]+\})\s*=\s*require\s*\(\s*['"]([^'"]+)['"]\s*\)""")
_JAVA = rx(r"import\s+(static\s+)?([a-zA-Z_][a-zA-Z0-9_.]*(?:\.\*)?);")
_GO = rx(r'import\s+"([^"]+)"')
_GO_BLOCK = rx(r"import\s*\(([^)]*)\)")


def _pairs(pattern: str, type: str, where: str) -> str:
    return f"""SELECT repo, path, language, {type} AS type, module, name, NULL AS alias, CAST(line_no AS INT) AS line_no FROM (
      SELECT repo, path, language, line_no, unnest(regexp_extract_all(line, {pattern}, 1)) AS name,
        unnest(regexp_extract_all(line, {pattern}, 2)) AS module FROM numbered WHERE {where})"""


_IMPORTS = f"""
js AS (
  {_pairs(_JS_FROM, "'import'", "language IN ('javascript', 'typescript')")}
  UNION ALL {_pairs(_JS_REQUIRE, "'import'", "language IN ('javascript', 'typescript')")}
  UNION ALL SELECT repo, path, language, 'import', unnest(regexp_extract_all(line, {_JS_BARE}, 1)), NULL, NULL, CAST(line_no AS INT)
    FROM numbered WHERE language IN ('javascript', 'typescript')),
java AS (SELECT repo, path, language, CASE WHEN coalesce(name, '') <> '' THEN 'static_import' ELSE 'import' END AS type, module,
    NULL AS name, alias, line_no FROM ({_pairs(_JAVA, "'x'", "language = 'java'")})),
go_blocks AS (
  SELECT repo, path, language, trim(unnest(string_split(block, chr(10))), {WS}) AS entry FROM (
    SELECT repo, path, language, unnest(regexp_extract_all(text, {_GO_BLOCK}, 1)) AS block FROM texts WHERE language = 'go')),
go AS (
  SELECT repo, path, language, 'import' AS type, unnest(regexp_extract_all(line, {_GO}, 1)) AS module, NULL AS name, NULL AS alias,
    CAST(line_no AS INT) AS line_no FROM numbered WHERE language = 'go'
  UNION ALL SELECT repo, path, language, 'import', trim(entry, '"'), NULL, NULL, 0 FROM go_blocks
    WHERE starts_with(entry, '"') AND ends_with(entry, '"')),
py AS (SELECT repo, path, language, type, module, name, alias, CAST(prose_lines + at_line AS INT) AS line_no
  FROM texts JOIN py_imports USING (py_snippet)),
imports AS (SELECT * FROM js UNION ALL SELECT * FROM java UNION ALL SELECT * FROM go UNION ALL SELECT * FROM py)
"""
_FIELDS = "repo, path, language, type, module, name, alias, line_no"


def _source(spark, sf):
    return prepared_files(corpus.source_files(spark, sf)).filter("analyzed")


@query("imports", with_ctes(CORE + _IMPORTS, f"SELECT {_FIELDS} FROM imports"))
def _(spark, sf):
    return imports.extract_imports(_source(spark, sf))


for _language, _names in {"py": ["python"], "js": ["javascript", "typescript"], "java": ["java"], "go": ["go"]}.items():
    @query(f"{_language}_imports", with_ctes(CORE + _IMPORTS, f"SELECT {_FIELDS} FROM {_language}"))
    def _(spark, sf, names=_names):
        return imports.extract_imports(_source(spark, sf), *names)


# --- dependencies --------------------------------------------------------------------------------------
def _manifests(spark, sf):
    return with_text(corpus.manifests(spark, sf))


_REQUIREMENTS = f"""
requirement_lines AS (
  SELECT repo, path, trim(unnest(string_split(text, chr(10))), {WS}) AS line FROM manifests
  WHERE list_extract(string_split(path, '/'), -1) IN ('requirements.txt', 'requirements-dev.txt')),
requirement AS (
  SELECT repo, path AS manifest, 'direct' AS scope, trim(regexp_split_to_array(line, '[><=!]')[1], {WS}) AS package
  FROM requirement_lines WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '-')
    AND trim(regexp_split_to_array(line, '[><=!]')[1], {WS}) <> ''),
"""
_MANIFEST = MANIFEST_FILES + _REQUIREMENTS + """
keyed AS (
  SELECT repo, path AS manifest, 'direct' AS scope, unnest(small) AS package FROM manifests
    WHERE path IN ('package.json', 'Pipfile', 'Cargo.toml', 'pyproject.toml')
  UNION ALL SELECT repo, path, 'dev', unnest(big) FROM manifests WHERE path IN ('package.json', 'Pipfile', 'Cargo.toml', 'pyproject.toml')
  UNION ALL SELECT repo, path, 'optional', 'opt' FROM manifests WHERE path = 'package.json'),
go_required AS (
  SELECT repo, path AS manifest, 'direct' AS scope, package FROM (
    SELECT repo, path, unnest(regexp_extract_all(text, 'require[\\s]+([^\\s]+)', 1)) AS package FROM manifests WHERE path = 'go.mod')
  WHERE NOT starts_with(package, '(')),
declared AS (SELECT * FROM requirement UNION ALL SELECT * FROM keyed UNION ALL SELECT * FROM go_required),
distinct_packages AS (SELECT DISTINCT repo, scope, package FROM declared WHERE NOT contains(manifest, '/'))
"""


@query("manifest_selection", with_ctes(MANIFEST_FILES, """
    SELECT repo, path FROM manifests WHERE path IN ('requirements.txt', 'requirements-dev.txt', 'Pipfile', 'pyproject.toml',
      'package.json', 'go.mod', 'Cargo.toml', 'pom.xml', 'build.gradle', 'composer.json')"""))
def _(spark, sf):
    return dependencies.root_manifests(corpus.manifests(spark, sf)).select("repo", "path")


for _name, _listed, _from, _where in [
    ("requirements_packages", dependencies.REQUIREMENTS, "requirement", "true"),
    ("package_json_packages", dependencies.PACKAGE_JSON, "keyed", "manifest = 'package.json'"),
    ("pipfile_packages", dependencies.PIPFILE, "keyed", "manifest = 'Pipfile'"),
    ("toml_packages", dependencies.POETRY + dependencies.CARGO, "keyed", "manifest IN ('Cargo.toml', 'pyproject.toml')"),
    ("go_mod_packages", dependencies.GO, "go_required", "true"),
    ("declared_packages", None, "declared", "true"),
]:
    @query(_name, with_ctes(_MANIFEST, f"SELECT repo, manifest, scope, package FROM {_from} WHERE {_where}"))
    def _(spark, sf, names=_listed):
        return dependencies.declared(_manifests(spark, sf), names=names)


@query("strict_requirements", with_ctes(MANIFEST_FILES + _REQUIREMENTS, f"""
    SELECT repo, path AS manifest, 'direct' AS scope, regexp_split_to_array(line, '[><=!~;\\[ ]')[1] AS package FROM requirement_lines
    WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '-')
      AND trim(regexp_split_to_array(line, '[><=!~;\\[ ]')[1], {WS}) <> ''"""))
def _(spark, sf):
    return dependencies.declared(_manifests(spark, sf), True, dependencies.REQUIREMENTS)


@query("strict_go_mod", with_ctes(_MANIFEST, """
    SELECT * FROM go_required UNION ALL SELECT repo, path, 'direct', 'in/block' FROM manifests WHERE path = 'go.mod'"""))
def _(spark, sf):
    return dependencies.declared(_manifests(spark, sf), True, dependencies.GO)


@query("repository_dependencies", with_ctes(_MANIFEST, "SELECT repo, scope, package FROM distinct_packages"))
def _(spark, sf):
    return dependencies.repository_dependencies(manifest_files(corpus.manifests(spark, sf)))


@query("dependency_lists", with_ctes(_MANIFEST, """
    SELECT repo, scope, string_agg(package, ',' ORDER BY package) AS packages, count(*) AS n_packages
    FROM distinct_packages GROUP BY repo, scope"""))
def _(spark, sf):
    found = dependencies.repository_dependencies(manifest_files(corpus.manifests(spark, sf)))
    return dependencies.dependency_lists(found).withColumn("packages", F.array_join("packages", ","))


@query("dependency_pages", with_ctes(_MANIFEST + """,
    placed AS (SELECT *, row_number() OVER (PARTITION BY repo, scope ORDER BY package) - 1 AS place FROM distinct_packages)""", """
    SELECT repo, scope, place // 50 + 1 AS page, min(place) + 1 AS first, string_agg(package, ',' ORDER BY place) AS packages, count(*) AS n
    FROM placed GROUP BY repo, scope, place // 50"""))
def _(spark, sf):
    found = dependencies.repository_dependencies(manifest_files(corpus.manifests(spark, sf)))
    pages = dependencies.dependency_pages(found, corpus.scratch(spark, "pages"), 50)
    return pages.select("repo", "scope", "page", "first", F.array_join("values", ",").alias("packages"), "n")


def _source_manifests(spark, sf):
    """The manifests under the names of the source repositories."""
    docs = corpus.manifests(spark, sf)
    return docs.withColumn("repo", F.concat(F.lit("src"), F.substring_index("repo", "/r", -1).cast("int") % 20))


_SOURCE_PACKAGES = """
packages AS (SELECT DISTINCT 'src' || (CAST(replace(repo, 'org/r', '') AS INT) % 20) AS repo, scope, package FROM distinct_packages)"""


@query("summary_with_dependencies", with_ctes(CORE + SCORES + _MANIFEST + "," + _SOURCE_PACKAGES, """
    SELECT repo, total_issues, most_common_language, coalesce(n, 0) AS total_dependencies, has_security_issues
    FROM rollup LEFT JOIN (SELECT repo, count(*) AS n FROM packages GROUP BY repo) p USING (repo)"""))
def _(spark, sf):
    rollup = repository_rollup(review(corpus.source_files(spark, sf)))
    found = dependencies.repository_dependencies(manifest_files(_source_manifests(spark, sf)))
    return summary(rollup, found).select(
        "repo", "summary.total_issues", "summary.most_common_language", "summary.total_dependencies", "summary.has_security_issues")


@query("security_digest", with_ctes(CORE + SCORES + _MANIFEST + "," + _SOURCE_PACKAGES + """,
    tops AS (SELECT repo, string_agg('- **' || path || '** (Line ' || line_no || '): ' || description, chr(10) ORDER BY rank) AS lines
      FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, line_no, rule_id) AS rank FROM named_issues
        WHERE severity = 'high' AND category = 'security') WHERE rank <= 10 GROUP BY repo),
    scoped AS (SELECT repo, string_agg(package, ', ' ORDER BY package) FILTER (scope = 'direct') AS direct,
      string_agg(package, ', ' ORDER BY package) FILTER (scope = 'dev') AS dev,
      string_agg(package, ', ' ORDER BY package) FILTER (scope = 'optional') AS optional FROM packages GROUP BY repo)""", """
    SELECT r.repo, concat_ws(chr(10) || chr(10), '# Security Analysis for ' || r.repo,
      '## Security Score: ' || printf('%.1f', round_even(security_score, 1)) || '/100',
      '## Security Issues Found: ' || security_issues,
      '### High Priority Security Issues' || chr(10) || coalesce(t.lines, ''),
      '### Dependencies' || chr(10) || 'direct: ' || coalesce(direct, '') || chr(10) || 'dev: ' || coalesce(dev, '')
        || chr(10) || 'optional: ' || coalesce(optional, '')) AS digest
    FROM rollup r LEFT JOIN tops t USING (repo) LEFT JOIN scoped s USING (repo)"""))
def _(spark, sf):
    results = review(corpus.source_files(spark, sf))
    found = dependencies.repository_dependencies(manifest_files(_source_manifests(spark, sf)))
    return digests.security_digest(results, found)


@query("repository_records", with_ctes(CORE + SCORES + _MANIFEST + "," + _SOURCE_PACKAGES + """,
    scoped AS (SELECT repo, string_agg(package, ',' ORDER BY package) FILTER (scope = 'direct') AS direct,
      string_agg(package, ',' ORDER BY package) FILTER (scope = 'dev') AS dev,
      string_agg(package, ',' ORDER BY package) FILTER (scope = 'optional') AS optional, count(*) AS n FROM packages GROUP BY repo),
    counted AS (SELECT repo, string_agg(language || '=' || n, ',' ORDER BY language) AS counts FROM repo_languages GROUP BY repo)""", """
    SELECT repo AS repository, total_files, analyzed_files, coalesce(counts, '') AS languages, security_score AS security,
      quality_score AS quality, performance_score AS performance, coalesce(direct, '') AS direct, coalesce(dev, '') AS dev,
      coalesce(optional, '') AS optional, total_issues, coalesce(n, 0) AS total_dependencies, most_common_language, requires_attention
    FROM rollup LEFT JOIN scoped USING (repo) LEFT JOIN counted USING (repo)"""))
def _(spark, sf):
    # both are read twice, by the record and by the summary: written, the files are reviewed once and the manifests read once
    folder = corpus.scratch(spark, "records")
    rollup = materialize(repository_rollup(review(corpus.source_files(spark, sf))), folder, "rollup")
    found = materialize(dependencies.repository_dependencies(manifest_files(_source_manifests(spark, sf))), folder, "packages")
    record = nested_repository_results(rollup, found, summary(rollup, found))
    counts = F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat(e.key, F.lit("="), e.value))
    return record.select(
        "repository", "total_files", "analyzed_files", F.array_join(counts, ",").alias("languages"), "overall_scores.*",
        *[F.array_join(f"dependencies.{x}", ",").alias(x) for x in ("direct", "dev", "optional")],
        *[f"summary.{x}" for x in ("total_issues", "total_dependencies", "most_common_language", "requires_attention")])


# --- listings ----------------------------------------------------------------------------------------------
def _records(spark, sf, schema=listings.REPOSITORY):
    return listings.parse_records(corpus.repository_json(spark, sf), "record", schema)


@query("repository_listing", with_ctes(REPOS, """
    SELECT id, name, full_name, description, language, default_branch, size, stargazers_count,
      array_to_string(topics, ',') AS topics, updated_at, updated_at AS created_at, private, fork, false AS archived FROM listed"""))
def _(spark, sf):
    return listings.listing(_records(spark, sf)).select(
        "id", "name", "full_name", "description", "language", "default_branch", "size", "stargazers_count",
        F.array_join("topics", ",").alias("topics"), "updated_at", "created_at", "private", "fork", "archived")


@query("newest_repositories", with_ctes(REPOS, "SELECT id, full_name, updated_at FROM listed ORDER BY updated_at DESC, full_name LIMIT 50"))
def _(spark, sf):
    return listings.newest(listings.listing(_records(spark, sf)), 50).select("id", "full_name", "updated_at")


@query("short_listing", with_ctes(REPOS, """
    SELECT name, full_name, coalesce(nullif(description, ''), 'No description') AS description, coalesce(language, 'Unknown') AS language,
      stargazers_count AS stars, updated_at[1:10] AS updated, private FROM repos"""))
def _(spark, sf):
    return listings.short_listing(_records(spark, sf))


@query("public_listing", with_ctes(REPOS, """
    SELECT name, coalesce(nullif(description, ''), 'No description') AS description, updated_at[1:10] AS updated
    FROM repos WHERE NOT private ORDER BY updated_at DESC, full_name LIMIT 10"""))
def _(spark, sf):
    public = listings.listing(_records(spark, sf), include_forks=True)
    return listings.short_listing(public, 10).select("name", "description", "updated")


@query("numbered_listing", with_ctes(REPOS, """
    SELECT owner, CAST(number AS INT) AS number, full_name, CAST(greatest(total - 10, 0) AS BIGINT) AS more FROM (
      SELECT *, row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC, full_name) AS number,
        count(*) OVER (PARTITION BY owner) AS total FROM (SELECT *, split_part(full_name, '/', 1) AS owner FROM repos))
    WHERE number <= 10"""))
def _(spark, sf):
    return listings.first_of_owner(_records(spark, sf), 10).select(
        "owner", F.col("rank").alias("number"), "full_name", "more")


@query("repository_details", with_ctes(REPOS, """
    SELECT full_name, owner_login AS owner, license, has_issues, has_wiki, CAST(epoch(strptime(updated_at, '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT) AS updated_seconds
    FROM repos"""))
def _(spark, sf):
    return listings.detail(_records(spark, sf, listings.REPOSITORY_DETAIL)).select(
        "full_name", "owner", "license", "has_issues", "has_wiki", F.unix_seconds("updated_ts").alias("updated_seconds"))


@query("language_bytes", with_ctes(REPOS, """
    SELECT full_name, 'Python' AS language, size AS bytes FROM repos WHERE has_languages
    UNION ALL SELECT full_name, p_type, p_partkey FROM repos WHERE has_languages"""))
def _(spark, sf):
    return listings.language_bytes(_records(spark, sf, listings.REPOSITORY_DETAIL))


@query("open_pull_requests", """
    SELECT o_orderkey AS number, 'Change ' || o_orderkey AS title, 'open' AS state, 'user' || o_custkey AS login,
      'feature/' || (o_orderkey % 100) AS head_ref, sha256(CAST(o_orderkey AS VARCHAR)) AS head_sha, 'main' AS base_ref,
      o_orderkey % 2 = 0 AS mergeable, CAST(floor(o_totalprice) AS BIGINT) AS additions
    FROM orders WHERE o_orderstatus = 'O'""")
def _(spark, sf):
    records = listings.parse_records(corpus.pull_request_json(spark, sf), "record", listings.PULL_REQUEST)
    return listings.pull_requests(records).select(
        "number", "title", "state", "user.login", F.col("head.ref").alias("head_ref"), F.col("head.sha").alias("head_sha"),
        F.col("base.ref").alias("base_ref"), "mergeable", "additions")


@query("repository_tree", """
    SELECT 'r' || o_orderkey AS repo, 'src/f' || o_orderkey || '.py' AS path, o_orderkey AS size FROM orders
    UNION ALL SELECT 'r' || o_orderkey, 'README-' || o_orderpriority, o_custkey FROM orders""")
def _(spark, sf):
    records = listings.parse_records(corpus.tree_json(spark, sf), "record", listings.TREE)
    return listings.tree_files(records).select("repo", "path", "size")


@query("file_contents", "SELECT source AS repo, 'doc_' || doc_id AS path, md5(text) AS text_md5, length(text)::INT AS n_chars FROM documents")
def _(spark, sf):
    records = listings.parse_records(corpus.content_json(spark, sf), "record", listings.FILE_CONTENT)
    return listings.decode_content(records).select(
        "repo", "path", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.length("text").alias("n_chars"))


# --- catalogue ----------------------------------------------------------------------------------------------------
@query("supported_repositories", with_ctes(REPOS, f"""
    SELECT full_name, language FROM repos WHERE lower(coalesce(language, '')) IN
      {sql_list(catalog.split_setting(catalog.SUPPORTED_LANGUAGES)).replace('[', '(').replace(']', ')')}"""))
def _(spark, sf):
    return catalog.in_languages(_records(spark, sf)).select("full_name", "language")


@query("supported_with_aliases", with_ctes(REPOS, """
    SELECT full_name, language FROM repos WHERE language IN ('C++', 'rust')"""))
def _(spark, sf):
    return catalog.in_languages(_records(spark, sf), "cpp, Rust", {"c++": "cpp"}).select("full_name", "language")


# Tools and checks by language.
_LISTS = """
    CASE lower(language) WHEN 'python' THEN 'pylint,bandit,safety,mypy' WHEN 'javascript' THEN 'eslint,npm-audit,jshint'
      WHEN 'java' THEN 'spotbugs,pmd,checkstyle' WHEN 'go' THEN 'go-vet,golint,gosec' ELSE '' END AS tools,
    CASE lower(language) WHEN 'python' THEN 'requirements,setup_py' WHEN 'javascript' THEN 'package_json,node_modules'
      WHEN 'java' THEN 'maven,gradle' WHEN 'go' THEN 'go_mod,go_sum' ELSE '' END AS checks"""


def _frameworks(names: dict[str, list[str]]) -> str:
    cases = []
    for name, words in names.items():
        inside = " OR ".join(f"contains(lower(coalesce(description, '')), {q(w)})" for w in [name, *words])
        listed = " OR ".join(f"list_contains(topics, {q(w)})" for w in words)
        cases.append(f"CASE WHEN {inside} OR {listed} THEN {q(name)} END")
    return f"concat_ws(',', {', '.join(cases)})"


# Words that point to a framework.
_FRAMEWORKS = {
    "python": {"django": ["django", "web", "webapp"], "flask": ["flask", "microservice", "api"], "fastapi": ["fastapi", "api", "async"],
               "streamlit": ["streamlit", "dashboard", "visualization"], "langchain": ["langchain", "llm", "ai", "chatbot"],
               "tensorflow": ["tensorflow", "ml", "machine-learning"], "pytorch": ["pytorch", "deep-learning", "neural"]},
    "js": {f: [f] for f in ("react", "vue", "angular", "node", "express", "next")},
    "java": {f: [f] for f in ("spring", "springboot", "hibernate", "maven", "gradle")},
}

for _name, _table in _FRAMEWORKS.items():
    @query(f"{_name}_frameworks", with_ctes(REPOS, f"SELECT full_name, {_frameworks(_table)} AS frameworks FROM repos"))
    def _(spark, sf, name=_name):
        indicators = {"python": catalog.PYTHON_FRAMEWORKS, "js": catalog.JS_FRAMEWORKS, "java": catalog.JAVA_FRAMEWORKS}[name]
        return _records(spark, sf).select(
            "full_name", F.array_join(catalog.frameworks(indicators, F.col("description"), F.col("topics")), ",").alias("frameworks"))


@query("default_settings", with_ctes(REPOS, f"""
    SELECT full_name, language, true AS security_scan, true AS performance_scan, true AS dependency_scan, true AS code_quality_scan,
      true AS auto_suggest_fixes, 'security,performance,maintainability,style' AS focus_areas, {_LISTS},
      CASE lower(language) WHEN 'python' THEN {_frameworks(_FRAMEWORKS['python'])} WHEN 'javascript' THEN {_frameworks(_FRAMEWORKS['js'])}
        WHEN 'java' THEN {_frameworks(_FRAMEWORKS['java'])} ELSE '' END AS frameworks FROM repos"""))
def _(spark, sf):
    return catalog.default_settings(_records(spark, sf)).select(
        "full_name", "language", *catalog.SWITCHES, *[F.array_join(c, ",").alias(c) for c in catalog.LISTS])


_CONFIG = ["owner", "name", "full_name", "language", "default_branch", "enabled"]


def _configs(spark, sf):
    return catalog.configure(_records(spark, sf))


def _overridden(spark, sf):
    return catalog.override_configs(_configs(spark, sf), corpus.config_updates(spark, sf))


_ENABLED = "NOT (p_partkey % 3 = 0 AND p_partkey % 2 = 0 AND NOT (p_partkey % 9 = 0 AND p_partkey % 4 = 0))"


@query("configured_repositories", with_ctes(REPOS, "SELECT owner, name, full_name, language, default_branch, true AS enabled, 'true' AS security_scan, CASE WHEN language = 'python' THEN 'true' END AS check_setup_py FROM configs"))
def _(spark, sf):
    return _configs(spark, sf).select(*_CONFIG, *[F.col("analysis_config")[k].alias(k) for k in ("security_scan", "check_setup_py")])


_OVERRIDDEN = with_ctes(REPOS, f"""
    SELECT full_name, {_ENABLED} AS enabled, CASE WHEN p_partkey % 3 = 0 THEN 'false' ELSE 'true' END AS security_scan,
      CASE WHEN p_partkey % 9 = 0 THEN 'second' WHEN p_partkey % 3 = 0 THEN p_type END AS owner_team, 'true' AS performance_scan,
      CASE WHEN p_partkey % 9 = 0 THEN 'false' WHEN language = 'python' THEN 'true' END AS check_setup_py FROM configs""")


def _some_settings(configs):
    settings = F.col("analysis_config")
    return configs.select("full_name", "enabled", *[settings[k].alias(k) for k in ("security_scan", "owner_team", "performance_scan", "check_setup_py")])


@query("overridden_configs", _OVERRIDDEN)
def _(spark, sf):
    return _some_settings(_overridden(spark, sf))


@query("saved_configs", _OVERRIDDEN)
def _(spark, sf):
    """Saved, loaded, changed, and saved to where they were loaded from."""
    store = repo_config.ConfigStore(spark, corpus.scratch(spark, "configs"))
    version = store.save(_configs(spark, sf))
    store.save(catalog.override_configs(store.load(), corpus.config_updates(spark, sf)), based_on=version)
    return _some_settings(store.load())


@query("replaced_configs", with_ctes(REPOS, f"""
    SELECT full_name, CASE WHEN p_partkey % 5 IN (0, 1) THEN {_ENABLED} ELSE true END AS enabled, language FROM configs"""))
def _(spark, sf):
    return catalog.replace_configs(
        _overridden(spark, sf), catalog.configure(listings.listing(_records(spark, sf)))).select("full_name", "enabled", "language")


@query("refreshed_configs", with_ctes(REPOS, """
    SELECT c.full_name, coalesce('new ' || r.language, c.language) AS language, coalesce(r.default_branch || '2', c.default_branch) AS default_branch
    FROM configs c LEFT JOIN listed r USING (full_name)"""))
def _(spark, sf):
    newer = listings.listing(_records(spark, sf)).withColumn("language", F.concat(F.lit("new "), "language")).withColumn(
        "default_branch", F.concat("default_branch", F.lit("2")))
    return catalog.refresh(_configs(spark, sf), newer).select("full_name", "language", "default_branch")


@query("enabled_configs", with_ctes(REPOS, f"SELECT full_name FROM configs WHERE {_ENABLED}"))
def _(spark, sf):
    return catalog.enabled(_overridden(spark, sf)).select("full_name")


@query("enabled_in_language", with_ctes(REPOS, f"SELECT full_name FROM configs WHERE {_ENABLED} AND language = 'JavaScript'"))
def _(spark, sf):
    return catalog.enabled_in_language(_overridden(spark, sf), "JAVASCRIPT").select("full_name")


@query("found_repositories", with_ctes(REPOS, "SELECT full_name FROM repos WHERE name IN (SELECT replace(p_name, ' ', '-') || '-' || p_partkey FROM part WHERE p_size > 25)"))
def _(spark, sf):
    wanted = corpus.table(spark, sf, "part").filter("p_size > 25").select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_partkey").alias("name"))
    return catalog.find(_records(spark, sf), wanted).select("full_name")


@query("catalogue_summary", with_ctes(REPOS, f"""
    SELECT (SELECT count(*) FROM configs) AS total_repositories, (SELECT count(*) FROM configs WHERE {_ENABLED}) AS enabled_repositories,
      (SELECT count(*) FROM configs WHERE NOT ({_ENABLED})) AS disabled_repositories,
      (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM (SELECT language, count(*) AS n FROM configs GROUP BY 1)) AS languages"""))
def _(spark, sf):
    return catalog.catalogue_summary(_overridden(spark, sf)).withColumn("languages", F.array_join(F.transform(
        F.array_sort(F.map_entries("languages")), lambda e: F.concat(e.key, F.lit("="), e.value)), ","))


@query("config_defaults", with_ctes(REPOS, """
    SELECT full_name, p_partkey % 2 = 0 OR p_partkey % 3 <> 0 AS enabled, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS settings,
      CASE WHEN p_partkey % 5 <> 0 THEN updated_at[1:10] END AS analyzed_day FROM repos"""))
def _(spark, sf):
    key = F.col("id")
    stored = _records(spark, sf).select(
        F.substring_index("full_name", "/", 1).alias("owner"), "name", "full_name", "language", "default_branch",
        F.when(key % 3 == 0, key % 2 == 0).alias("enabled"),
        F.when(key % 4 != 0, F.create_map(F.lit("a"), F.lit("b"))).alias("analysis_config"),
        F.when(key % 5 != 0, F.col("updated_at")).otherwise("").alias("last_analyzed"))
    return repo_config.with_defaults(stored).select(
        "full_name", "enabled", F.size("analysis_config").alias("settings"),
        F.date_format("last_analyzed", "yyyy-MM-dd").alias("analyzed_day"))


# --- linter reports ---------------------------------------------------------------------------------------------------
_FINDINGS = ["repo", "path", "phase", "category", "type", "severity", "description", "line_no", "code", "tool", "confidence", "rule"]
_LINT = f"""
lint_docs AS (
  SELECT source AS repo, path, doc_id, doc_id % 5 <> 0 AS given, string_split(documents.text, chr(10)) AS all_lines,
    ['very_high', 'high', 'medium', 'low', 'info', 'odd'][CAST(doc_id % 6 + 1 AS INT)] AS level,
    ['high', 'high', 'medium', 'low', 'low', 'medium'][CAST(doc_id % 6 + 1 AS INT)] AS mapped
  FROM documents JOIN (SELECT doc_id, path FROM made) USING (doc_id)),
filled_lines AS (
  SELECT * EXCLUDE (all_lines), unnest(filled) AS line, unnest(range(0, len(filled))) AS n FROM (
    SELECT *, list_filter(all_lines, lambda x: x <> '') AS filled FROM lint_docs)),
every_line AS (SELECT * EXCLUDE (all_lines), unnest(all_lines) AS line, unnest(range(0, len(all_lines))) AS n FROM lint_docs),
bandit AS (
  SELECT repo, path, 'security' AS phase, 'security' AS category, CASE WHEN given THEN 'B' || n ELSE 'unknown' END AS type,
    CASE WHEN given THEN level ELSE 'medium' END AS severity, line AS description, CASE WHEN given THEN CAST(n + 1 AS INT) ELSE 0 END AS line_no,
    'x = 1' AS code, 'bandit' AS tool, 'high' AS confidence, NULL AS rule FROM filled_lines),
ansible_lint AS (
  SELECT repo, path, 'security' AS phase, 'quality' AS category, 'ansible_lint_' || CASE WHEN given THEN 'E' || n ELSE 'unknown' END AS type,
    CASE WHEN given THEN mapped ELSE 'medium' END AS severity, line AS description, CASE WHEN given THEN CAST(n + 1 AS INT) ELSE 0 END AS line_no,
    '' AS code, 'ansible-lint' AS tool, NULL AS confidence, CASE WHEN given THEN 'E' || n ELSE '' END AS rule
  FROM filled_lines WHERE doc_id % 4 <> 1
  UNION ALL SELECT repo, path, 'security', 'quality', 'ansible_lint_issue', 'medium', trim(text, {WS}), 0, '', 'ansible-lint', NULL, NULL
  FROM (SELECT repo, path, CASE WHEN length(line) % 2 = 0 THEN '  Error: ' ELSE 'note ' END || line AS text FROM every_line
    WHERE doc_id % 4 = 1)
  WHERE contains(text, ':') AND (contains(lower(text), 'error') OR contains(lower(text), 'warning'))),
yamllint AS (
  SELECT repo, path, 'quality' AS phase, 'quality' AS category, 'yaml_lint_' || CASE WHEN given THEN 'style' ELSE 'unknown' END AS type,
    CASE WHEN n % 2 = 0 THEN 'high' ELSE 'medium' END AS severity, line AS description, CAST(n + 1 AS INT) AS line_no, '' AS code,
    'yamllint' AS tool, NULL AS confidence, CASE WHEN given THEN 'rule-x' ELSE '' END AS rule
  FROM every_line WHERE length(line) % 3 <> 0)
"""


for _tool, _function, _cte in [
    ("bandit", linters.bandit_issues, "bandit"), ("ansible-lint", linters.ansible_lint_issues, "ansible_lint"),
    ("yamllint", linters.yamllint_issues, "yamllint"),
]:
    @query(f"{_cte}_issues", with_ctes(FILES + _LINT, f"SELECT {', '.join(_FINDINGS)} FROM {_cte}"))
    def _(spark, sf, tool=_tool, function=_function):
        return function(corpus.linter_reports(spark, sf, tool)).select(*_FINDINGS)


@query("linter_levels", f"""
    SELECT event_id, CASE level WHEN 'VERY_HIGH' THEN 'high' WHEN 'info' THEN 'low' ELSE 'medium' END AS ansible_lint,
      CASE level WHEN 'Error' THEN 'high' WHEN 'info' THEN 'low' ELSE 'medium' END AS yamllint
    FROM (SELECT event_id, ['VERY_HIGH', 'info', 'Error', 'warning', 'odd'][CAST(event_id % 5 + 1 AS INT)] AS level FROM events)""")
def _(spark, sf):
    level = F.element_at(F.array(*[F.lit(x) for x in ("VERY_HIGH", "info", "Error", "warning", "odd")]), (F.col("event_id") % 5 + 1).cast("int"))
    return corpus.table(spark, sf, "events").select(
        "event_id", levels.ansible_lint_severity(level).alias("ansible_lint"), levels.yamllint_severity(level).alias("yamllint"))


@query("scores_with_findings", with_ctes(CORE + SCORES + _LINT + """,
    extra_points AS (SELECT repo, path, sum(CASE severity WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 5 END) AS p FROM bandit GROUP BY ALL),
    own AS (SELECT repo, path, sum(CASE WHEN category = 'security' AND phase = 'security' THEN CASE severity WHEN 'high' THEN 20
      WHEN 'medium' THEN 10 ELSE 5 END ELSE 0 END) AS p FROM named_issues GROUP BY ALL)""", """
    SELECT s.repo, s.path, CAST(greatest(0, 100 - coalesce(o.p, 0) - coalesce(f.p, 0)) AS DOUBLE) AS security_score
    FROM scores s LEFT JOIN own o ON o.repo = s.repo AND o.path = s.path
    LEFT JOIN extra_points f ON f.repo = s.repo AND f.path = s.path"""))
def _(spark, sf):
    findings = linters.bandit_issues(corpus.linter_reports(spark, sf, "bandit"))
    return review(corpus.source_files(spark, sf), findings=findings).filter("analyzed").select("repo", "path", "security_score")


# --- run logs --------------------------------------------------------------------------------------------------------------
_LOG = """
log AS (
  SELECT * REPLACE (CASE WHEN event_id % 211 <> 0 THEN ts END AS ts), 'scan.' || (user_id % 50) AS logger, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level FROM events),
marks AS (SELECT event_id, logger, ts, event_type IN ('click', 'signup') AS is_start,
    CASE WHEN event_type IN ('click', 'signup') THEN ts END AS start_ts,
    CASE WHEN event_type IN ('click', 'signup') THEN 'repo' || (event_id % 30) END AS start_repo,
    CASE event_type WHEN 'click' THEN '' WHEN 'signup' THEN 'full' END AS start_type,
    CASE WHEN event_type = 'purchase' THEN 'repo' || (event_id % 20) END AS named,
    CASE WHEN event_type = 'purchase' THEN event_id % 9 END AS issues, event_type,
    CASE WHEN event_type IN ('purchase', 'error') THEN round(value, 2) END AS seconds FROM log WHERE event_type <> 'view'),
runs AS (SELECT * FROM (SELECT logger, coalesce(named, last_value(start_repo IGNORE NULLS) OVER w) AS repo,
    CASE WHEN event_type = 'purchase' THEN 'security' ELSE nullif(last_value(start_type IGNORE NULLS) OVER w, '') END AS analysis_type,
    last_value(start_ts IGNORE NULLS) OVER w AS started, ts AS completed, seconds, issues
    FROM marks WINDOW w AS (PARTITION BY logger ORDER BY ts NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WHERE seconds IS NOT NULL)
"""


def _events(spark, sf):
    return run_log.parse_log(corpus.log_json(spark, sf), "record")


@query("log_events", with_ctes(_LOG, "SELECT logger, level, count(*) AS events FROM log GROUP BY ALL"))
def _(spark, sf):
    return run_log.event_counts(_events(spark, sf))


@query("completed_runs", with_ctes(_LOG, """
    SELECT logger, repo, strftime(started, '%Y-%m-%dT%H:%M:%S.%f') AS started, strftime(completed, '%Y-%m-%dT%H:%M:%S.%f') AS completed,
      seconds, analysis_type, issues FROM runs"""))
def _(spark, sf):
    return run_log.runs(_events(spark, sf)).select(
        "logger", "repo", *[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) for c in ("started", "completed")],
        "seconds", "analysis_type", "issues")


@query("run_durations", with_ctes(_LOG, """
    SELECT repo, count(*) AS runs, min(seconds) AS fastest, max(seconds) AS slowest, CAST(sum(CAST(round(seconds * 100) AS BIGINT)) AS BIGINT) AS total_cents
    FROM runs GROUP BY repo"""))
def _(spark, sf):
    out = run_log.run_durations(run_log.runs(_events(spark, sf)))
    return out.select("repo", "runs", "fastest", "slowest", F.round(F.col("mean_seconds") * F.col("runs") * 100).cast("long").alias("total_cents"))
