"""Sources, catalogue, dependencies, imports, logs."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from codesieve.functions import levels, paths
from codesieve.operators import catalog, dependencies, imports
from codesieve.operators.syntax import python_facts
from codesieve.plans.materialize import materialize
from codesieve.plans.review import manifest_files, prepared_files
from codesieve.sources import linters, listings, repo_config, run_log


def column(spark, values, function, type="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {type}")
    return [r.out for r in df.select("n", function(F.col("v")).alias("out")).orderBy("n").collect()]


def test_extensions(spark):
    names = ["a.py", "d.x/A.PY", ".env", "a.", "a.tar.gz", "d/.hidden.js", "noext", "x.c++", "y.h", "z.r", "Z.R"]
    assert column(spark, names, paths.extension) == [".py", ".py", "", "", ".gz", ".js", "", ".c++", ".h", ".r", ".r"]
    assert column(spark, names, paths.language) == [
        "python", "python", None, None, None, "javascript", None, "cpp", "cpp", "r", "r"]
    assert column(spark, ["a.pyw", "a.py"], paths.short_language) == ["unknown", "python"]
    assert column(spark, ["a.PY", "a.cs", "a.ts"], lambda c: paths.display_language(c, "quick")) == ["Unknown", "C#", "Unknown"]


def test_exclusion(spark):
    names = ["a.py", "a/b.log/c.py", "a.log", ".git/x", "x/.git", "x/node_modules", "dist/a", "a/dist", "my_dist/a", "a.pyc.txt", "a?b/c"]
    assert column(spark, names, paths.is_excluded) == [False, True, True, True, False, False, True, True, False, False, False]
    assert column(spark, ["ab/c", "ac/c", "x/[a]", "a.txt", "q/a.txt"], lambda c: paths.is_excluded(c, ["a[!b]", "?.txt"], [])) == [
        False, True, False, False, False]
    assert column(spark, ["a/.b/c", ".a", "a/b.c", "a"], paths.is_hidden) == [True, True, False, False]


def test_safe_names(spark):
    import os

    def want(name):
        for ch in '<>:"/\\|?*':
            name = name.replace(ch, "_")
        name = name.strip(" .") or "untitled"
        if len(name) > 255:
            stem, ext = os.path.splitext(name)
            name = stem[:255 - len(ext)] + ext
        return name

    names = ["a<b>.txt", " . ", "", "x" * 300, "x" * 300 + ".py", "a." + "y" * 300, "..hidden.", "a" * 254 + ".b.c", "é" * 256]
    assert column(spark, names, paths.sanitize_filename) == [want(n) for n in names]


def test_sizes(spark):
    def want(size):
        if size == 0:
            return "0 B"
        units, n = ["B", "KB", "MB", "GB", "TB"], 0
        while size >= 1024 and n < 4:
            size, n = size / 1024.0, n + 1
        return f"{size:.1f} {units[n]}"

    sizes = [0, 1, 1023, 1024, 1280, 1536, 1792, 2**20, 5 * 2**30 + 2**28, 2**50, 2**51 + 7, 123456789]
    assert column(spark, sizes, levels.readable_size, "bigint") == [want(s) for s in sizes]
    assert column(spark, ["very_low", "INFO", "x", None], levels.ansible_lint_severity) == ["low", "low", "medium", "medium"]


def test_imports(corpus_of):
    files = {
        "a.py": "import os, sys as s\nfrom . import x\nfrom .a.b import (c as d,\n e)\n",
        "bad.py": "import os\ndef (",
        "a.ts": "import React, { x } from 'react'\nimport { a, b } from \"m\"; import 'xy'\nconst fs = require('fs'); let y = require('n')\n",
        "A.java": "import a.b.C;\nimport static a.b.D.*; import e;\n// important;\n",
        "a.go": 'import "fmt"\nimport (\n\t"os"\n\tx "y"\n\n "net/http"\n)\n',
        "a.rb": "import 'x'",
    }
    rows = imports.extract_imports(prepared_files(corpus_of(files))).collect()
    assert {(r.path, r.type, r.module, r.name, r.alias, r.line_no) for r in rows} == {
        ("a.py", "import", "os", None, None, 1), ("a.py", "import", "sys", None, "s", 1), ("a.py", "from_import", "", "x", None, 2),
        ("a.py", "from_import", "a.b", "c", "d", 3), ("a.py", "from_import", "a.b", "e", None, 3),
        ("a.ts", "import", "m", "{ a, b }", None, 2), ("a.ts", "import", "xy", None, None, 2), ("a.ts", "import", "fs", "fs", None, 3),
        ("A.java", "import", "a.b.C", None, None, 1), ("A.java", "static_import", "a.b.D.*", None, None, 2), ("A.java", "import", "e", None, None, 2),
        ("a.go", "import", "fmt", None, None, 1), ("a.go", "import", "os", None, None, 0), ("a.go", "import", "net/http", None, None, 0),
    }


def test_python_facts():
    facts = python_facts("class A:\n  async def f(self):\n    return [i for i in x if a and b or c]\n")
    assert facts["functions"] == [{"name": "f", "line_no": 2, "n_args": 1, "decision_points": 4}]
    assert python_facts("a\x00b")["functions"] == []
    deep = python_facts("x = " + "-" * 50000 + "1")
    assert deep["functions"] == [] and deep["syntax_error"] is not None


def test_dependencies(corpus_of):
    files = {
        "requirements.txt": "Flask>=1\n# no\n-r x\n\n numpy\npkg~=1\nextra[a]==1; python_version>'3'\n==1\n",
        "package.json": json.dumps({"dependencies": {"a.b": "1", "@s/p": "2"}, "devDependencies": {}, "optionalDependencies": {"o": "1"}}),
        "sub/package.json": "{broken",
        "Pipfile": "x = 1\n[packages]\n\"a\" = \"*\"\n#b = 1\n\n  [dev-packages]\nc='1'\n[other]\nd = 1\n[packages]\ne = {version = \"1\"}",
        "pyproject.toml": "[tool.poetry.dependencies]\npython='3'\nx='1'\n[tool.poetry.group.dev.dependencies]\ny='1'\n",
        "poetry.lock": "[[package]]\nname='z'",
        "Cargo.toml": "[dependencies]\nserde='1'\nmany = [\n  'a',\n  {b = 1}\n]\n\"quoted\" = 1\nx.y = 2\nx.z = 3\n"
                      "[ dependencies.sub ] # note\nversion = 1\n[dev-dependencies]\nt={version='1'}\n[other]\nno = 1\n",
        "bad/Cargo.toml": "[dependencies\n",
        "list/pyproject.toml": "tool = [1]\n",
        "go.mod": "require a.b/c v1\nrequire (\n\tin/block v1\n\t// note\n)\n",
        "pom.xml": "<a/>",
    }
    corpus = corpus_of(files)
    text = corpus.withColumn("content", F.col("raw").cast("string"))
    got = {(r.manifest, r.scope, r.package) for r in dependencies.declared(text).collect()}
    assert got == {
        ("requirements.txt", "direct", p) for p in ("Flask", "numpy", "pkg~", "extra[a]")} | {
        ("package.json", "direct", "a.b"), ("package.json", "direct", "@s/p"), ("package.json", "optional", "o"),
        ("Pipfile", "direct", "a"), ("Pipfile", "dev", "c"), ("Pipfile", "direct", "e"),
        ("pyproject.toml", "direct", "x"), ("pyproject.toml", "dev", "y"),
        *[("Cargo.toml", "direct", p) for p in ("serde", "many", "quoted", "x", "sub")], ("Cargo.toml", "dev", "t"), ("go.mod", "direct", "a.b/c")}
    strict = {(r.manifest, r.package) for r in dependencies.declared(text, strict=True).collect()}
    assert {("requirements.txt", "pkg"), ("requirements.txt", "extra"), ("go.mod", "in/block")} <= strict
    assert ("go.mod", "//") not in strict
    merged = dependencies.repository_dependencies(manifest_files(corpus.unionByName(corpus))).collect()
    assert len(merged) == len({tuple(r) for r in merged}) == 18
    plan = dependencies.declared(text)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan


def test_listings(spark, tmp_path):
    records = [
        {"id": 1, "name": "a", "full_name": "o/a", "language": "Python", "private": False, "fork": False, "updated_at": "2024-05-01T00:00:00Z",
         "description": "Maintained", "topics": ["web"], "stargazers_count": 3, "default_branch": "dev"},
        {"id": 2, "name": "b", "full_name": "o/b", "language": None, "private": True, "fork": False, "updated_at": "2024-06-01T00:00:00Z"},
        {"id": 3, "name": "c", "full_name": "p/c", "language": "C++", "private": False, "fork": True, "updated_at": "2024-07-01T00:00:00Z"},
    ]
    file = tmp_path / "repos.json"
    file.write_text("\n".join(map(json.dumps, records)) + "\nnot json\n")
    read = listings.read_records(spark, str(file), listings.REPOSITORY)
    assert [r.id for r in listings.listing(read).collect()] == [1]
    assert {r.id for r in listings.listing(read, include_forks=True, include_private=True).collect()} == {1, 2, 3}
    assert [r.id for r in listings.newest(read, 2).collect()] == [3, 2]
    assert listings.short_listing(read).filter("name = 'b'").first().asDict() == {
        "name": "b", "full_name": "o/b", "description": "No description", "language": "Unknown", "stars": None, "updated": "2024-06-01", "private": True}
    assert {r.id for r in catalog.in_languages(read, "").collect()} == {2}
    assert {r.id for r in catalog.in_languages(read, "ALL").collect()} == {1, 2, 3}
    names = catalog.default_settings(read).filter("full_name = 'o/a'").first().frameworks
    # "ai" is part of "maintained", "web" is a topic
    assert names == ["django", "langchain"]
    b64 = spark.createDataFrame([("r", "p", "base64", "aGVs\nbG8="), ("r", "q", "utf-8", "plain")], listings.FILE_CONTENT)
    assert [r.text for r in listings.decode_content(b64).orderBy("path").collect()] == ["hello", "plain"]


def test_configs(spark, tmp_path):
    path = str(tmp_path / "cfg")
    stored = spark.createDataFrame([
        ("o", "a", "o/a", "Python", "main", None, None, "2024-01-02T03:04:05"), ("o", "b", "o/b", None, "main", False, {"x": "1"}, None)],
        repo_config.REPO_CONFIG)
    repo_config.save(repo_config.with_defaults(stored), path)
    loaded = repo_config.load(spark, path).cache()
    rows = {r.full_name: r for r in loaded.collect()}
    assert rows["o/a"].enabled and rows["o/a"].last_analyzed == datetime(2024, 1, 2, 3, 4, 5) and rows["o/a"].analysis_config == {}
    assert not rows["o/b"].enabled and rows["o/b"].analysis_config == {"x": "1"}
    updates = spark.createDataFrame([("o/b", {"x": "2", "y": "3"}, True), ("no/one", {"x": "9"}, True)],
                                    "full_name string, settings map<string,string>, enabled boolean")
    changed = {r.full_name: r for r in catalog.override_configs(loaded, updates).collect()}
    assert set(changed) == {"o/a", "o/b"} and changed["o/b"].analysis_config == {"x": "2", "y": "3"} and changed["o/b"].enabled
    assert [r.full_name for r in catalog.enabled_in_language(loaded, "pYTHON").collect()] == ["o/a"]
    summary = catalog.catalogue_summary(loaded).first()
    assert (summary.total_repositories, summary.enabled_repositories, summary.languages) == (2, 1, {"Python": 1, "unknown": 1})


def test_linter_reports(spark):
    def one(report):
        return spark.createDataFrame([("r", "p", report)], "repo string, path string, report string")

    bandit = linters.bandit_issues(one('{"results": [{"issue_severity": "LOW", "line_number": 3}, {"test_id": "B1", "issue_text": "t"}]}')).collect()
    assert [(r.type, r.severity, r.description, r.line_no, r.confidence) for r in bandit] == [
        ("unknown", "low", "", 3, "medium"), ("B1", "medium", "t", 0, "medium")]
    assert linters.bandit_issues(one("oops")).count() == 0
    lint = linters.ansible_lint_issues(one('[{"tag": "E1", "level": "VERY_HIGH", "message": "m", "linenumber": 2}, {}]')).collect()
    assert [(r.type, r.severity, r.rule, r.description) for r in lint] == [
        ("ansible_lint_E1", "high", "E1", "m"), ("ansible_lint_unknown", "medium", "", "Ansible lint issue")]
    text = linters.ansible_lint_issues(one(" a.yml:1: Warning x \nfine\nerror without colon\nb: error")).collect()
    assert [r.description for r in text] == ["a.yml:1: Warning x", "b: error"]
    yaml = linters.yamllint_issues(one('{"level": "error", "line": 4, "desc": "d"}\nnot json\n\n{"type": "t", "rule": "q"}')).collect()
    assert [(r.type, r.severity, r.line_no, r.rule) for r in yaml] == [("yaml_lint_unknown", "high", 4, ""), ("yaml_lint_t", "medium", 0, "q")]


def test_runs_across_slices(spark, tmp_path):
    def event(time, message, logger="a"):
        return json.dumps({"timestamp": time, "level": "INFO", "logger": logger, "message": message})

    file = tmp_path / "run.log"
    file.write_text("\n".join([
        event("2024-01-01T00:10:00.5", "Starting repository analysis: o/x"),
        event("2024-01-01T00:20:00", "Repository analysis completed in 1.50s"),
        event("2024-01-01T00:30:00", "Starting repository analysis: o/y"),
        event("2024-01-01T05:00:00", "Repository analysis completed in 7.25s"),
        event("2024-01-01T05:01:00", "Repository analysis completed in 2.00s", "b"),
        event("2024-01-01T06:00:00", "Starting full analysis for repository: o/z", "c"),
        event("2024-01-01T06:01:00", "Completed quality analysis for o/q in 3.00s - Found 12 issues", "c"),
        event("2024-01-01T06:02:00", "Repository analysis completed in 4.00s", "c"),
        "broken",
    ]))
    runs = run_log.runs(run_log.read_log(spark, str(file))).orderBy("completed").collect()
    assert [(r.repo, r.seconds) for r in runs] == [
        ("o/x", 1.5), ("o/y", 7.25), (None, 2.0), ("o/q", 3.0), ("o/z", 4.0)]
    assert [(r.analysis_type, r.issues) for r in runs][2:] == [(None, None), ("quality", 12), ("full", None)]
    assert runs[1].started == datetime(2024, 1, 1, 0, 30)


def test_runs_without_times(spark):
    def event(line, time, message, logger="a"):
        return (json.dumps({"timestamp": time, "level": "INFO", "logger": logger, "message": message, "line": line}),)

    rows = [
        event(1, None, "Repository analysis completed in 1.00s"), event(3, None, "Starting repository analysis: o/early"),
        event(4, "yesterday", "Repository analysis completed in 2.00s"), event(5, "2024-01-01T00:00:00", "Repository analysis completed in 3.00s"),
        event(6, "2024-01-01T01:00:00", "Starting repository analysis: o/one"), event(7, "2024-01-01T01:00:00", "Starting repository analysis: o/two"),
        event(8, "2024-01-01T01:00:00", "Repository analysis completed in 4.00s"),
        event(9, None, "Completed quality analysis for o/q in 5.00s - Found 1 issues", "b"),
    ]
    events = run_log.parse_log(spark.createDataFrame(rows, "record string"), "record")
    runs = {r.seconds: r for r in run_log.runs(events).collect()}
    assert {s: r.repo for s, r in runs.items()} == {1.0: None, 2.0: "o/early", 3.0: "o/early", 4.0: "o/two", 5.0: "o/q"}
    assert runs[2.0].completed is None and runs[5.0].logger == "b"
    plan = run_log.runs(events)
    plan.collect()
    assert plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") >= 1


def test_several_updates(spark):
    base = [("o", n, f"o/{n}", "go", "main", True, {"x": "0", "k": "0"}, None) for n in "abc"]
    configs = repo_config.with_defaults(spark.createDataFrame(base, repo_config.REPO_CONFIG))
    updates = spark.createDataFrame(
        [("o/a", {"x": "2"}, False, 2), ("o/a", {"x": "1", "y": "1"}, True, 1), ("o/a", None, None, 3), ("o/b", {"x": "9"}, None, 1), ("z", {}, True, 1)],
        "full_name string, settings map<string,string>, enabled boolean, seq int")
    got = {r.full_name: (r.enabled, r.analysis_config) for r in catalog.override_configs(configs, updates).collect()}
    assert got == {"o/a": (False, {"k": "0", "x": "2", "y": "1"}), "o/b": (True, {"k": "0", "x": "9"}), "o/c": (True, {"x": "0", "k": "0"})}
    records = spark.createDataFrame(
        [("o/a", "rust", None, "2024-01-01"), ("o/a", None, "dev", "2024-03-01"), ("o/a", "c", None, "2023-01-01")],
        "full_name string, language string, default_branch string, updated_at string")
    fresh = {r.full_name: (r.language, r.default_branch) for r in catalog.refresh(configs, records).collect()}
    assert fresh == {"o/a": ("rust", "dev"), "o/b": ("go", "main"), "o/c": ("go", "main")}
    new = configs.filter("name = 'a'").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("language", F.concat(F.lit("v"), "seq"))
    replaced = catalog.replace_configs(configs, new).collect()
    assert sorted((r.full_name, r.language) for r in replaced) == [("o/a", "v2"), ("o/b", "go"), ("o/c", "go")]


def test_large_reports(spark):
    entry = '{"tag": "E1", "message": "' + "m" * 100 + '"}'
    report = spark.range(1).select(
        F.lit("r").alias("repo"), F.lit("p").alias("path"),
        F.concat(F.lit("["), F.repeat(F.lit(entry + ","), 1_200_000), F.lit(entry + "]")).alias("report"))
    assert linters.ansible_lint_issues(report).count() == 1_200_001
    lines = linters.yamllint_issues(spark.createDataFrame([("r", "p", '1\n"x"\n[1]\n{"line": 2}\n{"line": 3')], "repo string, path string, report string"))
    assert [r.line_no for r in lines.collect()] == [2]


def test_updates_in_other_zones(spark):
    records = spark.createDataFrame([("o/a", "2024-01-01T00:30:00Z"), ("o/b", "2024-01-01T01:00:00+02:00"), ("o/c", None)], "full_name string, updated_at string")
    assert [r.full_name for r in listings.newest(records, 3).collect()] == ["o/a", "o/b", "o/c"]


def test_materialize(spark, tmp_path):
    assert materialize(spark.range(3), str(tmp_path)).count() == 3


def test_first_of_owner(spark):
    records = spark.createDataFrame([(f"o/{n}", f"2024-01-{n:02d}") for n in range(1, 15)] + [("p/1", "2024-01-01")], "full_name string, updated_at string")
    rows = listings.first_of_owner(records, 10).collect()
    assert {(r.owner, r.more) for r in rows} == {("o", 4), ("p", 0)} and len(rows) == 11
