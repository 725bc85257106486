"""The whole review on a small repository, worked out by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codesieve.functions.paths import MAX_FILE_SIZE
from codesieve.operators import rollups, scan, scores, topn
from codesieve.operators.suggestions import suggestion_rows
from codesieve.plans import digests, reports
from codesieve.plans.materialize import materialize
from codesieve.plans.review import prepared_files, profile_review, review
from codesieve.sources.files import read_checkouts
from codesieve.sources.results import nested_repository_results, write_file_results
from codesieve.streaming.incremental import file_stream, review_stream

PYTHON = '''class Shelf:
    def __init__(self, width, height, depth, colour, label, owner, room):
        self.size = width * height * depth

    def fits(self, box):
        return box.size <= self.size and not box.fragile

def load(stream):
    return pickle.loads(stream.read())

def total(shelves):
    rest = [s for s in shelves if s.size]
    out = 0
    while rest:
        out += rest.pop().size
    return out

secret = 'open sesame'
'''
JAVASCRIPT = '''const shelves = new Map();

const add = (name, box) => {
    shelves.set(name, box);
    console.warn(`added ${name}`);
};

async function render(root) {
    for (const [name, box] of shelves) {
        root.innerHTML = name + box;
        if (document.querySelector(`#${name}`) == null) continue;
    }
}

var label = shelves.size ? "some" : "none";
'''
FILES = {"app.py": PYTHON, "app.js": JAVASCRIPT, "README.md": "# Demo\n"}


@pytest.fixture(scope="module")
def results(corpus_of):
    return review(corpus_of(FILES)).cache()


def by_path(results):
    return {r.path: r for r in results.collect()}


def test_scores_and_metrics(results):
    rows = by_path(results)
    py, js, md = rows["app.py"], rows["app.js"], rows["README.md"]
    # __init__ 1, fits 2, load 1, total 3
    assert (py.functions, py.classes, py.cyclomatic_complexity) == (4, 1, 7)
    assert (py.security_score, py.quality_score, py.performance_score) == (60.0, 92.0, 100.0)
    # function, async function, const of a function, arrow; for, if, one ternary
    assert (js.functions, js.cyclomatic_complexity) == (4, 3)
    assert (js.security_score, js.quality_score, js.performance_score) == (90.0, 81.0, 100.0)
    assert not md.analyzed and md.issues == []
    assert (md.security_score, md.quality_score, md.performance_score, md.lines_of_code) == (None, None, None, None)
    assert py.lines_of_code == PYTHON.count("\n") + 1 and py.file_size == len(PYTHON)


def test_issues(results):
    found = sorted((i.path, i.rule_id) for i in scan.issues(results).collect())
    assert found == sorted(
        [("app.py", r) for r in ("R03", "R09", "R16")] + [("app.js", r) for r in ("R11", "R19", "R20", "R21")])


def test_rollup(results):
    r = rollups.repository_rollup(results).first()
    assert (r.security_score, r.quality_score, r.performance_score) == (75.0, 86.5, 100.0)
    assert (r.total_files, r.analyzed_files, r.total_issues) == (3, 2, 7)
    assert (r.high_issues, r.medium_issues, r.low_issues) == (2, 4, 1)
    assert r.requires_attention and r.recommendation == "requires attention"
    assert r.languages == {"javascript": 1, "python": 1} and r.most_common_language == "javascript"


def test_suggestions(results):
    found = sorted((s.path, s.priority) for s in suggestion_rows(results).collect())
    assert found == [("app.js", "medium")]


def test_repository_without_code(corpus_of):
    r = rollups.repository_rollup(review(corpus_of({"a.txt": "x"}))).first()
    assert (r.analyzed_files, r.security_score, r.most_common_language) == (0, 0.0, "unknown")
    assert r.recommendation == "excellent" and not r.requires_attention
    assert scores.repository_scores(review(corpus_of({"a.txt": "x"}))).first().quality == 0.0


def test_which_files_are_read(corpus_of):
    limit = MAX_FILE_SIZE
    files = corpus_of({
        "empty.py": "", "newline.py": "\n", "crlf.py": "a = 1\r\nb = 2\rc = 3", "nul.py": b"a\x00b", "late_nul.py": b"#" * 1024 + b"\x00",
        "edge.py": b"#" * limit, "over.py": b"#" * (limit + 1), "node_modules/x.py": "a", "a.pyc": "a", "deep/build/x.py": "a",
        "env": "a", "x.log": "a", "pic.png": "a", "UPPER.PY": "a = 1", ".env": "a", "none.py": None,
        "bad.py": b"# caf\xe9 \xff ok\n", "mark.py": "# � kept\n".encode(),
    })
    rows = {r.path: r for r in prepared_files(files, max_size=MAX_FILE_SIZE).withColumn("n", F.size(F.split("content", "\n", -1))).collect()}
    assert set(files.rdd.map(lambda r: r.path).collect()) - set(rows) == {
        "node_modules/x.py", "a.pyc", "deep/build/x.py", "env", "x.log"}
    every = {r.path for r in prepared_files(files).filter("analyzed").collect()}
    analyzed = {p for p, r in rows.items() if r.analyzed}
    assert every - analyzed == {"over.py"}
    assert analyzed == {"empty.py", "newline.py", "crlf.py", "late_nul.py", "edge.py", "UPPER.PY", "bad.py", "mark.py"}
    assert (rows["empty.py"].n, rows["newline.py"].n, rows["crlf.py"].n) == (1, 2, 3)
    assert rows["bad.py"].content == b"# caf\xe9 \xff ok\n".decode(errors="ignore")
    assert rows["mark.py"].content == "# � kept\n"


def test_analysis_type_and_partitions(corpus_of, results):
    gated = scan.issues(review(corpus_of(FILES), analysis_type="security")).select("path", "rule_id").collect()
    assert {r.rule_id for r in gated} == {"R03", "R09", "R11"}
    again = scan.issues(review(corpus_of(FILES).repartition(7))).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, scan.issues(results).collect()), key=repr)


def test_invariants(spark):
    from workload.corpus import source_files

    results = review(source_files(spark, "/root/testdata/sf0.001")).filter("analyzed").cache()
    names = ["security_score", "quality_score", "performance_score"]
    assert results.filter(" or ".join(f"{n} < 0 or {n} > 100 or {n} is null" for n in names)).count() == 0
    rollup = rollups.repository_rollup(results).selectExpr(
        "total_issues - security_issues - quality_issues - performance_issues as c", "total_issues - high_issues - medium_issues - low_issues as s")
    assert rollup.filter("c <> 0 or s <> 0").count() == 0
    whole = scan.issues(results).count()
    parts = [scan.issues(review(source_files(spark, "/root/testdata/sf0.001"), analysis_type=t)).count()
             for t in ("security", "quality", "performance")]
    assert sum(parts) == whole


def test_linter_findings_count(spark, corpus_of):
    findings = spark.createDataFrame([
        ("demo", "app.py", "security", "security", "B1", "low", "x", 1, "", "bandit", "high", None),
        ("demo", "app.py", "security", "quality", "ansible_lint_x", "high", "x", 1, "", "ansible-lint", None, "x"),
        ("demo", "app.py", "quality", "quality", "yaml_lint_x", "high", "x", 1, "", "yamllint", None, "x"),
    ], "repo string, path string, phase string, category string, type string, severity string, description string, line_no int, "
       "code string, tool string, confidence string, rule string")
    row = by_path(review(corpus_of(FILES), findings=findings))["app.py"]
    assert (row.security_score, row.quality_score) == (55.0, 77.0)
    assert len(row.issues) == 6


def test_profiles(corpus_of):
    quick = scores.profile_scores(profile_review(corpus_of({**FILES, "gone.rb": None}), "quick"), "quick").first()
    issues = scan.issues(profile_review(corpus_of({**FILES, "gone.rb": None}), "quick")).collect()
    assert {(i.path, i.rule_id, i.line_no) for i in issues if i.rule_id == "R71"} == {("gone.rb", "R71", 0)}
    assert quick.security_score == 100 - 10 * sum(i.category == "security" for i in issues)
    assert quick.total_files == 4 and quick.analyzed_files == 3
    web = profile_review(corpus_of({**FILES, ".git/x.py": "eval(1)"}), "web")
    assert web.filter("path like '.git%'").count() == 0


def test_first_n_of_a_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("repo"),
        F.format_string("p%05d", F.col("id")).alias("path")).repartition(6)
    got = {(r.repo, r.path, r["rank"]) for r in topn.first_per_group(rows, ["repo"], ["path"], 4, ["path"]).collect()}
    want = set()
    groups: dict[str, list[str]] = {}
    for r in rows.collect():
        groups.setdefault(r.repo, []).append(r.path)
    for repo, paths in groups.items():
        want |= {(repo, p, n + 1) for n, p in enumerate(sorted(paths)[:4])}
    assert got == want


def test_digests_and_reports(spark, results, tmp_path):
    stored = materialize(results, str(tmp_path), "test")
    text = digests.review_digest(stored).first().digest
    assert "# Code Review for demo" in text and "- **Files Analyzed**: 2/3" in text
    assert text.count("- **app.js**") == 1 and "### Style Issues" not in text
    packages = spark.createDataFrame([("demo", "direct", "numpy")], "repo string, scope string, package string")
    security = digests.security_digest(stored, packages).first().digest
    assert "## Security Score: 75.0/100" in security and "direct: numpy" in security and "(Line 9)" in security
    assert "### Medium Priority" in digests.improvement_digest(stored).first().digest
    assert "### Medium" not in digests.improvement_digest(stored, "security").first().digest
    report = reports.analysis_report(stored).first()
    assert report.security == "75.0/100 ⚠️" and report.quality == "86.5/100 ⚠️" and report.top_issues.startswith("1. [")
    summaries = rollups.summary(rollups.repository_rollup(stored), packages)
    record = nested_repository_results(rollups.repository_rollup(stored), packages, summaries).first()
    assert record.summary.total_dependencies == 1 and record.dependencies.direct == ["numpy"]
    assert record.overall_scores.quality == 86.5


def test_records_are_put_together_from_sorted_pieces(spark):
    """Packages reach a record's task sorted, no set of them is held there, and no join stands above the lists."""
    given = [(f"r{k % 3}", ("direct", "dev", "other")[k % 7 % 3], f"p{k * 7919 % 6000:05d}") for k in range(9000)]
    given += [("r0", "direct", None), (None, "direct", "lost"), ("r9", "direct", "lost"), ("r1", None, "lost")]
    found = spark.createDataFrame(given, "repo string, scope string, package string")
    numbers = ["total_files", "analyzed_files", *[f"{c}_score" for c in ("security", "quality", "performance")]]
    rollup = spark.createDataFrame([(r, n, {"go": n}) for n, r in enumerate(["r0", "r1", "r2", "none", None, "r2"])], "repo string, n bigint, languages map<string, bigint>")
    rollup = rollup.select("repo", *[F.col("n").alias(c) for c in numbers], "languages")
    summaries = spark.createDataFrame([(r, (r,)) for r in ("r0", "r1", "none")], "repo string, summary struct<of: string>")
    records = nested_repository_results(rollup, found, summaries)
    got = sorted(((r.repository, r.total_files, r.languages, r.summary and r.summary.of, *r.dependencies) for r in records.collect()), key=lambda r: r[1])
    want = []
    for n, repo in enumerate(["r0", "r1", "r2", "none", None, "r2"]):
        lists = [sorted({p for r, s, p in given if repo is not None and (r, s) == (repo, scope) and p is not None}) for scope in ("direct", "dev", "optional")]
        want.append((repo, n, {"go": n}, repo if repo in ("r0", "r1", "none") else None, *lists))
    assert got == want
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and plan.index("collect_list") < plan.index("Join")


def test_write_and_stream(spark, corpus_of, results, tmp_path):
    write_file_results(results, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    write_file_results(results, str(tmp_path / "json"), "json")
    source = tmp_path / "in"
    corpus_of(FILES).write.parquet(str(source))
    review_stream(file_stream(spark, str(source)), str(tmp_path / "stream"), str(tmp_path / "state")).awaitTermination()
    corpus_of({"b.py": "eval(x)"}).write.mode("append").parquet(str(source))
    review_stream(file_stream(spark, str(source)), str(tmp_path / "stream"), str(tmp_path / "state")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "stream"))
    assert streamed.count() == 4 and scan.issues(streamed).count() == 8


def test_read_checkouts(spark, tmp_path):
    for name, text in {"one/app.py": "eval(x)\n", "one/sub/a.js": "var a = 1\n", "two/b.py": "x = 1\n"}.items():
        file = tmp_path / "root" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    files = read_checkouts(spark, str(tmp_path / "root"))
    assert sorted((r.repo, r.path, r.size) for r in files.collect()) == [
        ("one", "app.py", 8), ("one", "sub/a.js", 10), ("two", "b.py", 6)]
    assert {(i.repo, i.rule_id) for i in scan.issues(review(files)).collect()} == {("one", "R05"), ("one", "R20")}


def test_one_shuffle(corpus_of):
    plan = rollups.repository_rollup(review(corpus_of(FILES)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan and "Join" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_nested_issue_json(results):
    assert json.loads(results.select(F.to_json(F.struct("issues")).alias("j")).filter("path = 'app.py'").first().j)["issues"]
