"""Findings of external linters, mapped to the common issue columns.

Input tables hold one report per row: ``repo, path, report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.levels import ansible_lint_severity, yamllint_severity
from codesieve.functions.text import contains_any, strip

_BANDIT = """results array<struct<test_id: string, issue_severity: string, issue_text: string, line_number: int,
    code: string, issue_confidence: string>>"""
_ANSIBLE_LINT = "array<struct<tag: string, level: string, message: string, linenumber: int>>"
_YAMLLINT = "type string, level string, desc string, line int, rule string"


def _columns(**values) -> list[Column]:
    names = ["phase", "category", "type", "severity", "description", "line_no", "code", "tool", "confidence", "rule"]
    none = F.lit(None).cast("string")
    return [values.get(n, none).alias(n) for n in names]


def bandit_issues(reports: DataFrame) -> DataFrame:
    """One row per result of a bandit JSON report."""
    parsed = reports.select("repo", "path", F.explode(F.from_json("report", _BANDIT)["results"]).alias("r"))
    r = F.col("r")
    return parsed.select("repo", "path", *_columns(
        phase=F.lit("security"),
        category=F.lit("security"),
        type=F.coalesce(r.test_id, F.lit("unknown")),
        severity=F.lower(F.coalesce(r.issue_severity, F.lit("medium"))),
        description=F.coalesce(r.issue_text, F.lit("")),
        line_no=F.coalesce(r.line_number, F.lit(0)),
        code=F.coalesce(r.code, F.lit("")),
        tool=F.lit("bandit"),
        confidence=F.lower(F.coalesce(r.issue_confidence, F.lit("medium"))),
    ))


def ansible_lint_issues(reports: DataFrame) -> DataFrame:
    """Entries of a JSON report; a report that is not JSON gives its lines that look like findings.

    The findings come from the security phase but are quality issues, so they lower neither score.
    """
    # an array if it reads as one: from_json takes texts of any size
    base = reports.select("repo", "path", "report", F.when(F.ltrim("report").startswith("[") | F.ltrim("report").startswith("{"), F.from_json("report", _ANSIBLE_LINT)).alias("entries"))
    e = F.col("e")
    entries = base.select("repo", "path", F.explode("entries").alias("e")).select("repo", "path", *_columns(
        phase=F.lit("security"),
        category=F.lit("quality"),
        type=F.concat(F.lit("ansible_lint_"), F.coalesce(e.tag, F.lit("unknown"))),
        severity=ansible_lint_severity(F.coalesce(e.level, F.lit("warning"))),
        description=F.coalesce(e.message, F.lit("Ansible lint issue")),
        line_no=F.coalesce(e.linenumber, F.lit(0)),
        code=F.lit(""),
        tool=F.lit("ansible-lint"),
        rule=F.coalesce(e.tag, F.lit("")),
    ))
    line = F.col("line")
    lines = (
        base.filter(F.col("entries").isNull())
        .select("repo", "path", F.explode(F.split("report", "\n")).alias("line"))
        .filter(line.contains(":") & contains_any(F.lower(line), ["error", "warning"]))
        .select("repo", "path", *_columns(
            phase=F.lit("security"),
            category=F.lit("quality"),
            type=F.lit("ansible_lint_issue"),
            severity=F.lit("medium"),
            description=strip(line),
            line_no=F.lit(0),
            code=F.lit(""),
            tool=F.lit("ansible-lint"),
        ))
    )
    return entries.unionByName(lines)


def yamllint_issues(reports: DataFrame) -> DataFrame:
    """One row per line that is a JSON object; other lines are skipped."""
    lines = reports.select("repo", "path", F.explode(F.split("report", "\n")).alias("line")).filter(F.ltrim("line").startswith("{"))
    # a line that is no JSON at all leaves its own text in the last field
    read = F.from_json("line", _YAMLLINT + ", broken string", {"columnNameOfCorruptRecord": "broken"})
    r = F.col("r")
    return lines.select("repo", "path", read.alias("r")).filter("r.broken IS NULL").select("repo", "path", *_columns(
        phase=F.lit("quality"),
        category=F.lit("quality"),
        type=F.concat(F.lit("yaml_lint_"), F.coalesce(r["type"], F.lit("unknown"))),
        severity=yamllint_severity(F.coalesce(r["level"], F.lit("warning"))),
        description=F.coalesce(r["desc"], F.lit("YAML lint issue")),
        line_no=F.coalesce(r["line"], F.lit(0)),
        code=F.lit(""),
        tool=F.lit("yamllint"),
        rule=F.coalesce(r["rule"], F.lit("")),
    ))


def add_findings(scanned: DataFrame, findings: DataFrame) -> DataFrame:
    """Append linter findings to the ``issues`` of their files, before scoring."""
    fields = [f.name for f in scanned.schema["issues"].dataType.elementType.fields]
    with_id = findings.withColumn("rule_id", F.lit(None).cast("string"))
    per_file = with_id.groupBy("repo", "path").agg(F.collect_list(F.struct(*fields)).alias("found"))
    return (
        scanned.join(per_file, ["repo", "path"], "left")
        .withColumn("issues", F.when(F.col("found").isNull(), F.col("issues")).otherwise(
            F.concat("issues", F.col("found").cast(scanned.schema["issues"].dataType))))
        .drop("found")
    )
