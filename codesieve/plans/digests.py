"""Text digests per repository: review, security, improvement.

Rollup and lists of a digest come from one pass over the file results, on one exchange by repository.

Fixed values in this file: headings and line formats of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.levels import one_decimal
from codesieve.operators.catalog import FOCUS_AREAS, split_setting
from codesieve.operators.rollups import rollup_with_lists, summary_struct
from codesieve.operators.suggestions import suggestion_rows
from codesieve.operators.topn import first_issues, first_per_group, issues_of_file

TOP_ISSUES = 10
TOP_SUGGESTIONS = 5


def _texts(entries: str, text) -> Column:
    """Lines of a list of (path, item); null where there are no items, as for a list that was never asked for."""
    return F.transform(entries, lambda e: text(e["path"], e["item"]))


def _bullet(path: Column, item: Column) -> Column:
    return F.concat(F.lit("- **"), path, F.lit("**: "), item["description"])


def _section(heading: str, lines: Column) -> Column:
    """Heading and lines, or null without lines."""
    return F.when(F.size(lines) > 0, F.concat_ws("\n", F.lit(heading), F.concat_ws("\n", lines)))


def _scores() -> list[Column]:
    return [F.concat(one_decimal(F.col(f"{c}_score")), F.lit("/100")) for c in ("security", "quality", "performance")]


def _languages() -> Column:
    return F.concat_ws(", ", F.map_keys("languages"))


def top_by_focus_area(results: DataFrame, areas: list[str], n: int = TOP_ISSUES) -> DataFrame:
    """First ``n`` high and medium issues per repository and focus area."""
    return first_issues(results, n, keep=lambda i: i.severity.isin("high", "medium")).filter(F.col("category").isin(areas))


def top_security(results: DataFrame, n: int = TOP_ISSUES) -> DataFrame:
    """First ``n`` high security issues per repository."""
    return first_issues(results, n, keep=lambda i: (i.severity == "high") & (i.category == "security"))


def top_suggestions(
    results: DataFrame, n: int = TOP_SUGGESTIONS, type: str | None = None, by_priority: bool = True
) -> DataFrame:
    """First ``n`` suggestions per repository and priority, or per repository alone."""
    keys = ["repo", "priority"] if by_priority else ["repo"]
    return first_per_group(suggestion_rows(results, type), keys, ["path", "order"], n, spread=["path"])


def review_digest(results: DataFrame, areas: list[str] | None = None) -> DataFrame:
    """Overview, scores, summary and the top issues of each focus area."""
    areas = areas or split_setting(FOCUS_AREAS)
    of_area = lambda a: issues_of_file(TOP_ISSUES, lambda i: (i.category == a) & i.severity.isin("high", "medium"))
    joined = rollup_with_lists(results, {f"top_{a}": of_area(a) for a in areas}, TOP_ISSUES).withColumn("summary", summary_struct())
    security, quality, performance = _scores()
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# Code Review for "), "repo"),
        F.concat_ws(
            "\n",
            F.lit("## Repository Overview"),
            F.concat(F.lit("- **Languages**: "), _languages()),
            F.concat(F.lit("- **Files Analyzed**: "), "analyzed_files", F.lit("/"), "total_files"),
            F.concat(F.lit("- **Overall Scores**: Security: "), security, F.lit(", Quality: "), quality,
                     F.lit(", Performance: "), performance)),
        F.lit("## Focus Areas\n" + ", ".join(areas)),
        F.concat(F.lit("## Analysis Summary\n"), F.to_json("summary")),
        F.lit("## Key Issues Found"),
        *[_section(f"### {a.title()} Issues", _texts(f"top_{a}", _bullet)) for a in areas],
    )
    return joined.select("repo", text.alias("digest"))


def security_digest(results: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Security score, number of findings, top high findings, dependencies by scope."""
    high = issues_of_file(TOP_ISSUES, lambda i: (i.severity == "high") & (i.category == "security"))
    rollup = rollup_with_lists(results, {"top": high}, TOP_ISSUES)
    bullet = lambda path, i: F.concat(F.lit("- **"), path, F.lit("** (Line "), i["line_no"], F.lit("): "), i["description"])
    packages = dependencies.groupBy("repo").agg(*[
        F.array_sort(F.collect_set(F.when(F.col("scope") == s, F.col("package")))).alias(s)
        for s in ("direct", "dev", "optional")])
    joined = rollup.join(packages, "repo", "left")
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# Security Analysis for "), "repo"),
        F.concat(F.lit("## Security Score: "), _scores()[0]),
        F.concat(F.lit("## Security Issues Found: "), "security_issues"),
        F.concat_ws("\n", F.lit("### High Priority Security Issues"), F.concat_ws("\n", _texts("top", bullet))),
        F.concat_ws("\n", F.lit("### Dependencies"), *[
            F.concat(F.lit(f"{s}: "), F.concat_ws(", ", s)) for s in ("direct", "dev", "optional")]),
    )
    return joined.select("repo", text.alias("digest"))


def improvement_digest(results: DataFrame, focus_area: str | None = None) -> DataFrame:
    """Scores, key metrics, and the top suggestions of high and medium priority."""

    def of_priority(priority):
        wanted = lambda s: (s.priority == priority) & (F.lit(True) if focus_area is None else s["type"] == focus_area)
        return F.slice(F.filter("suggestions", wanted), 1, TOP_SUGGESTIONS)

    joined = rollup_with_lists(results, {f"top_{p}": of_priority(p) for p in ("high", "medium")}, TOP_SUGGESTIONS)
    security, quality, performance = _scores()
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# Improvement Suggestions for "), "repo"),
        F.concat_ws("\n", F.lit("## Current Scores"), F.concat(F.lit("- Security: "), security),
                    F.concat(F.lit("- Quality: "), quality), F.concat(F.lit("- Performance: "), performance)),
        F.lit(f"## Focus Area: {focus_area or 'All Areas'}"),
        F.concat_ws("\n", F.lit("## Key Metrics"), F.concat(F.lit("- Languages: "), _languages()),
                    F.concat(F.lit("- Total Files: "), "total_files"),
                    F.concat(F.lit("- Files with Issues: "), "files_with_issues")),
        F.lit("## Improvement Opportunities"),
        _section("### High Priority", _texts("top_high", _bullet)),
        _section("### Medium Priority", _texts("top_medium", _bullet)),
    )
    return joined.select("repo", text.alias("digest"))
