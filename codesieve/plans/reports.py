"""Analysis reports per repository, as tables and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.levels import indicator, one_decimal
from codesieve.functions.paths import base_name
from codesieve.operators.rollups import rollup_with_lists
from codesieve.operators.scores import PROFILE_POINTS, count_of, profile_numbers, with_profile_scores
from codesieve.operators.topn import grouped_with_lists, issues_of_file

# Issues shown per category.
SHOWN = {"core": 10, "web": 10, "interactive": 5, "quick": 5}


_CATEGORIES = ("security", "quality", "performance")


def _category_lists(shown: int, categories=_CATEGORIES) -> dict[str, Column]:
    of = lambda category: lambda i: i.category == category
    return {f"first_{c}": issues_of_file(shown, of(c)) for c in categories}


def _lines(category: str, with_code: bool) -> Column:
    """The lines that a section shows; ``with_code`` quotes the line of security issues."""

    def line(e):
        i = e["item"]
        text = F.concat(F.lit("["), F.upper(i["severity"]), F.lit("] "), base_name(e["path"]), F.lit(":"), i["line_no"], F.lit(" - "), i["description"])
        return F.concat(text, F.lit(" `"), i["code"], F.lit("`")) if with_code and category == "security" else text

    return F.transform(f"first_{category}", line)


def category_sections(results: DataFrame, shown: int, with_code: bool = False) -> DataFrame:
    """Per repository and category: how many issues, the first ones, and how many more there are.

    ``with_code`` quotes the line of security issues.
    """
    counts = [count_of("category", c).alias(c) for c in _CATEGORIES]
    grouped = grouped_with_lists(results, counts, [F.sum(c).alias(c) for c in _CATEGORIES], _category_lists(shown), shown)
    section = lambda c: F.struct(
        F.lit(c).alias("category"), F.col(c).alias("issues"), _lines(c, with_code).alias("shown"),
        F.greatest(F.col(c) - shown, F.lit(0)).cast("long").alias("more"))
    rows = grouped.select("repo", F.explode(F.array(*map(section, _CATEGORIES))).alias("s")).select("repo", "s.*")
    return rows.filter("issues > 0")


def analysis_report(results: DataFrame, analysis_type: str = "full", shown: int = SHOWN["core"]) -> DataFrame:
    """Core profile: scores, counts, languages and the first issues of the wanted type."""
    wanted = _CATEGORIES if analysis_type == "full" else (analysis_type,)
    first = issues_of_file(shown, lambda i: i.category.isin(*wanted))
    line = lambda e, k: F.concat(
        k + 1, F.lit(". ["), F.upper(e["item"]["severity"]), F.lit("] "), e["path"], F.lit(": "), e["item"]["description"])
    return rollup_with_lists(results, {"first": first}, shown).select(
        "repo",
        *[F.concat(one_decimal(F.col(f"{c}_score")), F.lit("/100 "), indicator(F.col(f"{c}_score"))).alias(c)
          for c in ("security", "quality", "performance")],
        "total_files", "analyzed_files",
        F.concat_ws(", ", F.map_keys("languages")).alias("languages"),
        "recommendation",
        F.concat_ws("\n", F.transform("first", line)).alias("top_issues"),
    )


def profile_report(results: DataFrame, profile: str, analysis_type: str = "full") -> DataFrame:
    """Language-blind profiles: one text per repository with scores, summary and a section per category."""
    shown = SHOWN[profile]
    categories = list(PROFILE_POINTS[profile])
    numbers, aggregates = profile_numbers(profile)
    languages = F.array_sort(F.collect_set(F.when(F.col("analyzed"), F.col("language")))).alias("languages")
    grouped = grouped_with_lists(results, [*numbers, F.col("language")], [*aggregates, languages], _category_lists(shown, categories), shown)
    joined = with_profile_scores(grouped, profile).withColumns({c: F.struct(
        _lines(c, profile == "web").alias("shown"), F.greatest(F.col(f"{c}_issues") - shown, F.lit(0)).alias("more")) for c in categories})
    wanted = [c for c in categories if analysis_type in (c, "full")]

    def section(c):
        head = F.concat(F.lit(f"{c.title()} issues: "), F.col(f"{c}_issues"))
        more = F.when(F.col(f"{c}.more") > 0, F.concat(F.lit("... and "), F.col(f"{c}.more"), F.lit(f" more {c} issues")))
        return F.concat_ws("\n", head, F.concat_ws("\n", F.transform(f"{c}.shown", lambda t: F.concat(F.lit("- "), t))), more)

    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Analysis results for "), "repo"),
        F.concat_ws("\n", *[
            F.concat(F.lit(f"{c.title()}: "), F.col(f"{c}_score").cast("int"), F.lit("/100 "), indicator(F.col(f"{c}_score")))
            for c in categories]),
        F.concat_ws(
            "\n",
            F.concat(F.lit("Total files: "), "total_files"),
            F.concat(F.lit("Analyzed files: "), "analyzed_files"),
            F.concat(F.lit("Languages: "), F.coalesce(
                F.when(F.size("languages") > 0, F.concat_ws(", ", "languages")), F.lit("None detected"))),
            F.concat(F.lit("Total issues: "), sum((F.col(f"{c}_issues") for c in categories[1:]), F.col(f"{categories[0]}_issues")))),
        *[section(c) for c in wanted],
    )
    return joined.select("repo", text.alias("report"))
