"""Repository rollups: one partial aggregate per repository, whatever is asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.paths import LANGUAGE_EXTENSIONS
from codesieve.operators.scores import count_of
from codesieve.operators.topn import grouped_with_lists

_CATEGORIES = ("security", "quality", "performance")
_SEVERITIES = ("high", "medium", "low")


def language_counts(language: str = "language") -> Column:
    """Aggregate: map of language to files. Languages are a fixed set, so no second grouping is needed."""
    entries = ", ".join(f"'{name}', count_if({language} = '{name}')" for name in sorted(LANGUAGE_EXTENSIONS))
    return F.expr(f"map_filter(map({entries}), (name, n) -> n > 0)")


def most_common(counts: Column) -> Column:
    """Language with the most files, the first in the alphabet on a tie; ``unknown`` if there is none."""
    ranked = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct(-e["value"], e["key"].alias("name"))))
    return F.coalesce(F.try_element_at(ranked, F.lit(1))["name"], F.lit("unknown"))


def language_histogram(results: DataFrame) -> DataFrame:
    return (
        results.filter("analyzed").groupBy("repo", "language").agg(F.count("*").alias("files"))
    )


def language_names(results: DataFrame, name_column: str = "language") -> DataFrame:
    """Sorted distinct languages per repository."""
    return results.filter("analyzed").groupBy("repo").agg(
        F.array_sort(F.collect_set(name_column)).alias("languages"))


def issue_type_counts(results: DataFrame) -> DataFrame:
    """Issues per file and type, counted on the file's row."""
    types = F.transform("issues", lambda i: i["type"])
    return results.select("repo", "path", types.alias("types"), F.explode(F.array_distinct(types)).alias("type")).select(
        "repo", "path", "type",
        F.size(F.filter("types", lambda t: t == F.col("type"))).cast("long").alias("issues"))


def recommendation(high: Column, total: Column) -> Column:
    return (
        F.when(high > 0, "requires attention")
        .when(total > 10, "review recommended")
        .when(total > 0, "good with minor fixes")
        .otherwise("excellent")
    )


def file_numbers() -> list[Column]:
    """What a file adds to the rollup of its repository: ``file`` marks its row, the rest are flags and numbers."""
    return [
        F.lit(1).alias("file"), F.col("analyzed"), F.when(F.col("analyzed"), F.col("language")).alias("language"),
        *[F.when(F.col("analyzed"), F.col(f"{c}_score")).alias(f"{c}_score") for c in _CATEGORIES],
        F.size("issues").cast("long").alias("issue_count"),
        *[count_of("category", c).alias(f"n_{c}") for c in _CATEGORIES],
        *[count_of("severity", s).alias(f"n_{s}") for s in _SEVERITIES],
    ]


def rollup_aggregates() -> list[Column]:
    """Aggregates over :func:`file_numbers`; rows without a file count for nothing."""

    def total(column):
        return F.coalesce(F.sum(F.when(F.col("analyzed"), F.col(column))), F.lit(0))

    return [
        F.count("file").alias("total_files"),
        F.count_if("analyzed").alias("analyzed_files"),
        F.count_if(F.col("analyzed") & (F.col("issue_count") > 0)).alias("files_with_issues"),
        *[F.coalesce(F.avg(f"{c}_score"), F.lit(0.0)).alias(f"{c}_score") for c in _CATEGORIES],
        total("issue_count").alias("total_issues"),
        *[total(f"n_{c}").alias(f"{c}_issues") for c in _CATEGORIES],
        *[total(f"n_{s}").alias(f"{s}_issues") for s in _SEVERITIES],
        language_counts().alias("languages"),
    ]


def with_flags(rollup: DataFrame) -> DataFrame:
    return rollup.withColumns({
        "most_common_language": most_common(F.col("languages")),
        "has_security_issues": F.col("security_issues") > 0,
        "requires_attention": (F.col("high_issues") > 0) | (F.col("security_issues") > 5),
        "recommendation": recommendation(F.col("high_issues"), F.col("total_issues")),
    })


def repository_rollup(results: DataFrame) -> DataFrame:
    """Everything a repository report needs, in one shuffle: scores, counts, languages, flags."""
    return with_flags(results.select("repo", *file_numbers()).groupBy("repo").agg(*rollup_aggregates()))


def rollup_with_lists(results: DataFrame, lists: dict[str, Column], n: int) -> DataFrame:
    """The rollup of each repository, and its first ``n`` items of each list, from one pass over the files (:func:`grouped_with_lists`)."""
    return with_flags(grouped_with_lists(results, file_numbers(), rollup_aggregates(), lists, n))


def summary_struct(total_dependencies: Column | None = None) -> Column:
    """The nested summary of a rollup's row."""
    return F.struct(
        "total_issues",
        F.struct(*[F.col(f"{c}_issues").alias(c) for c in _CATEGORIES]).alias("issues_by_category"),
        F.struct(*[F.col(f"{s}_issues").alias(s) for s in _SEVERITIES]).alias("issues_by_severity"),
        F.map_keys("languages").alias("languages_detected"),
        "most_common_language",
        (F.lit(0) if total_dependencies is None else total_dependencies).cast("long").alias("total_dependencies"),
        "has_security_issues",
        "requires_attention",
    )


def summary(rollup: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """The nested repository summary; dependencies are counted over all scopes after de-duplication."""
    if dependencies is not None:
        counts = dependencies.groupBy("repo").agg(F.count("*").alias("total_dependencies"))
        rollup = rollup.join(counts, "repo", "left")
        total = F.coalesce("total_dependencies", F.lit(0))
    else:
        total = None
    return rollup.select("repo", summary_struct(total).alias("summary"))


def issue_cube(issues: DataFrame) -> DataFrame:
    """Issue counts with subtotals: repository, then category, then severity."""
    # count first: the rollup then expands one row per combination, not one per issue
    counted = issues.groupBy("repo", "category", "severity").agg(F.count("*").alias("n"))
    return counted.rollup("repo", "category", "severity").agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("issues"))


def issues_by_category(issues: DataFrame) -> DataFrame:
    return issues.groupBy("repo", "category").agg(F.count("*").alias("issues"))
