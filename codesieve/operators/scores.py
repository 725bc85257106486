"""Penalty scores per file, and count-weighted scores per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points lost per issue, by severity; any other severity counts as low.
SECURITY_POINTS = {"high": 20, "medium": 10, "low": 5}
QUALITY_POINTS = {"high": 15, "medium": 8, "low": 3}
PERFORMANCE_POINTS = {"high": 20, "medium": 12, "low": 5}

# Points lost per issue, by category, in the language-blind profiles.
PROFILE_POINTS = {
    "web": {"security": 20, "quality": 2, "performance": 10},
    "interactive": {"security": 20, "quality": 2, "performance": 10},
    "quick": {"security": 10, "quality": 2},
}


def penalty(category: str, points: dict[str, int]) -> str:
    """SQL: points lost in one phase; an issue counts only where its category is that of its phase."""
    return f"""aggregate(issues, 0, (lost, i) -> lost +
        CASE WHEN i.category != '{category}' OR i.phase != '{category}' THEN 0
             WHEN i.severity = 'high' THEN {points['high']}
             WHEN i.severity = 'medium' THEN {points['medium']}
             ELSE {points['low']} END)"""


def _score(lost: str) -> Column:
    return F.expr(f"cast(greatest(0, 100 - ({lost})) as double)")


def security_score() -> Column:
    return _score(penalty("security", SECURITY_POINTS))


def quality_score() -> Column:
    """Issues, and complexity above 10 (at most 20 points), and length above 500 lines (at most 10)."""
    return _score(f"""{penalty("quality", QUALITY_POINTS)}
        + CASE WHEN cyclomatic_complexity > 10 THEN least(20, cyclomatic_complexity - 10) ELSE 0 END
        + CASE WHEN lines_of_code > 500 THEN least(10, floor((lines_of_code - 500) / 100)) ELSE 0 END""")


def performance_score() -> Column:
    return _score(penalty("performance", PERFORMANCE_POINTS))


def with_scores(results: DataFrame) -> DataFrame:
    """Add the three file scores. A file without issues keeps its row and scores 100."""
    return results.withColumns({
        "security_score": security_score(),
        "quality_score": quality_score(),
        "performance_score": performance_score(),
    })


def repository_scores(results: DataFrame) -> DataFrame:
    """Mean file scores per repository; 0.0 where no file was analysed."""

    def mean(score):
        return F.coalesce(F.avg(F.when(F.col("analyzed"), F.col(score))), F.lit(0.0))

    return results.groupBy("repo").agg(
        mean("security_score").alias("security"),
        mean("quality_score").alias("quality"),
        mean("performance_score").alias("performance"),
    )


def count_of(field: str, value: str) -> Column:
    """How many of a file's issues have a value in a field."""
    return F.expr(f"cast(size(filter(issues, i -> i.{field} = '{value}')) as bigint)")


def profile_numbers(profile: str) -> tuple[list[Column], list[Column]]:
    """What a file adds to its repository's counts in a language-blind profile, and the aggregates over that."""
    categories = list(PROFILE_POINTS[profile])
    numbers = [F.lit(1).alias("file"), F.col("analyzed"), *[count_of("category", c).alias(c) for c in categories]]
    return numbers, [
        F.count("file").alias("total_files"),
        F.count_if("analyzed").alias("analyzed_files"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_issues") for c in categories]]


def with_profile_scores(counted: DataFrame, profile: str) -> DataFrame:
    return counted.withColumns({
        f"{category}_score": F.greatest(F.lit(0), F.lit(100) - F.col(f"{category}_issues") * lost).cast("double")
        for category, lost in PROFILE_POINTS[profile].items()})


def profile_scores(results: DataFrame, profile: str) -> DataFrame:
    """Scores of the language-blind profiles: a fixed number of points per issue, per repository."""
    numbers, aggregates = profile_numbers(profile)
    return with_profile_scores(results.select("repo", *numbers).groupBy("repo").agg(*aggregates), profile)
