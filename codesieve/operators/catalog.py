"""The catalogue of repositories: filters, default scan settings, frameworks, upserts, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions.text import contains_any

# Languages scanned by default, and focus areas of a review.
SUPPORTED_LANGUAGES = "python,javascript,typescript,java,go,rust,cpp,csharp,php,ruby"
FOCUS_AREAS = "security,performance,maintainability,style"

# Words that point to a framework. They are looked for as plain substrings.
PYTHON_FRAMEWORKS = {
    "django": ["django", "web", "webapp"],
    "flask": ["flask", "microservice", "api"],
    "fastapi": ["fastapi", "api", "async"],
    "streamlit": ["streamlit", "dashboard", "visualization"],
    "langchain": ["langchain", "llm", "ai", "chatbot"],
    "tensorflow": ["tensorflow", "ml", "machine-learning"],
    "pytorch": ["pytorch", "deep-learning", "neural"],
}
JS_FRAMEWORKS = {f: [f] for f in ["react", "vue", "angular", "node", "express", "next"]}
JAVA_FRAMEWORKS = {f: [f] for f in ["spring", "springboot", "hibernate", "maven", "gradle"]}

# Tools and manifest checks by language.
LANGUAGE_SETTINGS = {
    "python": (["pylint", "bandit", "safety", "mypy"], ["requirements", "setup_py"]),
    "javascript": (["eslint", "npm-audit", "jshint"], ["package_json", "node_modules"]),
    "java": (["spotbugs", "pmd", "checkstyle"], ["maven", "gradle"]),
    "go": (["go-vet", "golint", "gosec"], ["go_mod", "go_sum"]),
}


def split_setting(text: str) -> list[str]:
    return [part.strip().lower() for part in text.split(",")]


def in_languages(records: DataFrame, languages: str = SUPPORTED_LANGUAGES, aliases: dict[str, str] | None = None) -> DataFrame:
    """Keep repositories of the listed languages; ``all`` keeps every one, a null language counts as ''.

    ``aliases`` maps names of the listing to names of the list, such as ``{"c++": "cpp"}``.
    """
    wanted = split_setting(languages)
    if "all" in wanted:
        return records
    name = F.lower(F.coalesce("language", F.lit("")))
    if aliases:
        pairs = [F.lit(x) for pair in aliases.items() for x in pair]
        name = F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)
    return records.filter(name.isin(wanted))


def enabled(configs: DataFrame) -> DataFrame:
    return configs.filter("enabled")


def enabled_in_language(configs: DataFrame, language: str) -> DataFrame:
    return configs.filter(F.col("enabled") & (F.lower(F.coalesce("language", F.lit("unknown"))) == language.lower()))


def frameworks(indicators: dict[str, list[str]], description: Column, topics: Column) -> Column:
    """Frameworks whose indicators are part of the description or are among the topics."""
    text = F.lower(F.coalesce(description, F.lit("")))
    listed = F.coalesce(topics, F.array().cast("array<string>"))
    found = [
        F.when(contains_any(text, dict.fromkeys([name, *words]))
               | F.arrays_overlap(listed, F.array(*[F.lit(w) for w in words])), name)
        for name, words in indicators.items()
    ]
    return F.array_compact(F.array(*found))


def _with_settings(records: DataFrame) -> DataFrame:
    language = F.lower(F.coalesce("language", F.lit("")))
    none = F.array().cast("array<string>")

    def by_language(part):
        out = None
        for name, settings in LANGUAGE_SETTINGS.items():
            value = F.array(*[F.lit(x) for x in settings[part]])
            out = F.when(language == name, value) if out is None else out.when(language == name, value)
        return out.otherwise(none)

    names = (
        F.when(language == "python", frameworks(PYTHON_FRAMEWORKS, F.col("description"), F.col("topics")))
        .when(language == "javascript", frameworks(JS_FRAMEWORKS, F.col("description"), F.col("topics")))
        .when(language == "java", frameworks(JAVA_FRAMEWORKS, F.col("description"), F.col("topics")))
        .otherwise(none)
    )
    lists = {
        "focus_areas": F.array(*[F.lit(a) for a in FOCUS_AREAS.split(",")]),
        "tools": by_language(0), "frameworks": names, "checks": by_language(1),
    }
    return records.withColumns({**{name: F.lit(True) for name in SWITCHES}, **lists})


# Switches that are on by default.
SWITCHES = ["security_scan", "performance_scan", "dependency_scan", "code_quality_scan", "auto_suggest_fixes"]
LISTS = ["focus_areas", "tools", "frameworks", "checks"]


def default_settings(records: DataFrame) -> DataFrame:
    """Scan settings of each repository by its language."""
    return _with_settings(records).select("full_name", "language", *SWITCHES, *LISTS)


def configure(records: DataFrame) -> DataFrame:
    """Configuration rows of discovered repositories; the settings become a text map."""
    entries = []
    for name in SWITCHES:
        entries += [F.lit(name), F.col(name).cast("string")]
    for name in LISTS[:-1]:
        entries += [F.lit(name), F.concat_ws(",", name)]
    # each check is a setting of its own, which an update can switch off
    checks = F.map_from_entries(F.transform("checks", lambda c: F.struct(F.concat(F.lit("check_"), c).alias("key"), F.lit("true").alias("value"))))
    return _with_settings(records).select(
        F.substring_index("full_name", "/", 1).alias("owner"), "name", "full_name",
        F.coalesce("language", F.lit("unknown")).alias("language"),
        F.coalesce("default_branch", F.lit("main")).alias("default_branch"),
        F.lit(True).alias("enabled"), F.map_concat(F.create_map(*entries), checks).alias("analysis_config"),
        F.lit(None).cast("timestamp_ntz").alias("last_analyzed"))


def _last_row(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per ``full_name``: the last one by ``order``, then by its text, so that the choice never depends on chance."""
    given = [F.col(c) for c in order if c in rows.columns]
    latest = Window.partitionBy("full_name").orderBy(*[c.desc() for c in [*given, F.to_json(F.struct(*rows.columns))]])
    return rows.withColumn("_latest", F.row_number().over(latest)).filter("_latest = 1").drop("_latest")


def replace_configs(configs: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Discovered repositories replace their old rows; the others stay. Of several rows of one repository the last by ``order`` counts."""
    old, fresh = configs.alias("old"), _last_row(new, [order]).withColumn("found", F.lit(True)).alias("new")
    joined = old.join(fresh, F.col("old.full_name") == F.col("new.full_name"), "full_outer")
    return joined.select(*[
        F.when(F.col("new.found"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in configs.columns])


def override_configs(configs: DataFrame, updates: DataFrame, order: str = "seq") -> DataFrame:
    """Merge ``updates(full_name, settings map, enabled[, seq])`` into the configurations.

    New settings win over old ones. A repository may have several updates: they count in order of ``order``, the last value of each
    setting wins, and the last switch that isn't null (ties: the larger value). An update for an unknown repository changes nothing.
    """
    at = F.col(order) if order in updates.columns else F.lit(0)
    dated = updates.select("full_name", "settings", F.col("enabled").alias("switch"), at.alias("at"))
    last = F.max(F.when(F.col("switch").isNotNull(), F.struct("at", "switch")))["switch"]
    switches = dated.groupBy("full_name").agg(last.alias("switch"))
    settings = (
        dated.select("full_name", "at", F.explode("settings").alias("key", "value"))
        .groupBy("full_name", "key").agg(F.max(F.struct("at", "value"))["value"].alias("value"))
        .groupBy("full_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))
    )
    keep_old = F.map_filter("analysis_config", lambda k, _: ~F.array_contains(F.map_keys("settings"), k))
    merged = F.when(F.col("settings").isNull(), F.col("analysis_config")).otherwise(F.map_concat(keep_old, "settings"))
    return (
        configs.join(switches, "full_name", "left").join(settings, "full_name", "left")
        .withColumn("analysis_config", merged)
        .withColumn("enabled", F.coalesce("switch", "enabled"))
        .select(*configs.columns)
    )


def refresh(configs: DataFrame, records: DataFrame, order: str = "updated_at") -> DataFrame:
    """Take language and default branch from newer records where these have them; of several records the last by ``order`` that has it."""
    at = F.col(order) if order in records.columns else F.lit(0)

    def last(column):
        return F.max(F.when(F.col(column).isNotNull(), F.struct(at.alias("at"), F.col(column).alias("value"))))["value"]

    new = records.groupBy("full_name").agg(last("language").alias("new_language"), last("default_branch").alias("new_branch"))
    return (
        configs.join(new, "full_name", "left")
        .withColumn("language", F.coalesce("new_language", "language"))
        .withColumn("default_branch", F.coalesce("new_branch", "default_branch"))
        .select(*configs.columns)
    )


def find(records: DataFrame, names: DataFrame) -> DataFrame:
    """Records whose ``name`` is in ``names(name)``."""
    return records.join(names.select("name").distinct(), "name", "left_semi")


def catalogue_summary(configs: DataFrame) -> DataFrame:
    """One row: totals, and repositories by language."""
    name = F.coalesce(F.when(F.col("language") != "", F.col("language")), F.lit("unknown"))
    by_language = configs.groupBy(name.alias("language")).agg(
        F.count("*").alias("n"), F.count_if("enabled").alias("on"))
    # a few rows, one per language
    return by_language.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_repositories"),
        F.coalesce(F.sum("on"), F.lit(0)).alias("enabled_repositories"),
        F.coalesce(F.sum(F.col("n") - F.col("on")), F.lit(0)).alias("disabled_repositories"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"),
    )
