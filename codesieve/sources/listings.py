"""Repository, pull-request, tree and file-content records, as exported JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.operators.topn import first_per_group

# The fields of each record.
REPOSITORY = """id bigint, name string, full_name string, description string, language string, default_branch string,
    private boolean, fork boolean, archived boolean, disabled boolean, size bigint, stargazers_count bigint,
    watchers_count bigint, forks_count bigint, open_issues_count bigint, topics array<string>, created_at string,
    updated_at string, pushed_at string, clone_url string, html_url string, api_url string"""
REPOSITORY_DETAIL = """id bigint, name string, full_name string, owner struct<login: string>, description string,
    language string, languages map<string, bigint>, default_branch string, private boolean, fork boolean,
    archived boolean, disabled boolean, size bigint, stargazers_count bigint, watchers_count bigint,
    forks_count bigint, open_issues_count bigint, topics array<string>, license struct<name: string>,
    created_at string, updated_at string, pushed_at string, clone_url string, html_url string, ssh_url string,
    has_issues boolean, has_projects boolean, has_wiki boolean, has_pages boolean, has_downloads boolean"""
PULL_REQUEST = """number bigint, title string, body string, state string,
    user struct<login: string, avatar_url: string>, head struct<ref: string, sha: string>,
    base struct<ref: string, sha: string>, created_at string, updated_at string, mergeable boolean,
    additions bigint, deletions bigint, changed_files bigint, html_url string"""
TREE = """repo string, tree array<struct<path: string, size: bigint, sha: string, type: string, url: string>>"""
FILE_CONTENT = """repo string, path string, encoding string, content string"""


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """NDJSON files with one record per line; lines that are not JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_records(df: DataFrame, json: str, schema: str) -> DataFrame:
    """The same records from a JSON text column; other columns are kept in front."""
    others = [c for c in df.columns if c != json]
    # behind a generator the text is parsed once, not once per field that is used
    parsed = df.select(*others, F.explode(F.array(F.from_json(json, schema))).alias("record"))
    return parsed.filter(F.col("record").isNotNull()).select(*others, "record.*")


def listing(records: DataFrame, include_forks: bool = False, include_private: bool = False) -> DataFrame:
    """Repository records without forks and private ones unless asked for."""
    kept = records
    if not include_forks:
        kept = kept.filter(~F.coalesce("fork", F.lit(False)))
    if not include_private:
        kept = kept.filter(~F.coalesce("private", F.lit(False)))
    return kept


def updated() -> Column:
    """The time of the last update, whatever its offset."""
    return F.try_to_timestamp("updated_at")


def newest(records: DataFrame, n: int) -> DataFrame:
    """The ``n`` records updated last. A limit over a sort runs as a top-n, not as a full sort."""
    return records.orderBy(updated().desc(), "full_name").limit(n)


def short_listing(records: DataFrame, n: int | None = None) -> DataFrame:
    """Name, description, language, stars and date, with texts for what is missing; the first ``n`` by update."""
    chosen = records if n is None else newest(records, n)
    return chosen.select(
        "name",
        "full_name",
        _or("description", "No description").alias("description"),
        _or("language", "Unknown").alias("language"),
        F.col("stargazers_count").alias("stars"),
        F.left("updated_at", F.lit(10)).alias("updated"),
        F.coalesce("private", F.lit(False)).alias("private"),
    )


def _or(column: str, text: str) -> Column:
    return F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit(text))


def first_of_owner(records: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest records of each owner, numbered in ``rank``; ``more`` counts those left out."""
    owned = records.withColumn("owner", F.substring_index("full_name", "/", 1))
    counts = owned.groupBy("owner").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    first = first_per_group(owned, ["owner"], [updated().desc(), "full_name"], n, spread=["full_name"])
    return first.join(counts, "owner")


def detail(records: DataFrame) -> DataFrame:
    """Repository details with the licence name and owner login lifted out."""
    return (
        records.withColumn("license", F.col("license.name"))
        .withColumn("owner", F.col("owner.login"))
        .withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
        .withColumn("created_ts", F.try_to_timestamp("created_at"))
        .withColumn("updated_ts", F.try_to_timestamp("updated_at"))
    )


def language_bytes(records: DataFrame) -> DataFrame:
    """One row per repository and language with its bytes; none where the map is missing."""
    return records.select("full_name", F.explode(F.coalesce(
        "languages", F.create_map().cast("map<string,bigint>"))).alias("language", "bytes"))


def pull_requests(records: DataFrame, state: str = "open") -> DataFrame:
    """Pull requests in a state (``all`` for any)."""
    return records if state == "all" else records.filter(F.col("state") == state)


def tree_files(trees: DataFrame) -> DataFrame:
    """File entries of repository trees."""
    return trees.select("repo", F.explode("tree").alias("e")).filter("e.type = 'blob'").select("repo", "e.*")


def decode_content(records: DataFrame) -> DataFrame:
    """Text of file-content records, base64 or plain."""
    plain = F.when(F.col("encoding") == "base64", F.unbase64(F.regexp_replace("content", r"\s", "")).cast("string"))
    return records.withColumn("text", plain.otherwise(F.col("content"))).drop("content")
