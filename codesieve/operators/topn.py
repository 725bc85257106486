"""First n rows per group, safe for groups of any size; alone, or beside other aggregates of the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(
    df: DataFrame, keys: list[str], order: list[str | Column], n: int, spread: list[str], salts: int = 32
) -> DataFrame:
    """Keep the first ``n`` rows of each group and number them in ``rank``.

    A hot group is cut twice before one task sees it: Spark's window group limit keeps ``n`` rows per
    group and map task, and the first window works on (group, hash of ``spread``), so that the last
    one gets at most ``n * salts`` rows per group.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    by_salt = Window.partitionBy(*keys, "salt").orderBy(*order)
    by_key = Window.partitionBy(*keys).orderBy(*order)
    some = (
        df.withColumn("salt", salt)
        .withColumn("rank", F.row_number().over(by_salt))
        .filter(F.col("rank") <= n)
        .drop("rank", "salt")
    )
    return some.withColumn("rank", F.row_number().over(by_key)).filter(F.col("rank") <= n)


def issues_of_file(n: int, keep=None) -> Column:
    """The first ``n`` issues of a file's row that pass ``keep``, a test on the issue struct, by line and rule: no later issue of a file
    can be among the first ``n`` of its repository."""
    wanted = F.filter("issues", keep) if keep else F.col("issues")
    return F.slice(F.array_sort(F.transform(wanted, lambda i: F.struct(
        i.line_no, i.rule_id, i.category, i.severity, i["type"], i.description, i.code))), 1, n)


def first_issues(results: DataFrame, n: int, keys: list[str] | None = None, keep=None) -> DataFrame:
    """First ``n`` issues per repository and category, by path, line and rule.

    Each file hands over at most ``n`` issues per category. ``keep`` is a test on the issue struct.
    """
    keys = keys or ["repo", "category"]

    def of_category(category):
        return lambda i: (i.category == category) & keep(i) if keep else i.category == category

    rows = results.select(
        "repo", "path",
        F.explode(F.concat(*[issues_of_file(n, of_category(c)) for c in ("security", "quality", "performance")])).alias("i"),
    ).select("repo", "path", "i.*")
    return first_per_group(rows, keys, ["path", "line_no", "rule_id"], n, spread=["path"])


def grouped_with_lists(
    results: DataFrame, numbers: list[Column], aggregates: list[Column], lists: dict[str, Column], n: int, salts: int = 32
) -> DataFrame:
    """``aggregates`` over the columns ``numbers`` of all files of a repository, and its first ``n`` items of each list, in one pass.

    A list is an array on the file's row, in the order that counts inside a file and cut to ``n``; all lists hold one type. Across
    files the order is that of the paths. The result has an array column a list, of structs (path, item); item k is the k-th.

    A file's numbers and items leave its row together, as rows of one exchange, so the files are scanned once. There each (repository,
    list, hash of the path) is cut to ``n`` items, so that one aggregate by repository gets ``n * salts`` items a list at most, and
    sums, combined on the map side, of the numbers.
    """
    names = list(lists)
    if not names:
        return results.select("repo", *numbers).groupBy("repo").agg(*aggregates)
    item = results.select(lists[names[0]].alias("items")).schema["items"].dataType.elementType
    file = F.struct(*numbers)
    own = F.struct(F.lit(-1).alias("list"), F.lit(0).alias("at"), F.lit(None).cast(item).alias("item"), file.alias("file"))
    # of the numbers' type, and null
    no_file = F.when(F.lit(False), file)

    def entries(number: int, name: str) -> Column:
        return F.transform(lists[name], lambda x, i: F.struct(F.lit(number).alias("list"), i.alias("at"), x.alias("item"), no_file.alias("file")))

    rows = results.select("repo", "path", F.explode(F.concat(F.array(own), *[entries(k, name) for k, name in enumerate(names)])).alias("e"))
    salted = Window.partitionBy("repo", "list", "salt").orderBy("path", "at")
    rows = rows.select("repo", "path", "e.*").withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int"))
    some = rows.withColumn("rank", F.row_number().over(salted)).filter((F.col("list") < 0) | (F.col("rank") <= n))
    listed = [
        F.slice(F.array_sort(F.collect_list(F.when(F.col("list") == k, F.struct("path", "at", "item")))), 1, n).alias(name)
        for k, name in enumerate(names)]
    grouped = some.select("repo", "path", "list", "at", "item", "file.*").groupBy("repo").agg(*aggregates, *listed)
    return grouped.withColumns({name: F.transform(name, lambda x: F.struct(x["path"], x["item"])) for name in names})


def first_files(files: DataFrame, n: int = 100) -> DataFrame:
    """At most ``n`` files per repository in path order (a sampling option, off in every plan)."""
    return first_per_group(files, ["repo"], ["path"], n, spread=["path"]).drop("rank")
