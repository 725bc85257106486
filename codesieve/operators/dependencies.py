"""Declared dependencies: ``dependencies(repo, manifest, scope, package)`` from manifest files.

Works on ``files(repo, path, content)``. Manifests are picked by base name before anything else, so
only their text is read further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.paths import base_name
from codesieve.functions.text import contains_any, rx, split_lines, strip
from codesieve.operators.paging import paged
from codesieve.operators.toml import toml_names

# Manifests looked for at a repository's root, and the names each reader takes.
ROOT_MANIFESTS = [
    "requirements.txt", "requirements-dev.txt", "Pipfile", "pyproject.toml", "package.json", "go.mod", "Cargo.toml",
    "pom.xml", "build.gradle", "composer.json",
]
REQUIREMENTS = ["requirements.txt", "requirements-dev.txt", "requirements.in"]
PACKAGE_JSON = ["package.json"]
PIPFILE = ["Pipfile"]
POETRY = ["poetry.lock", "pyproject.toml"]
GO = ["go.mod", "go.sum"]
CARGO = ["Cargo.toml"]
SCOPES = ["direct", "dev", "optional"]


def root_manifests(files: DataFrame) -> DataFrame:
    """Known manifests in the top folder of their repository."""
    return files.filter(F.col("path").isin(ROOT_MANIFESTS))


_PACKAGES = "array<struct<scope: string, package: string>>"


def _scoped(scope, packages: Column) -> Column:
    label = F.lit(scope) if isinstance(scope, str) else scope
    return F.transform(packages, lambda p: F.struct(label.alias("scope"), p.alias("package"))).cast(_PACKAGES)


def _none() -> Column:
    return F.array().cast(_PACKAGES)


def requirements_packages(content: Column, strict: bool = False) -> Column:
    """pip requirement files. ``strict`` also cuts ``~=``, extras and markers off the name."""
    stop = "[><=!~;\\[ ]" if strict else "[><=!]"
    lines = F.transform(split_lines(content), strip)
    kept = F.filter(lines, lambda l: (l != "") & ~l.startswith("#") & ~l.startswith("-"))
    names = F.transform(kept, lambda l: strip(F.split(l, stop)[0]))
    return _scoped("direct", F.filter(names, lambda n: n != ""))


def package_json_packages(content: Column) -> Column:
    """Keys of the three dependency objects; a text that is not JSON gives nothing."""
    sections = {"direct": "$.dependencies", "dev": "$.devDependencies", "optional": "$.optionalDependencies"}
    found = F.concat(*[
        F.coalesce(_scoped(scope, F.json_object_keys(F.get_json_object(content, where))), _none())
        for scope, where in sections.items()])
    return F.when(F.from_json(content, "map<string, string>").isNotNull(), found)


def pipfile_packages(content: Column) -> Column:
    """Keys of ``[packages]`` and ``[dev-packages]``.

    The text is cut in front of every section header, so a line finds its section in its own piece
    and nothing has to be carried from row to row.
    """

    def of_piece(piece):
        header = strip(F.substring_index(piece, "\n", 1))
        lines = F.transform(split_lines(piece), strip)
        entries = F.filter(lines, lambda l: l.contains("=") & ~l.startswith("#") & ~l.startswith("["))
        names = F.transform(entries, lambda l: F.btrim(strip(F.substring_index(l, "=", 1)), F.lit("\"'")))
        return (
            F.when(header == "[packages]", _scoped("direct", names))
            .when(header == "[dev-packages]", _scoped("dev", names))
            .otherwise(_none())
        )

    return F.flatten(F.transform(F.split(content, rx(r"\n(?=[^\S\n]*\[)"), -1), of_piece))


def go_mod_packages(content: Column, strict: bool = False) -> Column:
    """``require module`` statements. ``strict`` also reads the lines of ``require ( ... )`` blocks."""
    single = F.filter(
        F.regexp_extract_all(content, F.lit(rx(r"require\s+([^\s]+)")), F.lit(1)), lambda m: ~m.startswith("("))
    if not strict:
        return _scoped("direct", single)
    # cut at the last closing bracket, every block that opens ends
    closed = F.left(content, F.length(content) - F.length(F.substring_index(content, ")", -1)))
    blocks = F.regexp_extract_all(closed, F.lit(rx(r"require\s*\(([^)]*+)\)")), F.lit(1))
    lines = F.transform(F.flatten(F.transform(blocks, split_lines)), strip)
    entries = F.filter(lines, lambda l: (l != "") & ~l.startswith("//"))
    return _scoped("direct", F.concat(single, F.transform(entries, lambda l: F.split(l, rx(r"\s"))[0])))


# The TOML sections that list packages, by manifest, with the scope of each.
POETRY_SECTIONS = {"tool.poetry.dependencies": "direct", "tool.poetry.group.dev.dependencies": "dev"}
CARGO_SECTIONS = {"dependencies": "direct", "dev-dependencies": "dev"}

def toml_packages(content: Column, *kinds: dict[str, str]) -> list[Column]:
    """For each of ``kinds``, scopes of sections, the names of what the sections hold, however they are written: entries below a header, sub-tables
    (``[dependencies.name]``), inline tables and dotted or quoted keys (:mod:`codesieve.operators.toml`). What stands in a string, a comment or a
    list is no key. A text is read once for all kinds.

    Of a text that is no TOML what can be read counts: a header or a string that does not close ends with its line, one of three quotes with the text.
    """
    sections = [section for kind in kinds for section in kind]
    # a text without the last part of a section's name has none of them, and no reader sees it
    needed = F.when(contains_any(content, sorted({section.split(".")[-1] for section in sections})), content)
    names = toml_names(needed, sections)
    return [F.concat(*[_scoped(scope, names[sections.index(section)]) for section, scope in kind.items()]) for kind in kinds]


def declared(files: DataFrame, strict: bool = False, names: list[str] | None = None) -> DataFrame:
    """Every dependency of every known manifest (or of those called ``names``), duplicates kept.

    One pass: the reader is chosen by the manifest's base name, on its own row.
    """
    base, content = base_name(F.col("path")), F.col("content")
    # only texts of TOML manifests go to Python; the language itself is no package
    poetry, cargo = toml_packages(F.when(base.isin(POETRY + CARGO), content), POETRY_SECTIONS, CARGO_SECTIONS)
    poetry = F.filter(poetry, lambda p: p["package"] != "python")
    readers = {
        "requirements": (REQUIREMENTS, requirements_packages(content, strict)),
        "package_json": (PACKAGE_JSON, package_json_packages(content)),
        "pipfile": (PIPFILE, pipfile_packages(content)),
        "go": (GO, go_mod_packages(content, strict)),
        "poetry": (POETRY, poetry),
        "cargo": (CARGO, cargo),
    }
    wanted = [n for listed, _ in readers.values() for n in listed if names is None or n in names]
    packages = None
    for listed, found in readers.values():
        if set(listed) & set(wanted):
            packages = F.when(base.isin(listed), found) if packages is None else packages.when(base.isin(listed), found)
    if packages is None:
        packages = _none()
    # the outer form keeps the optimizer from testing the size of the array, which would read the texts again
    rows = files.filter(base.isin(wanted)).select("repo", F.col("path").alias("manifest"), F.explode_outer(packages).alias("p"))
    return rows.filter(F.col("p").isNotNull()).select("repo", "manifest", "p.scope", "p.package")


def repository_dependencies(files: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct packages per repository and scope, from the manifests at its root."""
    return declared(root_manifests(files), strict).select("repo", "scope", "package").distinct()


def dependency_lists(dependencies: DataFrame) -> DataFrame:
    """Sorted packages per repository and scope, as arrays: a list goes into one value, so where a repository may have any number, use
    the rows of ``dependencies`` themselves. Its rows are distinct already."""
    return dependencies.groupBy("repo", "scope").agg(
        F.array_sort(F.collect_list("package")).alias("packages"), F.count("*").alias("n_packages"))


def dependency_pages(dependencies: DataFrame, folder: str, size: int = 1000) -> DataFrame:
    """Sorted packages per repository and scope in pages of ``size``, for repositories with any number of them; ``folder`` is for
    :func:`codesieve.operators.paging.paged`."""
    return paged(dependencies, ["repo", "scope"], "package", size, folder)
