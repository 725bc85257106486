"""Import tables: ``imports(repo, path, language, type, module, name, alias, line_no)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import rx, split_lines, strip
from codesieve.operators.syntax import syntax_facts

# Import statements.
JS_FROM = r"""import\s+(\*\s+as\s+\w+|\w+|\{[^}]+\})\s+from\s+['"]([^'"]+)['"]"""
JS_BARE = r"""import\s+['"]([^'"]+)['"]"""
JS_REQUIRE = r"""const\s+(\w+|\{[^}]+\})\s*=\s*require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
JAVA_IMPORT = r"import\s+(static\s+)?([a-zA-Z_][a-zA-Z0-9_.]*(?:\.\*)?);"
GO_SINGLE = r'import\s+"([^"]+)"'
GO_BLOCK = r"import\s*\(([^)]*)\)"

_ARRAY = "array<struct<type: string, module: string, name: string, alias: string, line_no: int>>"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(group))


def _record(type: Column, module: Column, line_no: Column, name: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(type.alias("type"), module.alias("module"), (none if name is None else name).alias("name"),
                    none.alias("alias"), line_no.cast("int").alias("line_no"))


def _from_lines(content: Column, found) -> Column:
    """``found(line, line_no)`` over all lines, as one array; it is null for lines without an import."""
    per_line = F.transform(split_lines(content), lambda line, pos: found(line, pos + 1))
    return F.flatten(F.filter(per_line, lambda rows: rows.isNotNull()))


def python_records(content: Column) -> Column:
    return syntax_facts(content)["imports"]


def js_records(content: Column) -> Column:
    """ES imports, bare imports and ``const x = require(...)``; a bare import gives its whole module."""

    def found(line, line_no):
        def named(pattern):
            pairs = F.arrays_zip(_all(line, pattern, 1).alias("name"), _all(line, pattern, 2).alias("module"))
            return F.transform(pairs, lambda p: _record(F.lit("import"), p.module, line_no, p["name"]))

        bare = F.transform(_all(line, JS_BARE, 1), lambda m: _record(F.lit("import"), m, line_no))
        return F.when(line.contains("import") | line.contains("require"), F.concat(named(JS_FROM), bare, named(JS_REQUIRE)))

    return _from_lines(content, found)


def java_records(content: Column) -> Column:
    def found(line, line_no):
        pairs = F.arrays_zip(_all(line, JAVA_IMPORT, 1).alias("static"), _all(line, JAVA_IMPORT, 2).alias("module"))
        return F.when(line.contains("import"), F.transform(pairs, lambda p: _record(
            F.when(p["static"] != "", "static_import").otherwise("import"), p.module, line_no)))

    return _from_lines(content, found)


def go_records(content: Column) -> Column:
    """Single imports by line; block imports have line 0."""
    single = _from_lines(content, lambda line, line_no: F.when(line.contains("import"), F.transform(
        _all(line, GO_SINGLE, 1), lambda m: _record(F.lit("import"), m, line_no))))
    entries = F.transform(F.flatten(F.transform(_all(content, GO_BLOCK, 1), split_lines)), strip)
    quoted = F.filter(entries, lambda e: (e != "") & e.startswith('"') & e.endswith('"'))
    block = F.transform(quoted, lambda e: _record(F.lit("import"), F.btrim(e, F.lit('"')), F.lit(0)))
    return F.concat(single, block)


RECORDS = {
    ("python",): python_records,
    ("javascript", "typescript"): js_records,
    ("java",): java_records,
    ("go",): go_records,
}


def extract_imports(files: DataFrame, *languages: str) -> DataFrame:
    """Imports of ``files(repo, path, language, content)``, of all known languages or the given ones.

    One pass: each file's imports are found on its own row, by the extractor of its language.
    """
    records = None
    for names, extract in RECORDS.items():
        if languages and not set(names) & set(languages):
            continue
        test = F.col("language").isin(list(names))
        # the parser gets nulls for other languages
        found = extract(F.when(test, F.col("content"))) if extract is python_records else extract(F.col("content"))
        found = found.cast(_ARRAY)
        records = F.when(test, found) if records is None else records.when(test, found)
    return files.select("repo", "path", "language", F.explode(records).alias("r")).select("repo", "path", "language", "r.*")
