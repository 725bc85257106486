"""Facts about Python sources that only a parser can give.

One parse per file feeds the syntax rules, the Python metrics and the import table. The parser runs
as an Arrow UDF on the content column alone; files of other languages reach it as nulls, so their
text never leaves the JVM and no shuffle or join is needed to bring the facts back to the row.
"""

from __future__ import annotations

import ast
import sys
import warnings

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Executors get the parser with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACTS_SCHEMA = """struct<
    functions: array<struct<name: string, line_no: int, n_args: int, decision_points: int>>,
    classes: array<struct<name: string, line_no: int>>,
    imports: array<struct<type: string, module: string, name: string, alias: string, line_no: int>>,
    node_lines: array<struct<line_no: int, nodes: int>>,
    syntax_error: struct<message: string, line_no: int>>"""

_ARROW_FACTS = pa.struct([
    ("functions", pa.list_(pa.struct([
        ("name", pa.string()), ("line_no", pa.int32()), ("n_args", pa.int32()), ("decision_points", pa.int32())]))),
    ("classes", pa.list_(pa.struct([("name", pa.string()), ("line_no", pa.int32())]))),
    ("imports", pa.list_(pa.struct([
        ("type", pa.string()), ("module", pa.string()), ("name", pa.string()), ("alias", pa.string()),
        ("line_no", pa.int32())]))),
    ("node_lines", pa.list_(pa.struct([("line_no", pa.int32()), ("nodes", pa.int32())]))),
    ("syntax_error", pa.struct([("message", pa.string()), ("line_no", pa.int32())])),
])

#: Characters above which a line's nodes are counted.
LONG = 120

_BRANCHES = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.comprehension)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def python_facts(source: str) -> dict:
    """Functions, classes, imports and node counts per line of one source text."""
    facts = {"functions": [], "classes": [], "imports": [], "node_lines": [], "syntax_error": None}
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except SyntaxError as error:
        facts["syntax_error"] = {"message": str(error), "line_no": error.lineno or 0}
        return facts
    except (ValueError, RecursionError, MemoryError) as error:
        # the parser gives up on it: that is an issue of the file, not a clean file
        facts["syntax_error"] = {"message": f"not parsed ({type(error).__name__})", "line_no": 0}
        return facts

    # parents come before their children, so one backward pass sums every subtree
    order = [(tree, -1)]
    for position, (node, _) in enumerate(order):
        order.extend((child, position) for child in ast.iter_child_nodes(node))
    points = [0] * len(order)
    per_line: dict[int, int] = {}
    for position in range(len(order) - 1, -1, -1):
        node, parent = order[position]
        if isinstance(node, _BRANCHES):
            points[position] += 1
        elif isinstance(node, ast.BoolOp):
            points[position] += len(node.values) - 1
        if parent >= 0:
            points[parent] += points[position]
        line_no = getattr(node, "lineno", None)
        if line_no is not None:
            per_line[line_no] = per_line.get(line_no, 0) + 1

    for position, (node, _) in enumerate(order):
        if isinstance(node, _FUNCTIONS):
            facts["functions"].append({
                "name": node.name, "line_no": node.lineno, "n_args": len(node.args.args),
                "decision_points": 1 + points[position]})
        elif isinstance(node, ast.ClassDef):
            facts["classes"].append({"name": node.name, "line_no": node.lineno})
        elif isinstance(node, ast.Import):
            facts["imports"].extend(
                {"type": "import", "module": a.name, "name": None, "alias": a.asname, "line_no": node.lineno}
                for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            facts["imports"].extend(
                {"type": "from_import", "module": node.module or "", "name": a.name, "alias": a.asname,
                 "line_no": node.lineno}
                for a in node.names)
    # only long lines are reported, see the scan
    long = {n for n, line in enumerate(source.split("\n"), 1) if len(line) > LONG}
    facts["node_lines"] = [{"line_no": n, "nodes": per_line[n]} for n in sorted(long & per_line.keys())]
    return facts


def _facts_batch(sources: pa.Array) -> pa.Array:
    return pa.array((None if s is None else python_facts(s) for s in sources.to_pylist()), type=_ARROW_FACTS)


_facts_batch.__annotations__ = {"sources": pa.Array, "return": pa.Array}


def syntax_facts(content: Column) -> Column:
    """Struct of parser facts; null where ``content`` is null."""
    return F.arrow_udf(_facts_batch, FACTS_SCHEMA)(content)


def syntax_rows(files: DataFrame) -> DataFrame:
    """Facts in long form: one row per function, class, import, line with nodes, or syntax error."""
    parsed = files.filter("language = 'python'").select("repo", "path", syntax_facts(F.col("content")).alias("facts"))

    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def row(kind, line_no, name=none_s, n_args=none_i, decision_points=none_i, module=none_s, alias=none_s, nodes=none_i):
        return F.struct(
            F.lit(kind).alias("kind"), line_no.alias("line_no"), name.alias("name"), n_args.alias("n_args"),
            decision_points.alias("decision_points"), module.alias("module"), alias.alias("alias"),
            nodes.alias("nodes"))

    rows = F.concat(
        F.transform("facts.functions", lambda f: row(
            "function", f.line_no, f["name"], f.n_args, f.decision_points)),
        F.transform("facts.classes", lambda c: row("class", c.line_no, c["name"])),
        F.transform("facts.imports", lambda i: row(
            "import", i.line_no, i["name"], module=i.module, alias=i["alias"])),
        F.transform("facts.node_lines", lambda n: row("node_line", n.line_no, nodes=n.nodes)),
        F.when(F.col("facts.syntax_error").isNotNull(), F.array(row(
            "syntax_error", F.col("facts.syntax_error.line_no"), F.col("facts.syntax_error.message"))))
        .otherwise(F.array().cast("array<struct<kind:string,line_no:int,name:string,n_args:int,"
                                  "decision_points:int,module:string,alias:string,nodes:int>>")),
    )
    return parsed.select("repo", "path", F.explode(rows).alias("r")).select("repo", "path", "r.*")
