"""The derived tables, built in Spark. ``workload.oracle_base`` builds the same ones in SQL."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.sources.files import from_table, spread
from workload.snippets import EXTENSIONS, FOLDERS, SITE, SNIPPETS

MANIFESTS = [
    "requirements.txt", "package.json", "Pipfile", "pyproject.toml", "go.mod", "Cargo.toml", "requirements-dev.txt",
    "docs/requirements.txt", "pom.xml", "composer.json",
]


# columns the derivations use; giving them saves a look into the files
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, dealt out: the given tables are single files."""
    return spread(table(spark, sf_dir, name), int(spark.conf.get("spark.sql.shuffle.partitions")))


def _array(values) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def _fixed(files: DataFrame) -> DataFrame:
    """The same rows behind a generator, so that a filter on a derived column does not repeat its derivation."""
    return files.select(F.inline(F.array(F.struct(*files.columns))))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(repo, path, size, raw)``: every document and page as a source file.

    Documents get an extension, a folder and a snippet by their id; prose in Python files is commented
    out, so that the snippet decides whether the file parses. Some files have CRLF line ends, some
    start with a NUL, some cannot be read.
    """
    docs = _placed(texts(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    snippet = F.element_at(F.element_at(_snippets(), F.col("ext")), F.col("k") + 1)
    body = F.when(F.col("ext") == ".py", F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))).otherwise(F.col("text"))
    content = F.concat(body, F.lit("\n"), snippet)
    content = F.when(F.col("step") % 5 == 4, F.replace(content, F.lit("\n"), F.lit("\r\n"))).otherwise(content)
    content = F.when(F.col("doc_id") % 89 == 7, F.concat(F.lit("\0"), content)).otherwise(content)
    content = F.when(F.col("doc_id") % 97 != 5, content)
    pages = texts(spark, sf_dir, "pages")
    return _fixed(from_table(docs, F.col("source"), F.col("path"), content)).unionByName(
        from_table(pages, _page_repo(), _page_path(), F.col("html")))


def _snippets():
    return F.from_json(F.lit(json.dumps(SNIPPETS)), "map<string, array<string>>")


def _placed(docs: DataFrame) -> DataFrame:
    """Documents with the path of the file made from each, its extension and the number of its snippet."""
    step = F.floor(F.col("doc_id") / 12)
    ext = F.element_at(_array(EXTENSIONS), (F.col("doc_id") % 12 + 1).cast("int"))
    sizes = F.create_map(*[F.lit(x) for e, texts_ in SNIPPETS.items() for x in (e, len(texts_))])
    placed = docs.withColumns({"ext": ext, "step": step}).withColumn("k", (F.col("step") % F.element_at(sizes, F.col("ext"))).cast("int"))
    folder = F.element_at(_array(FOLDERS), (F.col("step") % len(FOLDERS) + 1).cast("int"))
    site = F.lit(False)
    for e, k in SITE.items():
        site = site | ((F.col("ext") == e) & (F.col("k") == k))
    name = F.when(site, F.concat(F.lit("play_"), "doc_id", F.lit("/site"), "ext")).otherwise(
        F.concat(F.lit("doc_"), "doc_id", "ext"))
    return placed.withColumn("path", F.concat(folder, name))


def _page_repo():
    return F.regexp_extract("url", "https?://([^/]+)", 1)


def _page_path():
    return F.concat(F.lit("page_"), "page_id", F.lit(".html"))


def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, path`` of the same files; no text is read."""
    docs = _placed(table(spark, sf_dir, "documents").select("doc_id", "source"))
    pages = table(spark, sf_dir, "pages").select(_page_repo().alias("repo"), _page_path().alias("path"))
    return docs.select(F.col("source").alias("repo"), "path").unionByName(pages)


#: A TOML section that lists nothing, though its text and its list look as if they did.
DECOY = '''[notes]
text = """
[dependencies]
no = "1" \\"""
[tool.poetry.dependencies]
no = "1"
"""
list = [
  "[dev-dependencies]", # {
  {no = 1, "dependencies" = {no = 2}},
]
'''


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the cluster shares, for queries that write tables and read them back; a local session may have none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="codesieve-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files``: ten documents make a repository with ten manifests, their words are its packages."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)))
    docs = texts(spark, sf_dir, "documents").select(
        F.concat(F.lit("org/r"), F.floor(F.col("doc_id") / 10)).alias("repo"),
        F.element_at(_array(MANIFESTS), (F.col("doc_id") % 10 + 1).cast("int")).alias("path"),
        "doc_id", "text", words.alias("w"))

    def each(before, after, source="w"):
        return F.transform(source, lambda w: F.concat(F.lit(before), w, F.lit(after)))

    def joined(separator, items):
        return F.array_join(items, separator)

    upper = F.filter("w", lambda w: w.rlike("^[A-Z]"))
    lower = F.filter("w", lambda w: ~w.rlike("^[A-Z]"))
    way = (F.floor(F.col("doc_id") / 10) % 3 + 1).cast("int")
    content = (
        F.when(F.col("path").endswith("requirements.txt"), F.concat(
            "text", F.lit("\nflask>=1.0\n# comment\n-r other.txt\n\n  numpy == 1.2 \npkg~=1\n!x\n")))
        .when(F.col("path") == "requirements-dev.txt", joined("\n", each("", "<2 ; python_version > '3'")))
        .when(F.col("path") == "package.json", F.concat(
            F.lit('{"name": "x", "dependencies": {'), joined(", ", each('"', '": "1"', lower)),
            F.lit('}, "devDependencies": {'), joined(", ", each('"', '": "1"', upper)),
            F.lit('}, "optionalDependencies": {"opt": "1"}}')))
        .when(F.col("path") == "Pipfile", F.concat(
            F.lit("[[source]]\nurl = \"x\"\n[packages]\n"), joined("\n", each("", ' = "*"', lower)),
            F.lit("\n# no = 1\n  [dev-packages]\n"), joined("\n", each('"', '" = "*"', upper)),
            F.lit("\n[requires]\npython_version = \"3\"\n")))
        .when(F.col("path") == "pyproject.toml", F.element_at(F.array(
            # below headers; as an inline table and dotted keys; behind quoted headers, between texts and lists that hold no key
            F.concat(
                F.lit("[tool.poetry.dependencies]\npython = \"3\"\n"), joined("\n", each("", ' = "1"', lower)),
                F.lit("\n[tool.poetry.group.dev.dependencies]\n"), joined("\n", each("", ' = "1"', upper)), F.lit("\n")),
            F.concat(
                F.lit("[tool.poetry]\nname = 'x' # = {\ndependencies = {python = \"3\", "),
                joined(", ", each("", ' = {version = "1", extras = ["a", "b"]}', lower)),
                F.lit("}\n"), joined("\n", each('group.dev . dependencies."', '" = "1"', upper)), F.lit("\n")),
            F.concat(
                F.lit(DECOY + "[ tool.\"poetry\" . 'dependencies' ]\n"), joined("\n", each("'", "'.version = '''\n[x]\nno = 1\\'''", lower)),
                F.lit("\n" + DECOY.replace("[notes]", "[more.notes]")), joined("\n", each("[tool.poetry.group.dev.dependencies.", "] # [x]\noptional = true", upper)), F.lit("\n"))),
            way))
        .when(F.col("path") == "Cargo.toml", F.element_at(F.array(
            F.concat(
                F.lit("[dependencies]\n"), joined("\n", each("", ' = "1"', lower)),
                F.lit("\n[dev-dependencies]\n"), joined("\n", each("", ' = "1"', upper)), F.lit("\n")),
            F.concat(
                F.lit("dependencies = {"), joined(", ", each("", " = { version = '1', features = [\"a#\", \"b=\"] }", lower)),
                F.lit("}\n"), joined("\n", each("dev-dependencies.", ".version = \"1\"", upper)), F.lit("\n")),
            F.concat(
                F.lit(DECOY + "[\"dependencies\"]\n"), joined("\n", each('"', '" = [\n  "no = 1", # ]\n  { no = 1 },\n]', lower)),
                F.lit("\n" + DECOY.replace("[notes]", "[more.notes]")), joined("\n", each("['dev-dependencies'.", "]\nversion = \"\\\"\"", upper)), F.lit("\n"))),
            way))
        .when(F.col("path") == "go.mod", F.concat(
            F.lit("module x\nrequire (\n  in/block v1\n)\n"), joined("\n", each("require example.com/", " v1"))))
        .otherwise(F.col("text"))
    )
    return _fixed(from_table(docs, F.col("repo"), F.col("path"), content))


REPO_LANGUAGES = ["python", "JavaScript", "Java", "go", "C++", None, "rust", "COBOL"]
WORDS = ["django web app", "Flask API", "react and next", "spring maven", "maintain", "plain", "PyTorch neural", "vue", "hibernate"]
TOPICS = ["machine-learning", "api", "express", "gradle", "web", "none"]


def repository_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record``: every part as a repository record in JSON, with a date made of its key."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), key)
    day = F.date_add(F.to_date(F.lit("1992-01-01")), (key * 37 % 2500).cast("int"))
    iso = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z"))

    def pick(values):
        return F.element_at(_array(values), (key % len(values) + 1).cast("int"))

    record = F.struct(
        key.alias("id"),
        name.alias("name"),
        F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), name).alias("full_name"),
        F.when(key % 7 == 0, None).when(key % 7 == 1, "").otherwise(F.concat("p_name", F.lit(" "), pick(WORDS))).alias("description"),
        pick(REPO_LANGUAGES).alias("language"),
        F.when(key % 3 != 0, "main").alias("default_branch"),
        (key % 5 == 0).alias("private"),
        (key % 5 == 1).alias("fork"),
        F.lit(False).alias("archived"),
        F.col("p_size").alias("size"),
        F.floor("p_retailprice").alias("stargazers_count"),
        F.array(F.lower("p_type"), pick(TOPICS)).alias("topics"),
        iso.alias("updated_at"), iso.alias("created_at"),
        F.struct(F.substring_index("p_brand", "#", 1).alias("login")).alias("owner"),
        F.when(key % 4 != 0, F.struct(F.concat("p_type", F.lit(" licence")).alias("name"))).alias("license"),
        F.when(key % 6 != 0, F.create_map(
            F.lit("Python"), F.col("p_size").cast("long"), F.col("p_type"), key)).alias("languages"),
        (key % 2 == 0).alias("has_issues"), (key % 3 == 0).alias("has_wiki"),
    )
    return part.select(F.to_json(record).alias("record"))


def config_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``updates(full_name, settings, enabled, seq)`` for every third repository, two of them for some, and for unknown ones."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    key = F.col("p_partkey")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), key)
    known = part.filter(key % 3 == 0).select(
        F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), name).alias("full_name"),
        F.create_map(F.lit("security_scan"), F.lit("false"), F.lit("owner_team"), F.col("p_type")).alias("settings"),
        F.when(key % 2 == 0, F.lit(False)).alias("enabled"), F.lit(1).alias("seq"), key.alias("key"))
    # a second update of every ninth one: one setting again, one new, the switch again for some
    again = known.filter(F.col("key") % 9 == 0).select(
        "full_name", F.create_map(F.lit("owner_team"), F.lit("second"), F.lit("check_setup_py"), F.lit("false")).alias("settings"),
        F.when(F.col("key") % 4 == 0, F.lit(True)).alias("enabled"), F.lit(2).alias("seq"))
    unknown = supplier.select(
        F.concat(F.lit("nobody/"), "s_name").alias("full_name"),
        F.create_map(F.lit("security_scan"), F.lit("false")).alias("settings"), F.lit(True).alias("enabled"), F.lit(1).alias("seq"))
    return known.drop("key").unionByName(again).unionByName(unknown)


def pull_request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record``: every order as a pull request."""
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.struct(
        F.col("o_orderkey").alias("number"),
        F.concat(F.lit("Change "), "o_orderkey").alias("title"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("merged").alias("state"),
        F.struct(F.concat(F.lit("user"), "o_custkey").alias("login")).alias("user"),
        F.struct(F.concat(F.lit("feature/"), F.col("o_orderkey") % 100).alias("ref"), sha.alias("sha")).alias("head"),
        F.struct(F.lit("main").alias("ref"), sha.alias("sha")).alias("base"),
        iso.alias("created_at"),
        (F.col("o_orderkey") % 2 == 0).alias("mergeable"),
        F.floor(F.col("o_totalprice")).alias("additions"),
        (F.col("o_orderkey") % 7).alias("deletions"),
    )
    return table(spark, sf_dir, "orders").select(F.to_json(record).alias("record"))


def tree_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record``: every order as the tree of a repository, with one folder and two files."""
    key = F.col("o_orderkey")

    def entry(path, type, size):
        return F.struct(path.alias("path"), size.alias("size"), F.sha1(path).alias("sha"), F.lit(type).alias("type"))

    tree = F.array(
        entry(F.lit("src"), "tree", F.lit(None).cast("bigint")),
        entry(F.concat(F.lit("src/f"), key, F.lit(".py")), "blob", key),
        entry(F.concat(F.lit("README-"), "o_orderpriority"), "blob", F.col("o_custkey")))
    return table(spark, sf_dir, "orders").select(
        F.to_json(F.struct(F.concat(F.lit("r"), key).alias("repo"), tree.alias("tree"))).alias("record"))


def content_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record``: every document as a file-content record, half of them base64."""
    packed = F.col("doc_id") % 2 == 0
    record = F.struct(
        F.col("source").alias("repo"), F.concat(F.lit("doc_"), "doc_id").alias("path"),
        F.when(packed, "base64").otherwise("utf-8").alias("encoding"),
        F.when(packed, F.base64(F.encode("text", "UTF-8"))).otherwise(F.col("text")).alias("content"))
    return table(spark, sf_dir, "documents").select(F.to_json(record).alias("record"))


def log_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record``: every event as a log line; clicks and sign-ups start a run, purchases and errors complete one. Some have no time."""
    message = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("Starting full analysis for repository: repo"), F.col("event_id") % 30))
        .when(F.col("event_type") == "purchase", F.concat(
            F.lit("Completed security analysis for repo"), F.col("event_id") % 20, F.lit(" in "), F.format_string("%.2f", "value"),
            F.lit("s - Found "), F.col("event_id") % 9, F.lit(" issues")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Starting repository analysis: repo"), F.col("event_id") % 30))
        .when(F.col("event_type") == "view", F.lit("Found 3 total files, 2 analyzable"))
        .otherwise(F.concat(F.lit("Repository analysis completed in "), F.format_string("%.2f", "value"), F.lit("s"))))
    record = F.struct(
        F.when(F.col("event_id") % 211 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.lit("scan."), F.col("user_id") % 50).alias("logger"),
        message.alias("message"), F.lit("analyzer").alias("module"), F.col("event_id").cast("int").alias("line"))
    return texts(spark, sf_dir, "events").select(F.to_json(record).alias("record"))


def linter_reports(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    """``repo, path, report``: every document as a report of that linter about the file made from it.

    Its lines become findings; some fields are left out, some reports and lines are not JSON.
    """
    docs = _placed(texts(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "source", "path", F.split("text", "\n").alias("lines"))
    lines = F.filter("lines", lambda l: l != "")
    level = F.element_at(_array(["very_high", "HIGH", "medium", "low", "info", "odd"]), (F.col("doc_id") % 6 + 1).cast("int"))
    some = F.col("doc_id") % 5 != 0

    def when_some(c):
        return F.when(some, c)

    reports = {
        "bandit": F.to_json(F.struct(F.transform(lines, lambda l, n: F.struct(
            when_some(F.concat(F.lit("B"), n)).alias("test_id"),
            when_some(F.upper(level)).alias("issue_severity"),
            l.alias("issue_text"),
            when_some(n + 1).alias("line_number"),
            F.lit("x = 1").alias("code"),
            F.lit("HIGH").alias("issue_confidence"))).alias("results"))),
        "ansible-lint": F.when(F.col("doc_id") % 4 == 1, F.array_join(F.transform(
            "lines", lambda l: F.concat(F.when(F.length(l) % 2 == 0, "  Error: ").otherwise("note "), l)), "\n")).otherwise(
            F.to_json(F.transform(lines, lambda l, n: F.struct(
                when_some(F.concat(F.lit("E"), n)).alias("tag"), when_some(level).alias("level"), l.alias("message"),
                when_some(n + 1).alias("linenumber"))))),
        "yamllint": F.array_join(F.transform("lines", lambda l, n: F.when(F.length(l) % 3 == 0, l).otherwise(F.to_json(F.struct(
            when_some(F.lit("style")).alias("type"),
            F.when(n % 2 == 0, "error").otherwise("warning").alias("level"), l.alias("desc"),
            (n + 1).alias("line"), when_some(F.lit("rule-x")).alias("rule"))))), "\n"),
    }
    return docs.select(F.col("source").alias("repo"), "path", reports[tool].alias("report"))
