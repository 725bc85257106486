"""Every rule against lines that it must and must not report, and patterns against Python's re."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from codesieve.functions.text import PY_WHITESPACE, rx, strip
from codesieve.operators import metrics, rule_tables, scan
from codesieve.plans.review import profile_review, review
from codesieve.rules import Rule, matches, register, rules, unregister

ANSIBLE = "hosts: x\nbecome: y\ntasks: z\n"
NO_BECOME = "hosts: x\nvars: y\ntasks: z\n"

# rule, extension, text before the line, line that is reported, line that is not
CASES = [
    ("R01", ".go", "", "Password = 'x'", "password = x"),
    ("R02", ".go", "", 'API-KEY="x"', "api key = 'x'"),
    ("R03", ".go", "", "secret='x'", "secret=''"),
    ("R04", ".go", "", "my_token = \"x\"", "token: 'x'"),
    ("R05", ".py", "", "evaL (x)", "evaluate(x)"),
    ("R06", ".py", "", "exec(x)", "execute(x)"),
    ("R07", ".py", "", "os.system (x)", "os_system(x)"),
    ("R08", ".py", "", "subprocess.call(x, shell = True)", "subprocess.run(x, shell=True)"),
    ("R09", ".py", "", "pickle.load(x)", "pickle.dump(x)"),
    ("R10", ".ts", "", "eval(x)", "evil(x)"),
    ("R11", ".js", "", "a.innerHTML  = x", "a.innerText = x"),
    ("R12", ".js", "", "document.write(x)", "document.writeln(x)"),
    ("R13", ".tsx", "", "new Function('x')", "newFunction('x')"),
    ("R14", ".sql", "", "'a' + b + 'c'", "'a' || 'c'"),
    ("R15", ".sql", "", "EXECUTE('a%b')", "EXECUTE('ab')"),
    ("R19", ".js", "", "console.debug(x)", "console.table(x)"),
    ("R20", ".js", "", "  var x", "variable x"),
    ("R21", ".js", "", "a == b", "a === b"),
    ("R22", ".java", "", "System.out.println(x)", "System.err.println(x)"),
    ("R23", ".java", "", "catch (E e) { }", "catch (E e) { f(); }"),
    ("R24", ".py", "", "for x in y: z += x", "z += x"),
    ("R25", ".py", "", "for x in y: z.append(x)", "z.append(x)"),
    ("R26", ".js", "", "while (x) document.querySelector(y)", "document.querySelector(y)"),
    ("R27", ".js", "", "a.indexOf(b) >= -1", "a.indexOf(b) == -1"),
    ("R28", ".yml", "", "key: abcd1234", "key: abc"),
    ("R29", ".yaml", "", "http://u:p@h", "http://h"),
    ("R30", ".yml", ANSIBLE, "command: x {{ item }}", "command: x {{ y }}"),
    ("R31", ".yml", NO_BECOME, "shell: sudo x", "shell: x"),
    ("R32", ".yml", ANSIBLE, "mode: '777'", "mode: 0777"),
    ("R33", ".yml", ANSIBLE, "src: {{ x }}", "src: {{ x |quote }}"),
    ("R34", ".yml", ANSIBLE, "debug: var: my_KEY", "debug: x: key"),
    ("R35", ".yml", ANSIBLE, "user: x password: y", "user: x no_log: 1 password: y"),
    ("R36", ".yml", "", "a:\tb", "a: b"),
    ("R37", ".yml", "", "a: b ", "   "),
    ("R38", ".yml", "", "   a: b", "  a: b"),
    ("R39", ".yml", ANSIBLE, "- include: x", "- include_tasks: x"),
    ("R40", ".yml", ANSIBLE, "sudo: yes", "sudo yes"),
    ("R41", ".yml", ANSIBLE, "sudo_user: x", "become_user: x"),
    ("R42", ".yml", ANSIBLE, "always_run: x", "run: x"),
    ("R43", ".yml", ANSIBLE, "a: {{ b }}", "a: '{{ b }}'"),
    ("R44", ".yml", ANSIBLE, "Token: a", "tokens: a"),
    ("R48", ".yml", ANSIBLE, "shell: GIT CLONE x", "shell: svn x"),
    ("R50", ".yml", ANSIBLE, "with_items: x", "loop: x"),
    ("R51", ".py", "", "PASSWORD = 'x'", "# password = 'x'"),
    ("R52", ".py", "", "api_key = 'x'", "api_key = input('x')"),
    ("R53", ".py", "", "secret_key = \"x\"", "secret_key = x"),
    ("R54", ".py", "", "access_token='x'", "access_token 'x'"),
    ("R55", ".py", "", "x = eval(y)", " # eval(y)"),
    ("R56", ".py", "", "shell_exec(y)", "execute(y)"),
    ("R57", ".py", "", "os.system(y)", "system y"),
    ("R58", ".py", "", "shell_exec(y)", "exec(y)"),
    ("R59", ".py", "", "é" * 121, "é" * 120),
    ("R60", ".py", "", "# hAcK", "# to do"),
    ("R61", ".py", "", "for i in range(len(x))", "range(len(x))"),
    ("R62", ".py", "", "monkey = 1", "monkey"),
    ("R63", ".py", "", "exec(x)", "exec (x)"),
    ("R64", ".py", "", "x" * 121, "x" * 120),
    ("R65", ".py", "", "for i in range(len(x))", "for i of x"),
    ("R66", ".py", "", "PassWord=1", "password 1"),
    ("R67", ".py", "", "mySQL + x", "sql x"),
    ("R68", ".py", "", "eval(x)", "eval x"),
    ("R69", ".py", "", "x" * 121, "x" * 120),
    ("R70", ".py", "", "  FIXME x", "# TODO x"),
]


def test_lines(corpus_of):
    files = {}
    for rule, ext, before, hit, miss in CASES:
        files[f"{rule}_hit{ext}"] = before + hit
        files[f"{rule}_miss{ext}"] = before + miss
    corpus = corpus_of(files)
    found = {(i.path, i.rule_id) for i in scan.issues(review(corpus)).collect()}
    for profile in ("web", "interactive", "quick"):
        found |= {(i.path, i.rule_id) for i in scan.issues(profile_review(corpus, profile)).collect()}
    for rule, ext, *_ in CASES:
        assert (f"{rule}_hit{ext}", rule) in found, f"{rule} misses its line"
        assert (f"{rule}_miss{ext}", rule) not in found, f"{rule} reports too much"
    covered = {c[0] for c in CASES} | {"R16", "R17", "R18", "R45", "R46", "R47", "R49", "R71"}
    assert covered == {r.id for p in ("core", "web", "interactive", "quick") for r in rules(p)}


def test_whole_file_rules(corpus_of):
    files = {
        "tasks.yml": "hosts: a\nvars: b\nbecome: c\n",
        "many.yml": ANSIBLE + "- name: x\n" * 51,
        "few.yml": ANSIBLE + "- name: x\n" * 50 + "# doc",
        "ahead.yml": ANSIBLE + "register: a\n" + "x\n" * 4 + "when: b\nregister: c\n" + "x\n" * 5 + "when: d\n",
        "end.yml": ANSIBLE + "register: a\n" + "x\n" * 4,
        "main.yml": "src: {{ x }}",
        "window.yml": ANSIBLE + "user: a password: b\n" + "x" * 199 + "\nno_log: 1\nuser: c password: d\n  no_log: 1",
        "far.yml": ANSIBLE + "user: a password: b\n" + "x" * 250 + "\nno_log: 1",
        # the second line's text first occurs inside the first line, which ends in no_log
        "inside.yml": ANSIBLE + "x user: a password: b\nno_log: 1\n" + "y\n" * 200 + "user: a password: b",
    }
    found = {(i.path, i.rule_id, i.line_no, i.description) for i in scan.issues(review(corpus_of(files))).collect()}
    short = {f[:2] for f in found}
    assert ("tasks.yml", "R45") in short and ("many.yml", "R46", 1, "Playbook has 51 tasks, consider breaking into roles") in found
    assert ("few.yml", "R46") not in short and ("few.yml", "R47") not in short and ("many.yml", "R47") in short
    assert {f[2] for f in found if f[:2] == ("ahead.yml", "R49")} == {10}
    assert ("end.yml", "R49") not in short and ("main.yml", "R33") in short
    assert ("window.yml", "R35") not in short or {f[2] for f in found if f[:2] == ("window.yml", "R35")} == {4}
    assert ("far.yml", "R35") in short and ("inside.yml", "R35") not in short


# text behind the playbook's first three lines, lines that R35 reports
NO_LOG = [
    ("user: a password: b", [4]),
    ("mysql_user: password", [4]),
    ("user: a password: b no_log: x", []),
    ("user: a password: b\nno_log: x", []),
    ("no_log: x\nuser: a password: b", [5]),  # only what comes after counts, and the line itself
    ("user: a password: b\n" + "x" * 192 + "no_log:", []),  # the last of 200 characters
    ("user: a password: b\n" + "x" * 193 + "no_log:", [4]),
    ("user: a password: b\n" + "é" * 300 + "\nno_log: x", [4]),
    ("user: a password: b\nno_log: x\ny\n" + "z\n" * 150 + "user: a password: b", []),  # the same text: its first place counts
    ("user: a password: b\n" + "z\n" * 150 + "user: a password: b\nno_log: x", [4, 155]),
    ("user: a", []), ("password: b", []),
]


def test_no_log_windows(corpus_of):
    found = scan.issues(review(corpus_of({f"f{n}.yml": ANSIBLE + text for n, (text, _) in enumerate(NO_LOG)}))).filter("rule_id = 'R35'").collect()
    for n, (_, lines) in enumerate(NO_LOG):
        assert sorted(f.line_no for f in found if f.path == f"f{n}.yml") == lines, n


def test_look_ahead(corpus_of):
    random.seed(3)
    pieces = ["register: r", "when: c", "y", "", "x" * 90]
    files = {f"f{n}.yml": ANSIBLE + "\n".join(random.choices(pieces, k=random.randint(1, 25))) for n in range(40)}
    found = scan.issues(review(corpus_of(files))).filter("rule_id = 'R49'").collect()
    for path, text in files.items():
        lines = text.split("\n")
        ahead = {i for i, line in enumerate(lines, 1) if "register:" in line and i < len(lines) - 5
                 and not any("when:" in other for other in lines[i:i + 5])}
        assert {f.line_no for f in found if f.path == path} == ahead


def test_long_lines_end(corpus_of):
    """One line of a mebibyte that a backtracking search would take hours for."""
    n = 1 << 20
    texts = {
        "quotes.sql": "'" * (n // 2) + "+" + "x" * (n // 2), "plus.sql": "'+" * (n // 2), "percent.sql": "execute('" + "%" * n,
        "marks.js": "? " * (n // 2), "marks2.js": "?" * n + "\n" + " " * 100, "index.js": ".indexOf(" * (n // 9), "arrow.js": "let " + "a" * n,
        "catch.java": "catch (" * (n // 7) + "}", "braces.yml": ": {{" * (n // 4) + "}", "braces2.yml": "}}" + ": {{" * (n // 4),
        "url.yml": "@" + "http://a:b" * (n // 10), "shell.yml": ANSIBLE + "shell:" * (n // 6) + "sud", "key.yml": "key:" + " " * n,
        "call.py": "# " + "subprocess.call(" * (n // 16), "loop.py": "# " + "for a in : " * (n // 11) + ".append(",
        "require.mod": "require (" * (n // 9),
    }
    started = time.time()
    found = {(i.path, i.rule_id) for i in scan.issues(review(corpus_of(texts))).collect()}
    assert ("plus.sql", "R14") in found and ("quotes.sql", "R14") not in found
    assert time.time() - started < 120


def test_rewritten_patterns_against_their_definition(corpus_of):
    """Rules that are searched in one pass, beside the patterns that define them."""
    random.seed(11)
    # The patterns that define the rules.
    defined = {
        "R08": (".py", True, r"subprocess\.call\s*\([^)]*shell\s*=\s*True", ["subprocess.call", "(", ")", "shell", "=", " ", "True", "x", "TRUE"]),
        "R14": (".sql", True, r"""['"].*\+.*['"]""", ["'", '"', "+", "a", " "]),
        "R15": (".sql", True, r"""execute\s*\(\s*['"][^'"]*%[^'"]*['"]""", ["execute", "(", "'", '"', "%", "a", " "]),
        "R23": (".java", False, r"catch\s*\([^)]+\)\s*\{\s*\}", ["catch", "(", ")", "{", "}", " ", "E"]),
        "R25": (".py", False, r"for\s+\w+\s+in\s+.*:\s*\w+\.append\(", ["for", " ", " in ", "x", ":", ".append(", "y"]),
        "R27": (".js", False, r"\.indexOf\(.*\)\s*[><!]=?\s*-?1", [".indexOf(", ")", ">", "=", "-", "1", " ", "x"]),
        "R29": (".yml", False, r"https?://[^:]+:[^@]+@", ["http", "s", "://", ":", "@", "u"]),
        "R31": (".yml", False, r"(shell|command):.*sudo", ["shell", "command", ":", "sudo", " ", "x"]),
    }
    for rule, (ext, fold, pattern, parts) in defined.items():
        lines = ["".join(random.choices(parts, k=random.randint(2, 12))) for _ in range(600)]
        lines = ["# " + x for x in lines] if ext == ".py" else lines
        files = {f"{rule}{ext}": (NO_BECOME if rule == "R31" else "") + "\n".join(lines)}
        found = {i.line_no for i in scan.issues(review(corpus_of(files))).filter(F.col("rule_id") == rule).collect()}
        before = 3 if rule == "R31" else 0
        want = {n + before for n, x in enumerate(lines, 1) if re.search(pattern, x, re.IGNORECASE if fold else 0)}
        assert found == (want if rule != "R31" or "become:" not in files[f"{rule}{ext}"] else set()), rule


def test_long_python_lines(corpus_of):
    text = "x = '" + "a" * 130 + "'\n# " + "b" * 130 + "\ndef f(a, b, c, d, e, f, g, h): pass\n"
    once = scan.issues(review(corpus_of({"a.py": text}))).filter("type = 'long_line'").collect()
    assert [(i.line_no, i.description) for i in once] == [(1, "Line length 136 exceeds 120 characters")]
    nodes = review(corpus_of({"a.py": text}), per_node_long_lines=True).first()
    assert sum(i.type == "long_line" for i in nodes.issues) == 3
    assert any(i.description == "Function has 8 arguments (max recommended: 7)" for i in nodes.issues)
    broken = scan.issues(review(corpus_of({"b.py": "x = 1\ndef f(:\n"}))).first()
    assert (broken.type, broken.line_no, broken.description) == ("syntax_error", 2, "Syntax error: invalid syntax (<unknown>, line 2)")


PATTERNS = [(p, True) for p in [*metrics.JS_FUNCTIONS, *metrics.JS_CLASSES, *metrics.JS_DECISIONS]] + [
    (r"""password\s*=\s*['"][^'"]+['"]""", True), (r"[^=!]==[^=]", False), (r"\bvar\s+\w+", False),
    (r"\.indexOf\(.*\)\s*[><!]=?\s*-?1", False), (r"for\s+\w+\s+in\s+.*:\s*\w+\.append\(", False),
    (r"""(password|secret|key|token|api_key):\s*["']?[a-zA-Z0-9_\-+=\/]{8,}["']?""", True),
    (r"https?://[^:]+:[^@]+@", False), (r":\s*\{\{.*\}\}", False), (r"catch\s*\([^)]+\)\s*\{\s*\}", False),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_patterns_agree_with_python(spark, seed):
    random.seed(seed)
    parts = ["password", "=", " = ", "'x'", '"', "==", "!=", "var", " ", "été", "\u00a0", "\u2028", "\x85", "\t", "\n", "function", "if (", "else if(",
             "?", ":", "x", ".indexOf(", ")", "> -1", "for", " in ", "y", ".append(", "key: ", "abcd1234", "https://u:p@h", "{{", "}}", "=>",
             "const a = (", "class", "case ", "catch (e) { }", "ſ", "CLASS É", "_", "async function", "1"]
    texts = ["".join(random.choices(parts, k=random.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    counts = df.select("id", *[F.regexp_count("t", F.lit(rx(p, ci))).alias(f"c{n}") for n, (p, ci) in enumerate(PATTERNS)]).collect()
    for row in counts:
        for n, (p, ci) in enumerate(PATTERNS):
            want = sum(1 for _ in re.finditer(p, texts[row.id], re.IGNORECASE if ci else 0))
            assert row[f"c{n}"] == want, (p, texts[row.id])


# One pattern per kind of function and decision, to be counted apart.
SINGLE = {
    "functions": [r"function\s+\w+", r"const\s+\w+\s*=\s*\(", r"let\s+\w+\s*=\s*\(", r"var\s+\w+\s*=\s*\(", r"=>", r"async\s+function"],
    "classes": [r"class\s+\w+"],
    "cyclomatic_complexity": [r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bwhile\s*\(", r"\bfor\s*\(", r"\bswitch\s*\(", r"\bcase\s+",
                              r"\bcatch\s*\(", r"\?\s*.*\s*:"],
}


def test_javascript_counts_against_single_patterns(corpus_of):
    random.seed(5)
    parts = ["if", "while", "for", "switch", "catch", "case", "else", "(", " ", " ", "\n", "const", "let", "var", "function", "async", "=>", "=",
             "= (", "a", "É", "_", "\u00a0", "?", ":", "class", "IF", "Case\t", "x1"]
    files = {f"f{n}.js": "".join(random.choices(parts, k=random.randint(1, 60))) for n in range(400)}
    for row in review(corpus_of(files)).select("path", *SINGLE).collect():
        for name, patterns in SINGLE.items():
            want = sum(len(re.findall(p, files[row.path], re.IGNORECASE)) for p in patterns)
            assert row[name] == want, (name, files[row.path])


def test_strip_is_pythons(spark):
    texts = [ch + "a" + ch for ch in PY_WHITESPACE] + ["\u200ba\ufeff", "  é ", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip() for r in rows)


def test_own_rules(corpus_of, spark):
    register(Rule("X01", "core", "quality", "quality", "chain", "low", "Long chain of {n}", "mine",
                  matches(r"(\.\w+\(\)){3,}"), dialects=("java",), needs=(".",)))
    try:
        found = scan.issues(review(corpus_of({"a.java": "a.b().c().d()\na.b()", "a.go": "a.b().c().d()"}))).collect()
        assert [(i.path, i.rule_id, i.description) for i in found] == [("a.java", "X01", "Long chain of 13")]
        with pytest.raises(ValueError):
            register(Rule("X01", "core", "q", "quality", "t", "low", "m", None))
        with pytest.raises(ValueError):
            register(Rule("X02", "core", "q", "quality", "t", "low", "m", None, dialects=("cobol",)))
    finally:
        unregister("X01")
    register(Rule("Y01", "house", "quality", "quality", "tabs", "low", "Tab", None, needs=("\t",)))
    try:
        files = corpus_of({"a.go": "\tx"}).withColumn("language", F.lit("go")).withColumn("content", F.col("raw").cast("string"))
        assert scan.issues(scan.with_issues(files, "house")).count() == 1
    finally:
        unregister("Y01")


def test_rule_table(spark):
    lines = spark.createDataFrame(
        [("r", f"p{n % 7}", n, "python" if n % 3 else None, f"x{n} token") for n in range(300)],
        "repo string, path string, line_no int, language string, line string")
    rows = [("A", None, "x1"), ("B", "python", "token$"), ("C", "go", "x"), ("B", None, "x2"), ("D", "python", None), ("A", None, "x1")]
    rows += [(f"M{n % 9}", ["python", None, "go"][n % 3], f"x{n}1 ") for n in range(250)]
    table = spark.createDataFrame(rows, "rule_id string, language string, pattern string")
    found = sorted((r.rule_id, r.pattern, r.line_no) for r in rule_tables.scan_with_rule_table(lines, table).collect())
    want = sorted(
        (i, p, n) for n in range(300) for i, language, p in rows
        if p is not None and (language is None or (language == "python" and n % 3)) and re.search(p, f"x{n} token"))
    assert found == want
    assert rule_tables.scan_with_rule_table(lines, table.limit(0)).count() == 0
