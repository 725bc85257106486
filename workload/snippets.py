"""Code appended to the derived files so that every rule has hits and near misses."""

from __future__ import annotations

LONG = "a" * 130

PYTHON = [
    """import os
import subprocess, pickle as pk
from os import path as p, sep
password = "hunter2"
api_key = 'abc'
apikey == "near miss"
secret = "s3"
token = 't0'
os.system("ls")
result = eval("1 + 1")
exec("x = 1")
subprocess.call("ls", shell=True)
subprocess.call("ls", shell=False)
pickle.loads(b"x")
pickle.load (f)
evaluate = 1""",
    """class Shape:
    def area(self, a, b, c, d, e, f, g):
        if a and b or c:
            return [x for x in a if x]
        for i in b:
            while c:
                c -= 1
        return None

async def fetch(url, tries):
    try:
        async for part in url:
            yield part
    except ValueError:
        return
    except (OSError, KeyError):
        return

def outer(a, b, c, d, e, f, g):
    def inner(z):
        return z if z else None
    return inner""",
    """total = ""
for i in range(3): total += str(i)
while total: total += "x"
total += "near miss"
out = []
for x in out: out.append(x)
for i in range(len(out)): print(out[i])
formatted = "sql" + "x".format()""",
    f"""value = "{LONG}"
# {LONG}
# TODO: tidy
# fixme later
TODO = 1""",
    """x = 1
def broken(:
    pass""",
    "",
    "def decide(x):\n" + "\n".join(f"    if x == {n}: return {n}" for n in range(16)),
    """from . import sibling
from ..pkg import *
import a.b.c as d""",
]

JAVASCRIPT = [
    """var apiKey = "sk-1";
const password = 'pw';
const r = eval(code);
el.innerHTML = value;
document.write(value);
const f = new Function("return 1");
evaluate(x)""",
    """console.log("x");
variable = 1;
if (a == b) { run(); }
if (a === b) { run(); }
if (a != b) { run(); }
  console.warn('y')  """,
    """for (let i = 0; i < n; i++) { document.getElementById("x"); }
while (on) document.querySelector("y");
document.querySelector("z");
if (list.indexOf(x) > -1) { run(); }
if (list.indexOf(x) !== -1) { run(); }
if (list.indexOf(x) >= 1) { run(); }""",
    """class Box {
  constructor() { this.x = 1; }
}
async function load() { return 1; }
const add = (a, b) => a + b;
let sub = (a, b) => { return a - b; };
function main() {
  if (a) { one(); } else if (b) { two(); }
  for (let i = 0; i < 2; i++) { }
  while (c) { }
  switch (d) { case 1: break; case 2: break; }
  try { e(); } catch (err) { }
  return f ? g : h;
}
// comment
/* comment */""",
    """import x from 'y';
import {a, b} from "m";
import * as ns from 'n';
import 'side-effect';
const z = require('fs');
const {q, s} = require( "path" );
let w = require('near-miss');""",
    f"""// TODO: one
// fixme two
// Hack three
const sql = "select " + name.format();
for (i in range(len(x))) {{ }}
const long = "{LONG}";""",
]

SNIPPETS = {
    ".py": PYTHON,
    ".js": JAVASCRIPT,
    ".ts": JAVASCRIPT[1:] + JAVASCRIPT[:1],
    ".java": [
        """import java.util.List;
import static org.junit.Assert.*;
import near miss;
class A { void f() { System.out.println("x"); } }""",
        """try { f(); } catch (Exception e) { }
try { f(); } catch (Exception e) { log(e); }
System.err.println("near miss");
// secret = "in a comment\"""",
    ],
    ".go": [
        """package main
import "fmt"
import (
    "os"
    alias "strings"
    "net/http"
)
func main() { fmt.Println("x") }""",
        """import ()
import "a/b"; import "c/d"
token := "near miss"
token = "hit\"""",
    ],
    ".sql": [
        """SELECT 'a' + 'b';
SELECT "a" || "b";
EXECUTE("SELECT %s");
execute('SELECT 1');""",
        """-- comment
/* comment */
SELECT 1 + 1;
execute ( 'x%y' ) + "z\"""",
    ],
    ".yml": [
        # plain YAML
        """name: value
password: "abcdefgh12"
key: short
url: http://user:pw@host/x
url: http://host/x
\ttab: 1
trailing: 1  
 odd: 1
  even: 2
   
token: ab""",
        # Ansible with become
        """- hosts: all
  become: yes
  vars:
    a: 1
  tasks:
    - name: one
      shell: echo {{ user_input }}
    - name: two
      shell: sudo ls
    - name: three
      file: path=/x mode: 777
    - name: four
      file:
        mode: "0777"
    - name: five
      file:
        mode: '775'
    - name: six
      copy:
        src: {{ base }}/x
    - name: seven
      copy:
        src: "{{ base | quote }}"
    - debug: msg="the password"
    - debug: msg="near miss"
      when: a""",
        # Ansible without become
        """- hosts: web
  gather_facts: no
  tasks:
    - shell: sudo apt install x
    - command: git clone x
    - command: echo x
    - name: a
      shell: Systemctl restart x {{ item }}
      with_items: [1, 2]
      notify: later""",
        # users and passwords
        """- hosts: db
  tasks:
    - mysql_user: name=a password=b
    - user: name=c password=d
      no_log: true
    - postgresql_user: name=e
    - user: name=g password=h
    # filler filler filler filler filler filler filler filler filler filler filler filler filler filler filler filler
    # filler filler filler filler filler filler filler filler filler filler filler filler filler filler filler filler
    - user: name=g password=h
  handlers:
    - x""",
        # look ahead for a condition
        """- hosts: all
  tasks:
    - shell: a
      register: one
    - b
    - c
    - d
    - e
    - f
      when: one
    - shell: g
      register: two
      when: two
    - h
    - i
    - j
    - k
    - shell: l
      register: near_the_end
    - m""",
        # a playbook without tasks
        """- hosts: all
  vars:
    - a: 1
  handlers:
    - name: only""",
        # many tasks
        "- hosts: all\n  become: yes\n  tasks:\n" + "\n".join("    - name: t" for _ in range(51)),
        # deprecated syntax
        """- hosts: all
  tasks:
    - include: other.yml
    - include_tasks: other.yml
      sudo: yes
      sudo_user: root
      always_run: yes
    - x: {{ unquoted }}
    - y: "{{ quoted }}"
    - secret: abc
      register: r""",
        # named like a playbook, see SITE
        """- import: x
  src: {{ y }}""",
    ],
    ".rb": ["# comment\nPassword = 'x'\nputs 1", "token = \"x\"\n// near miss"],
    ".php": [
        "shell_exec('ls');\nsystem('ls');\n# eval('x');\n// exec('x');\n/* x */",
        "$secret_key = 'x';\n$access_token = \"y\";\n$api_key = input('z');\n$password = 'p';",
    ],
    ".html": ["<script>var t = 1;</script>\n<input token='x' secret = \"y\">"],
    ".txt": ["password = 'not analysed'"],
}
SNIPPETS[".yaml"] = SNIPPETS[".yml"][3:] + SNIPPETS[".yml"][:3]

# which snippet of an extension is stored under a playbook's name
SITE = {".yml": 8, ".yaml": 5}

EXTENSIONS = [".py", ".js", ".ts", ".java", ".go", ".sql", ".yml", ".yaml", ".rb", ".php", ".html", ".txt"]
FOLDERS = ["src/", "node_modules/lib/", ".config/", "app/build/", "src/main.log/", "lib/env", "src/a/", "src/b/", ""]
