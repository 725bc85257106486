"""Names that sections of a TOML text hold: one fold over its tokens, on the text's own row.

It runs in Python, on TOML manifests alone: carried from token to token in an expression, the state would be copied at every step, which
takes time in the square of a text.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that close, strings of three quotes and of one that do not, comments, line ends, marks, bare words, other characters.
_TOKENS = re.compile(r'''
    """(?:[^"\\]|\\.|"{1,2}(?!"))*+"{3,5}|\'\'\'(?:[^']|'{1,2}(?!'))*+'{3,5}|"""(?:.*+)|\'\'\'(?:.*+)
    |"(?:[^"\\\n]|\\[^\n])*+"|'[^'\n]*+'|["'][^\n]*+
    |\#[^\n]*+|\n|[][{}=.,]|[A-Za-z0-9_-]++|[^\s]''', re.VERBOSE | re.DOTALL)
_WORD = re.compile("[A-Za-z0-9_-]")
_KEY, _HEADER, _LIST_HEADER, _VALUE, _END = range(5)
_NOWHERE = ("",)  # a path that no section begins with


def _part(token: str) -> str | None:
    """A token as part of a key; None if it is none."""
    if token[0] in "\"'":
        if len(token) < 2 or token[-1] != token[0] or token[:3] in ('"""', "'''") and len(token) > 2:
            return None
        if token[0] == '"' and "\\" in token:
            try:
                return json.loads(token)
            except ValueError:
                pass
        return token[1:-1]
    return token if _WORD.match(token) else None


def section_names(text: str, sections: list[tuple[str, ...]]) -> list[dict[str, None]]:
    """For each section, a path, the names right below it, in the order of the text.

    Carried along: the mode, the key that is being read, the path of the section and of the value (nowhere in a list, or behind a header that does not
    close), and for each open bracket the path of its table, None for a list.
    """
    found: list[dict[str, None]] = [{} for _ in sections]

    def keep(path):
        for section, names in zip(sections, found, strict=True):
            if len(path) > len(section) and path[:len(section)] == section:
                names[path[len(section)]] = None

    mode, key, dot = _KEY, (), True
    top: tuple = ()
    path: tuple = ()
    stack: list[tuple | None] = []
    for match in _TOKENS.finditer(text):
        token = match.group()
        if token == "\n":
            if not stack:  # an open bracket spans lines
                if mode in (_HEADER, _LIST_HEADER):
                    top = _NOWHERE
                mode, key, dot = _KEY, (), True
        elif token[0] == "#" or mode == _END:
            continue
        elif mode == _VALUE:
            if token == "{":
                stack.append(path)
                mode, key, dot = _KEY, (), True
            elif token == "[":
                stack.append(None)
                path = _NOWHERE
            elif token in ("]", "}") and stack and (token == "]") == (stack[-1] is None):
                stack.pop()
            elif token == "," and stack and stack[-1] is not None:
                mode, key, dot = _KEY, (), True
        elif token == ".":
            dot = True
        elif token == "=" and mode == _KEY:
            path = (stack[-1] if stack else top) + key
            keep(path)
            mode = _VALUE
        elif token == "[" and not key and not stack:
            mode = _HEADER if mode == _KEY else _LIST_HEADER
        elif token == "]" and mode != _KEY:
            keep(key)
            top = key if mode == _HEADER else _NOWHERE
            mode = _END
        elif token == "}" and stack:
            stack.pop()
            mode = _VALUE
        elif dot and (part := _part(token)) is not None:
            key, dot = (*key, part), False
    return found


def toml_names(content: Column, sections: list[str]) -> Column:
    """Array with an array of names for each of ``sections`` (dotted paths of bare words); null for a null."""
    paths = [tuple(s.split(".")) for s in sections]

    @F.pandas_udf("array<array<string>>")
    def names(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [list(own) for own in section_names(t, paths)])

    return names(content)
