"""Text helpers: decoding, trimming, snippets, regular-expression flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python's str.strip() removes.
PY_WHITESPACE = "".join(
    map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
)


def rx(pattern: str, ignore_case: bool = False) -> str:
    """Give a pattern Python's meaning in Java: ``.`` stops only at a newline, classes are Unicode."""
    # a quote is written as its code, so that the pattern fits into a raw SQL literal
    return ("(?diU)" if ignore_case else "(?dU)") + pattern.replace("'", r"\x27")


def sql_string(text: str) -> str:
    """A SQL literal, the same under every escape setting; quotes become regular-expression or JSON escapes."""
    if "'" in text:
        raise ValueError("write a quote as \\x27 in patterns and as \\u0027 in JSON")
    return f"r'{text}'"


# the same set as a SQL expression
SQL_WHITESPACE = f"decode(X'{PY_WHITESPACE.encode().hex()}', 'utf-8')"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(PY_WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(PY_WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(PY_WHITESPACE))


# Marks that the decoder writes while a text holds invalid bytes: an escape, itself and a replacement character of the text's own.
_ESCAPE, _ESCAPED, _GENUINE = "\uf8ff", "\uf8ff0", "\uf8ff1"


def without_invalid_bytes(text: Column) -> Column:
    """A string whose bytes may be no UTF-8, without those that are not; what Python's ``errors="ignore"`` leaves.

    Replacement characters that the text itself holds are set aside before invalid bytes become replacement characters, and
    come back after these are dropped. A character's first byte is no other character's part, so both are found in the bytes.
    """
    aside = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPED)), F.lit("\ufffd"), F.lit(_GENUINE))
    kept = F.replace(F.make_valid_utf8(aside), F.lit("\ufffd"), F.lit(""))
    return F.replace(F.replace(kept, F.lit(_GENUINE), F.lit("\ufffd")), F.lit(_ESCAPED), F.lit(_ESCAPE))


def decode_text(raw: Column) -> Column:
    """UTF-8 bytes to text: invalid bytes are dropped, line ends become ``\\n``."""
    text = raw.cast("string")
    return normalise_newlines(F.when(F.is_valid_utf8(text), text).otherwise(without_invalid_bytes(text)))


def normalise_newlines(text: Column) -> Column:
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.replace(unix, F.lit("\r"), F.lit("\n"))


def split_lines(content: Column) -> Column:
    """All lines, with the empty one after a final newline."""
    return F.split(content, "\n", -1)


def snippet(line: Column, width: int = 100) -> Column:
    return F.left(strip(line), F.lit(width))


def truncate(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("..."))).otherwise(text)


def comma_list(c: Column) -> Column:
    """``'a, B'`` to ``['a', 'b']``."""
    return F.transform(F.split(c, ","), lambda part: F.lower(strip(part)))


def contains_any(c: Column, words) -> Column:
    first, *others = words
    found = c.contains(first)
    for word in others:
        found = found | c.contains(word)
    return found
