"""Literals that a regular expression needs: what a line must contain to match it at all."""

from __future__ import annotations

#: Folded together before anything is compared: A-Z, and the foreign letters that a pattern without case takes for k, s and i.
FOLDED = {**{c: c + 32 for c in range(65, 91)}, 0x212A: ord("k"), 0x17F: ord("s"), 0x130: ord("i"), 0x131: ord("i")}

_MOST = 16  # literals of which a pattern may need one
_LONG = 8  # more characters tell no more


class _UnknownSyntaxError(Exception):
    pass


def fold(text: str) -> str:
    return text.translate(FOLDED)


def needed_literals(pattern: str) -> list[str]:
    """Folded ASCII literals, one of which every match of the pattern (in Java's syntax) contains; none if that can't be told."""
    try:
        reader = _Reader(pattern)
        needs = reader.alternatives()
        return _best(needs) if reader.at == len(pattern) else []
    except (_UnknownSyntaxError, IndexError, ValueError):
        return []


def _best(needs: list[list[str]]) -> list[str]:
    """Of several sets of which a match needs one literal each, the one that tells most."""
    return max(needs, key=lambda s: (min(min(map(len, s)), _LONG), -len(s)), default=[])


class _Reader:
    """Reads a pattern once, from left to right. ``needs`` are sets of literals; of each set a match holds one."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def next(self) -> str:
        self.at += 1
        return self.pattern[self.at - 1]

    def ahead(self, text: str) -> bool:
        return self.pattern.startswith(text, self.at)

    def until(self, end: str) -> str:
        stop = self.pattern.index(end, self.at)
        out, self.at = self.pattern[self.at:stop], stop + len(end)
        return out

    def alternatives(self) -> list[list[str]]:
        parts = [self.sequence()]
        while self.ahead("|"):
            self.at += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        best = [_best(p) for p in parts]
        together = sorted({x for b in best for x in b})
        return [together] if all(best) and len(together) <= _MOST else []

    def sequence(self) -> list[list[str]]:
        needs: list[list[str]] = []
        run = ""

        def flush():
            nonlocal run
            if run:
                needs.append([run])
            run = ""

        while self.at < len(self.pattern) and not self.ahead("|") and not self.ahead(")"):
            c = self.next()
            inner: list[list[str]] = []
            if c in "^$":
                continue
            if c == "\\":
                literal = self.escape()
                if literal == "":  # an assertion
                    continue
            elif c == "(":
                inner = self.group()
                if inner is None:
                    continue
                literal = None
            elif c == "[":
                self.character_class()
                literal = None
            elif c in "*+?{}":
                raise _UnknownSyntaxError
            else:
                literal = None if c == "." else c
            least = self.quantifier()
            if literal is not None and not literal.isascii():
                literal = None
            if literal and least is not None:  # of a quoted run the last character repeats
                run += fold(literal[:-1])
                literal = literal[-1]
            if literal is None:
                flush()
                needs += inner if least != 0 else []
            elif least == 0:
                flush()
            else:
                run += fold(literal)
                if least is not None:
                    flush()
        flush()
        return needs

    def quantifier(self) -> int | None:
        """The least number of repetitions, or None without a quantifier."""
        if self.at >= len(self.pattern) or self.pattern[self.at] not in "*+?{":
            return None
        c = self.next()
        least = int(self.until("}").split(",")[0]) if c == "{" else int(c == "+")
        if self.at < len(self.pattern) and self.pattern[self.at] in "?+":
            self.at += 1
        return least

    def escape(self) -> str | None:
        """Of what follows a backslash: the literal, '' for an assertion, None for anything else."""
        c = self.next()
        if c == "Q":
            return self.until("\\E") if "\\E" in self.pattern[self.at:] else self.until_end()
        if c in "bBAGZz":
            if c == "b" and self.ahead("{"):
                self.until("}")
            return ""
        if c == "x":
            digits = self.braced() if self.ahead("{") else self.next() + self.next()
            return chr(int(digits, 16))
        if c == "u":
            return chr(int("".join(self.next() for _ in range(4)), 16))
        if c in "tnrfae":
            return {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "a": "\x07", "e": "\x1b"}[c]
        if c in "pP":
            if self.ahead("{"):
                self.until("}")
            else:
                self.next()
            return None
        if c == "k":
            self.until(">")
            return None
        if c in "dDsSwWhHvVRX" or c in "123456789":
            return None
        if c.isalnum() or not c.isascii():
            raise _UnknownSyntaxError
        return c

    def until_end(self) -> str:
        out, self.at = self.pattern[self.at:], len(self.pattern)
        return out

    def braced(self) -> str:
        self.at += 1
        return self.until("}")

    def group(self) -> list[list[str]] | None:
        """What a group needs; None for one that takes no part of the text."""
        around = False
        if self.ahead("?"):
            self.at += 1
            if self.ahead("<=") or self.ahead("<!"):
                self.at += 2
                around = True
            elif self.ahead("=") or self.ahead("!"):
                self.at += 1
                around = True
            elif self.ahead("<"):
                self.until(">")
            elif self.ahead(":") or self.ahead(">"):
                self.at += 1
            else:
                flags = ""
                while not self.ahead(":") and not self.ahead(")"):
                    flags += self.next()
                if "x" in flags.split("-")[0] or not set(flags) <= set("idmsuU-"):
                    raise _UnknownSyntaxError
                if self.next() == ")":
                    return None
        needs = self.alternatives()
        if self.next() != ")":
            raise _UnknownSyntaxError
        if around:
            self.quantifier()
        return None if around else needs

    def character_class(self) -> None:
        if self.ahead("^"):
            self.at += 1
        if self.ahead("]"):
            raise _UnknownSyntaxError
        depth = 1
        while depth:
            c = self.next()
            if c == "\\":
                if self.next() == "Q":
                    raise _UnknownSyntaxError
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
