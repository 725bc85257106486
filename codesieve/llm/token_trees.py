"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoded only where an edit touches it."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Fixed value: the pre-token pattern that belongs to the vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 128  # characters that a leaf has at least, where the text can be cut

#: No pre-token of PATTERN holds a space after another character than white space, and a single space before one always opens
#: the next: whatever stands around, a text may be cut before such a space.
_CUT = re.compile(r"(?<=\S) (?=\S)")

TREE = "struct<chars: array<bigint>, tokens: array<bigint>>"
EDIT = "struct<start: bigint, stop: bigint, text: string>"

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(vocabulary: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoding of a vocabulary file's content; each Python worker builds it once."""
    key = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
    if key not in _encodings:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        _encodings[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def leaves(text: str, size: int = LEAF) -> list[str]:
    """The text in pieces that encode as they do together: cut at the first safe place after ``size`` characters each."""
    out, at = [], 0
    while at < len(text):
        found = _CUT.search(text, at + size)
        stop = found.start() if found else len(text)
        out.append(text[at:stop])
        at = stop
    return out


class TokenTree:
    """Leaf texts with a segment tree of their characters and tokens, as one array each: node 1 is the root, node i has the
    children 2i and 2i + 1."""

    def __init__(self, encode: tiktoken.Encoding, pieces: list[str], tree: tuple[np.ndarray, np.ndarray] | None = None):
        self.encode, self.pieces, self.encoded = encode, pieces, 0
        if tree is None:
            self._build([self.count(p) for p in pieces])
        else:
            self.chars, self.tokens = (np.array(x, np.int64) for x in tree)

    @classmethod
    def load(cls, encode, text: str, chars, tokens) -> TokenTree:
        """Leaf texts cut again from the stored numbers of characters; nothing is encoded."""
        half = len(chars) // 2
        ends = np.cumsum(np.asarray(chars[half:], np.int64))
        return cls(encode, [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], (chars, tokens))

    def count(self, piece: str) -> int:
        self.encoded += len(piece)
        return len(self.encode.encode_ordinary(piece)) if piece else 0

    def _build(self, counts: list[int]) -> None:
        half = 1
        while half < len(self.pieces):
            half *= 2
        self.pieces += [""] * (half - len(self.pieces))
        self.chars, self.tokens = np.zeros(2 * half, np.int64), np.zeros(2 * half, np.int64)
        self.chars[half:] = [len(p) for p in self.pieces]
        self.tokens[half:half + len(counts)] = counts
        for sums in (self.chars, self.tokens):
            for i in range(half - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def locate(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a character offset, and the offset of the leaf itself."""
        node, half, before = 1, len(self.chars) // 2, 0
        while node < half:
            node *= 2
            if offset >= before + self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - half, before

    def _put(self, leaf: int, piece: str, tokens: int) -> None:
        node = leaf + len(self.chars) // 2
        grown, more = len(piece) - self.chars[node], tokens - self.tokens[node]
        self.pieces[leaf] = piece
        while node:
            self.chars[node] += grown
            self.tokens[node] += more
            node //= 2

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Replace characters start to stop; offsets outside the text mean its ends. The leaves touched are encoded again,
        with the next one on a side where the place between them is no safe cut any more."""
        total = int(self.chars[1])
        start = min(max(start, 0), total)
        stop = min(max(stop, start), total)
        (first, before), (last, _) = self.locate(min(start, max(total - 1, 0))), self.locate(min(max(stop - 1, start), max(total - 1, 0)))
        region = "".join(self.pieces[first:last + 1])
        region = region[:start - before] + replacement + region[stop - before:]
        while first and region and not (region[0] == " " and len(region) > 1 and not region[1].isspace()) and any(self.pieces[:first]):
            first -= 1
            region = self.pieces[first] + region
        while last + 1 < len(self.pieces) and region and region[-1].isspace() and any(self.pieces[last + 1:]):
            last += 1
            region += self.pieces[last]
        new = leaves(region)
        counts = [self.count(p) for p in new]
        slots = last - first + 1
        if len(new) <= slots:
            for i in range(slots):
                self._put(first + i, *((new[i], counts[i]) if i < len(new) else ("", 0)))
        else:  # more leaves: the sums are laid out anew, the other leaves keep their counts
            half = len(self.chars) // 2
            known = self.tokens[half:].tolist()
            merged = [*zip(self.pieces[:first], known[:first], strict=True), *zip(new, counts, strict=True), *zip(self.pieces[last + 1:], known[last + 1:], strict=True)]
            merged = [x for x in merged if x[0]]
            self.pieces = [p for p, _ in merged]
            self._build([c for _, c in merged])


class TokenCounter:
    """The operator for one vocabulary: its file is read by the driver and sent to the tasks, with a bound on its size."""

    def __init__(self, spark: SparkSession, vocabulary: str = VOCABULARY, pattern: str = PATTERN, most_bytes: int = 32 << 20):
        with open(vocabulary, "rb") as f:
            raw = f.read(most_bytes + 1)
        if len(raw) > most_bytes:
            raise ValueError(f"{vocabulary} has more than {most_bytes} bytes")
        self.raw, self.pattern = spark.sparkContext.broadcast(raw), pattern

    def trees(self, text: Column) -> Column:
        """The tree of each text; the root's sums, ``chars[1]`` and ``tokens[1]``, count the whole text. Null counts as empty."""
        raw, pattern = self.raw, self.pattern

        @pandas_udf(TREE)
        def build(texts: pd.Series) -> pd.DataFrame:
            encode = encoding(raw.value, pattern)
            made = [TokenTree(encode, leaves(t or "")) for t in texts]
            return pd.DataFrame({"chars": [t.chars for t in made], "tokens": [t.tokens for t in made]})

        return build(text)

    def edited(self, text: Column, tree: Column, edits: Column) -> Column:
        """Apply an array of EDIT in order: a struct of the new ``text``, its ``tree`` and the characters ``encoded`` for it."""
        raw, pattern = self.raw, self.pattern

        @pandas_udf("text string, chars array<bigint>, tokens array<bigint>, encoded bigint")
        def apply(texts: pd.Series, trees: pd.DataFrame, changes: pd.Series) -> pd.DataFrame:
            encode, out = encoding(raw.value, pattern), []
            for t, chars, tokens, todo in zip(texts, trees["chars"], trees["tokens"], changes, strict=True):
                tree = TokenTree.load(encode, t or "", chars, tokens)
                for e in todo if todo is not None else ():
                    start, stop = (0 if pd.isna(e[end]) else int(e[end]) for end in ("start", "stop"))
                    tree.edit(start, stop, e["text"] or "")
                out.append((tree.text, tree.chars, tree.tokens, tree.encoded))
            return pd.DataFrame(out, columns=["text", "chars", "tokens", "encoded"])

        return apply(text, tree, edits)


def count_tokens(docs: DataFrame, counter: TokenCounter) -> DataFrame:
    """``docs`` plus ``tree`` and ``n_tokens``. One narrow pass: no shuffle. Whole texts of any length; null and empty texts have
    no tokens; repeated rows count alike; other columns pass through, columns of the two names are replaced."""
    return docs.drop("tree", "n_tokens").withColumn("tree", counter.trees(F.col("text"))).withColumn("n_tokens", F.col("tree.tokens")[1])


def apply_edits(counted: DataFrame, edits: DataFrame, counter: TokenCounter, key: str = "doc_id") -> DataFrame:
    """Documents of ``count_tokens`` after ``edits(key, seq, start, stop, text)``, offsets in characters of the text as the edits
    before left it. Adds ``encoded``, the characters that had to be encoded again; documents without edits stay.

    Edits with a null key or of unknown documents change nothing; equal ``seq`` are applied in order of (start, stop, text); null offsets are 0 and
    null texts empty. Edits of one document come together, as they must be applied one after the other.
    """
    order = Window.partitionBy(key).orderBy("seq", "start", "stop", "text")
    todo = edits.filter(F.col(key).isNotNull()).withColumn("__no", F.row_number().over(order)).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("__no", "start", "stop", "text"))).alias("__edits"))
    joined = counted.join(todo, key, "left")
    done = joined.withColumn("__done", counter.edited(F.col("text"), F.col("tree"), F.transform("__edits", lambda e: e.dropFields("__no"))))
    return done.withColumns({
        "text": F.when(F.col("text").isNotNull() | (F.size("__edits") > 0), F.col("__done.text")),
        "tree": F.struct(F.col("__done.chars").alias("chars"), F.col("__done.tokens").alias("tokens")),
        "n_tokens": F.col("__done.tokens")[1], "encoded": F.col("__done.encoded")}).drop("__edits", "__done")
