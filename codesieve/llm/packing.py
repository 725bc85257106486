"""Packing documents into windows of tokens: online, by the sum of squares of an array of fill levels."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from codesieve.llm.common import some_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SIZE, MOST_OPEN, END = 1024, 2048, 0

#: Fixed value: the pre-token pattern that belongs to byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BYTES = 1 << 22  # of ids that a task hands on together
_encoders: dict[str, Encoder] = {}


class Encoder:
    """The ids that a byte-level BPE file of ``tokenizers`` gives. Merges are in the order of the ids, so the same vocabulary works as
    ranks, several times as fast; texts that hold an added token's string take the tokenizer itself."""

    def __init__(self, content: str):
        described = json.loads(content)
        vocabulary, merges = described["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"]]
        kind = described["pre_tokenizer"] or {}
        if (kind.get("type"), kind.get("use_regex"), kind.get("add_prefix_space")) != ("ByteLevel", True, False) or described["normalizer"]:
            raise ValueError("a byte-level vocabulary without a normalizer is needed")
        if [vocabulary[a + b] for a, b in merges] != list(range(256, 256 + len(merges))):
            raise ValueError("the merges must be in the order of their ids")
        self.added = [t["content"] for t in described["added_tokens"]]
        self.whole = Tokenizer.from_str(content)
        alphabet = {c: b for b, c in _alphabet().items()}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in self.added}
        self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def _alphabet() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it shows, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def encoder(content: str) -> Encoder:
    """Each Python worker reads a vocabulary once."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(content)
    return _encoders[key]


class Packer:
    """Windows of ``size`` tokens that are filled online. A piece is (document, start, ids); ``done`` holds the finished windows, lists of pieces.

    ``counts[h]`` windows are filled up to level h. A piece of s tokens goes to the level h, or to a new window, that makes the sum of
    squares of all counts least; at a tie to the fullest. Full windows leave the array. Documents longer than a window give whole
    windows first, and only their rest is placed.
    """

    def __init__(self, size: int = SIZE, most_open: int = MOST_OPEN):
        self.size, self.most_open, self.n_open = size, most_open, 0
        self.counts = np.zeros(size + 1, np.int64)
        self.leave = np.full(size + 1, np.iinfo(np.int64).max // 4)  # what the sum changes by if a window leaves a level
        self.enter = np.ones(size + 1, np.int64)  # or if one comes to it
        self.leave[0] = self.enter[size] = 0
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.done: list[list] = []

    def add(self, document, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            self.done.append([(document, at, ids[at:at + self.size])])
        if len(ids) > whole:
            self._place([(document, whole, ids[whole:])], len(ids) - whole)
        if self.n_open > self.most_open:
            self._settle()

    def level_for(self, length: int) -> int:
        """The fill level (0: a new window) that a piece of ``length`` tokens goes to."""
        last = self.size - length
        return last - int(np.argmin((self.leave[:last + 1] + self.enter[length:])[::-1]))

    def _count(self, level: int, change: int) -> None:
        self.n_open += change
        self.counts[level] += change
        n = self.counts[level]
        self.leave[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4
        self.enter[level] = 2 * n + 1

    def _place(self, pieces: list, length: int) -> None:
        level = self.level_for(length)
        window: list = []
        if level:
            window = self.open[level].pop()
            self._count(level, -1)
        window.extend(pieces)
        self._keep(window, level + length)

    def _keep(self, window: list, level: int) -> None:
        if level == self.size:
            self.done.append(window)
        elif level:
            self.open[level].append(window)
            self._count(level, 1)

    def _settle(self) -> None:
        """Open windows become full ones: the fullest take what they lack from the emptiest, whose pieces are cut. At most one stays open."""
        windows = [(level, w) for level in range(self.size - 1, 0, -1) for w in self.open[level]]
        for level in range(1, self.size):
            self._count(level, -len(self.open[level]))
            self.open[level] = []
        first, last = 0, len(windows)
        level, window = 0, []
        rest: list = []  # pieces of windows that have been opened up
        while first < last or rest:
            if not window and first < last:
                level, window = windows[first]
                first += 1
            elif not rest:
                last -= 1
                rest = list(windows[last][1])
            else:
                document, start, ids = rest.pop()
                room = self.size - level
                if len(ids) > room:
                    rest.append((document, start + room, ids[room:]))
                window.append((document, start, ids[:room]))
                level += min(len(ids), room)
            if level == self.size:
                self.done.append(window)
                level, window = 0, []
        self._keep(window, level)

    def end(self) -> None:
        """Close all windows without padding: what is left after :meth:`_settle` is cut into windows of powers of two, largest first."""
        self._settle()
        left = [piece for level in range(1, self.size) for w in self.open[level] for piece in w][::-1]
        room = 0
        window: list = []
        n = sum(len(ids) for _, _, ids in left)
        while left:
            if not room:
                window, room = [], 1 << (n.bit_length() - 1)
                n -= room
                self.done.append(window)
            document, start, ids = left.pop()
            if len(ids) > room:
                left.append((document, start + room, ids[room:]))
            window.append((document, start, ids[:room]))
            room -= min(len(ids), room)
        for level in range(1, self.size):
            self._count(level, -len(self.open[level]))
            self.open[level] = []


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SIZE, most_open: int = MOST_OPEN, end: int = END) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``: doc_id, start (its document's tokens before it), length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset (the tokens before it in its sequence).

    A document is the ids of its whole text, then ``end``. Each id is in one piece; a sequence's pieces follow each other without gaps. Sequences have ``size`` tokens; at the
    end of a task what does not fill one is cut into sequences of powers of two, so none needs padding.

    Every task packs the rows of its partition as they come (:class:`Packer`), with no shuffle. It holds one text's ids and at most ``most_open``
    open windows; beyond that the open windows are filled up with pieces of each other. A sequence's id is its partition's number times 2^33, plus its number
    there. Rows of files come in the same order each time; a table whose rows may come in another order is to be written first.

    Defined cases: a null or empty text is ``end`` alone; a null doc_id is kept as null; repeated rows are packed each; texts of any length are
    read whole; an empty table gives no rows; other columns are ignored. Strings of added tokens in a text are read as those tokens, as the
    library does by default. ``size`` must be a power of two of at least 2, for the rest to be cut.
    """
    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    with open(vocabulary, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches):
        encode, packer = encoder(content.value), Packer(size, most_open)
        sequence = TaskContext.get().partitionId() << 33

        def finished():
            nonlocal sequence
            rows = []
            for window in packer.done:
                offset = 0
                for (doc_id, n), start, ids in window:
                    rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), n, sequence, offset))
                    offset += len(ids)
                sequence += 1
            packer.done = []
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [name for name, _ in kinds])

        for batch in batches:
            for part in some_rows(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(encode.ids(text or ""), np.uint32(end))
                    packer.add((doc_id, len(ids)), ids)
                    if 4 * size * len(packer.done) >= _BYTES:
                        yield finished()
        packer.end()
        yield finished()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
