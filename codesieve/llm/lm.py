"""Language-model scoring of whole texts: a word-count base, and a causal attention model of subwords trained on the corpus."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm import attention
from codesieve.llm.common import mixed, stored, words
from codesieve.llm.token_trees import PATTERN, VOCABULARY, encoding

_UNIT_WORDS, _UNIT_DOCS = 4_000_000, 8192  # what a task combines before it hands it on
_CACHE = 400_000  # words whose subwords a worker keeps
_BATCH = 128  # windows scored together
_STEP = 32  # windows of a training step
_PART = 1 << 17  # subwords of a text that are cut into windows at once
_ROUND = 4  # of so many texts one is for the first round of training
_SPLIT = 2048  # embedding rows in a piece
_SALTS = 32


def _windows(sequence: np.ndarray, opening: int):
    """Windows of a text, a long one by parts, each with the tokens before it."""
    for first in range(0, len(sequence), _PART):
        made = attention.windows(sequence[first:first + _PART], opening)
        if first:
            made[0][0, :attention.CONTEXT + 1] = sequence[first - attention.CONTEXT - 1:first]
        yield made


class _Places(dict):
    """Words to places; a word that is looked up for the first time gets the next one, and is noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Subwords:
    """Words to hashes and subword ids, by a cache of arrays. Each word is one piece, behind a space."""

    def __init__(self, vocabulary: bytes):
        self.encode = encoding(vocabulary, PATTERN)
        self.end = self.encode.n_vocab
        self.piece = self.encode._core_bpe.encode_single_piece
        self.clear()

    def clear(self) -> None:
        self.index = _Places()
        self.flat_size = 0
        self.hashes, self.starts, self.sizes, self.flat = (np.empty(1024, k) for k in (np.uint64, np.int64, np.int64, np.int32))

    def ids(self, word: bytes) -> list[int]:
        return self.piece(b" " + word)

    def _room(self, words: int, pieces: int) -> None:
        """Arrays grow to twice their size when they are too small for so many words, and more subwords."""
        while words > len(self.hashes):
            self.hashes, self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.hashes, self.starts, self.sizes))
        while self.flat_size + pieces > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])

    def positions(self, tokens: list[bytes]) -> np.ndarray:
        index, first = self.index, len(self.index)
        at = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
        if new := index.new:
            own = [self.piece(b" " + w) for w in new]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            ends = self.flat_size + np.cumsum(sizes)
            last = len(index)
            self._room(last, int(sizes.sum()))
            self.hashes[first:last] = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
            self.sizes[first:last], self.starts[first:last] = sizes, ends - sizes
            self.flat[self.flat_size:ends[-1]] = np.fromiter(chain.from_iterable(own), np.int32, int(sizes.sum()))
            self.flat_size = int(ends[-1])
            index.new = []
        return at

    def sequence(self, at: np.ndarray) -> np.ndarray:
        """Subword ids of the words at these positions, in a row."""
        n = self.sizes[at]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - n), n)].astype(np.int64)


_subwords: dict[str, Subwords] = {}


def subwords(vocabulary: bytes) -> Subwords:
    key = xxhash.xxh3_64_hexdigest(vocabulary)
    if key not in _subwords:
        _subwords[key] = Subwords(vocabulary)
    return _subwords[key]


def _bucketed(keys: np.ndarray, buckets: int):
    """(bucket, positions) for each bucket that has keys."""
    bucket = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for piece in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(keys) else ():
        yield int(bucket[piece[0]]), piece


_LEARNED = "kind int, bucket int, a binary, b binary, n bigint, at bigint, ids binary"


def _learn(vocabulary, buckets: int):
    """What a task sees of the training texts. Kinds: 0 word hashes and counts, 1 subword ids and counts, 2 a text's subword ids and its end, 3 texts."""

    def run(batches):
        sub = subwords(vocabulary.value)
        kind = _id_kind(sub)
        counts, seen, texts = np.zeros(0, np.int64), 0, 0  # of words, by their place in sub
        positions, held = [], 0
        pieces = np.zeros(sub.end + 1, np.int64)
        names = [c.split()[0] for c in _LEARNED.split(", ")]

        def count():
            nonlocal counts, seen, positions, held
            if positions:
                added = np.bincount(np.concatenate(positions), minlength=len(counts))
                added[:len(counts)] += counts
                counts, seen, positions, held = added, seen + held, [], 0

        def flush():
            nonlocal counts, seen
            count()
            used = np.flatnonzero(counts)
            hashes, n = sub.hashes[used], counts[used]
            pieces[:] += np.bincount(sub.sequence(used), weights=np.repeat(n, sub.sizes[used]), minlength=len(pieces)).astype(np.int64)
            counts, seen = np.zeros(0, np.int64), 0
            return [(0, bucket, hashes[at].tobytes(), n[at].tobytes(), len(at), None, None) for bucket, at in _bucketed(hashes, buckets)]

        for batch in batches:
            ids = []
            for text in batch["text"]:
                if len(sub.index) > _CACHE:
                    yield pd.DataFrame(flush(), columns=names)
                    sub.clear()
                own = sub.positions(words(text))
                ids.append(np.append(sub.sequence(own), sub.end).astype(kind).tobytes())
                positions.append(own)
                held, texts = held + len(own), texts + 1
                if held >= _UNIT_WORDS // 8:
                    count()
                if seen >= _UNIT_WORDS:
                    yield pd.DataFrame(flush(), columns=names)
            yield pd.DataFrame({"kind": 2, "bucket": None, "a": None, "b": None, "n": None, "at": batch["at"], "ids": ids}, columns=names)
        out = flush()
        pieces[sub.end] += texts
        used = np.flatnonzero(pieces)
        for chunk in np.unique(used // _SPLIT):
            own = used[used // _SPLIT == chunk]
            out.append((1, int(chunk), own.tobytes(), pieces[own].tobytes(), len(own), None, None))
        out.append((3, 0, b"", b"", texts, None, None))
        yield pd.DataFrame(out, columns=names)

    return run


def _id_kind(sub: Subwords) -> type:
    """What a stored id takes: two bytes where all fit."""
    return np.uint16 if sub.end < 1 << 16 else np.int32


def _whole(rows: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _merge_counts(kind):
    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _summed(_whole(group["a"], kind), _whole(group["b"], np.int64))
        return pd.DataFrame({"bucket": [key[0]], "keys": [keys.tobytes()], "counts": [counts.tobytes()], "distinct_keys": [len(keys)], "total": [int(counts.sum())]})

    return merge


_COUNTS = "bucket int, keys binary, counts binary, distinct_keys bigint, total bigint"
_CHANGES = "piece int, salt int, weights binary, changes binary"
_DENSE = ("query", "key", "value", "skip", "distance", "hidden", "out", "bias")


def _train_task(vocabulary, parameters, model_vocabulary):
    """Training on all windows of a task's texts, given by their stored ``ids`` or as ``text``, from the shared parameters; yields weighted changes."""

    def run(batches):
        sub = subwords(vocabulary.value)
        trainer = attention.Trainer(parameters.value, model_vocabulary.value)
        held, size = [], 0

        def steps(least):
            nonlocal held, size
            inputs, targets, mask = (np.concatenate(x) for x in zip(*held, strict=True))
            last = size if least == 1 else size // least * least
            for at in range(0, last, _STEP):
                trainer.step(inputs[at:at + _STEP], targets[at:at + _STEP], mask[at:at + _STEP])
            held, size = [(inputs[last:], targets[last:], mask[last:])], size - last

        def sequences(batch):
            if "ids" in batch:
                yield from (np.frombuffer(ids, _id_kind(sub)).astype(np.int64) for ids in batch["ids"])
                return
            for text in batch["text"]:
                if len(sub.index) > _CACHE:
                    sub.clear()
                yield np.append(sub.sequence(sub.positions(words(text))), sub.end)

        for batch in batches:
            for sequence in sequences(batch):
                for made in _windows(sequence, sub.end + 1):
                    held.append(made)
                    size += len(made[0])
                    if size >= 16 * _STEP:
                        steps(_STEP)
        if size:
            steps(1)
        salt = TaskContext.get().partitionId() % _SALTS
        out = []
        if trainer.steps:
            flat = np.concatenate([(trainer.p[n] - parameters.value[n]).ravel() for n in _DENSE]).astype(np.float64)
            out.append((-1, salt, np.array([trainer.steps], np.float64).tobytes(), (flat * trainer.steps).tobytes()))
            change = trainer.p["embedding"] - parameters.value["embedding"]
            for first in range(0, len(change), _SPLIT):
                used = trainer.used[first:first + _SPLIT].astype(np.float64)
                if used.any():
                    out.append((first // _SPLIT, salt, used.tobytes(), (change[first:first + _SPLIT] * used[:, None]).tobytes()))
        yield pd.DataFrame(out, columns=["piece", "salt", "weights", "changes"])

    return run


def _add_changes(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    add = lambda c: np.sum([np.frombuffer(x, np.float64) for x in group[c]], axis=0).tobytes()
    return pd.DataFrame({"piece": [key[0]], "salt": [0], "weights": [add("weights")], "changes": [add("changes")]})


def _train(texts: DataFrame, vocabulary, model_vocabulary) -> dict[str, np.ndarray]:
    """Two rounds: tasks train on their own of ``texts(at, ids)`` (a quarter, then the others), each text in one of them, and their changes are averaged, an embedding row by
    how often each task met it. What reaches the driver is as large as the model."""
    context = texts.sparkSession.sparkContext
    p = attention.initial(model_vocabulary.value)
    first = F.pmod("at", F.lit(_ROUND)) == 0
    for part in (first, ~first):
        shared = context.broadcast(p)
        changes = texts.filter(part).select("ids").mapInPandas(_train_task(vocabulary, shared, model_vocabulary), _CHANGES).groupBy("piece", "salt").applyInPandas(
            _add_changes, _CHANGES).groupBy("piece").applyInPandas(_add_changes, _CHANGES).collect()
        p = {k: v.copy() for k, v in p.items()}
        for piece, _, weights, change in changes:
            weights, change = np.frombuffer(weights, np.float64), np.frombuffer(change, np.float64)
            if piece < 0:
                at = 0
                for n in _DENSE:
                    p[n] += (change[at:at + p[n].size] / weights[0]).reshape(p[n].shape).astype(np.float32)
                    at += p[n].size
            else:
                own = slice(piece * _SPLIT, piece * _SPLIT + len(weights))
                p["embedding"][own] += (change.reshape(-1, attention.WIDTH) / np.maximum(weights, 1)[:, None]).astype(np.float32)
        p = attention.bounded(p)
    return p


_SCORED = "kind int, unit bigint, bucket int, doc int, doc_id bigint, at bigint, n_tokens bigint, known bigint, base double, score double, keys binary, runs binary, docs binary, times binary"


def _score(vocabulary, parameters, model_vocabulary, frequent, buckets: int):
    """Scores of a task's texts. Kinds: 0 a text, with the model's score and the base of its frequent words; 1 the other words of some
    texts: their hashes, in how many texts each occurs, those texts and how often."""

    def run(batches):
        sub = subwords(vocabulary.value)
        common, logs = frequent.value
        places, known = np.empty(0, np.int64), 0  # of the words in sub: their place among the frequent ones, -1 for others

        def place_of(at: np.ndarray) -> np.ndarray:
            nonlocal places, known
            if known < (last := len(sub.index)):
                if last > len(places):
                    places = np.concatenate([places, np.empty(len(sub.hashes) - len(places), np.int64)])
                new = sub.hashes[known:last]
                found = np.minimum(np.searchsorted(common, new), max(len(common) - 1, 0))
                places[known:last], known = np.where(common[found] == new, found, -1) if len(common) else -1, last
            return places.take(at)

        task = TaskContext.get().partitionId() << 24
        unit, docs, seen, rare = 0, [], 0, []
        pending: list = []  # (row of docs, windows) waiting for the model

        def score_pending():
            parts = [w for _, w in pending]
            inputs, targets, mask = (np.concatenate([w[i] for w in parts]) for i in range(3))
            values = np.concatenate([
                attention.log_probabilities(parameters.value, model_vocabulary.value, inputs[a:a + _BATCH], targets[a:a + _BATCH]) for a in range(0, len(inputs), _BATCH)])
            values = np.where(mask[:, attention.CONTEXT:], values, 0).sum(axis=1, dtype=np.float64)
            sizes = [len(w[0]) for w in parts]
            for (row, _), total in zip(pending, np.add.reduceat(values, np.cumsum([0, *sizes[:-1]])), strict=True):
                docs[row]["score"] += float(total / np.log(10))
            pending.clear()

        def flush():
            if pending:
                score_pending()
            out = [dict(d, kind=0, unit=task + unit, doc=n) for n, d in enumerate(docs)]
            if rare:
                keys = np.concatenate([r[0] for r in rare])
                times = np.concatenate([r[1] for r in rare]).astype(np.int32)
                of = np.repeat(np.arange(len(rare)), [len(r[0]) for r in rare])
                for bucket, at in _bucketed(keys, buckets):
                    at = at[np.argsort(keys[at], kind="stable")]
                    own, runs = np.unique(keys[at], return_counts=True)
                    out.append({"kind": 1, "unit": task + unit, "bucket": bucket, "keys": own.tobytes(), "runs": runs.astype(np.int32).tobytes(),
                                "docs": of[at].astype(np.uint16).tobytes(), "times": times[at].tobytes()})
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _SCORED.split(", ")])
            whole = ["unit", "bucket", "doc", "doc_id", "at", "n_tokens", "known"]
            return frame.astype({c: "Int64" for c in whole})

        for batch in batches:
            for doc_id, at, text in zip(batch["doc_id"], batch["at"], batch["text"], strict=True):
                tokens = words(text)
                if len(sub.index) > _CACHE:
                    sub.clear()
                    known = 0
                positions = sub.positions(tokens)
                place = place_of(positions)
                is_common = place >= 0
                sequence = np.append(sub.sequence(positions), sub.end)
                docs.append({"doc_id": None if pd.isna(doc_id) else int(doc_id), "at": int(at), "n_tokens": len(tokens) + 1, "known": int(is_common.sum()),
                             "base": float(logs[place[is_common]].sum()) if len(common) else 0.0, "score": 0.0})
                rare.append(np.unique(sub.hashes[positions[~is_common]], return_counts=True))
                for made in _windows(sequence, sub.end + 1):
                    pending.append((len(docs) - 1, made))
                    if sum(len(w[0]) for _, w in pending) >= 2 * _BATCH:
                        score_pending()
                seen += len(tokens)
                if len(docs) >= _UNIT_DOCS or seen >= _UNIT_WORDS:
                    yield flush()
                    unit, docs, seen, rare = unit + 1, [], 0, []
        if docs:
            yield flush()

    return run


_SUMS = "unit bigint, docs binary, sums binary, known binary"


def _look_up(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """The base of the rare words of a bucket: for each unit, sums by text."""
    keys, times = (np.frombuffer(counts[c].iloc[0], k) if len(counts) else np.empty(0, k) for c, k in (("keys", np.uint64), ("counts", np.int64)))
    out = []
    for unit, own, runs, docs, n in rows[["unit", "keys", "runs", "docs", "times"]].itertuples(index=False) if len(rows) else ():
        own, runs, docs, n = np.frombuffer(own, np.uint64), np.frombuffer(runs, np.int32), np.frombuffer(docs, np.uint16), np.frombuffer(n, np.int32)
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        c = np.where(keys[at] == own, times[at], 0) if len(keys) else np.zeros(len(own), np.int64)
        sums = np.bincount(docs, weights=np.repeat(np.log10(c + 1.0), runs) * n)
        known = np.bincount(docs, weights=np.repeat(c > 0, runs) * n)
        used = np.flatnonzero(known)
        out.append((unit, used.astype(np.uint16).tobytes(), sums[used].tobytes(), known[used].astype(np.int64).tobytes()))
    return pd.DataFrame(out, columns=["unit", "docs", "sums", "known"])


def _by_doc(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    docs = _whole(group["docs"], np.uint16).astype(np.int64)
    sums, known = np.bincount(docs, weights=_whole(group["sums"], np.float64)), np.bincount(docs, weights=_whole(group["known"], np.int64))
    used = np.unique(docs)
    return pd.DataFrame({"unit": key[0], "doc": used, "rare_base": sums[used], "rare_known": known[used].astype(np.int64)})


def score_texts(docs: DataFrame, training, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs(doc_id, text)``, learned from the rows
    for which the column ``training`` holds.

    Tokens of the base are words without the case of A-Z, then one end. ``base_score`` sums log10((c + 1) / (N + V + 1)) over a
    text's tokens: c the token's count in the training texts, N all, V the distinct ones; ``n_known`` has c > 0. ``score`` is the
    log10 probability of the text's subwords and its end under a causal attention model (:mod:`codesieve.llm.attention`): windows
    of 24 subwords that overlap by 6, each token scored once.

    All training texts count: their words, subwords, and all their windows, each trained on once, from the subword ids that the pass over the
    words keeps in the shared folder. Counts are packed by bucket of the word's hash. Words that make more than 1 in 65,536 of all are that many at most; they are sent to all tasks and looked up where
    the text is read, so no word is common enough to make a bucket heavy. The other words of some thousand texts go to their bucket
    together, and come back as sums by text.

    Defined cases: a null text is empty and has one token, the end; with no training texts N = V = 0 and the model is untrained; a row whose
    ``training`` is null isn't trained on; null and repeated doc_ids are rows like others; an empty table gives no rows; texts are scored whole; other columns are ignored. Words are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("at"), "text", F.coalesce(training, F.lit(False)).alias("training"))
    training_texts = rows.filter("training").select("at", "text")
    learned = stored(training_texts.mapInPandas(_learn(shared, buckets), _LEARNED), "learned")
    of = lambda kind: learned.filter(F.col("kind") == kind)
    counts = stored(of(0).groupBy("bucket").applyInPandas(_merge_counts(np.uint64), _COUNTS), "word-counts")
    texts = of(3).agg(F.sum("n")).first()[0] or 0
    total, distinct = counts.agg(F.sum("total"), F.sum("distinct_keys")).first()
    n, v = (total or 0) + texts, (distinct or 0) + (texts > 0)

    def often(batches):
        for batch in batches:
            for keys, times in zip(batch["keys"], batch["counts"], strict=True):
                keys, times = np.frombuffer(keys, np.int64), np.frombuffer(times, np.int64)
                yield pd.DataFrame({"key": keys[times * 65536 > n], "n": times[times * 65536 > n]})

    found = counts.select("keys", "counts").mapInPandas(often, "key bigint, n bigint").toPandas()  # 65,536 rows at most
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], np.log10(found["n"].to_numpy(np.float64)[order] + 1)))

    sub = subwords(shared.value)
    pieces = np.zeros(sub.end + 1, np.int64)
    for r in of(1).groupBy("bucket").applyInPandas(_merge_counts(np.int64), _COUNTS).select("keys", "counts").collect():  # one count for each subword
        pieces[np.frombuffer(r["keys"], np.int64)] = np.frombuffer(r["counts"], np.int64)
    opens = np.array([sub.encode.decode_single_token_bytes(i)[:1] == b" " for i in range(sub.end)] + [True])
    model_vocabulary = spark.sparkContext.broadcast(attention.Vocabulary(pieces, opens))
    parameters = spark.sparkContext.broadcast(_train(of(2).select("at", "ids"), shared, model_vocabulary))

    scored = stored(rows.select("doc_id", "at", "text").mapInPandas(_score(shared, parameters, model_vocabulary, frequent, buckets), _SCORED), "scored")
    rest = scored.filter("kind = 1").select("unit", F.col("bucket").alias("of"), "keys", "runs", "docs", "times")
    sums = rest.groupBy("of").cogroup(counts.groupBy("bucket")).applyInPandas(_look_up, _SUMS)
    by_doc = sums.groupBy("unit").applyInPandas(_by_doc, "unit bigint, doc int, rare_base double, rare_known bigint")
    whole = scored.filter("kind = 0").select("unit", "doc", "doc_id", "n_tokens", "known", "base", "score").join(by_doc, ["unit", "doc"], "left")
    floor = float(np.log10(n + v + 1.0))
    return whole.select(
        "doc_id", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + int(texts > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + float(np.log10(texts + 1.0)) - F.col("n_tokens") * floor).alias("base_score"),
        "score")
