"""Fuzzy line deduplication: MinHash bands over character shingles, exact similarity, one line of each component stays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from codesieve.llm.common import bitmap, in_bitmap, mixed, shingle_hashes, some_rows, stored
from codesieve.llm.components import components
from codesieve.llm.forest import TOGETHER, counted, links_between, links_together

SHINGLE, BANDS, ROWS, PERCENT = 8, 12, 4, 80
_BLOCK = 1 << 16  # characters signed together
_UNIT = 1 << 15  # lines that a task combines before it hands them on
_NO_ID = 2**63 - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def normal(line: str) -> str:
    """What is compared of a line: no white space at the ends, no case."""
    return line.strip().lower()


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def _windows(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all lines in a row, and where each line's begin; a shorter line is one shingle."""
    gap = "\n" * width
    codes = np.frombuffer((gap.join(lines) + gap).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashes = shingle_hashes(codes * _GOLD, width)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(sizes + width)[:-1]])
    counts = np.maximum(sizes - width + 1, 1)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return hashes[np.arange(counts.sum()) + np.repeat(starts - begins, counts)], begins


def shingles(line: str, width: int = SHINGLE) -> np.ndarray:
    return np.unique(_windows([line], width)[0])


def band_keys(lines: list[str], width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each line and band."""
    out, at = np.empty((len(lines), bands), np.uint64), 0
    factors = (mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    while at < len(lines):
        stop, size = at, 0
        while stop < len(lines) and (stop == at or size + len(lines[stop]) < _BLOCK):
            size += len(lines[stop])
            stop += 1
        hashes, begins = _windows(lines[at:stop], width)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        least, some = np.empty((bands * rows, len(begins)), np.uint32), np.empty_like(short)
        for f, of in zip(factors, least, strict=True):
            np.bitwise_xor(short, f >> np.uint32(7), out=some)
            np.multiply(some, f, out=some)
            np.minimum.reduceat(some, begins, out=of)
        key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, len(begins)).reshape(bands, -1)
        for row in range(rows):
            key = mixed(key * _GOLD + least[row::rows])
        out[at:stop] = key.T
        at = stop
    return out


def _in_bands(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that share a key, each paired with the key's first line and with the one before it: pairs grow with the lines, not with the
    square of a key's. The order is another one for each key. Also each key with its first line. All lines of a key lie in one component
    of these pairs, also across units, and all lines of a component are compared."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    last = np.concatenate([keys[1:] != keys[:-1], [True]]) if len(keys) else np.empty(0, bool)
    alone = last & np.concatenate([[True], last[:-1]]) if len(keys) else last
    single = keys[alone], ids[alone]  # most keys: no pairs
    keys, ids = keys[~alone], ids[~alone]
    order = np.lexsort((mixed(ids ^ keys), keys))
    keys, ids = keys[order], ids[order]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]) if len(keys) else np.empty(0, bool)
    keys, ids = keys[fresh], ids[fresh]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    at = np.flatnonzero(~first)
    head = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))[at] if len(at) else at
    a, b = np.concatenate([ids[at - 1], ids[head]]), np.concatenate([ids[at], ids[at]])
    return a, b, np.concatenate([single[0], keys[first]]), np.concatenate([single[1], ids[first]])


_PARTS = "kind int, bucket int, a binary, b binary, c binary, d binary"


def _parts(buckets: int, width: int, bands: int, rows: int):
    """What a task knows of its lines, packed by bucket. Kinds: 0 the first place of each line (line, doc, at, number), 1 keys
    (key, line), 2 pairs of lines with a common key, 3 places of lines that came before (doc, at, number)."""

    def packed(kind, key, arrays):
        if not len(key):
            return
        bucket = (mixed(key) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for piece in np.split(order, cuts):
            row = [a[piece].tobytes() for a in arrays]
            yield (kind, int(bucket[piece[0]]), *row, *[None] * (4 - len(row)))

    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def frame(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "bucket", "a", "b", "c", "d"])

    def unit(places, keys, ids):
        line, doc, at, number = places
        order = np.lexsort((number, at, doc, line))
        line, doc, at, number = line[order], doc[order], at[order], number[order]
        first = np.concatenate([[True], line[1:] != line[:-1]])
        yield frame(packed(0, line[first], (line[first], doc[first], at[first], number[first])))
        yield frame(packed(3, at[~first].view(np.uint64), (doc[~first], at[~first], number[~first])))
        a, b, keys, ids = _in_bands(keys.ravel(), np.repeat(ids, keys.shape[1]))
        yield frame(packed(2, a ^ b, (a, b)))
        yield frame(packed(1, keys, (keys, ids)))

    def run(batches):
        seen: set[int] = set()
        places, keys, ids, held = [], [], [], 0

        def flush():
            columns = [np.concatenate(x) for x in zip(*places, strict=True)]
            yield from unit(columns, np.concatenate(keys), np.concatenate(ids))

        for batch in batches:
            for part in some_rows(batch):
                line, doc, at, number, new, new_ids = [], [], [], [], [], []
                for d, h, text in zip(*(part.column(c).to_pylist() for c in ("doc", "at", "text")), strict=True):
                    for n, raw in enumerate(text.split("\n")):
                        if own := normal(raw):
                            i = line_id(own)
                            line.append(i), doc.append(d), at.append(h), number.append(n)
                            if i not in seen:
                                seen.add(i)
                                new.append(own), new_ids.append(i)
                if line:
                    places.append((np.array(line, np.uint64), np.array(doc, np.int64), np.array(at, np.int64), np.array(number, np.int32)))
                    keys.append(band_keys(new, width, bands, rows)), ids.append(np.array(new_ids, np.uint64))
                    held += len(line)
                if held >= _UNIT:
                    yield from flush()
                    seen, places, keys, ids, held = set(), [], [], [], 0
        if held:
            yield from flush()

    return run


def _whole(rows: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind)


def _merge_places(group: pd.DataFrame) -> pd.DataFrame:
    line, doc, at, number = (_whole(group[c], k) for c, k in zip("abcd", (np.uint64, np.int64, np.int64, np.int32), strict=True))
    order = np.lexsort((number, at, doc, line))
    line = line[order]
    first = np.concatenate([[True], line[1:] != line[:-1]])
    return pd.DataFrame({"line": line.view(np.int64), "doc": doc[order], "at": at[order], "number": number[order], "first": first})


def _merge_keys(group: pd.DataFrame) -> pd.DataFrame:
    a, b, _, _ = _in_bands(_whole(group["a"], np.uint64), _whole(group["b"], np.uint64))
    a, b = a.view(np.int64), b.view(np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _unpack_pairs(batches):
    for batch in batches:
        a, b = (_whole(batch[c], np.int64) for c in "ab")
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _unpack_places(batches):
    for batch in batches:
        yield pd.DataFrame({"doc": _whole(batch["a"], np.int64), "at": _whole(batch["b"], np.int64), "number": _whole(batch["c"], np.int32)})


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(line, ...)`` with the lines' ``text``, read again from the documents."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "line"))

    def scan(batches):
        for batch in batches:
            seen: dict[int, str] = {}
            for part in some_rows(batch):
                own = [x for text in part.column("text").to_pylist() for raw in text.split("\n") if (x := normal(raw))]
                ids = np.fromiter(map(line_id, own), np.uint64, len(own))
                for n in np.flatnonzero(in_bitmap(bits.value, ids)):
                    seen.setdefault(int(ids[n]), own[n])
            ids = np.fromiter(seen, np.uint64, len(seen)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(seen.values()), pa.string())], ["line", "text"])

    return docs.select("text").mapInArrow(scan, "line bigint, text string").join(wanted, "line").dropDuplicates(["line"])


def _shingle_sets(lines: list[str], width: int) -> dict[str, np.ndarray]:
    """Sorted distinct shingles of each line; all lines are hashed together."""
    lines = list(dict.fromkeys(lines))
    hashes, begins = _windows(lines, width)
    out = {}
    for line, begin, end in zip(lines, begins, [*begins[1:], len(hashes)], strict=True):
        own = np.sort(hashes[begin:end])
        out[line] = own[np.concatenate([[True], own[1:] != own[:-1]])]
    return out


def _similar(width: int, percent: int):
    @pandas_udf(T.BooleanType())
    def decide(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(left), 256):  # a line stands in many pairs: its set is made once for all that are near
            xs, ys = left.iloc[at:at + 256].to_list(), right.iloc[at:at + 256].to_list()
            sets = _shingle_sets([*xs, *ys], width)
            for x, y in zip(xs, ys, strict=True):
                if min(len(x), len(y)) < width:
                    out.append(x == y)
                    continue
                both = np.concatenate([sets[x], sets[y]])
                both.sort()
                common = np.count_nonzero(both[1:] == both[:-1])
                out.append(100 * common >= percent * (len(both) - common))
        return pd.Series(out, dtype=bool)

    return decide


def _open_families(families: DataFrame, known: DataFrame) -> DataFrame:
    """(node, family, part) of the lines of families in which lines may be similar that no link joins yet; a part is a component of the links that
    are known. Families in one part are settled."""
    found = families.join(known.withColumnRenamed("component", "part"), "node", "left")
    found = stored(found.withColumn("part", F.coalesce("part", "node")), "line-families")
    left = found.groupBy("family").agg(F.min("part").alias("first"), F.max("part").alias("last")).filter("first <> last")
    return found.join(left.select("family"), "family", "left_semi")


def repeated_lines(docs: DataFrame, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """(doc, at, number) of every line of ``docs(doc, at, text)`` that is not the first of its component, in order of document,
    ``at`` and line number.

    Tasks first combine their own lines: a line's first place, a key's first line. What they hand on is packed into one row for
    each bucket, so a line that fills a third of the corpus arrives once from each task. Lines with a common band key are
    paired with the key's first line and with the line before. Components of all pairs, similar or not, are families, and a family holds all lines of its keys.
    The lines of a family are linked exactly on their shingle sets (:func:`links_together`). In families of more than TOGETHER lines the pairs are compared first, and
    what similar ones leave apart is linked by :func:`links_between`; a line in a link belongs to its component.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(docs.mapInArrow(_parts(buckets, width, bands, rows), _PARTS), "line-parts")
    of = lambda kind: parts.filter(F.col("kind") == kind)
    places = stored(of(0).groupBy("bucket").applyInPandas(_merge_places, "line bigint, doc bigint, at bigint, number int, first boolean"), "line-places")
    found = of(1).groupBy("bucket").applyInPandas(_merge_keys, "a bigint, b bigint")
    pairs = stored(found.union(of(2).select("a", "b").mapInPandas(_unpack_pairs, "a bigint, b bigint")).distinct(), "line-pairs")
    families = stored(counted(components(pairs).withColumnRenamed("component", "family")), "families")
    texts = stored(_line_texts(docs, families.withColumnRenamed("node", "line")), "line-texts")
    few, many = texts.filter(F.col("n") <= TOGETHER), texts.filter(F.col("n") > TOGETHER)
    left, right = many.select(F.col("line").alias("a"), F.col("text").alias("left")), many.select(F.col("line").alias("b"), F.col("text").alias("right"))

    def read(own):
        return list(map(_shingle_sets(own, width).__getitem__, own))

    def confirm(found):  # written, so that no stage holds the workers of two Python steps
        return stored(found.join(left, "a").join(right, "b").filter(_similar(width, percent)("left", "right")).select("a", "b"), "line-links")

    # texts travel, which are shorter than their sets
    together = stored(links_together(few.select("family", F.col("line").alias("node"), F.col("text").alias("shingles")), percent, read), "line-links")
    known = confirm(pairs)
    links = links_between(
        _open_families(families.filter(F.col("n") > TOGETHER).select("node", "family"), components(known)),
        many.select(F.col("line").alias("set_id"), F.col("text").alias("shingles")), percent, confirm, read=read)
    members = components(together.union(known).union(links)).withColumnRenamed("node", "line").join(places.filter("first"), "line")
    members = stored(members.select("component", F.struct("doc", "at", "number").alias("place")), "line-members")
    kept = members.groupBy("component").agg(F.min("place").alias("kept"))
    others = members.join(kept, "component").filter("place <> kept").select("place.doc", "place.at", "place.number")
    again = of(3).select("a", "b", "c").mapInPandas(_unpack_places, "doc bigint, at bigint, number int")
    return places.filter("NOT first").select("doc", "at", "number").union(again).union(others)


def line_decisions(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` plus ``dropped``: the numbers (from 0) of the lines of ``text`` that are not the first of their component, null
    where there are none.

    Lines are split at newlines. Two lines are linked if their normal forms (ends trimmed, lower case) are equal or share 80
    percent of their shingles of 8 characters; shorter lines are linked if they are equal. Of a component the line in the smallest (doc_id, hash of
    text, line number) stays; a null doc_id comes last.

    Defined cases: null texts have no lines; blank lines are never dropped; rows that agree in doc_id and text are decided alike
    (their lines stay or go together); texts and lines of any length are read whole; an empty table gives no rows; other columns
    pass through, a column ``dropped`` is replaced. Lines are compared by 64-bit hashes where they are equal.
    """
    rows = docs.drop("dropped").withColumns({"__doc": F.coalesce("doc_id", F.lit(_NO_ID)), "__at": F.xxhash64("doc_id", F.xxhash64("text"))})
    lines = rows.filter("text IS NOT NULL").select(F.col("__doc").alias("doc"), F.col("__at").alias("at"), "text")
    dropped = stored(
        repeated_lines(lines, **parameters).groupBy(F.col("doc").alias("__doc"), F.col("at").alias("__at")).agg(F.array_sort(F.collect_set("number")).alias("dropped")), "dropped-lines")
    return rows.join(dropped, ["__doc", "__at"], "left").drop("__doc", "__at")


@pandas_udf(T.StringType())
def _without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    return pd.Series([
        None if gone is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in lost)
        for text, gone in zip(texts, dropped, strict=True) for lost in [set(gone if gone is not None else ())]])


def dedupe_lines(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the lines that :func:`line_decisions` drops. A document all of whose text is found elsewhere stays as a
    row with an empty text; ``n_dropped`` says how many lines went."""
    marked = line_decisions(docs, **parameters).withColumn("n_dropped", F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long"))
    lost = F.col("dropped").isNotNull()
    shorter = _without(F.when(lost, F.col("text")), F.col("dropped"))
    return marked.withColumn("text", F.when(lost, shorter).otherwise(F.col("text"))).drop("dropped")
