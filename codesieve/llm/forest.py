"""Near-duplicate documents by an LSH forest: sorted MinHash signatures whose neighbours are compared exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from codesieve.llm.common import bitmap, in_bitmap, mixed, shingle_hashes, some_rows, stored, word_hashes, words
from codesieve.llm.components import components

TREES, DEPTH = 12, 6
_CHUNK = 2048
_GOLD = 0x9E3779B97F4A7C15


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; fewer words are one run, no words none."""
    tokens = word_hashes(words(text))
    if not len(tokens):
        return tokens
    return np.unique(shingle_hashes(tokens, min(width, len(tokens))))


def _factors(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of 32 bits."""
    factors = _factors(n)[:, None]
    out = np.full(n, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[None, at:at + _CHUNK]
        out = np.minimum(out, ((part ^ (factors >> np.uint64(17))) * factors).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, width: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``n_shingles``, ``set_id`` (a hash of the set; null if it's empty) and the signature of each row of ``docs(doc_id, at, text)``."""

    def scan(batches):
        for batch in batches:
            for part in some_rows(batch):
                sets = [shingle_set(text, width) for text in part.column("text").to_pylist()]
                ids = [xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets]
                signatures = [signature(s, trees * depth).astype(">u4").tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("at"), pa.array(map(len, sets), pa.int64()), pa.array(ids, pa.int64()), pa.array(signatures, pa.binary())],
                    ["doc_id", "at", "n_shingles", "set_id", "signature"])

    return docs.select("doc_id", "at", "text").mapInArrow(scan, "doc_id bigint, at bigint, n_shingles bigint, set_id bigint, signature binary")


def _neighbours(window: int, least: int, width: int, ends: bool):
    """Pairs of rows of a sorted partition that are at most ``window`` apart and share ``least`` leading values or more; with
    ``ends``, also the partition's first and last rows, which may have neighbours in the next one."""

    def pairs_of(tree, prefix, node):
        values = np.frombuffer(b"".join(prefix), ">u4").reshape(len(prefix), width)
        out = []
        for off in range(1, min(window, len(node) - 1) + 1):
            common = np.cumprod(values[:-off] == values[off:], axis=1).sum(axis=1)
            hit = np.flatnonzero((common >= least) & (tree[:-off] == tree[off:]))
            out.append(np.stack([hit, hit + off, common[hit]]))
        return np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)

    def run(batches):
        columns = ["a", "b", "common", "tree", "prefix"]
        held, first = None, True
        for batch in batches:
            if not len(batch):
                continue
            if ends and first:
                yield batch.head(window).assign(a=lambda x: x["node"], b=None, common=None)[columns]
            first = False
            old = 0 if held is None else len(held)
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            node = rows["node"].to_numpy(np.int64)
            i, j, common = pairs_of(rows["tree"].to_numpy(), rows["prefix"].to_list(), node)
            new = j >= old  # pairs inside the rows held over are known
            a, b = node[i[new]], node[j[new]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "common": common[new], "tree": None, "prefix": None})
            held = rows.tail(window)
        if ends and held is not None:
            yield held.assign(a=lambda x: x["node"], b=None, common=None)[columns]

    return run


def candidates(sets: DataFrame, trees: int = TREES, depth: int = DEPTH, least: int = 2, window: int = 3) -> DataFrame:
    """(a, b, support) with a < b: sets that are neighbours in some tree.

    A tree is one sorted order of all signatures, each by its own ``depth`` values. Its rows are dealt out by range, with the id
    as the last key, so that a region of any size is cut evenly. A row's neighbours are those next to it, which share the longest
    prefix: where rows are sparse, ``least`` common values will do, and where a region is dense the depth grows until the prefix
    leaves ``window`` rows. So pairs grow with the rows, never with the square of a region. Rows at either end of a range are
    paired in a second, small pass.
    """
    rows = sets.select(
        F.col("set_id").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "signature").select(
        "node", "tree", F.expr(f"substring(signature, tree * {4 * depth} + 1, {4 * depth})").alias("prefix"))
    order = ["tree", "prefix", "node"]
    schema = "a bigint, b bigint, common int, tree int, prefix binary"
    found = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_neighbours(window, least, depth, True), schema), "neighbours")
    ends = found.filter("b IS NULL").select(F.col("a").alias("node"), "tree", "prefix").distinct()
    across = ends.repartition(1).sortWithinPartitions(*order).mapInPandas(_neighbours(window, least, depth, False), schema)
    return found.filter("b IS NOT NULL").union(across).groupBy("a", "b").agg(F.sum("common").alias("support"))


def _set_table(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted(set_id, at, ...)`` without ``at`` and with the sets' ``shingles``, read again from their documents in ``docs(at, text)``."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "at"))

    def scan(batches):
        for batch in batches:
            for part in some_rows(batch):
                part = part.filter(pa.array(in_bitmap(bits.value, part.column("at").to_numpy())))
                found = [s for text in part.column("text").to_pylist() if len(s := shingle_set(text, width))]
                ids = [xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in found]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["set_id", "shingles"])

    return docs.select("at", "text").mapInArrow(scan, "set_id bigint, shingles binary").join(wanted.drop("at"), "set_id").dropDuplicates(["set_id"])


def _similar(percent: int):
    @pandas_udf(T.BooleanType())
    def decide(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(x) + len(y) - len(np.union1d(x, y))
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    return decide


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are similar: 100 * intersection >= percent * union."""
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").filter(_similar(percent)("left", "right")).select("a", "b")


def _numbers(shingles: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in shingles]


_CELLS, _PIECE = 1 << 18, 1 << 12  # counters of shingles, and of them in a row


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (mixed(shingles) >> np.uint64(64 - 18)).astype(np.int64)


def _frequencies(rows: DataFrame, read) -> np.ndarray:
    """How often the shingles of each of _CELLS cells occur in ``rows(shingles)``: a table of fixed size, summed by tasks first."""

    def count(batches):
        total = np.zeros(_CELLS, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                sets = read(batch["shingles"].iloc[at:at + 256].to_list())
                total += np.bincount(_cells(np.concatenate(sets)), minlength=_CELLS)
        yield pd.DataFrame({"piece": range(_CELLS // _PIECE), "counts": list(total.reshape(-1, _PIECE))})

    def add(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": [key[0]], "counts": [np.sum(np.stack(pieces["counts"].to_list()), axis=0)]})

    schema = "piece int, counts array<bigint>"
    found = rows.select("shingles").mapInPandas(count, schema).groupBy("piece").applyInPandas(add, schema).toArrow()
    out = np.zeros((_CELLS // _PIECE, _PIECE), np.int64)
    out[found["piece"].to_numpy()] = found["counts"].combine_chunks().flatten().to_numpy().reshape(-1, _PIECE)
    return out.ravel()


_PICKED = 32  # sets, about, that a family's centres are made of
_CENTRES = 8  # most of a family


def _common(own: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Which of ``own`` are in ``centre``, both sorted."""
    if not len(centre):
        return np.zeros(len(own), bool)
    return centre[np.minimum(np.searchsorted(centre, own), len(centre) - 1)] == own


def _distance(own: np.ndarray, centre: np.ndarray) -> float:
    common = np.count_nonzero(_common(own, centre))
    return 1 - common / (len(own) + len(centre) - common)


def _centres(read):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """What most sets hold, of those around one: first around the set that has the most others within half their shingles, then of what is left. Sets
        that are all far from each other have one centre."""
        sets = read(group["shingles"].to_list())
        near = np.eye(len(sets), dtype=bool)
        for i, own in enumerate(sets):
            for j in range(i):
                near[i, j] = near[j, i] = _distance(own, sets[j]) <= 0.5
        left, around = np.ones(len(sets), bool), []
        while len(around) < _CENTRES and (most := (near & left).sum(axis=1)).max() > 1:
            around.append(np.flatnonzero(near[most.argmax()] & left))
            left[around[-1]] = False
        centres = []
        for own in around or [np.arange(len(sets))]:
            every, times = np.unique(np.concatenate([sets[i] for i in own]), return_counts=True)
            centres.append(every[2 * times > len(own)].tobytes())
        return pd.DataFrame({"family": [group["family"].iloc[0]], "centres": [centres]})

    return run


def _differences(percent: int, read):
    """Each set as what tells it from the centres of its family that are next to it; a centre and the sets it is next to are a cluster. ``delta`` are the
    shingles that only one of both holds, ``excess`` is (100 + percent) * |delta| - (100 - percent) * n, ``lost`` how many of ``delta`` a
    similar set can lack at most. ``home`` is the cluster of the nearest centre.

    Distances of sets obey the triangle inequality, and similar sets are 1 - percent / 100 apart at most. So a set is found at the home of each set
    that is similar to it, if it is in all clusters whose centres are farther than its nearest one by up to twice that."""
    slack = 2 * (100 - percent) / 100 + 1e-9

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.iloc[first:first + 256]
                at, family, home, deltas, n, w, lost = [], [], [], [], [], [], []
                for row, (of, own, centres) in enumerate(zip(part["family"], read(part["shingles"].to_list()), part["centres"], strict=True)):
                    centres = _numbers(centres) if centres is not None else [np.empty(0, np.uint64)]
                    far = np.array([_distance(own, c) for c in centres]) if len(centres) > 1 else np.zeros(1)
                    for k in np.flatnonzero(far <= far.min() + slack):
                        centre, inside = centres[k], _common(own, centres[k])
                        common = np.count_nonzero(inside)
                        alone = np.concatenate([own[~inside], centre[~_common(centre, own)]])
                        alone.sort()
                        at.append(row), family.append((of + int(k) * _GOLD) % 2**64), home.append(k == far.argmin())
                        deltas.append(alone.tobytes()), n.append(len(own)), w.append(len(alone))
                        # of a similar pair, all that only one of both holds is n * (100 - percent) / percent at most, and n * (100 - percent) / 100 of it are mine
                        own_most = min(len(own) - common, len(own) * (100 - percent) // 100)
                        lost.append(min(len(own) * (100 - percent) // percent, own_most + len(centre) - common))
                n, w = np.array(n, np.int64), np.array(w, np.int64)
                yield pd.DataFrame({
                    "family": np.array(family, np.uint64).view(np.int64), "node": part["node"].to_numpy()[at], "part": part["part"].to_numpy()[at],
                    "home": np.array(home, bool), "excess": (100 + percent) * w - (100 - percent) * n, "lost": np.array(lost, np.int64), "delta": deltas})

    return run


_RECORD = np.dtype([("at", "u8"), ("node", "i8"), ("part", "i8"), ("excess", "i8"), ("ahead", "i8"), ("flags", "u1")])
_ASKS, _ASKED, _HOME, _MIDDLE = 1, 2, 4, 8
_DEALT = 256  # differences, about, whose shingles are in a bucket
_HOT = 1 << 13  # differences that hold a shingle, about, whose askers are in one bucket
_PAIRED = 1 << 20  # pairs looked at together


def _prefixes(frequencies, percent: int, buckets: int, hot: int = _HOT):
    """Of each difference its rarest shingles: so many that it shares one of them with that of every similar set whose excess is known to be so much or
    more, if the excesses add up to more than 0 and both keep one order of all shingles. A set outside the middle asks with those for ``of_all``, and every set is asked by those
    for ``of_asked``, which are the first of them. ``ahead`` counts a shingle and those behind it.

    The shingles are packed, a row for each bucket of (cluster, shingle), ``at``. If very many differences hold a shingle, those that ask with it are dealt
    to several places, and those that are asked by it are in each of these."""

    def run(batches):
        for batch in batches:
            dealt = []
            for first in range(0, len(batch), 256):
                part = batch.iloc[first:first + 256]
                sets = _numbers(part["delta"].to_list())
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                order = np.lexsort((every, frequencies.value[_cells(every)], owner))
                at = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                excess, middle, node = part["excess"].to_numpy(), part["middle"].to_numpy(bool), part["node"].to_numpy()
                wide = {}
                for least in ("of_all", "of_asked"):
                    common = np.maximum(-(-(excess + part[least].to_numpy()) // (2 * (100 + percent))), sizes - part["lost"].to_numpy())
                    wide[least] = sizes - np.maximum(common, 1) + 1
                asks, asked = ~middle[owner] & (at < wide["of_all"][owner]), at < wide["of_asked"][owner]
                kept = np.flatnonzero(asks | asked)
                keys, own = every[order[kept]], owner[kept]
                places = 1 + frequencies.value[_cells(keys)] // hot
                again = np.repeat(np.arange(len(kept)), places)
                place = np.arange(len(again)) - np.repeat(np.cumsum(places) - places, places)
                kept, keys, own, places = kept[again], keys[again], own[again], places[again]
                asks = asks[kept] & ((mixed(node[own].view(np.uint64)) % places.astype(np.uint64)).astype(np.int64) == place)
                out = np.empty(len(kept), _RECORD)
                out["at"] = mixed(mixed(part["family"].to_numpy().view(np.uint64)[own] + np.uint64(_GOLD) * place.astype(np.uint64)) ^ keys)
                out["node"], out["part"], out["excess"], out["ahead"] = node[own], part["part"].to_numpy()[own], excess[own], sizes[own] - at[kept]
                out["flags"] = _ASKS * asks + _ASKED * asked[kept] + _HOME * part["home"].to_numpy(bool)[own] + _MIDDLE * middle[own]
                dealt.append(out[asks | asked[kept]])
            records = np.concatenate(dealt) if dealt else np.empty(0, _RECORD)
            bucket = (records["at"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            records, bucket = records[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            pieces = np.split(np.arange(len(records)), cuts) if len(records) else []
            yield pd.DataFrame({"bucket": [bucket[x[0]] for x in pieces], "records": [records[x].tobytes() for x in pieces]}).astype({"bucket": "int64"})

    return run


def _asking_pairs(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Pairs of sets of different parts, one asking the other by a shingle behind which both have enough left. A pair outside the middle is asked once."""
        records = np.frombuffer(b"".join(group["records"]), _RECORD)
        records = records[np.argsort(records["at"], kind="stable")]
        asking, asked = (records[records["flags"] & flag > 0] for flag in (_ASKS, _ASKED))
        begins = np.searchsorted(asked["at"], asking["at"])
        counts = np.searchsorted(asked["at"], asking["at"], "right") - begins
        out = [pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})]
        for some in np.split(np.arange(len(asking)), np.flatnonzero(np.diff(np.cumsum(counts) // _PAIRED)) + 1):
            x = np.repeat(some, counts[some])
            y = np.arange(len(x)) - np.repeat(np.cumsum(counts[some]) - counts[some], counts[some]) + begins[x]
            for name, wanted in (
                ("part", lambda i, j: i != j),
                ("ahead", lambda i, j: np.minimum(i, j) * (2 * (100 + percent)) >= asking["excess"][x] + asked["excess"][y]),
                ("flags", lambda i, j: (i | j) & _HOME > 0),
                ("node", lambda i, j: (asked["flags"][y] & _MIDDLE > 0) | (i < j)),
            ):
                hit = wanted(asking[name][x], asked[name][y])
                x, y = x[hit], y[hit]
            a, b = asking["node"][x], asked["node"][y]
            out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates())
        return pd.concat(out, ignore_index=True).drop_duplicates()

    return run


TOGETHER = 64  # sets of a family whose pairs are all compared, at most
_COUNTED = 1 << 22  # entries of a matrix of sets and shingles


def counted(families: DataFrame) -> DataFrame:
    """``families(node, family)`` with ``n``, how many nodes the family has."""
    return families.join(families.groupBy("family").agg(F.count("*").alias("n")), "family")


def _tree(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components which all links between these sets give: a tree of each."""
    n, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    if n == 2:
        shared = np.count_nonzero(_common(*sets))
        return [(0, 1)] if 100 * shared >= percent * (sizes.sum() - shared) else []
    every, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, several = np.repeat(np.arange(n), sizes), times > 1  # what one set holds alone is in no intersection
    at, owner = (np.cumsum(several) - 1)[at[several[at]]], owner[several[at]]
    common, wide = np.zeros((n, n), np.int64), _COUNTED // n
    for first in range(0, int(several.sum()), wide):
        own = (at >= first) & (at < first + wide)
        holds = np.zeros((n, min(wide, int(several.sum()) - first)), np.float32)
        holds[owner[own], at[own] - first] = 1
        common += (holds @ holds.T).astype(np.int64)
    similar = 100 * common >= percent * (sizes[:, None] + sizes - common)
    out, left = [], np.ones(n, bool)
    for start in range(n):
        ahead = [start] if left[start] else []
        left[start] = False
        while ahead:
            x = ahead.pop()
            found = np.flatnonzero(similar[x] & left)
            left[found] = False
            out += [(x, int(y)) for y in found]
            ahead += found.tolist()
    return out


def links_together(rows: DataFrame, percent: int, read=_numbers) -> DataFrame:
    """(a, b): links between the sets of each family of ``rows(family, node, shingles)``, enough for the components that all links would give; exact. Families
    of TOGETHER sets or fewer: each comes to one task, which counts the intersections of all its pairs. ``read`` is that of :func:`links_between`."""

    def links(part: pd.DataFrame) -> pd.DataFrame:
        family, node, a, b = part["family"].to_numpy(), part["node"].to_numpy(np.int64), [], []
        starts = np.flatnonzero(np.concatenate([[True], family[1:] != family[:-1]]))
        ends = np.append(starts[1:], len(part))
        for some in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts // 256)) + 1):  # whole families, of some 256 rows
            begin = starts[some[0]]
            sets = read(part["shingles"].iloc[begin:ends[some[-1]]].to_list())
            for start, end in zip(starts[some], ends[some], strict=True):
                for x, y in _tree(sets[start - begin:end - begin], percent):
                    a.append(node[start + x]), b.append(node[start + y])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    def run(batches):
        held = None  # rows of the last family, which may go on
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            family = rows["family"].to_numpy()
            last = int((family != family[-1]).sum()) if len(rows) else 0
            if last:
                yield links(rows.iloc[:last])
            held = rows.iloc[last:]
        if held is not None and len(held):
            yield links(held)

    rows = rows.select("family", "node", "shingles").repartition("family").sortWithinPartitions("family")
    return rows.mapInPandas(run, "a bigint, b bigint")


def links_between(families: DataFrame, sets: DataFrame | None, percent: int, confirm, read=_numbers) -> DataFrame:
    """(a, b): links between the sets of a family, enough for the components that all links would give; exact. ``families(node, family)`` may have a column
    ``part``: sets of one part are known to be in one component, and no link between them is asked for. Without ``sets(set_id, shingles)`` it is a written table that has
    their ``shingles``. ``read`` gives the sorted distinct hashes
    of each of a list of values of ``shingles``, ``confirm`` keeps those of ``pairs(a, b)`` whose sets are similar.

    A family has a few centres, each the shingles that most sets around it hold, and a set takes part in the clusters of the centres next to it, so that every
    pair of similar sets is in one cluster, at home for one of them (:func:`_differences`). There each set is told by its difference d to the centre C. Two sets differ in
    |d| + |d'| - 2 |d & d'| shingles, so they are similar if, and only if, the sum of their excesses (see :func:`_differences`) is at most
    2 * (100 + percent) * |d & d'|. That holds for any C; a good one only makes differences small. So

    - the set of the least excess is similar to all whose excess is at most its own with the sign turned. Any two sets whose excesses
      add up to 0 or less are among these. No pair is looked at for that;
    - every other link asks for shingles that both differences share. These meet in buckets of (cluster, shingle), rarest first: a difference
      takes part with so many that a pair with enough in common meets, and behind the first one both must have enough left. Near copies that lie
      below the similarity share nearly all of the centre, but hardly any of their differences. Tasks pack what they deal out by bucket.

    The parts that the first step joins are the middle of the cluster; every set outside is asked against all of other parts.
    """
    spark = families.sparkSession
    if "part" not in families.columns:
        families = families.withColumn("part", F.col("node"))
    rows = families
    if sets is not None:
        rows = stored(families.join(sets.withColumnRenamed("set_id", "node"), "node").select("family", "node", "part", "shingles"), "apart")
    counts = families.groupBy("family").agg(F.ceil(F.count("*") / _PICKED).alias("one_in"))
    picked = F.expr("pmod(xxhash64(node), one_in) = 0")
    centres = rows.join(counts, "family").filter(picked).select("family", "shingles")
    centres = stored(centres.groupBy("family").applyInPandas(_centres(read), "family bigint, centres array<binary>"), "centres")
    schema = "family bigint, node bigint, part bigint, home boolean, excess bigint, lost bigint, delta binary"
    told = stored(rows.select("family", "node", "part", "shingles").join(centres, "family", "left").mapInPandas(_differences(percent, read), schema), "differences")

    first = told.groupBy("family").agg(F.min(F.struct("excess", "node")).alias("first"))
    told = told.join(stored(first, "first"), "family").withColumn("near", (F.col("node") == F.col("first.node")) | (F.col("excess") + F.col("first.excess") <= 0))
    plain = told.filter("near AND node <> first.node").select(F.col("first.node").alias("a"), F.col("node").alias("b"))
    whole = stored(told.groupBy("family", "part").agg(F.max("near").alias("middle"), F.min("excess").alias("least")), "family-parts")
    outside = whole.filter("NOT middle").groupBy("family").agg(F.min("least").alias("of_asked"))
    rows = told.join(whole.drop("least"), ["family", "part"]).join(outside, "family").select(
        "family", "node", "part", "home", "excess", "lost", "delta", "middle", F.col("first.excess").alias("of_all"), "of_asked")
    rows = stored(rows, "differences")

    frequencies = spark.sparkContext.broadcast(_frequencies(rows.select(F.col("delta").alias("shingles")), _numbers))
    dealt = rows.mapInPandas(_prefixes(frequencies, percent, rows.count() // _DEALT + 1), "bucket bigint, records binary")
    pairs = dealt.groupBy("bucket").applyInPandas(_asking_pairs(percent), "a bigint, b bigint")
    pairs = stored(pairs.distinct(), "pairs-apart")
    return plain.union(confirm(pairs))


def linked_sets(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the sets that have a link.

    Sets with a link share a prefix in some tree, and so do all rows between them in its order, so both lie in one component of the
    candidates, their family, even where a dense region hides them from each other's neighbours. :func:`links_together` finds what
    joins the sets of a family, :func:`links_between` does for families of more than TOGETHER sets.
    """
    families = stored(counted(components(candidates(sets).select("a", "b")).withColumnRenamed("component", "family")), "families")
    wanted = sets.select("set_id", "at").join(families.withColumnRenamed("node", "set_id"), "set_id")
    table = stored(_set_table(docs, wanted, width), "sets")
    few, many = table.filter(F.col("n") <= TOGETHER), table.filter(F.col("n") > TOGETHER)
    links = stored(links_together(few.withColumnRenamed("set_id", "node"), percent), "links")
    more = links_between(many.withColumnRenamed("set_id", "node"), None, percent, lambda pairs: confirmed(pairs, many.select("set_id", "shingles"), percent))
    links = links.union(more)
    return stored(components(stored(links, "links")), "components")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, ``at`` (a hash of doc_id and text), n_shingles, component_id, kept.

    Documents are linked if their sets of ``width``-word shingles (words without the case of A-Z; a shorter text is one shingle) have
    a similarity of ``percent`` or more; a component's id is the smallest doc_id in it, and that document is kept.

    Equal sets are one node, whatever their number, so copies meet in an aggregate only. Candidates come from the forest
    (:func:`candidates`), links are confirmed on whole sets, and components are found over tables. Nodes and shingles are 64-bit hashes.

    Defined cases: null texts and texts without words have no shingles, link with nothing and are kept; a null doc_id is never the smallest
    unless all of its component are null, and rows with a null doc_id are kept only then; repeated rows are decided
    alike; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("at"), "text")
    known = stored(sketches(rows, width), "sketches")
    sets = stored(
        known.filter("set_id IS NOT NULL").groupBy("set_id").agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias("first"), F.first("signature").alias("signature"))
        .select("set_id", "first.doc_id", "first.at", "signature"), "classes")
    joined = linked_sets(rows, sets, width, percent)
    members = sets.select("set_id", "doc_id").join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id"))
    smallest = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = stored(members.join(smallest, "component").select("set_id", "component_id"), "members")
    out = known.drop("signature").join(found, "set_id", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "at", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))
