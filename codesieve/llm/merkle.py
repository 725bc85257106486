"""A Merkle manifest of a dataset: leaf hashes, a root a group, one root of all, and every row's proof, by butterfly exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import stored

_NO_GROUP = ""  # keys of groups that exist begin with "="


def field_hash(*columns: Column) -> Column:
    """Lowercase hex sha256 of the fields in a row: ``-`` for a null, else the value's length in bytes, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows(group, rank, hash, kept)`` with ``position``, from 0 in the order of (rank, hash) of its group, and the group's ``total``.

    Rows are dealt out and sorted by range, so that a group of any size is split; the few rows that say where a group stands in
    each range are summed up by a window.
    """
    order = ["group", "rank", "hash"]
    sorted_ = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    place = F.shiftright("at", 33)
    ranges = sorted_.groupBy("group", place.alias("place")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ranges = ranges.selectExpr(
        "group", "place", "first", "SUM(n) OVER (PARTITION BY group) AS total",
        "COALESCE(SUM(n) OVER (PARTITION BY group ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier")
    return sorted_.withColumn("place", place).join(ranges, ["group", "place"]).select(
        "group", "total", (F.col("earlier") + F.col("at") - F.col("first")).alias("position"), "hash", "kept")


def _chunks(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Aligned chunks of ``fanout ** levels`` leaves, each with its own subtree: (group, part, total, leaves, tree). ``tree`` has one array of
    hashes a level, up to the chunk's root; in a group that is one chunk it ends where one node is left."""
    size = fanout**levels
    leaf = F.struct("position", "hash", "kept")
    packed = rows.groupBy("group", F.floor(F.col("position") / size).alias("part")).agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(leaf), lambda x, y: F.signum(x["position"] - y["position"]).cast("int")).alias("leaves"))

    def above(tree: Column, level: Column) -> Column:
        below = F.element_at(tree, -1)
        runs = F.transform(F.sequence(F.lit(1), F.size(below), F.lit(fanout)), lambda i: F.sha2(_joined(F.slice(below, i, fanout)), 256))
        return F.when(F.col("total") > F.pow(F.lit(fanout), level - 1), F.concat(tree, F.array(runs))).otherwise(tree)

    tree = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(F.transform("leaves", lambda x: x["hash"])), above)
    return packed.withColumn("tree", tree)


def _receivers(unit: int, fanout: int) -> Column:
    """The chunks that a chunk sends its root to, itself among them, where runs of ``unit`` chunks are swapped."""
    run = F.floor(F.col("part") / unit)
    offset = F.col("part") - run * unit
    members = lambda of: F.least(F.lit(unit), F.col("parts") - of * unit)

    def there(i: Column) -> Column:
        other = F.floor(run / fanout) * fanout + i
        those = F.sequence(other * unit + offset, other * unit + members(other) - 1, members(run))
        return F.when(other == run, F.array(F.col("part"))).when(offset < members(other), those).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), there))


def _exchanged(chunks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(group, part, root, path): what each chunk knows after the butterfly. ``path`` leads from the chunk's root to the group's.

    In round r, chunk p holds the root of the aligned run of fanout^r chunks that it stands in. It swaps it with one chunk of each
    other such run in its run of fanout^(r+1), and hashes what it has got: all chunks of a run make the same node, and none
    has to be told later. A chunk sends to those that stand where it does; the last run of a group may be short, then its chunks take turns.
    """
    size = fanout**levels
    known = stored(chunks.select(
        "group", "part", F.ceil(F.col("total") / size).alias("parts"), F.element_at(F.element_at("tree", -1), 1).alias("root"),
        F.array().cast("array<struct<before:string,after:string>>").alias("path")), "merkle-parts")
    most = known.agg(F.max("parts")).first()[0] or 0
    unit = 1
    while unit < most:
        sent = known.select(
            "group", "part", "parts", F.floor(F.col("part") / unit).alias("run"), "root", "path", F.explode(_receivers(unit, fanout)).alias("to"))
        own = F.col("to") == F.col("part")
        got = sent.groupBy("group", "to").agg(
            F.max("parts").alias("parts"), F.max(F.when(own, F.col("run"))).alias("run"), F.max(F.when(own, F.col("path"))).alias("path"),
            F.array_sort(F.collect_list(F.struct("run", "root"))).alias("runs"))
        side = lambda test: _joined(F.transform(F.filter("runs", test), lambda x: x["root"]))
        step = F.struct(side(lambda x: x["run"] < F.col("run")).alias("before"), side(lambda x: x["run"] > F.col("run")).alias("after"))
        open_ = F.col("parts") > unit
        known = got.select(
            "group", F.col("to").alias("part"), "parts",
            F.when(open_, F.sha2(_joined(F.col("runs.root")), 256)).otherwise(F.col("runs")[0]["root"]).alias("root"),
            F.when(open_, F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path"))
        unit *= fanout
    return stored(known.select("group", "part", "root", "path"), "merkle-tops")


def _proved(chunks: DataFrame, tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """A row for each leaf: its hash, ``kept``, all further columns of ``tops``, and the path through its chunk, followed by that of ``tops``."""

    def step(j: Column, level: Column) -> Column:
        at = F.floor(j / F.pow(F.lit(fanout), level)).cast("int")
        inside = at % fanout
        run = F.slice(F.col("tree")[level], at - inside + 1, F.lit(fanout))
        return F.struct(_joined(F.slice(run, F.lit(1), inside)).alias("before"), _joined(F.slice(run, inside + 2, F.lit(fanout))).alias("after"))

    steps = F.slice(F.sequence(F.lit(0), F.lit(levels)), F.lit(1), F.size("tree") - 1)
    leaf = lambda x, j: F.struct(x["hash"].alias("hash"), x["kept"].alias("kept"), F.transform(steps, lambda level: step(j, level)).alias("path"))
    more = [c for c in tops.columns if c not in ("group", "part", "path")]
    rows = chunks.join(tops, ["group", "part"]).select("group", *more, F.col("path").alias("upper"), F.explode(F.transform("leaves", leaf)).alias("leaf"))
    return rows.select("group", *more, "leaf.hash", "leaf.kept", F.concat("leaf.path", "upper").alias("path"))


def manifest(rows: DataFrame, leaf: Column, group: Column, rank: Column, keep: list[str], fanout: int = 16, levels: int = 3) -> DataFrame:
    """For each row: the columns ``keep``, ``leaf`` (its hash), ``subroot`` (of its group), ``root`` (of all) and ``path``, the hashes beside its way up: an
    array of (before, after), each the digests of a run's other nodes, from the leaf's run to the root's.

    Leaves of a group stand in the order of ``rank`` (nulls first), ties by hash. While more than one node remains, every ``fanout`` consecutive
    ones become one; a last, shorter run does, too, even if it is one node. The groups' subroots, in the order of ``group`` (null first, then by
    bytes), are the leaves of one more such tree. :func:`folded` and :func:`proof_digest` use the path.

    Leaves are numbered by sorting them by range, and cut into aligned chunks of fanout^levels. A chunk hashes its own subtree; then
    chunks swap roots round by round (:func:`_exchanged`), and each has its upper proof when the root is known. No task holds more than a
    chunk, or ``fanout`` roots, whatever the size of a group or the number of groups.

    Defined cases: nulls are fields like others (:func:`field_hash`); rows that agree in group, rank and hash have places of their own, in any
    order among them; a lone leaf is its group's subroot, a lone subroot the root, with an empty path; an empty table gives no rows. Columns not in ``keep`` are
    ignored; a kept column may have any name but those of the results.
    """
    key = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(_NO_GROUP))
    leaves = stored(rows.select(key.alias("group"), rank.alias("rank"), leaf.alias("hash"), F.struct(*keep).alias("kept")), "merkle-leaves")
    chunks = stored(_chunks(_numbered(leaves), fanout, levels), "merkle-chunks")
    tops = _exchanged(chunks, fanout, levels)
    roots = tops.filter("part = 0").select(F.lit(_NO_GROUP).alias("group"), F.col("group").alias("rank"), F.col("root").alias("hash"), F.struct("group").alias("kept"))
    upper = stored(_chunks(_numbered(roots), fanout, levels), "merkle-group-chunks")
    groups = _proved(upper, _exchanged(upper, fanout, levels), fanout, levels).select(
        F.col("kept.group").alias("group"), F.col("hash").alias("subroot"), "root", F.col("path").alias("above"))
    both = tops.drop("root").join(groups, "group").select("group", "part", "subroot", "root", F.concat("path", "above").alias("path"))
    return _proved(chunks, both, fanout, levels).select(*[F.col("kept")[c].alias(c) for c in keep], F.col("hash").alias("leaf"), "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the hashes beside its way."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """One hash of all hashes beside the way, from the leaf up, left to right."""
    return F.sha2(_joined(F.transform(path, lambda step: F.concat(step["before"], step["after"]))), 256)
