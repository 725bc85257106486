"""What several operators need: tables in the shared folder, word splitting, hashes of tokens."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session without one gets its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    folder = folder or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="codesieve-llm-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Rows of an Arrow batch while a table is written: documents may be long, and a batch is held by both sides at once.
ARROW_ROWS = 1000


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> str:
    """From now on this session hands ARROW_ROWS rows at most to Python at once. Returns how many it were."""
    rows = spark.conf.get(_BATCH_ROWS)
    if not 0 < int(rows) <= ARROW_ROWS:
        spark.conf.set(_BATCH_ROWS, str(ARROW_ROWS))
    return rows


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later plans start there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path, rows = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}", small_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_ROWS, rows)
    return spark.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z in lower case. ``bytes.split`` cuts at exactly the six characters of WORD."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(tokens) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(t) for t in tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of 64-bit values (finalizer of splitmix64)."""
    out = x >> np.uint64(30)  # in place from here on
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


_HASHED = 1 << 14  # shingles hashed together: what fits a processor's cache


def shingle_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` token hashes, in order; none if there are fewer tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _HASHED):
        stop = min(at + _HASHED, n)
        part = mixed(tokens[at:stop])
        for i in range(1, width):
            part *= np.uint64(0x9E3779B97F4A7C15)
            part += tokens[at + i:stop + i]
            part = mixed(part)
        out[at:stop] = part
    return out


def some_rows(batch, rows: int = 256):
    """An Arrow batch in slices: texts become Python's strings only when they are read."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


#: Bits of a bitmap that filters rows before a join: 8 MB, whatever the size of the table behind it.
BITMAP_BITS = 1 << 26


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap with the bit of each key's low 26 bits set. It has a fixed size, so it may go to every task; what passes it by
    chance is for the join that must follow."""
    key = F.col(column)
    cell = F.shiftright(key.bitwiseAND(F.lit(BITMAP_BITS - 1)), 6).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63)).cast("int"))
    cells = keys.groupBy(cell.alias("cell")).agg(F.bit_or(bit).alias("bits"))
    found = cells.toArrow()  # as columns: up to a million rows
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be among the bitmap's."""
    low = keys.view(np.uint64) & np.uint64(BITMAP_BITS - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


_PIECE = 128  # numbers of a vector that travel in one row


def summed_vectors(rows: DataFrame, label: str, vector, size: int) -> dict:
    """For each value of ``label``, the sum of ``vector(text)`` (``size`` integers) over all rows with a ``text``.

    A task sums what it reads; sums are shuffled in pieces, and the driver gets ``size`` numbers a label, however many rows there are.
    """
    kind = dict(rows.dtypes)[label]
    schema = f"label {kind}, piece int, counts array<bigint>"

    def count(batches):
        total: dict = {}
        for batch in batches:
            for name, text in zip(batch["label"], batch["text"], strict=True):
                if name not in total:
                    total[name] = np.zeros(size, np.int64)
                total[name] += vector(text)
        for name, counts in total.items():
            yield pd.DataFrame({"label": name, "piece": range(size // _PIECE), "counts": list(counts.reshape(-1, _PIECE))})

    def add(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": [key[0]], "piece": [key[1]], "counts": [np.sum(np.stack(pieces["counts"].to_list()), axis=0)]})

    read = rows.select(F.col(label).alias("label"), "text").filter("label IS NOT NULL AND text IS NOT NULL")
    out: dict = {}
    for name, piece, counts in read.mapInPandas(count, schema).groupBy("label", "piece").applyInPandas(add, schema).collect():
        out.setdefault(name, np.zeros(size, np.int64))[piece * _PIECE:(piece + 1) * _PIECE] = counts
    return out
