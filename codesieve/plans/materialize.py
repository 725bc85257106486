"""Write an intermediate table once so that several rollups can read it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def materialize(df: DataFrame, folder: str, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet below ``folder``, which every executor must reach, and read it back: later plans prune its columns,
    and lost executors cost nothing. The caller owns the folder and what it holds."""
    path = f"{folder.rstrip('/')}/codesieve-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
