from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.sessions import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(memory="4g")
    if not session.sparkContext.getConf().get("spark.checkpoint.dir"):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


@pytest.fixture(scope="session")
def corpus_of(spark):
    """``files(repo, path, size, raw)`` from ``{path: text or bytes}``."""

    def build(files: dict, repo: str = "demo"):
        rows = [(repo, path, len(raw), raw) for path, raw in (
            (p, t if isinstance(t, bytes) or t is None else t.encode()) for p, t in files.items())
            if raw is not None] + [(repo, p, None, None) for p, t in files.items() if t is None]
        return spark.createDataFrame(
            [(r, p, s, bytearray(b) if b is not None else None) for r, p, s, b in rows],
            "repo string, path string, size bigint, raw binary")

    return build
