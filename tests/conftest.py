from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from glyphmill.session import build_session

    base = tmp_path_factory.mktemp("spark")
    session = build_session("tests", cores=4, spark__sql__warehouse__dir=str(base / "warehouse"), spark__checkpoint__dir=str(base / "ckpt"))
    session.sparkContext.setCheckpointDir(str(base / "ckpt"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
