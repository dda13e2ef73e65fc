import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rollspan.functions import blocks
from rollspan.session import build_session, clear_scratch


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, partitions=4, app="rollspan-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)


@pytest.fixture
def short_blocks(monkeypatch):
    """Blocks of four frames, so every block rule is crossed by tiny series."""
    monkeypatch.setattr(blocks, "BLOCK", 4)
