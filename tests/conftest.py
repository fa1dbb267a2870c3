import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from tallyguard.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def dense(spark):
    """Make almost every key count as dense."""
    spark.conf.set("tallyguard.rowsPerChunk", "8")
    spark.conf.set("tallyguard.slidingRows", "6")
    yield
    spark.conf.unset("tallyguard.rowsPerChunk")
    spark.conf.unset("tallyguard.slidingRows")
