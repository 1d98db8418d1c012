import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from plumbline import build_session
    session = build_session("plumbline-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "2", "spark.driver.memory": "8g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples."""
    def collect(df, *columns):
        return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)
    return collect
