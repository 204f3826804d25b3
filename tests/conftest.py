import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from roadframes.schemas import FRAMES  # noqa: E402
from roadframes.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
        spark__checkpoint__dir=tmp_path_factory.mktemp("scratch"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frames(spark):
    """Make frames from ``(pixels, height, width, channels, layout)`` tuples."""

    def make(*rows):
        data = [
            (i, "s", h, w, c, layout, None if px is None else [None if v is None else float(v) for v in px], 0)
            for i, (px, h, w, c, layout) in enumerate(rows)]
        return spark.createDataFrame(data, FRAMES)

    return make
