import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from glyphmill import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                              "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


EDGE = ["", " ", "!!!", "a", "Hello, World! It's 3.14.", "你好世界。再见", "कि है।", "😀 smile 😀", "a​b", "x́y", "é à ü", "A.B. c\nd  e",
        " pad　", "-- dash -- here", "Mail a.b@c.org now", "U.S. policy is 1,000 at 10:30.", "Is it? Yes! No: maybe; so"]


@pytest.fixture()
def edge(spark):
    return spark.createDataFrame(list(enumerate(EDGE)), "id int, text string")
