import pytest

from wayledger.functions.pseudonym import PlateHasher
from wayledger.session import build_session

KEY = "k" * 40


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "8g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def hasher():
    return PlateHasher(KEY)
