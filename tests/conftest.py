import pytest

from civicpulse.session import build_session


def make_session():
    spark = build_session(
        "civicpulse-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
           "spark.driver.host": "localhost", "spark.driver.bindAddress": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return make_session()
