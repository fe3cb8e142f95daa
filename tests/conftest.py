import pytest


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    out = session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
