import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sessionlake.session import build_session

    session = build_session("local[8]", "tests", shuffle_partitions=4, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_groups(spark):
    """Treat sessions above a few dozen rows as large, so that the split code runs."""
    from sessionlake.operators.ordering import GROUP_ROWS_CONF

    spark.conf.set(GROUP_ROWS_CONF, "25")
    yield spark
    spark.conf.unset(GROUP_ROWS_CONF)
