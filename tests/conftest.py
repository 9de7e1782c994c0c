import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from railyard.session import get_session
    from railyard.session import checkpoint_dir
    s = get_session("local[*]", 8, app_name="railyard-tests")
    checkpoint_dir(s)   # the cluster's folder, or a private one when none is configured
    yield s


@pytest.fixture(scope="session")
def adapter_small(spark):
    from railyard.sources.adapter import StarAdapter
    return StarAdapter(spark, SF_SMALL)


@pytest.fixture(scope="session")
def seed(spark):
    import datetime as dt
    from railyard.sources.seed import SeedTables
    return SeedTables(spark, dt.datetime(2024, 5, 10, 9, 30, 0))
