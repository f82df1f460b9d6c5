import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from trendloom.session import build_session
    conf = {}
    # tests set their own checkpoint folder only where none is configured
    from pyspark.sql import SparkSession
    if SparkSession.getActiveSession() is None:
        conf["spark.driver.memory"] = "8g"
    # build_session keeps a configured spark.checkpoint.dir and sets a local
    # folder only where none is configured
    s = build_session("local[*]", app_name="trendloom-tests", shuffle_partitions=8, conf=conf)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)
