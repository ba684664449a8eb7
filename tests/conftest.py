import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from caseflow.session import clear_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("checkpoints")
    s = (
        SparkSession.builder.master("local[4]").appName("caseflow-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{work}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    clear_scratch(s)
    assert not [p for p in work.iterdir() if p.name.startswith("scratch-")]
    s.stop()
