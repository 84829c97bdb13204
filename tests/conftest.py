import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


conf = {
    "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.ui.showConsoleProgress": "false",
}
# begun here, as columns at the top of a test module need a session
SESSION = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION
