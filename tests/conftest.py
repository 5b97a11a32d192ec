import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TINY = """H\tVN:Z:1.0
S\ts1\t*\tLN:i:100\tdp:f:5.0
S\ts2\tACGTACGTAC\tdp:f:3.5
S\ts3\t*\tLN:i:250
S\ts4\t*\tLN:i:40\tKC:i:80
S\ts5\t*\tLN:i:60
S\ts6\t*\tLN:i:10
L\ts1\t+\ts2\t+\t10M
L\ts2\t+\ts3\t-\t5M
L\ts1\t+\ts3\t+\t0M
L\ts4\t+\ts5\t+\t3M
"""


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny(spark, tmp_path_factory):
    from contiguum.sources.gfa import read_gfa

    path = tmp_path_factory.mktemp("gfa") / "tiny.gfa"
    path.write_text(TINY)
    return read_gfa(spark, f"file://{path}")
