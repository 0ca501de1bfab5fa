import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark():
    from sparkfolio.session import checkpoints, session

    s = session("local[4]", 4, **{"spark.driver.memory": "3g", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4"})
    s.sparkContext.setLogLevel("OFF")
    checkpoints(s)
    return s


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
