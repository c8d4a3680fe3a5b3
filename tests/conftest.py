import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from leverkit.session import get_spark, shared_dir
    s = get_spark("local[*]", shuffle_partitions=8)
    shared_dir(s)
    yield s
    s.stop()


@pytest.fixture
def small_groups(spark):
    """Force the split-safe (chunked) paths of the ordered primitives."""
    spark.conf.set("leverkit.maxGroupRows", "2")
    yield
    spark.conf.unset("leverkit.maxGroupRows")
