import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tideline.session import get_session

    s = get_session("tests", cores=8, shuffle_partitions=4, memory="6g")
    s.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    return s


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    from helpers import connect

    return connect(DATA)


@pytest.fixture(scope="session")
def variants(tmp_path_factory):
    from helpers import write_variants

    return write_variants(DATA, tmp_path_factory.mktemp("variants"))
