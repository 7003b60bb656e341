import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rollbook.session import local_session

    s = local_session(4, shuffle_partitions=4, name="tests")
    yield s


@pytest.fixture(scope="session")
def views(spark):
    from rollbook.plans.fixtures import Views

    return Views(spark, SF)
