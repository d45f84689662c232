import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from sample_paths import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from postlens.session import get_spark
    s = get_spark("local[*]", 8)
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from postlens.plans.oracle_check import duckdb_conn
    return duckdb_conn(SF_SMALL)
