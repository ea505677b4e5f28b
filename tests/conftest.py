import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from tidewave.session import session

    s = session(cores=4, **{"spark.sql.shuffle.partitions": "4"})
    yield s


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
