import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from skein.session import get_spark

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    s = get_spark("tests", cores=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

