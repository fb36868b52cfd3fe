import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quillon.session import build_session

    return build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
