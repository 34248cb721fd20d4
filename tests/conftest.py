import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sievework.session import local_session

    session = local_session(4, "4g", spark_sql_shuffle_partitions="4", spark_sql_warehouse_dir=tempfile.mkdtemp(prefix="warehouse-"))
    yield session
    session.stop()
