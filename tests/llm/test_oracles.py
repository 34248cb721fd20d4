import sys
from pathlib import Path

import pytest

pytest.importorskip("sievework.llm")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import hold  # noqa: E402

from sievework.llm import oracles, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_like_sql(spark, name):
    hold(spark, queries.QUERIES[name], oracles.SQL[name])
