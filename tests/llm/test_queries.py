"""Every query of the subpackage that has SQL against it, on the smallest tables."""

import pytest
from compare import canonical, oracle

from mnemospark.llm import queries

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SMALLEST)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == oracle(SMALLEST, queries.SQL[name])
