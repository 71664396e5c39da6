"""Every core query against its SQL, on the smallest tables."""

import pytest
from compare import canonical, oracle

from mnemospark.plans import association_queries, history_queries, interval_queries, ledger_queries, link_queries, search_queries, store_queries, text_queries

MODULES = (history_queries, store_queries, text_queries, ledger_queries, link_queries, search_queries, association_queries, interval_queries)
SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,module", [(n, m) for m in MODULES for n in m.QUERIES])
def test_query(spark, name, module):
    df = module.QUERIES[name](spark, SMALLEST)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    if name in module.SQL:
        assert got == oracle(SMALLEST, module.SQL[name])
