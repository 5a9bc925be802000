import pytest
from compare import compare, oracle_connection

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
# A sample of the registered queries; `python tests/compare.py` runs them all.
SAMPLE = ["price_lens", "lens_summary", "observation_ranks", "audit_findings", "segments", "top_issues", "marketplace_check", "mapped_page_check", "page_product_nodes", "robots_admission", "sitemap_products", "price_changes_streamed", "upsert_products"]


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, oracle, name):
    assert compare(spark, oracle, SF, name) is None


def test_entry_and_registry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "gap_pct" in df.columns
    assert set(contract.oracle_sql()) <= set(contract.queries())
