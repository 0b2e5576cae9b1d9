"""The driver contract: entry, naming, and a spread of queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, compare

SPREAD = (
    "op_eq", "evaluate_all", "group_outcome", "result_summary", "remediation_actions", "rule_trace", "state_override",
    "src_rule_base", "src_feed_entries", "txt_extract_rules", "review_flag", "amb_detect", "enrich_classify", "batch_validate",
    "rel_detect", "seq_steps", "join_feed_scheme", "contra_cross", "session_match_trigger", "rag_context", "rag_query",
    "scheme_name_search", "whatif_compare", "join_whatif", "stream_rate", "session_stream",
)


@pytest.fixture(scope="module")
def oracle(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", SPREAD)
def test_query_agrees_with_its_sql(spark, folder, oracle, name):
    verdict, _, _, detail = compare(spark, oracle, name, contract.queries()[name], contract.oracle_sql()[name], folder)
    assert verdict == "ok", detail
