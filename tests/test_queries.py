"""A cross-section of the registered queries against DuckDB; compare.py runs them all."""

import pytest
from compare import ROOT, compare, connect

import __spark_entry__ as entry_module

SF = f"{ROOT}/sf0.01"
CHOSEN = [
    "delay_profile",
    "harmonize_mapping",
    "clean_attrition",
    "trailing_7d_events",
    "tfidf_vectors",
    "time_split_summary",
    "binary_metrics",
    "fairness_summary",
    "membership_attack",
    "explanation_drift",
    "privacy_tradeoff",
    "early_stopping",
    "yearly_quota",
    "page_slice",
    "drifting_rows",
    "datastore_records",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    con = connect(SF)
    result, rows = compare(spark, SF, con, entry_module.queries()[name], entry_module.oracle_sql()[name])
    assert result == "match" and rows > 0


def test_registry():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
