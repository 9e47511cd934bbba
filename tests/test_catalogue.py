"""Named queries against their SQL twins (a selection; set ALL_QUERIES=1 for all of them, a quarter of an hour)."""

import os

import pytest

import oracle_check
from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
SELECTION = [
    "features_rsi", "features_moving_averages", "label_first_passage", "asof_observations", "calendar_days", "micro_block_features",
    "split_chronological", "table_target_drift", "metrics_binary", "trades_non_overlapping", "scan_yield_curve_xml", "validate_bars",
    "table_quantile_target_rates", "table_regime_structure", "table_forward_relation", "comparison_models", "permutation_labels_against_theory",
    "permutation_bijection", "model_fold_baselines", "probe_history", "audit_exposed_rows", "audit_holdout_rules", "manifest_files",
    "features_market_context", "features_rates", "strategy_metrics_grid", "drift_features", "trades_exits_kept_open",
]
NAMES = sorted(oracle_sql()) if os.environ.get("ALL_QUERIES") else SELECTION

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    why, _ = oracle_check.compare(spark, con, SF, queries()[name], oracle_sql()[name])
    assert why is None, why


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
