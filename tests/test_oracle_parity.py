"""Registered queries vs their independent DuckDB SQL (small scale factor).

The full set runs at sf0.01 with ``python -m pitwise.testing``; here a
representative query of every family runs at sf0.001.
"""

import pytest

from pitwise.plans.registry import ORACLES, QUERIES, load_all
from pitwise.testing import compare, duck
from tests.conftest import SF_SMALL

load_all()

SUBSET = ["training_rows", "w_cash_trend", "history_depth", "outcome_join", "json_fields",
          "season_core", "mag_restock", "shop_training_rows", "txn_training_rows", "shop_blocked_rate",
          "running_revenue", "running_cash", "weekly_snapshot", "price_pct_change",
          "coverage", "metrics_report", "temporal_split", "scale_continuous", "feature_matrix",
          "ridge_fit", "category_models", "tree_comparison", "feature_matrix_shop", "scale_continuous_shop", "shop_const_cols"]


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLES)
    assert rows_only == {"model_comparison"}
    assert len(QUERIES) >= 100


@pytest.mark.parametrize("name", SUBSET)
def test_parity(spark, name):
    res = compare(QUERIES[name](spark, SF_SMALL), duck(ORACLES[name], SF_SMALL))
    assert res["ok"], res


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert len(df.columns) == 81
    assert df.count() >= 0
