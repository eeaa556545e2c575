"""Hand-written edge rows for the scenario features (FIXTURES.md section 4)."""

import math

import pytest

from pitwise.plans.training import TRAINING_COLS, training_rows

B = "2024-03-20T00:00:00"          # scenario time used throughout
FILL = [("2024-01-01T00:00:00", "ORDER_FULFILLED", '{"inventory_after": -1}')] * 10


def rows(spark, make_commits, make_branch, commits, rounded=False, **kw):
    c = make_commits(FILL + commits)
    b, o = make_branch(B, **kw)
    out = training_rows(c, b, o, rounded=rounded, keep_n_prior=True).collect()
    return out[0].asDict() if out else None


def test_81_columns_in_fixed_order(spark, make_commits, make_branch):
    c = make_commits(FILL)
    b, o = make_branch(B)
    df = training_rows(c, b, o)
    assert df.columns == TRAINING_COLS
    assert len(TRAINING_COLS) == 81


def test_boundaries_e1_e2_e3(spark, make_commits, make_branch):
    r = rows(spark, make_commits, make_branch, [
        ("2024-03-20T00:00:00", "ORDER_RECEIVED", '{"revenue": 1}'),           # E1 at b: excluded
        ("2024-03-13T00:00:00", "ORDER_RECEIVED", '{"revenue": 2}'),           # E2 at b-7d: in w7
        ("2024-03-12T23:59:59.999999", "ORDER_RECEIVED", '{"revenue": 4}'),    # E3: w30, w90 only
    ])
    assert r["w7_order_count"] == 1
    assert r["w30_order_count"] == 2
    assert r["w90_order_count"] == 2
    assert r["n_prior"] == 12


def test_min_history_e4(spark, make_commits, make_branch):
    c = make_commits(FILL[:9])
    b, o = make_branch(B)
    assert training_rows(c, b, o).count() == 0
    c = make_commits(FILL[:10])
    assert training_rows(c, b, o).count() == 1


def test_cancel_rate_capped_e5(spark, make_commits, make_branch):
    r = rows(spark, make_commits, make_branch, [
        ("2024-03-19T00:00:00", "ORDER_RECEIVED", '{"revenue": 1}'),
        ("2024-03-19T01:00:00", "ORDER_CANCELLED", "{}"),
        ("2024-03-19T02:00:00", "ORDER_CANCELLED", "{}"),
        ("2024-03-19T03:00:00", "ORDER_CANCELLED", "{}"),
    ])
    assert r["w7_cancel_rate"] == 1.0


def test_cash_trend_short_span_e6_and_normalization(spark, make_commits, make_branch):
    r = rows(spark, make_commits, make_branch, [
        ("2024-03-19T00:00:00", "LEDGER_ENTRY", '{"cash_balance": 100, "inventory_units": 5}'),
        ("2024-03-19T12:00:00", "LEDGER_ENTRY", '{"cash_balance": 150, "inventory_units": 5}'),
    ])
    # raw trend 50 / max(0 days, 1) = 50; normalised by the w90 latest cash 150
    assert r["w7_cash_trend"] == pytest.approx(50 / 150)
    assert r["w7_latest_cash_balance"] == pytest.approx(1.0)


def test_empty_price_payload_e7(spark, make_commits, make_branch):
    r = rows(spark, make_commits, make_branch, [("2024-03-19T00:00:00", "PRICE_CHANGE", "")])
    assert r["w7_price_change_count"] == 1
    assert r["n_past_price_changes"] == 0
    assert r["w7_avg_price_change_pct"] == 0.0


def test_decay_weight_half_life_e8(spark, make_commits, make_branch):
    r = rows(spark, make_commits, make_branch, [("2024-02-19T00:00:00", "ORDER_RECEIVED", '{"revenue": 1}')])
    assert r["w90_weighted_order_count"] == pytest.approx(0.5, rel=1e-12)


def test_baselines_e9(spark, make_commits, make_branch):
    # no ledger -> latest cash 0 -> baseline 1.0 (values unchanged)
    r = rows(spark, make_commits, make_branch, [("2024-03-19T00:00:00", "ORDER_RECEIVED", '{"revenue": 70}')])
    assert r["w90_revenue_per_day"] == pytest.approx(1.0)          # normalised by itself
    assert r["w7_revenue_total"] == pytest.approx(70 / ((70 / 90) * 7))
    # negative baseline -> not normalised
    r = rows(spark, make_commits, make_branch, [
        ("2024-03-19T00:00:00", "LEDGER_ENTRY", '{"cash_balance": -40}')])
    assert r["w7_latest_cash_balance"] == -40.0


def test_equal_ts_seq_orders_e10(spark, make_commits, make_branch):
    r = rows(spark, make_commits, make_branch, [
        ("2024-03-19T00:00:00", "LEDGER_ENTRY", '{"cash_balance": 10}', "b1", 100),
        ("2024-03-19T00:00:00", "LEDGER_ENTRY", '{"cash_balance": 20}', "b1", 101),
    ], rounded=False)
    assert r["w7_latest_cash_balance"] == pytest.approx(1.0)   # 20 / baseline 20


def test_duplicate_outcome_last_wins_e11(spark, make_commits):
    from tests.conftest import OUTCOME_SCHEMA, dt
    from pitwise.plans.training import dedup_outcomes
    o = spark.createDataFrame([("o1", 1, "x1", "b1", "retail", dt(B), 14, 1.0, 1.0, 1.0),
                               ("o2", 2, "x1", "b1", "retail", dt(B), 14, 9.0, 9.0, 9.0)], OUTCOME_SCHEMA)
    got = dedup_outcomes(o).collect()
    assert len(got) == 1 and got[0]["inventory_delta"] == 9.0


def test_week_of_month_clamp_e12(spark):
    from pyspark.sql import functions as F
    from pitwise.functions.season import season_core, season_shop
    df = spark.createDataFrame([("2024-01-29",), ("2024-01-30",), ("2024-01-31",)], "d string") \
        .select(F.col("d").cast("timestamp_ntz").alias("t"))
    core = df.select(season_core("t", F.lit("retail"))["week_of_month_sin"].alias("s")).collect()
    assert all(abs(r["s"] - math.sin(2 * math.pi * 3 / 4)) < 1e-12 for r in core)
    shop = df.select(season_shop("t")["week_of_month_sin"].alias("s")).collect()
    assert all(abs(r["s"] - math.sin(2 * math.pi * 5 / 5)) < 1e-12 for r in shop)


def test_shop_days_to_peak_e13(spark):
    from pyspark.sql import functions as F
    from pitwise.functions.season import shop_days_to_peak
    df = spark.createDataFrame([("2024-12-14 12:00:00",), ("2024-12-15 12:00:00",)], "d string") \
        .select(F.col("d").cast("timestamp_ntz").alias("t"))
    assert [r[0] for r in df.select(shop_days_to_peak("t")).collect()] == [1, 0]


def test_unknown_category_and_type_e14_e15(spark, make_commits, make_branch):
    r = rows(spark, make_commits, make_branch, [], category="mystery", branch_type="teleport")
    assert r["days_to_peak"] == 180 and r["is_peak_month"] == 0
    assert r["cat_retail"] + r["cat_apparel"] + r["cat_b2b"] == 0
    assert all(r[c] == 0 for c in TRAINING_COLS if c.startswith("bt_"))
    assert all(r[c] == 0.0 for c in TRAINING_COLS if c.startswith("mag_"))
    assert r["deviation_from_norm"] == 0.0


def test_bulk_restock_no_history_e16(spark, make_commits, make_branch):
    r = rows(spark, make_commits, make_branch, [], branch_type="bulk_restock",
             params='{"quantity": 250, "cost_per_unit": 40}')
    assert r["deviation_from_norm"] == 0.0
    assert r["mag_restock_qty_norm"] == pytest.approx(0.5)
    assert r["mag_restock_cost_norm"] == pytest.approx(0.25)


def test_business_without_commits_e25(spark, make_commits, make_branch):
    c = make_commits([("2024-01-01T00:00:00", "ORDER_RECEIVED", "{}", "other")] * 12)
    b, o = make_branch(B)
    assert training_rows(c, b, o).count() == 0


def test_null_and_empty_payload_same_e26(spark, make_commits, make_branch):
    a = rows(spark, make_commits, make_branch, [("2024-03-19T00:00:00", "ORDER_RECEIVED", "")])
    b = rows(spark, make_commits, make_branch, [("2024-03-19T00:00:00", "ORDER_RECEIVED", None)])
    assert a == b


def test_no_leakage_invariant(spark, make_commits, make_branch):
    base = [("2024-03-19T00:00:00", "ORDER_RECEIVED", '{"revenue": 5}')]
    a = rows(spark, make_commits, make_branch, base)
    b = rows(spark, make_commits, make_branch, base + [
        ("2024-03-20T00:00:00", "ORDER_RECEIVED", '{"revenue": 500}'),
        ("2024-04-01T00:00:00", "LEDGER_ENTRY", '{"cash_balance": 1}')])
    assert a == b
