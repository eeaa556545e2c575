"""Ledger rules (L1-L4) and event-order robustness."""

import pytest
from pyspark.sql import functions as F

from pitwise.operators.ledger import price_pct_change, running_balances, weekly_snapshot


def test_running_balances_signs_and_opening(make_commits):
    c = make_commits([
        ("2024-01-01T09:00:00", "ORDER_RECEIVED", '{"quantity": 2, "revenue": 10.50}'),
        ("2024-01-01T10:00:00", "ORDER_CANCELLED", '{"quantity": 1, "revenue_reversed": 5.25}'),
        ("2024-01-02T00:00:00", "SUPPLIER_PO_CREATED", '{"quantity": 50, "cost": 100}'),
        ("2024-01-05T00:00:00", "INVENTORY_RESTOCK", '{"quantity_added": 50, "cost": 100}'),
        ("2024-01-06T00:00:00", "PRICE_CHANGE", "{bad"),
    ])
    r = {x["commit_id"]: x for x in running_balances(c, opening_cash=1000.0, opening_units=10.0).collect()}
    assert r["c0"]["cash_balance"] == pytest.approx(1010.50)
    assert r["c1"]["cash_balance"] == pytest.approx(1005.25)
    assert r["c2"]["cash_balance"] == pytest.approx(905.25)
    assert [r[f"c{i}"]["inventory_units"] for i in range(5)] == [8.0, 9.0, 9.0, 59.0, 59.0]


def test_weekly_snapshot_last_of_period(make_commits):
    c = make_commits([
        ("2024-01-01T09:00:00", "ORDER_RECEIVED", '{"revenue": 1}'),
        ("2024-01-07T23:00:00", "ORDER_RECEIVED", '{"revenue": 2}'),
        ("2024-01-08T01:00:00", "ORDER_RECEIVED", '{"revenue": 4}'),
        ("2024-02-01T01:00:00", "ORDER_RECEIVED", '{"revenue": 8}'),
    ])
    w = {x["week"]: x for x in weekly_snapshot(c).collect()}
    assert w[0]["cash_balance"] == pytest.approx(3.0) and w[0]["n_commits"] == 2
    assert w[1]["cash_balance"] == pytest.approx(7.0)
    assert sorted(w) == [0, 1, 2, 3, 4]                  # weeks without a commit repeat the balance
    assert [(w[k]["cash_balance"], w[k]["n_commits"]) for k in (2, 3, 4)] == [(7.0, 0), (7.0, 0), (15.0, 1)]


def test_price_pct_change_first_row_null(spark):
    from datetime import datetime
    df = spark.createDataFrame([("s", datetime(2024, 1, 1), 1, 10.0), ("s", datetime(2024, 1, 2), 2, 12.0),
                                ("s", datetime(2024, 1, 3), 3, 0.0), ("s", datetime(2024, 1, 4), 4, 5.0)],
                               "shop_id string, created_at timestamp_ntz, tie int, price double")
    got = [x["pct_change"] for x in price_pct_change(df).orderBy("created_at").collect()]
    assert got[0] is None and got[1] == pytest.approx(20.0) and got[2] == pytest.approx(-100.0)
    assert got[3] is None                       # previous price 0
    assert F is not None


def test_fulfilment_before_order_e27(spark, make_commits, make_branch):
    from pitwise.plans.training import training_rows
    fill = [("2024-01-01T00:00:00", "ORDER_FULFILLED", '{"inventory_after": -1}')] * 10
    a = make_commits(fill + [("2024-03-19T08:00:00", "ORDER_RECEIVED", '{"revenue": 3}'),
                             ("2024-03-19T09:00:00", "ORDER_FULFILLED", '{"inventory_after": 7}')])
    b = make_commits(fill + [("2024-03-19T09:00:00", "ORDER_RECEIVED", '{"revenue": 3}'),
                             ("2024-03-19T08:00:00", "ORDER_FULFILLED", '{"inventory_after": 7}')])
    br, o = make_branch("2024-03-20T00:00:00")
    ra = training_rows(a, br, o).first()
    rb = training_rows(b, br, o).first()
    assert ra["w7_order_count"] == rb["w7_order_count"] == 1
    assert ra["w7_revenue_total"] == rb["w7_revenue_total"]


def test_sums_keep_small_and_large_amounts(spark, make_commits):
    rows = [(f"2024-01-{i + 1:02d} 00:00:00", "ORDER_RECEIVED", '{"revenue": 0.004, "quantity": 1}') for i in range(28)]
    rows.append(("2024-01-30 00:00:00", "ORDER_RECEIVED", '{"revenue": 1e13, "quantity": 1}'))
    got = [r.cash_balance for r in running_balances(make_commits(rows)).orderBy("seq").collect()]
    assert got[27] == 0.112 and got[28] == 10_000_000_000_000.112
