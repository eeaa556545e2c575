"""Order-export adapter edges (E17-E20) and sampling rules."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.operators import dense, scan, shops as S


def _shop(spark, n, shop="s1", start=datetime(2024, 1, 1), step_days=1, ptypes=None, cash=True):
    rows = []
    for i in range(n):
        pt = ptypes[i % len(ptypes)] if ptypes else "Apparel"
        rows.append((shop, start + timedelta(days=i * step_days), 10.0 + i, None, pt, 100 - i,
                     float(i) if cash else None, i))
    df = spark.createDataFrame(rows, "shop_id string, created_at timestamp_ntz, total_price double, "
                                     "cancelled_at timestamp_ntz, product_type string, inventory_qty int, "
                                     "cash_balance double, seq long")
    return S.prepare_shop_orders(df, tie=["seq"])


def test_sample_indices(spark):
    ix = S.indexed(_shop(spark, 50))
    idx = sorted(r["idx"] for r in S.sample_points(ix).collect())
    assert idx == [30, 37, 44]


def test_min_rows_e17(spark):
    for n, expect in ((44, 0), (45, 1)):
        sh = _shop(spark, n)
        st = S.shop_stats(sh)
        got = S.sample_points(S.indexed(sh), st, min_rows=S.MIN_SHOP_ROWS).count()
        assert (got > 0) == bool(expect)


def test_horizon_equal_kept_e18(spark):
    sh = _shop(spark, 45)                     # last row at day 44; idx 30 -> day 30 + 14 = 44
    st = S.shop_stats(sh)
    pts = S.sample_points(S.indexed(sh), st, horizon_days=14).collect()
    assert [r["idx"] for r in pts] == [30]


def test_single_row_window_trend_zero_e19(spark):
    sh = _shop(spark, 40, step_days=5)        # exactly one row in each 7-day window
    f = S.window_features(sh).first()
    assert f["w7_order_count"] == 1
    assert f["w7_cash_trend"] == 0.0 and f["w7_inventory_trend"] == 0.0


def test_mode_tie_smallest_e20(spark):
    sh = _shop(spark, 40, ptypes=["Wholesale", "Fashion"])
    st = S.shop_stats(sh).first()
    assert st["mode_type"] == "Fashion"


def test_labels_and_velocity(spark):
    sh = _shop(spark, 50)
    lab = {r["idx"]: r for r in S.labels(sh).collect()}
    r = lab[30]          # pre = days 0..29 (30 rows), post = days 30..43 (14 rows)
    assert r["label_order_velocity_delta"] == pytest.approx(14 / 14 - 30 / 30)
    assert r["label_inventory_delta"] == (100 - 43) - (100 - 29)
    assert r["label_cashflow_delta"] == 43.0 - 29.0


def test_map_category_order(spark):
    from pitwise.functions.encode import infer_category, map_category
    df = spark.createDataFrame([("Home Services",), (" Wholesale ",), ("Fashion Wear",), ("Misc",), (None,)], "p string")
    got = [(r[0], r[1]) for r in df.select(map_category("p"), infer_category("p")).collect()]
    assert got == [("retail", "b2b"), ("b2b", "b2b"), ("apparel", "apparel"), ("retail", "retail"),
                   ("retail", "retail")]


def test_missing_optional_columns_p9(spark):
    df = spark.createDataFrame([("s1", "2024-01-01T00:00:00+02:00", 5.0)],
                               "shop_id string, created_at string, total_price double")
    r = S.prepare_shop_orders(df).first()
    assert r["created_at"] == datetime(2023, 12, 31, 22, 0)
    assert r["cash_balance"] == 0.0 and r["inventory_qty"] == 0.0 and r["cancelled_at"] is None
    assert r["product_type"] is None
    assert F is not None


def _brute_windows(rows, a, w):
    """B1-B8 of one window from its rows, sorted by time and tie: (t, price, cancelled, inventory, cash)."""
    lo = a - timedelta(days=w)
    inside = [r for r in rows if lo <= r[0] < a]
    n = len(inside)
    if not n:
        return [0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    q = float(np.percentile([r[1] for r in inside], 75))
    steps = [[y[k] - x[k] for x, y in zip(inside, inside[1:]) if x[k] is not None and y[k] is not None] for k in (4, 3)]
    mean = [sum(x) / len(x) if x else 0.0 for x in steps]
    return [n, sum(r[1] for r in inside), sum(r[2] for r in inside) / n, sum(r[2] and r[1] > q for r in inside) / n,
            inside[-1][4], mean[0], mean[1], sum(1 / max((a - r[0]).days, 1) for r in inside)]


@pytest.mark.parametrize("cut", [False, True])
def test_window_features_equal_brute_force(spark, monkeypatch, cut):
    """Times inside days, ties, long gaps, cancelled rows, missing cash and amounts below a cent."""
    rnd = random.Random(5)
    data, t = {"a": [], "b": []}, {}
    for shop, gap in (("a", 30), ("b", 3000)):
        now = datetime(2024, 1, 1)
        for i in range(160):
            now += timedelta(minutes=rnd.choice([0, rnd.randrange(1, gap), 1440, 7 * 1440 if i % 40 == 0 else 1]))
            data[shop].append((now, rnd.choice([0.004, 12.5, rnd.uniform(0, 90), 1e13]), rnd.random() < (0.2 if shop == "a" else 0.0),
                               rnd.randrange(100) * 1.0, None if rnd.random() < 0.1 else round(rnd.uniform(-9, 9), 3)))
    df = spark.createDataFrame([(s, r[0], r[1], r[0] if r[2] else None, "x", r[3], r[4], i)
                                for s in data for i, r in enumerate(data[s])],
                               "shop_id string, created_at timestamp_ntz, total_price double, cancelled_at timestamp_ntz, "
                               "product_type string, inventory_qty double, cash_balance double, seq long")
    if cut:
        monkeypatch.setattr(scan, "HEAVY_KEY_ROWS", 0)
        monkeypatch.setattr(scan, "TARGET_PERIOD_ROWS", 50)
    got = S.window_features(S.prepare_shop_orders(df, tie=["seq"])).collect()
    assert len(got) == 2 * len(range(30, 160, 7))
    names = ["order_count", "revenue_total", "cancel_rate", "blocked_rate", "latest_cash_balance", "cash_trend",
             "inventory_trend", "weighted_order_count"]
    for r in got:
        rows = data[r["shop_id"]]
        for w in S.WINDOWS:
            want = _brute_windows(rows, rows[r["idx"]][0], w)
            have = [r[f"w{w}_{c}"] for c in names]
            assert [x is None for x in have] == [x is None for x in want]
            assert [x or 0.0 for x in have] == pytest.approx([x or 0.0 for x in want], rel=1e-9, abs=1e-9), (r["shop_id"], r["idx"], w)


def test_work_is_linear_in_density(spark):
    """Ten times the orders in the same days: ten times the rows of every operator, no pairs of rows."""
    import time
    rng = np.random.default_rng(2)
    spent = []
    for n in (20_000, 200_000):
        t = np.sort(rng.integers(0, 200 * 86_400_000_000, n))
        price, gone = rng.uniform(0, 90, n), rng.random(n) < 0.3
        picked = np.arange(30, n, 7)
        start = time.perf_counter()
        dense.shop_features(t, price, gone, picked, (7, 30, 90), 86_400_000_000)
        spent.append(time.perf_counter() - start)
    assert spent[1] <= 30 * spent[0]          # a window of 90 days holds 90,000 rows: pairs would be 100 times
    plan = S.window_features(_shop(spark, 400))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("Generate") == 0


def test_order_statistics_equal_sorting():
    rng = np.random.default_rng(4)
    for n, kinds in ((0, 1), (1, 1), (40, 3), (300, 10**6), (257, 200)):
        price = np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, kinds, n) / 7)
        gone = rng.random(n) < 0.4
        ends = np.sort(rng.integers(0, n + 1, (60, 2)), axis=1)
        got = dense.blocked_rows(price, gone, ends[:, 0], ends[:, 1])
        for (a, b), have in zip(ends, got, strict=True):
            known = price[a:b][~np.isnan(price[a:b])]
            assert have == (sum(gone[a:b] & (price[a:b] > np.percentile(known, 75))) if len(known) else 0)


def test_huge_and_tiny_prices(spark):
    """One order of 1e19, infinite or 1e-10: no abort, windows without it are exact."""
    for odd in (1e19, 9.3e18, float("inf"), -float("inf"), 1e-10, float("nan")):
        rows = [("s", datetime(2024, 1, 1) + timedelta(days=i), odd if i == 3 else 0.1, float(i), i) for i in range(60)]
        df = spark.createDataFrame(rows, "shop_id string, created_at timestamp_ntz, total_price double, cash_balance double, seq long")
        got = {r["idx"]: r for r in S.window_features(S.prepare_shop_orders(df, tie=["seq"])).collect()}
        assert got[51]["w30_revenue_total"] == pytest.approx(30 * 0.1, rel=1e-12)
        extra = 0.0 if odd != odd else odd
        assert got[51]["w90_revenue_total"] == pytest.approx(50 * 0.1 + extra, rel=1e-12)


def test_running_revenue_of_huge_and_tiny_amounts(spark):
    rows = [(i, "a", "2024-01-01", x, i) for i, x in enumerate(["1e-10", "1e-10", "1e-10", "1e19", "9.3e18", "-1e19", "-9.3e18", "2.5", "Infinity", "1", "-Infinity"])]
    df = spark.createDataFrame(rows, "transaction_id long, store_id string, date string, total_amount string, seq long")
    got = [r["cash_balance"] for r in S.normalize_retail(df.withColumnRenamed("seq", "pos"), order=["transaction_id"]).orderBy("pos").collect()]
    assert got[:8] == pytest.approx([1e-10, 2e-10, 3e-10, 1e19, 1.93e19, 9.3e18, 3e-10, 2.5 + 3e-10], rel=1e-12)
    assert got[8:10] == [float("inf")] * 2 and math.isnan(got[10])


def test_many_hot_shops_and_equal_bits(spark, monkeypatch):
    """More hot shops than are ever collected, each cut into periods: the same rows as uncut."""
    rows = [(f"s{k}", datetime(2024, 1, 1) + timedelta(hours=7 * i + k % 5), (i * 37 + k) % 91 / 7, i % 3 == 0, i) for k in range(150) for i in range(40)]
    df = spark.createDataFrame(rows, "shop_id string, created_at timestamp_ntz, total_price double, gone boolean, seq long")
    df = df.withColumn("cancelled_at", F.expr("if(gone, created_at, NULL)"))
    shops = S.prepare_shop_orders(df, tie=["seq"])
    plain = sorted(map(tuple, S.window_features(shops).collect()))
    monkeypatch.setattr(scan, "HEAVY_KEY_ROWS", 0)
    monkeypatch.setattr(scan, "TARGET_PERIOD_ROWS", 500)
    assert scan.key_sizes(shops, "shop_id").hot.count() == 150
    cut = sorted(map(tuple, S.window_features(shops).collect()))
    assert len(plain) == 300 and [r[:2] for r in plain] == [r[:2] for r in cut]
    for a, b in zip(plain, cut, strict=True):
        assert a[2:] == pytest.approx(b[2:], rel=1e-12, abs=1e-12)
