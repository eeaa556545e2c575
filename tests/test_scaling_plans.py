"""Shapes of plans whose time and memory must not grow with the number of features."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from pitwise.operators import scan, shops as S
from pitwise.plans.training import training_rows

T0 = dt.datetime(2024, 1, 1)


def _formatted(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _shop_rows(spark):
    rows = [(f"s{i % 3}", T0 + dt.timedelta(hours=7 * i), float(i % 11), i) for i in range(600)]
    raw = spark.createDataFrame(rows, "shop_id string, created_at timestamp_ntz, total_price double, tie int")
    return S.prepare_shop_orders(raw.withColumn("cash_balance", F.col("total_price") * 3))


def test_shop_rows_take_one_shuffle_and_no_join(spark):
    plan = _formatted(S.shop_training_rows(_shop_rows(spark), sizes=scan.KeySizes(["shop_id"], None, 0, 600)))
    assert len(re.findall(r"\n\(\d+\) Exchange", plan)) == 1
    assert "Join" not in plan and "\n(1) " in plan


def test_small_shops_taken_together_equal_each_alone(spark, monkeypatch):
    from pitwise.operators import dense

    shops = _shop_rows(spark)
    got = sorted(S.shop_training_rows(shops).collect(), key=lambda r: r["branch_id"])
    monkeypatch.setattr(dense, "TOGETHER", 1)
    alone = [r for i in range(3) for r in S.shop_training_rows(shops.where(f"shop_id = 's{i}'")).collect()]
    assert len(got) > 50
    for a, b in zip(got, sorted(alone, key=lambda r: r["branch_id"]), strict=True):
        assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))


def test_lookback_sorts_narrow_rows(spark):
    commits = spark.createDataFrame([], "commit_id string, timestamp timestamp_ntz, business_id string, event_type string, payload string, seq long")
    branches = spark.createDataFrame([], "branch_id string, business_id string, category string, branch_type string, branch_params string, "
                                         "committed_at timestamp_ntz, status string, seq long")
    outcomes = spark.createDataFrame([], "branch_id string, inventory_delta double, cashflow_delta double, order_velocity_delta double, seq long")
    plan = _formatted(training_rows(commits, branches, outcomes))
    widths = [int(n) for n in re.findall(r"\n\(\d+\) Sort\s*\[?[^\n]*\nInput \[(\d+)\]", plan)]
    assert widths and max(widths) <= 20


def test_first_points_of_a_long_key(spark):
    n, step = 6_000, 1_000_000
    df = spark.range(n).selectExpr("1 AS k", f"id * {step} AS t", "id", "1L AS v",
                                   f"if(id % 701 = 5, struct(id * {step} AS t, id AS x), NULL) AS p")
    got = scan.offset_scan(df, "k", "t", {"back": -100 * step}, ids=["id"], sums=["v"], lasts=["p"], firsts=["p"])
    points = [i for i in range(n) if i % 701 == 5]
    for r in got.collect():
        before, after = ([p for p in points if (p < r["id"] - 100) == side] for side in (True, False))
        assert r["v@back"] == max(r["id"] - 100, 0)
        assert (r["p@back"].x if r["p@back"] else None) == (before[-1] if before else None)
        assert (r["first_p@back"].x if r["first_p@back"] else None) == (after[0] if after else None)


def test_model_queries_build_their_rows_by_narrow_sorts(spark, monkeypatch, tmp_path):
    from pitwise.plans import q_model
    from pitwise.plans.registry import QUERIES, load_all

    class Built(Exception):
        """Carries what a query starts from."""

    def built(*args):
        raise Built(*args)

    kinds = ["view", "signup", "click", "error", "purchase"]
    rows = [(i, T0 + dt.timedelta(hours=i), i % 2, kinds[i % 5], float(i), f'{{"k": {i % 100}}}') for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).write.parquet(str(tmp_path / "events.parquet"))
    load_all()
    monkeypatch.setattr(q_model, "materialize", built)
    with pytest.raises(Built) as got:
        q_model._t1(spark, str(tmp_path))
    widths = [int(n) for n in re.findall(r"\n\(\d+\) Sort\s*\[?[^\n]*\nInput \[(\d+)\]", _formatted(got.value.args[0]))]
    assert widths and max(widths) <= 20
    monkeypatch.setattr(q_model, "_t1", built)
    for name in ("feature_matrix", "linear_attribution", "model_comparison", "ridge_fit", "scale_continuous", "temporal_split"):
        with pytest.raises(Built):
            QUERIES[name](spark, str(tmp_path))
