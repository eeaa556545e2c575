"""Split, scaling, ridge and metrics (M1-M11) on hand-made data."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.operators import model as M


def _frame(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        x1, x2 = float(rng.normal()), float(rng.normal() * 3)
        rows.append((f"b{i}", "biz", "retail", "t", t0 + timedelta(hours=i // 2),
                     x1, x2, int(i % 2), 1.0, 2 * x1 - x2 + float(rng.normal()), 0.0, 1.0))
    schema = ("branch_id string, business_id string, category string, branch_type string, "
              "committed_at timestamp_ntz, f1 double, f2 double, bt_x int, const_feat double, "
              "label_inventory_delta double, label_cashflow_delta double, label_order_velocity_delta double")
    return spark.createDataFrame(rows, schema)


def test_temporal_split_ties_go_to_test(spark):
    df = _frame(spark, n=10)     # two rows per timestamp
    s = M.temporal_split(df).collect()
    # k = int(10 * 0.8) = 8 -> cutoff = 9th smallest time (pair index 4)
    train = [r for r in s if r["split"] == "train"]
    test = [r for r in s if r["split"] == "test"]
    assert len(train) == 8 and len(test) == 2
    assert max(r["committed_at"] for r in train) < min(r["committed_at"] for r in test)
    odd = _frame(spark, n=9)     # k = 7 falls inside a tie pair -> both to test
    s = M.temporal_split(odd).collect()
    assert sum(r["split"] == "train" for r in s) == 6


def test_train_ratio_one_raises(spark):
    with pytest.raises(ValueError):
        M.temporal_cutoff(_frame(spark, n=5), train_ratio=1.0)


def test_ridge_matches_closed_form(spark):
    df = _frame(spark, n=80)
    z, sc = M.prepare(df)
    train = z.filter(F.col("split") == "train")
    fit = M.fit_ridge(train, sc.order, "label_inventory_delta", alpha=1.0)
    pdf = train.select(*sc.order, "label_inventory_delta").toPandas()
    X = pdf[sc.order].to_numpy(float)
    y = pdf["label_inventory_delta"].to_numpy(float)
    Xc, yc = X - X.mean(0), y - y.mean()
    beta = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(X.shape[1]), Xc.T @ yc)
    icpt = y.mean() - X.mean(0) @ beta
    assert np.allclose(fit.coef, beta, atol=1e-8)
    assert fit.intercept == pytest.approx(icpt, abs=1e-8)
    resid = y - (X @ beta + icpt)
    assert fit.resid_std == pytest.approx(resid.std(), rel=1e-8)


def test_constant_feature_scaled_to_zero_e24(spark):
    df = _frame(spark, n=20)
    z, sc = M.prepare(df)
    assert sc.std["const_feat"] == 0.0
    assert {r[0] for r in z.select("const_feat").collect()} == {0.0}
    assert sc.binary == ["bt_x"]


def test_metrics_bounds_and_mape_null(spark):
    p = spark.createDataFrame([
        ("t", "test", 1.0, 1.0, 0.0, 1.0),        # on the upper bound: inside (E22)
        ("t", "test", 0.0, 0.5, 0.0, 1.0),        # y = 0: excluded from MAPE
        ("u", "test", 1e-7, 0.0, -1.0, 1.0),      # all |y| <= 1e-6 -> MAPE NULL (E21)
    ], "target string, split string, y double, y_pred double, lower double, upper double")
    m = {r["target"]: r for r in M.metrics(p, ["target"]).collect()}
    assert m["t"]["coverage"] == 1.0
    assert m["t"]["mape"] == pytest.approx(0.0)
    assert m["u"]["mape"] is None
    bands = p.select(M.band(F.lit(14.9)).alias("a"), M.band(F.lit(30.0)).alias("b"),
                     M.band(F.lit(31.0)).alias("c")).first()
    assert (bands["a"], bands["b"], bands["c"]) == ("strong", "acceptable", "weak")


def test_top_coefficients_order(spark):
    fits = {"y": M.RidgeFit("y", ["a", "b", "c"], [0.5, -2.0, 0.5], 0.0)}
    top = M.top_coefficients(M.coefficients(fits, spark), 2).orderBy("rank").collect()
    assert [r["feature"] for r in top] == ["b", "a"]


def _closed_form(X, y, alpha=1.0):
    Xc, yc = X - X.mean(0), y - y.mean()
    beta = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ yc)
    icpt = y.mean() - X.mean(0) @ beta
    return beta, icpt, (y - X @ beta - icpt).std()


def _categories(spark, n, names):
    c = F.element_at(F.array(*[F.lit(x) for x in names]),
                     (F.substring("branch_id", 2, 9).cast("int") % len(names) + 1).cast("int"))
    return _frame(spark, n=n).withColumn("category", c)


def test_models_of_all_categories_match_closed_form(spark):
    """One pass gives the global model and each category's; a NULL category is one of them, a category of one
    training row has none, a row without a finite label is not learnt from."""
    df = _categories(spark, 120, ["a", "b", None]).withColumn(
        "category", F.when(F.col("branch_id") == "b7", "alone").otherwise(F.col("category"))).withColumn(
        "label_cashflow_delta", F.when(F.col("branch_id") == "b3", None).when(F.col("branch_id") == "b4", float("inf"))
        .otherwise(1e9 + F.col("f1") + F.col("f2") * F.col("f2")))
    z, sc = M.prepare(df)
    train = z.filter(F.col("split") == "train")
    got = {(r["scope"], r["key"], r["target"]): r
           for r in M.ridge_models(train, sc.order, M.TARGETS, by="category").collect()}
    pdf = train.toPandas()
    pdf = pdf[~pdf["branch_id"].isin(["b3", "b4"])]
    assert {k[:2] for k in got} == {("global", None), ("per_category", "a"), ("per_category", "b"),
                                    ("per_category", None)}
    for (scope, key, target), r in got.items():
        part = pdf if scope == "global" else pdf[pdf["category"].isna()] if key is None else pdf[pdf["category"] == key]
        beta, icpt, std = _closed_form(part[sc.order].to_numpy(float), part[target].to_numpy(float))
        assert r["n"] == len(part)
        assert np.allclose(r["coef"], beta, atol=1e-6)
        assert r["intercept"] == pytest.approx(icpt, rel=1e-9, abs=1e-8)
        assert r["resid_std"] == pytest.approx(std, rel=1e-6, abs=1e-7)


def test_category_predictions_cover_every_row(spark):
    df = _categories(spark, 90, ["a", "b", None]).withColumn(
        "category", F.when(F.col("branch_id") == "b89", "unseen").otherwise(F.col("category")))
    z, sc = M.prepare(df)
    models = M.ridge_models(z.filter(F.col("split") == "train"), sc.order, M.TARGETS, by="category")
    rows = M.category_predictions(z, sc.order, M.TARGETS, models).toPandas()
    assert len(rows) == 90 * 3
    assert rows[rows["category"] == "unseen"]["y_pred"].isna().all()
    assert rows[rows["category"] != "unseen"]["y_pred"].notna().all()
    t = M.category_comparison(df).toPandas()
    unseen = t[(t["scope"] == "per_category") & (t["category"] == "unseen")]
    assert len(unseen) == 3 and unseen["mape"].isna().all() and (unseen["n_test"] == 1).all()


def test_jobs_do_not_grow_with_categories(spark):
    def jobs(names):
        group = f"categories-{len(names)}"
        spark.sparkContext.setJobGroup(group, group)
        M.category_comparison(_categories(spark, 240, names)).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    few = jobs(["a", "b"])
    assert 0 < few and jobs([f"c{i}" for i in range(20)]) <= few + 2      # the cutoff's search may take a step more


def test_rounding_noise_is_no_feature(spark):
    df = _frame(spark, n=40).withColumn("f2", F.when(F.col("bt_x") == 1, 0.1 + 0.2).otherwise(0.3))
    _, sc = M.prepare(df)
    assert sc.std["f2"] == 0.0
    assert sc.std["f1"] > 0.0


def test_stumps_against_all_cuts(spark):
    df = _frame(spark, n=90, seed=5)
    features = ["f1", "f2", "bt_x", "const_feat"]
    x = M.feature_matrix(df, features)
    got = M.fit_stumps(x, features, M.TARGETS)
    pdf = x.toPandas()
    for t in M.TARGETS:
        y = pdf[t].to_numpy(float)
        best = (-1.0, None, None)
        for c in sorted(features):
            v = pdf[c].to_numpy(float)
            width = v.max() - v.min()
            part = np.clip(np.floor((v - v.min()) / width * M.PARTS + M.EDGE), 0, M.PARTS - 1) if width else np.zeros(len(v))
            for p in sorted(set(part))[:-1]:
                low = part <= p
                sse = ((y[low] - y[low].mean()) ** 2).sum() + ((y[~low] - y[~low].mean()) ** 2).sum()
                share = round(1 - sse / ((y - y.mean()) ** 2).sum(), M.TIE_DIGITS) if y.std() else -1.0
                if share > best[0]:
                    best = (share, c, int(p), np.where(low, y[low].mean(), y[~low].mean()))
        s = got[t]
        want = best[3] if best[1] else np.full(len(y), y.mean())
        assert s.feature == best[1] and (s.feature is None or s.part == best[2])
        pred = [r.y_pred for r in x.select(s.predict().alias("y_pred")).collect()]
        assert np.allclose(pred, want) and s.resid_std == pytest.approx((y - want).std(), abs=1e-9)
    with pytest.raises(ValueError):
        M.fit_stumps(x.where("false"), features, M.TARGETS)


def test_feature_counts():
    from pitwise.plans import q_model as Q
    assert (len(Q.FEATURES), len(Q.ADAPTER_FEATURES), len(Q.UNION_FEATURES)) == (73, 69, 77)
