"""Queries for splitting, modeling and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitwise.operators import model as M
from pitwise.operators import shops as S
from pitwise.plans import oracle_model as O
from pitwise.plans import q_ledger as L
from pitwise.plans.oracle_lookback import training_rows_sql
from pitwise.plans.oracle_model import CONT, FEATURES
from pitwise.plans.oracle_shops import adapter_sql
from pitwise.plans.oracle_views import with_views
from pitwise.plans.q_shops import shops
from pitwise.plans.registry import query
from pitwise.plans.training import dedup_outcomes
from pitwise.session import materialize
from pitwise.sources import views as V
from pitwise.sources.schemas import ID_COLS


def _t1(spark, d, rounded=False) -> DataFrame:
    from pitwise.plans.q_lookback import t1
    return materialize(t1(spark, d, rounded=rounded))


def _t1_sql_with(body: str, extra: str = "") -> str:
    return f"WITH t1 AS ({training_rows_sql()}), {O.CUT}{extra}\n{body}"


@query("temporal_split", _t1_sql_with(
    "SELECT branch_id, CASE WHEN committed_at < (SELECT cutoff FROM cut) THEN 'train' ELSE 'test' END AS split FROM t1"))
def temporal_split_q(spark, d):
    """M1: train < cutoff <= test, cutoff = committed_at of sorted row int(0.8 n)."""
    return M.temporal_split(_t1(spark, d)).select("branch_id", "split")


@query("feature_matrix", f"WITH t1 AS ({training_rows_sql()}) SELECT branch_id, "
       + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in FEATURES) + " FROM t1")
def feature_matrix_q(spark, d):
    """M2: every non-id, non-label column as a NULL-free double."""
    t1 = _t1(spark, d)
    return M.feature_matrix(t1, M.feature_columns(t1)).select("branch_id", *FEATURES)


_UNPIV = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in CONT)


@query("scale_continuous", _t1_sql_with(
    f"SELECT feature, avg(v) AS mean, stddev_pop(v) AS std FROM "
    f"(UNPIVOT (SELECT {_UNPIV} FROM t1 WHERE committed_at < (SELECT cutoff FROM cut)) "
    f"ON {', '.join(CONT)} INTO NAME feature VALUE v) GROUP BY feature"))
def scale_continuous(spark, d):
    """M3: population mean / std of every continuous feature on the train rows."""
    x = M.temporal_split(M.feature_matrix(_t1(spark, d), FEATURES))
    sc = M.fit_scaler(x.filter(F.col("split") == "train"), FEATURES)
    return spark.createDataFrame([(c, sc.mean[c], sc.std[c]) for c in sc.cont],
                                 "feature string, mean double, std double")


# -- the same on adapter rows and on the union of sources
# (the last columns of the union are those that only one source has)

ADAPTER_FEATURES = [c for c in S.ADAPTER_COLS if c not in M.NON_FEATURES]
UNION_FEATURES = [c for c in L.union_columns() if c not in M.NON_FEATURES]


def _matrix_sql(rows: str, ids: str, features: list[str]) -> str:
    return f"WITH t1 AS ({rows}) SELECT {ids}, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in features) + " FROM t1"


def _scale_sql(rows: str, features: list[str]) -> str:
    cont, _ = M.split_binary(features)
    filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in cont)
    return (f"WITH t1 AS MATERIALIZED ({rows}), {O.CUT} SELECT feature, avg(v) AS mean, CASE WHEN max(v) - min(v) <= "
            f"greatest(abs(min(v)), abs(max(v))) * {M.NOISE} THEN 0.0 ELSE stddev_pop(v) END AS std FROM "
            f"(UNPIVOT (SELECT {filled} FROM t1 WHERE committed_at < (SELECT cutoff FROM cut)) "
            f"ON {', '.join(cont)} INTO NAME feature VALUE v) GROUP BY feature")


def _scaler_rows(spark, rows: DataFrame, features: list[str]) -> DataFrame:
    x = M.temporal_split(materialize(M.feature_matrix(rows.select(*ID_COLS, *features), features)))
    sc = M.fit_scaler(x.filter(F.col("split") == "train"), features)
    return spark.createDataFrame([(c, sc.mean[c], sc.std[c]) for c in sc.cont], "feature string, mean double, std double")


@query("feature_matrix_shop", _matrix_sql(adapter_sql("shop"), "branch_id", ADAPTER_FEATURES))
def feature_matrix_shop(spark, d):
    """M2: the 69 features of the rows of a shop export."""
    sizes = V.shop_sizes(spark, d)
    rows = S.shop_training_rows(shops(spark, d, sizes=sizes), sizes=sizes)
    return M.feature_matrix(rows, M.feature_columns(rows)).select("branch_id", *ADAPTER_FEATURES)


@query("feature_matrix_union", _matrix_sql(L.union_sql(), "branch_id, source", UNION_FEATURES))
def feature_matrix_union(spark, d):
    """M2: the 77 features of the union of sources."""
    rows = L.union_sources(spark, d)
    return M.feature_matrix(rows, M.feature_columns(rows)).select("branch_id", "source", *UNION_FEATURES)


@query("scale_continuous_shop", _scale_sql(adapter_sql("shop"), ADAPTER_FEATURES))
def scale_continuous_shop(spark, d):
    """M3: mean / std of the continuous features of a shop export's train rows (constant ones have std 0)."""
    sizes = V.shop_sizes(spark, d)
    return _scaler_rows(spark, S.shop_training_rows(shops(spark, d, sizes=sizes), sizes=sizes), ADAPTER_FEATURES)


@query("scale_continuous_union", _scale_sql(L.union_sql(), UNION_FEATURES))
def scale_continuous_union(spark, d):
    """M3: mean / std of the continuous features of the union's train rows."""
    return _scaler_rows(spark, L.union_sources(spark, d), UNION_FEATURES)


# -- metrics on a SQL-checkable predictor ------------------------------------
# Per (target, category): y ~ x (x = k + value of the scenario event) by least squares on the train rows (regr_slope /
# regr_intercept), applied to every row. It exercises the same split, interval
# and metric operators as the ridge model.

_TARGET_SRC = {"label_inventory_delta": "inventory_delta", "label_cashflow_delta": "cashflow_delta",
               "label_order_velocity_delta": "order_velocity_delta"}


def simple_predictions(spark, d) -> DataFrame:
    o = dedup_outcomes(V.outcomes(spark, d))
    b = V.branches(spark, d).select("branch_id", "committed_at", (F.col("k") + F.col("value")).alias("x"))
    base = o.join(b, "branch_id").select("branch_id", "category", "committed_at", "x",
                                         *_TARGET_SRC.values())
    base = M.temporal_split(materialize(base))
    lg = base.select("branch_id", "category", "x", "split", F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(src).cast("double").alias("y"))
        for t, src in _TARGET_SRC.items()])).alias("_t")).select("*", "_t.*").drop("_t")
    cf = (lg.filter(F.col("split") == "train").groupBy("target", "category")
          .agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("icpt")))
    pr = lg.join(cf, ["target", "category"]).withColumn(
        "y_pred", F.col("icpt") + F.col("slope") * F.col("x"))
    rs = (pr.filter(F.col("split") == "train").groupBy("target", "category")
          .agg(F.stddev_pop(F.col("y") - F.col("y_pred")).alias("resid_std")))
    pr = pr.join(rs, ["target", "category"])
    return pr.select("target", "category", "branch_id", "split", "y", "y_pred", "resid_std",
                     (F.col("y_pred") - F.lit(M.CONFIDENCE_Z) * F.col("resid_std")).alias("lower"),
                     (F.col("y_pred") + F.lit(M.CONFIDENCE_Z) * F.col("resid_std")).alias("upper"))


_PRED_CTES = """
base AS (SELECT o.branch_id, o.category, b.committed_at, b.k + b.value AS x, o.inventory_delta, o.cashflow_delta,
                o.order_velocity_delta
         FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY seq DESC) AS rn
                              FROM outcomes) WHERE rn = 1) o
         JOIN branches b ON b.branch_id = o.branch_id),
cut AS (SELECT committed_at AS cutoff FROM (SELECT committed_at, row_number() OVER (ORDER BY committed_at) - 1 AS rn
                                            FROM base)
        WHERE rn = (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM base)),
sb AS (SELECT base.*, CASE WHEN committed_at < (SELECT cutoff FROM cut) THEN 'train' ELSE 'test' END AS split FROM base),
lg AS (SELECT branch_id, category, x, split, 'label_inventory_delta' AS target, CAST(inventory_delta AS DOUBLE) AS y FROM sb
       UNION ALL SELECT branch_id, category, x, split, 'label_cashflow_delta', CAST(cashflow_delta AS DOUBLE) FROM sb
       UNION ALL SELECT branch_id, category, x, split, 'label_order_velocity_delta', CAST(order_velocity_delta AS DOUBLE) FROM sb),
cf AS (SELECT target, category, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt
       FROM lg WHERE split = 'train' GROUP BY target, category),
pr AS (SELECT lg.*, cf.icpt + cf.slope * lg.x AS y_pred FROM lg JOIN cf ON cf.target = lg.target AND cf.category = lg.category),
rs AS (SELECT target, category, stddev_pop(y - y_pred) AS resid_std FROM pr WHERE split = 'train' GROUP BY target, category),
pi AS (SELECT pr.*, rs.resid_std, pr.y_pred - 1.28 * rs.resid_std AS lower, pr.y_pred + 1.28 * rs.resid_std AS upper
       FROM pr JOIN rs ON rs.target = pr.target AND rs.category = pr.category)
"""


def _pred_sql(body: str) -> str:
    return with_views(["outcomes", "branches"], body, _PRED_CTES)


@query("residual_std", _pred_sql("SELECT target, category, resid_std FROM rs"))
def residual_std(spark, d):
    """M5: population std of train residuals per (target, category) model."""
    return simple_predictions(spark, d).select("target", "category", "resid_std").distinct()


@query("prediction_interval", _pred_sql("SELECT target, branch_id, y_pred, lower, upper FROM pi WHERE split = 'test'"))
def prediction_interval(spark, d):
    """M6: prediction +- 1.28 * residual std on the test rows."""
    return (simple_predictions(spark, d).filter(F.col("split") == "test")
            .select("target", "branch_id", "y_pred", "lower", "upper"))


@query("coverage", _pred_sql("SELECT target, category, avg(CASE WHEN y >= lower AND y <= upper THEN 1.0 ELSE 0.0 END) "
                             "AS coverage FROM pi WHERE split = 'test' GROUP BY target, category"))
def coverage(spark, d):
    """M7: share of test actuals inside the interval (bounds inclusive)."""
    p = simple_predictions(spark, d).filter(F.col("split") == "test")
    return p.groupBy("target", "category").agg(
        M.coverage_expr(F.col("y"), F.col("lower"), F.col("upper")).alias("coverage"))


_MAPE_SQL = "avg(CASE WHEN abs(y) > 1e-6 THEN abs((y - y_pred) / y) END) * 100.0"


@query("mape", _pred_sql(f"SELECT target, category, {_MAPE_SQL} AS mape FROM pi WHERE split = 'test' "
                         "GROUP BY target, category"))
def mape(spark, d):
    """M8: MAPE over test rows with |y| > 1e-6 (NULL when there are none)."""
    p = simple_predictions(spark, d).filter(F.col("split") == "test")
    return p.groupBy("target", "category").agg(M.mape_expr(F.col("y"), F.col("y_pred")).alias("mape"))


@query("metrics_report", _pred_sql(
    f"SELECT target, mape, coverage, CASE WHEN mape IS NULL THEN 'n/a' WHEN mape < 15 THEN 'strong' "
    f"WHEN mape <= 30 THEN 'acceptable' ELSE 'weak' END AS band FROM ("
    f"SELECT target, {_MAPE_SQL} AS mape, avg(CASE WHEN y >= lower AND y <= upper THEN 1.0 ELSE 0.0 END) "
    f"AS coverage FROM pi WHERE split = 'test' GROUP BY target)"))
def metrics_report(spark, d):
    """M9: per-target MAPE and coverage with the interpretation band."""
    p = simple_predictions(spark, d).filter(F.col("split") == "test")
    g = p.groupBy("target").agg(M.mape_expr(F.col("y"), F.col("y_pred")).alias("mape"),
                                M.coverage_expr(F.col("y"), F.col("lower"), F.col("upper")).alias("coverage"))
    return g.select("target", "mape", "coverage", M.band(F.col("mape")).alias("band"))


@query("picp_mpiw", _pred_sql(
    "SELECT target, category, avg(CASE WHEN y >= lower AND y <= upper THEN 1.0 ELSE 0.0 END) AS picp, "
    "avg(upper - lower) AS mpiw FROM pi WHERE split = 'test' GROUP BY target, category"))
def picp_mpiw(spark, d):
    """Interval coverage probability and mean interval width."""
    p = simple_predictions(spark, d).filter(F.col("split") == "test")
    return p.groupBy("target", "category").agg(
        M.coverage_expr(F.col("y"), F.col("lower"), F.col("upper")).alias("picp"),
        F.avg(F.col("upper") - F.col("lower")).alias("mpiw"))


# -- ridge on the training rows

def _baseline(spark, d):
    return M.train_baseline(_t1(spark, d))


@query("ridge_fit", O.RIDGE_FIT)
def ridge_fit(spark, d):
    """M4: ridge coefficients per target (scaled continuous + binary features)."""
    fits, _, _, _ = _baseline(spark, d)
    return M.coefficients(fits, spark)


@query("top_coefficients", O.TOP_COEFFICIENTS)
def top_coefficients(spark, d):
    """The 10 largest |coef| per target."""
    fits, _, _, _ = _baseline(spark, d)
    return M.top_coefficients(M.coefficients(fits, spark), 10)


@query("model_comparison")
def model_comparison(spark, d):
    """Ridge vs gradient-boosted trees on the same temporal split."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    fits, pred, z, sc = _baseline(spark, d)
    out = [M.metrics(pred, ["target"]).withColumn("model", F.lit("ridge"))]
    z = materialize(VectorAssembler(inputCols=sc.order, outputCol="_x", handleInvalid="keep").transform(z))
    for t in M.TARGETS:
        tr = z.filter(F.col("split") == "train")
        gbt = GBTRegressor(featuresCol="_x", labelCol=t, predictionCol="_p", maxIter=20, maxDepth=4, seed=7)
        m = gbt.fit(tr)
        scored = m.transform(z)
        rs = scored.filter(F.col("split") == "train").agg(
            F.stddev_pop(F.col(t) - F.col("_p")).alias("r")).collect()[0]["r"] or 0.0
        p = scored.select(F.lit(t).alias("target"), "branch_id", "category", "split",
                          F.col(t).cast("double").alias("y"), F.col("_p").alias("y_pred"),
                          (F.col("_p") - F.lit(M.CONFIDENCE_Z * rs)).alias("lower"),
                          (F.col("_p") + F.lit(M.CONFIDENCE_Z * rs)).alias("upper"))
        out.append(M.metrics(p, ["target"]).withColumn("model", F.lit("gbt")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res.select("model", "target", "mape", "coverage", "mpiw", "n_test")


@query("tree_comparison", O.TREE_COMPARISON)
def tree_comparison(spark, d):
    """Ridge vs the best regression tree of one cut on the same temporal split."""
    t1 = _t1(spark, d)
    _, ridge, _, _ = M.train_baseline(t1)
    x = materialize(M.temporal_split(M.feature_matrix(t1, FEATURES)))
    tree = M.global_predictions(x, M.fit_stumps(x.filter(F.col("split") == "train"), FEATURES, M.TARGETS))
    pred = ridge.withColumn("model", F.lit("ridge")).unionByName(tree.withColumn("model", F.lit("tree")))
    return M.metrics(pred, ["model", "target"])


@query("category_models", O.CATEGORY_MODELS)
def category_models(spark, d):
    """One global model vs one model per category, metrics per category."""
    return M.category_comparison(_t1(spark, d))


@query("linear_attribution", O.LINEAR_ATTRIBUTION)
def linear_attribution(spark, d):
    """Mean |coef * (z - mean_train z)| per feature, target and category."""
    fits, _, z, sc = _baseline(spark, d)
    coefs = M.coefficients(fits, spark)           # n_features x n_targets rows: bounded
    tr_mean = z.filter(F.col("split") == "train").agg(
        *[F.avg(c).alias(c) for c in sc.order]).collect()[0].asDict()
    test = z.filter(F.col("split") == "test")
    # |coef| is constant within a feature: one mean per feature and category, then the small result is unpivoted
    means = test.groupBy("category").agg(*[
        F.avg(F.abs(F.col(c) - F.lit(float(tr_mean[c] or 0.0)))).alias(c) for c in sc.order])
    long = means.select("category", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("m")) for c in sc.order])))
    return long.join(coefs, "feature").select(
        "target", "category", "feature", (F.abs("coef") * F.col("m")).alias("mean_abs_attribution"))
