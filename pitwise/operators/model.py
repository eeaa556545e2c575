"""Temporal split, scaling, ridge fit and forecast metrics.

* The split cutoff is an exact order statistic found by descending a
  histogram (day -> hour -> minute -> second -> ms -> us buckets); each step
  is a Spark aggregate whose result has at most a few thousand rows, so no
  row-level data reaches the driver.
* Scaling statistics are one aggregate row (mean, population std per
  continuous column) - a fixed-size broadcast of 2 x n_features numbers.
* Ridge minimises ||y - Xb - c||^2 + alpha ||b||^2 with an unpenalised intercept.
  One pass over the rows aggregates the products of all columns (``gram``) per
  category: the models of all categories and targets, and the global ones, are
  solved from these sums, each in one small task. The number of jobs depends
  neither on categories nor on targets.
* Predictions are column expressions (intercept + sum coef * z).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pitwise.functions.timecols import DAY_US, floor_div, micros
from pitwise.session import materialize
from pitwise.sources.schemas import ID_COLS, LABELS

TARGETS = list(LABELS)
TRAIN_RATIO = 0.80
CONFIDENCE_Z = 1.28
ALPHA = 1.0
MAPE_EPS = 1e-6
NOISE = 1e-9                # relative range below which a column counts as constant
HELD_GRAMS = 256            # categories whose products one task holds before it passes them on
SMALL_MODELS = 10_000       # models (rows) up to which they are broadcast
TIE_DIGITS = 9              # coefficients (and explained shares of trees) equal to this many decimals tie
PARTS = 32                  # equal parts of a feature's range between which a tree may cut
EDGE = 1e-9                 # of a part: values at an edge belong to the part above, whatever their last bits
BINARY_PREFIXES = ("bt_", "cat_", "is_")
NON_FEATURES = set(ID_COLS) | set(LABELS) | {"source", "split", "n_prior"}

NO_TIME = 400_000_000_000_000_000       # microseconds; beyond year 9999
_LEVELS = [DAY_US, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1]


def temporal_cutoff(df: DataFrame, ts: str = "committed_at", train_ratio: float = TRAIN_RATIO) -> int:
    """Time (microseconds) of the row at 0-based position int(n * ratio) in
    time order.

    Raises ValueError when that position does not exist (ratio 1.0)."""
    n = df.count()
    k = int(n * train_ratio)
    if n == 0 or k >= n:
        raise ValueError(f"train_ratio={train_ratio} leaves no test rows (n={n})")
    # rows without a time come last, after every other
    t = df.select(F.coalesce(micros(F.col(ts)), F.lit(NO_TIME)).alias("_t"))
    lo, hi, r = None, None, k          # search range [lo, hi) and rank inside it
    for g in _LEVELS:
        sub = t if lo is None else t.filter((F.col("_t") >= lo) & (F.col("_t") < hi))
        buckets = sorted((row["_b"], row["n"], row["t0"], row["t1"]) for row in
                         sub.groupBy(floor_div(F.col("_t"), g).alias("_b"))
                            .agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("t0"),
                                 F.max("_t").alias("t1")).collect())
        for b, cnt, t0, t1 in buckets:
            if r < cnt:
                if t0 == t1:           # one distinct time in the bucket: found
                    return int(t0)
                lo, hi = b * g, (b + 1) * g
                break
            r -= cnt
    return int(lo)


def temporal_split(df: DataFrame, ts: str = "committed_at", train_ratio: float = TRAIN_RATIO) -> DataFrame:
    """M1: ``split`` = 'train' for ts < cutoff, 'test' otherwise (ties at the
    cutoff all go to test)."""
    cutoff_us = temporal_cutoff(df, ts, train_ratio)
    t = F.coalesce(micros(F.col(ts)), F.lit(NO_TIME))
    return df.withColumn("split", F.when(t < F.lit(cutoff_us), "train").otherwise("test"))


def feature_columns(df: DataFrame) -> list[str]:
    """M2: every column except ids, labels and bookkeeping, in table order."""
    return [c for c in df.columns if c not in NON_FEATURES]


def split_binary(cols: list[str]) -> tuple[list[str], list[str]]:
    binary = [c for c in cols if c.startswith(BINARY_PREFIXES)]
    cont = [c for c in cols if c not in binary]
    return cont, binary


def feature_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """M2: features as doubles, NULL -> 0."""
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])


@dataclass
class Scaler:
    cont: list[str]
    binary: list[str]
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)

    @property
    def order(self) -> list[str]:
        return self.cont + self.binary

    def columns(self) -> list[Column]:
        """Scaled continuous columns, then binary columns unchanged."""
        out = []
        for c in self.cont:
            s = self.std[c] if self.std[c] not in (None, 0.0) else 1.0
            out.append(((F.col(c) - F.lit(self.mean[c] or 0.0)) / F.lit(s)).alias(c))
        out += [F.col(c) for c in self.binary]
        return out


def fit_scaler(train: DataFrame, cols: list[str]) -> Scaler:
    """M3: population mean/std of continuous columns on the training rows. A
    column whose values differ by rounding noise alone (range within 1e-9 of the
    largest magnitude) has std 0: scaled noise would pass for a feature."""
    cont, binary = split_binary(cols)
    std = [F.when(F.max(c) - F.min(c) <= F.greatest(F.abs(F.min(c)), F.abs(F.max(c))) * NOISE, 0.0)
            .otherwise(F.stddev_pop(c)) for c in cont]
    row = train.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cont)],
                    *[s.alias(f"s_{i}") for i, s in enumerate(std)]).collect()[0]
    sc = Scaler(cont, binary)
    for i, c in enumerate(cont):
        sc.mean[c] = row[f"m_{i}"]
        sc.std[c] = row[f"s_{i}"]
    return sc


@dataclass
class RidgeFit:
    target: str
    features: list[str]
    coef: list[float]
    intercept: float
    resid_std: float = 0.0

    def predict(self) -> Column:
        expr = F.lit(self.intercept)
        for c, b in zip(self.features, self.coef):
            if b != 0.0:
                expr = expr + F.col(c) * F.lit(float(b))
        return expr


@dataclass
class Stump:
    """A regression tree of one cut: ``low`` up to ``part`` of the feature's range [lo, hi], ``high`` beyond."""
    target: str
    low: float
    high: float
    resid_std: float
    feature: str | None = None      # None: no feature tells anything, low = high = the mean
    part: int = 0
    lo: float = 0.0
    hi: float = 0.0

    def predict(self) -> Column:
        if self.feature is None:
            return F.lit(self.low)
        return F.when(part_of(self.feature, self.lo, self.hi) <= self.part, self.low).otherwise(self.high)


def part_of(feature: str, lo: float | None, hi: float | None) -> Column:
    """Which of PARTS equal parts of [lo, hi] a value lies in; values outside belong to the first or last one."""
    if lo is None or hi is None or not hi > lo:
        return F.lit(0)
    place = (F.col(feature) - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(PARTS)) + F.lit(EDGE)
    return F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(PARTS - 1.0))).cast("int")


def fit_stumps(train: DataFrame, features: list[str], targets: list[str]) -> dict[str, Stump]:
    """Per target the cut that explains most of the variance (ties: feature name, then lower part).

    Two passes for all targets and features together: ranges and means, then counts and sums per feature and
    part, at most features x PARTS rows, whose prefix sums give the gain of every cut. Rows with a label that is
    NULL or not finite are not learnt from."""
    from pyspark.sql import Window

    train = train.filter(learnable(targets))
    seen = train.agg(F.count(F.lit(1)).alias("n"),
                     *[f(c).alias(f"{k}_{i}") for i, c in enumerate(features) for k, f in (("lo", F.min), ("hi", F.max))],
                     *[f(F.col(t).cast("double")).alias(f"{k}_{i}") for i, t in enumerate(targets)
                       for k, f in (("mean", F.avg), ("var", F.var_pop))]).first()
    n = seen["n"]
    if not n:
        raise ValueError("no row to learn from")
    place = F.array(*[part_of(c, seen[f"lo_{i}"], seen[f"hi_{i}"]) for i, c in enumerate(features)])
    rows = train.select(*[(F.col(t).cast("double") - F.lit(seen[f"mean_{i}"])).alias(f"_y{i}") for i, t in enumerate(targets)],
                        F.posexplode(place).alias("f", "part"))
    sums = rows.groupBy("f", "part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_y{i}").alias(f"s{i}") for i in range(len(targets))])
    told = [F.struct(F.lit(i).alias("t"), F.col(f"s{i}").alias("s"), F.lit(seen[f"var_{i}"] * n).alias("sst"))
            for i in range(len(targets)) if seen[f"var_{i}"] > 0]
    found = {}
    if told:
        upto = Window.partitionBy("t", "f").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        cuts = sums.select("f", "part", "n", F.inline(F.array(*told))).select(
            "t", "f", "part", "sst", F.sum("n").over(upto).alias("below"), F.sum("s").over(upto).alias("s"))
        share = F.col("s") * F.col("s") * (F.try_divide(F.lit(1.0), "below") + F.try_divide(F.lit(1.0), F.lit(n) - F.col("below"))) / F.col("sst")
        cuts = cuts.filter(F.col("below") < n).withColumn("share", share).withColumn("name", F.get(F.array(*map(F.lit, features)), F.col("f")))
        best = F.row_number().over(Window.partitionBy("t").orderBy(F.round("share", TIE_DIGITS).desc(), "name", "part"))
        found = {r["t"]: r for r in cuts.withColumn("rank", best).filter(F.col("rank") == 1).collect()}
    out = {}
    for i, t in enumerate(targets):
        mean, var, r = seen[f"mean_{i}"], seen[f"var_{i}"], found.get(i)
        if r is None:
            out[t] = Stump(t, mean, mean, float(np.sqrt(var)))
        else:
            out[t] = Stump(t, mean + r["s"] / r["below"], mean - r["s"] / (n - r["below"]), float(np.sqrt(max(var * (1 - r["share"]), 0.0))),
                           r["name"], r["part"], seen[f"lo_{r['f']}"], seen[f"hi_{r['f']}"])
    return out


def learnable(targets: list[str]) -> Column:
    """Whether all labels are finite numbers."""
    usable = F.lit(True)
    for t in targets:
        usable = usable & F.coalesce(F.abs(F.col(t).cast("double")) < float("inf"), F.lit(False))
    return usable


def gram(df: DataFrame, columns: list[str], by: Column) -> DataFrame:
    """(key, i, j, s): per key the sum of the products of columns i and j, i <= j.

    Column 0 is the constant 1, so that s(0, 0) counts rows and s(0, j) sums
    columns. Tasks add up their own rows first; what is shuffled is one row per
    task, key and pair of columns."""
    width = len(columns) + 1
    upper = np.triu_indices(width)

    def rows(held: dict) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"key": key, "i": upper[0], "j": upper[1], "s": g[upper]})
                          for key, g in held.items()], ignore_index=True).astype({"key": object})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf.iloc[:, 1:].to_numpy(float)])
            codes, keys = pd.factorize(pdf.iloc[:, 0])
            for code in np.unique(codes):
                part = x[codes == code]
                key = None if code < 0 else keys[code]
                held[key] = held.get(key, 0.0) + part.T @ part
            if len(held) >= HELD_GRAMS:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    narrow = df.select(by.cast("string").alias("key"),
                       *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    return (narrow.mapInPandas(partial, "key string, i int, j int, s double")
            .groupBy("key", "i", "j").agg(F.sum("s").alias("s")))


def ridge_models(train_z: DataFrame, features: list[str], targets: list[str], alpha: float = ALPHA,
                 by: str | None = None) -> DataFrame:
    """M4/M5: (scope, key, target, n, intercept, coef array, resid_std), a row
    per target for scope 'global' (key NULL) and, with ``by``, per value of that
    column for scope 'per_category'. Rows with a label that is NULL or not
    finite are not learnt from; a scope without rows has no model, nor has a
    value of ``by`` with a single row."""
    train = train_z.filter(learnable(targets))
    # products are taken about the labels' means: a large common offset does not cost digits
    shift = train.agg(*[F.avg(F.col(t).cast("double")).alias(t) for t in targets]).collect()[0]
    offset = [shift[t] or 0.0 for t in targets]
    shifted = train.select(*([F.col(by).alias("_by")] if by else []), *features,
                           *[(F.col(t).cast("double") - F.lit(o)).alias(t) for t, o in zip(targets, offset)])
    products = gram(shifted, [*features, *targets], F.col("_by") if by else F.lit(None))
    whole = products.groupBy("i", "j").agg(F.sum("s").alias("s")).select(
        F.lit("global").alias("scope"), F.lit(None).cast("string").alias("key"), "i", "j", "s")
    if by:
        products = materialize(products)
        whole = (products.groupBy("i", "j").agg(F.sum("s").alias("s"))
                 .select(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("key"), "i", "j", "s")
                 .unionByName(products.select(F.lit("per_category").alias("scope"), "key", "i", "j", "s")))
    p = len(features)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((p + len(targets) + 1,) * 2)
        g[pdf["i"], pdf["j"]] = pdf["s"]
        g[pdf["j"], pdf["i"]] = pdf["s"]
        n, scope = g[0, 0], pdf["scope"].iat[0]
        if scope == "per_category" and n < 2:
            return pd.DataFrame(columns=["scope", "key", "target", "n", "intercept", "coef", "resid_std"])
        mean = g[0, 1:] / n
        c = g[1:, 1:] - n * np.outer(mean, mean)
        coef = np.linalg.solve(c[:p, :p] + alpha * np.eye(p), c[:p, p:])
        # the residuals' products, from those of the columns
        sse = c[p:, p:].diagonal() - 2 * (coef * c[:p, p:]).sum(0) + (coef * (c[:p, :p] @ coef)).sum(0)
        return pd.DataFrame({"scope": scope, "key": pdf["key"].iat[0], "target": targets, "n": int(n),
                             "intercept": mean[p:] - mean[:p] @ coef + np.array(offset),
                             "coef": list(coef.T), "resid_std": np.sqrt(np.maximum(sse, 0.0) / n)}
                            ).astype({"key": object})

    return whole.groupBy("scope", "key").applyInPandas(
        solve, "scope string, key string, target string, n long, intercept double, coef array<double>, resid_std double")


def global_fits(models: DataFrame, features: list[str]) -> dict[str, RidgeFit]:
    """The global models on the driver: targets x features numbers."""
    rows = models.filter(F.col("scope") == "global").collect()
    if not rows:
        raise ValueError("no row to learn from")
    return {r["target"]: RidgeFit(r["target"], list(features), list(r["coef"]), r["intercept"], r["resid_std"])
            for r in rows}


def fit_ridges(train_z: DataFrame, features: list[str], targets: list[str],
               alpha: float = ALPHA) -> dict[str, RidgeFit]:
    """M4: the global model of every target."""
    return global_fits(ridge_models(train_z, features, targets, alpha), features)


def fit_ridge(train_z: DataFrame, features: list[str], target: str, alpha: float = ALPHA) -> RidgeFit:
    """M4: ridge with an unpenalised intercept for one target."""
    return fit_ridges(train_z, features, [target], alpha)[target]


def category_predictions(z: DataFrame, features: list[str], targets: list[str], models: DataFrame) -> DataFrame:
    """Predictions of the models of each row's own category (NULL where it
    has none), in the columns of :func:`train_baseline`'s table."""
    own = materialize(models.filter(F.col("scope") == "per_category").groupBy(F.col("key").alias("_key")).agg(
        F.collect_list(F.struct("target", "intercept", "coef", "resid_std")).alias("_models")))
    if own.count() <= SMALL_MODELS:
        own = F.broadcast(own)
    rows = z.select("branch_id", "category", "split", F.array(*features).alias("_x"),
                    F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"))
                              for t in targets]).alias("_t"))
    rows = (rows.join(own, F.col("category").eqNullSafe(F.col("_key")), "left")
            .select("branch_id", "category", "split", "_x", "_models", F.inline("_t"))
            .withColumn("_m", F.get(F.filter("_models", lambda m: m["target"] == F.col("target")), F.lit(0))))
    scored = rows.withColumn("y_pred", F.col("_m.intercept") + F.aggregate(
        F.zip_with("_x", "_m.coef", lambda x, b: x * b), F.lit(0.0), lambda a, v: a + v))
    half = F.lit(CONFIDENCE_Z) * F.col("_m.resid_std")
    return scored.select("target", "branch_id", "category", "split", "y", "y_pred",
                         (F.col("y_pred") - half).alias("lower"), (F.col("y_pred") + half).alias("upper"))


def mape_expr(y: Column, p: Column) -> Column:
    """M8: mean |(y - p)/y| * 100 over rows with |y| > 1e-6 (NULL if none)."""
    return F.avg(F.when(F.abs(y) > MAPE_EPS, F.abs((y - p) / y))) * F.lit(100.0)


def coverage_expr(y: Column, lower: Column, upper: Column) -> Column:
    """M7: share of actuals inside [lower, upper] (bounds inclusive)."""
    return F.avg(((y >= lower) & (y <= upper)).cast("double"))


def band(mape: Column) -> Column:
    """M9 interpretation guide: < 15 strong, 15-30 acceptable, > 30 weak."""
    return (F.when(mape.isNull(), F.lit("n/a")).when(mape < 15, "strong")
             .when(mape <= 30, "acceptable").otherwise("weak"))


def prepare(df: DataFrame, train_ratio: float = TRAIN_RATIO):
    """Split, feature matrix, scaler -> (scaled frame with split, scaler)."""
    cols = feature_columns(df)
    x = feature_matrix(df, cols)
    x = temporal_split(x, "committed_at", train_ratio)
    sc = fit_scaler(x.filter(F.col("split") == "train"), cols)
    keep = [c for c in x.columns if c not in cols]
    z = x.select(*keep, *sc.columns())
    return z, sc


def global_predictions(z: DataFrame, fits: dict[str, RidgeFit] | dict[str, Stump]) -> DataFrame:
    """M6: (target, branch_id, category, split, y, y_pred, lower, upper), a row per
    row of z and target; z is read once."""
    parts = [F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"), f.predict().alias("y_pred"),
                      F.lit(CONFIDENCE_Z * f.resid_std).alias("half")) for t, f in fits.items()]
    long = z.select("branch_id", "category", "split", F.inline(F.array(*parts)))
    return long.select("target", "branch_id", "category", "split", "y", "y_pred",
                       (F.col("y_pred") - F.col("half")).alias("lower"),
                       (F.col("y_pred") + F.col("half")).alias("upper"))


def train_baseline(df: DataFrame, alpha: float = ALPHA, targets=TARGETS,
                   train_ratio: float = TRAIN_RATIO):
    """M4-M6 for every target: fits and a long prediction table
    (target, branch_id, category, split, y, y_pred, lower, upper)."""
    z, sc = prepare(df, train_ratio)
    fits = fit_ridges(z.filter(F.col("split") == "train"), sc.order, list(targets), alpha)
    return fits, global_predictions(z, fits), z, sc


def metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    """M7/M8/M11 on test rows grouped by ``by``."""
    y, p = F.col("y"), F.col("y_pred")
    return (pred.filter(F.col("split") == "test").groupBy(*by)
            .agg(mape_expr(y, p).alias("mape"),
                 coverage_expr(y, F.col("lower"), F.col("upper")).alias("coverage"),
                 F.avg(F.col("upper") - F.col("lower")).alias("mpiw"),
                 F.count(F.lit(1)).alias("n_test")))


def category_comparison(df: DataFrame, targets=TARGETS) -> DataFrame:
    """Metrics per category and target of the global model and of the
    category's own, all solved from one pass (NULL for a category with fewer
    than two training rows)."""
    z, sc = prepare(df)
    models = materialize(ridge_models(z.filter(F.col("split") == "train"), sc.order, list(targets), by="category"))
    fits = global_fits(models, sc.order)
    whole = metrics(global_predictions(z, fits), ["target", "category"]).withColumn("scope", F.lit("global"))
    own = metrics(category_predictions(z, sc.order, list(targets), models), ["target", "category"])
    return whole.unionByName(own.withColumn("scope", F.lit("per_category"))).select("scope", "category", "target", "mape", "coverage", "mpiw", "n_test")


def coefficients(fits: dict[str, RidgeFit], spark) -> DataFrame:
    rows = [(t, f, float(b), float(fit.intercept)) for t, fit in fits.items()
            for f, b in zip(fit.features, fit.coef)]
    return spark.createDataFrame(rows, "target string, feature string, coef double, intercept double")


def top_coefficients(coefs: DataFrame, n: int = 10) -> DataFrame:
    """Top-n features by |coef| per target (to nine decimals; ties by feature name)."""
    from pyspark.sql import Window
    w = Window.partitionBy("target").orderBy(F.round(F.abs("coef"), TIE_DIGITS).desc(), F.col("feature"))
    return (coefs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("target", "rank", "feature", "coef"))
