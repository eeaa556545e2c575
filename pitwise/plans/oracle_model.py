"""SQL formulation of the ridge models: sums about the means of every pair of
columns by a self-join of the unpivoted rows, Gauss-Jordan elimination of
(X'X + alpha I | X'y) as a recursive query over (row, column, value)."""

from __future__ import annotations

from pitwise.operators import model as M
from pitwise.plans.oracle_lookback import training_rows_sql
from pitwise.plans.training import TRAINING_COLS
from pitwise.sources.schemas import ID_COLS, LABELS

FEATURES = [c for c in TRAINING_COLS if c not in set(ID_COLS) | set(LABELS)]
CONT, BINARY = M.split_binary(FEATURES)

CUT = ("cut AS (SELECT committed_at AS cutoff FROM (SELECT committed_at, "
       "row_number() OVER (ORDER BY committed_at) - 1 AS rn FROM t1) "
       "WHERE rn = (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM t1))")

_ORDER = CONT + BINARY
_P = len(_ORDER)
_STATS = ", ".join(f"avg(x.{c}) AS m_{c}, CASE WHEN max(x.{c}) - min(x.{c}) <= "
                   f"greatest(abs(min(x.{c})), abs(max(x.{c}))) * {M.NOISE} THEN 1.0 ELSE stddev_pop(x.{c}) END AS s_{c}"
                   for c in CONT)
_FILLED = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in _ORDER)
_SCALED = ", ".join([f"(x.{c} - m_{c}) / s_{c} AS {c}" for c in CONT] + BINARY)
_LABELS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LABELS)
_POSITIONS = ", ".join(f"('{c}', {i})" for i, c in enumerate([*_ORDER, *LABELS], start=1))

#: z: scaled rows; lz: one row per scenario and feature; models: coefficients per (k, target, feature), where
#: k is 'global' or 'c:' and the category; fits: intercept and residual deviation; scored: predictions of all rows.
RIDGE_CTES = f"""
x AS (SELECT branch_id, category, CASE WHEN committed_at < (SELECT cutoff FROM cut) THEN 'train' ELSE 'test' END AS split,
             {_FILLED}, {_LABELS} FROM t1),
st AS (SELECT {_STATS} FROM x WHERE split = 'train'),
z AS (SELECT branch_id, category, split, {_SCALED}, {', '.join(LABELS)} FROM x, st),
pos(name, i) AS (VALUES {_POSITIONS}),
lz AS (UNPIVOT z ON {', '.join([*_ORDER, *LABELS])} INTO NAME name VALUE v),
lk AS MATERIALIZED (SELECT s.k, lz.branch_id, lz.split, pos.i, lz.v
       FROM lz JOIN pos ON pos.name = lz.name, LATERAL (VALUES ('global'), ('c:' || lz.category)) s(k)),
mean AS (SELECT k, i, avg(v) AS m FROM lk WHERE split = 'train' GROUP BY k, i),
cen AS MATERIALIZED (SELECT lk.k, lk.branch_id, lk.i, lk.v - mean.m AS v
       FROM lk JOIN mean ON mean.k = lk.k AND mean.i = lk.i WHERE split = 'train'),
rowcount AS (SELECT k, count(DISTINCT branch_id) AS n FROM cen GROUP BY k),
aug AS MATERIALIZED (SELECT a.k, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN {M.ALPHA} ELSE 0.0 END AS v
       FROM cen a JOIN cen b ON b.k = a.k AND b.branch_id = a.branch_id JOIN rowcount r ON r.k = a.k
       WHERE a.i <= {_P} AND (a.k = 'global' OR r.n >= 2) GROUP BY a.k, a.i, b.i),
elim AS (SELECT 0 AS step, k, i, j, v FROM aug
       UNION ALL
       SELECT e.step + 1, e.k, e.i, e.j, CASE WHEN e.i = pv.i THEN e.v / pv.v ELSE e.v - cl.v * rw.v / pv.v END
       FROM elim e
       JOIN elim rw ON rw.k = e.k AND rw.i = e.step + 1 AND rw.j = e.j
       JOIN elim cl ON cl.k = e.k AND cl.i = e.i AND cl.j = e.step + 1
       JOIN elim pv ON pv.k = e.k AND pv.i = e.step + 1 AND pv.j = e.step + 1
       WHERE e.j > e.step + 1 AND e.step < {_P}),
models AS MATERIALIZED (SELECT e.k, t.name AS target, f.name AS feature, f.i, t.i AS j, e.v AS coef
       FROM elim e JOIN pos f ON f.i = e.i JOIN pos t ON t.i = e.j WHERE e.step = {_P}),
icpt AS (SELECT o.k, o.target, any_value(my.m) - sum(o.coef * mx.m) AS intercept
       FROM models o JOIN mean mx ON mx.k = o.k AND mx.i = o.i JOIN mean my ON my.k = o.k AND my.i = o.j
       GROUP BY o.k, o.target),
ys AS (SELECT s.k, z.branch_id, z.category, z.split, pos.name AS target, lz.v AS y
       FROM z JOIN lz ON lz.branch_id = z.branch_id JOIN pos ON pos.name = lz.name AND pos.i > {_P},
            LATERAL (VALUES ('global'), ('c:' || z.category)) s(k)),
dots AS (SELECT lk.k, lk.branch_id, o.target, sum(lk.v * o.coef) AS dot
       FROM lk JOIN models o ON o.k = lk.k AND o.i = lk.i GROUP BY lk.k, lk.branch_id, o.target),
points AS MATERIALIZED (SELECT ys.*, icpt.intercept + dots.dot AS y_pred
       FROM ys LEFT JOIN dots ON dots.k = ys.k AND dots.branch_id = ys.branch_id AND dots.target = ys.target
       LEFT JOIN icpt ON icpt.k = ys.k AND icpt.target = ys.target),
fits AS (SELECT k, target, stddev_pop(y - y_pred) AS resid_std FROM points WHERE split = 'train' GROUP BY k, target),
scored AS (SELECT points.*, y_pred - {M.CONFIDENCE_Z} * resid_std AS lower, y_pred + {M.CONFIDENCE_Z} * resid_std AS upper
       FROM points LEFT JOIN fits ON fits.k = points.k AND fits.target = points.target)
"""


def ridge_sql(body: str) -> str:
    return f"WITH RECURSIVE t1 AS MATERIALIZED ({training_rows_sql()}), {CUT}, {RIDGE_CTES}\n{body}"


def _part_sql(c: str) -> str:
    place = f"(x.{c} - lo_{c}) / (hi_{c} - lo_{c}) * {float(M.PARTS)} + {M.EDGE}"
    return f"CASE WHEN hi_{c} > lo_{c} THEN CAST(floor(least(greatest({place}, 0.0), {M.PARTS - 1.0})) AS INTEGER) ELSE 0 END AS {c}"


_TARGET_ROWS = ", ".join(f"('{t}', {t})" for t in LABELS)

#: tree: the best cut of each target; treed: predictions of all rows.
TREE_CTES = f"""
ranges AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in _ORDER)} FROM x WHERE split = 'train'),
parted AS (SELECT branch_id, split, {', '.join(map(_part_sql, _ORDER))} FROM x, ranges),
lp AS MATERIALIZED (UNPIVOT parted ON {', '.join(_ORDER)} INTO NAME feature VALUE part),
ty AS (SELECT x.branch_id, x.split, v.target, v.y FROM x, LATERAL (VALUES {_TARGET_ROWS}) v(target, y)),
tm AS (SELECT target, avg(y) AS m, var_pop(y) * count(*) AS sst, count(*) AS n FROM ty WHERE split = 'train' GROUP BY target),
tb AS (SELECT ty.target, lp.feature, lp.part, count(*) AS n, sum(ty.y - tm.m) AS s
       FROM lp JOIN ty ON ty.branch_id = lp.branch_id JOIN tm ON tm.target = ty.target
       WHERE lp.split = 'train' GROUP BY ty.target, lp.feature, lp.part),
cuts AS (SELECT target, feature, part, CAST(sum(n) OVER w AS DOUBLE) AS below, sum(s) OVER w AS s FROM tb
         WINDOW w AS (PARTITION BY target, feature ORDER BY part ROWS UNBOUNDED PRECEDING)),
tree AS (SELECT * FROM (SELECT cuts.*, row_number() OVER (PARTITION BY cuts.target ORDER BY
           round(s * s * (1.0 / below + 1.0 / (tm.n - below)) / sst, {M.TIE_DIGITS}) DESC, feature, part) AS rk
         FROM cuts JOIN tm ON tm.target = cuts.target WHERE below < tm.n AND sst > 0) WHERE rk = 1),
treed AS (SELECT ty.*, tm.m + CASE WHEN tree.feature IS NULL THEN 0.0 WHEN lp.part <= tree.part THEN tree.s / tree.below
                 ELSE -tree.s / (tm.n - tree.below) END AS y_pred
          FROM ty JOIN tm ON tm.target = ty.target LEFT JOIN tree ON tree.target = ty.target
          LEFT JOIN lp ON lp.branch_id = ty.branch_id AND lp.feature = tree.feature),
treer AS (SELECT target, stddev_pop(y - y_pred) AS r FROM treed WHERE split = 'train' GROUP BY target),
both_models AS (SELECT 'ridge' AS model, target, y, y_pred, lower, upper FROM scored WHERE split = 'test' AND k = 'global'
          UNION ALL SELECT 'tree', treed.target, y, y_pred, y_pred - {M.CONFIDENCE_Z} * r, y_pred + {M.CONFIDENCE_Z} * r
          FROM treed JOIN treer ON treer.target = treed.target WHERE split = 'test')
"""

TREE_COMPARISON = (f"WITH RECURSIVE t1 AS MATERIALIZED ({training_rows_sql()}), {CUT}, {RIDGE_CTES}, {TREE_CTES}\n"
                   f"SELECT model, target, avg(CASE WHEN abs(y) > {M.MAPE_EPS} THEN abs((y - y_pred) / y) END) * 100.0 AS mape, "
                   "avg(CASE WHEN y >= lower AND y <= upper THEN 1.0 ELSE 0.0 END) AS coverage, avg(upper - lower) AS mpiw, "
                   "count(*) AS n_test FROM both_models GROUP BY model, target")

RIDGE_FIT = ridge_sql("SELECT o.target, o.feature, o.coef, i.intercept FROM models o "
                      "JOIN icpt i ON i.k = o.k AND i.target = o.target WHERE o.k = 'global'")

TOP_COEFFICIENTS = ridge_sql(
    "SELECT target, rank, feature, coef FROM (SELECT target, feature, coef, row_number() OVER (PARTITION BY target "
    f"ORDER BY round(abs(coef), {M.TIE_DIGITS}) DESC, feature) AS rank FROM models WHERE k = 'global') WHERE rank <= 10")

CATEGORY_MODELS = ridge_sql(
    "SELECT CASE WHEN k = 'global' THEN 'global' ELSE 'per_category' END AS scope, category, target, "
    f"avg(CASE WHEN abs(y) > {M.MAPE_EPS} THEN abs((y - y_pred) / y) END) * 100.0 AS mape, "
    "avg(CASE WHEN y_pred IS NULL THEN NULL WHEN y >= lower AND y <= upper THEN 1.0 ELSE 0.0 END) AS coverage, "
    "avg(upper - lower) AS mpiw, count(*) AS n_test FROM scored WHERE split = 'test' GROUP BY k, category, target")

LINEAR_ATTRIBUTION = ridge_sql(
    "SELECT o.target, z.category, o.feature, avg(abs(o.coef * (lk.v - mean.m))) AS mean_abs_attribution "
    "FROM lk JOIN models o ON o.k = lk.k AND o.i = lk.i JOIN mean ON mean.k = lk.k AND mean.i = lk.i "
    "JOIN z ON z.branch_id = lk.branch_id WHERE lk.k = 'global' AND lk.split = 'test' "
    "GROUP BY o.target, z.category, o.feature")
