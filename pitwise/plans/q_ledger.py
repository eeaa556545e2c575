"""Queries for ledger reconciliation (L1-L4) and the union of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.operators import ledger as L
from pitwise.operators import shops as S
from pitwise.plans.oracle_lookback import training_rows_sql
from pitwise.plans.oracle_shops import adapter_sql
from pitwise.plans.oracle_views import with_views
from pitwise.plans.registry import query
from pitwise.plans.training import TRAINING_COLS
from pitwise.sources import views as V

_DELTAS = """
d AS (SELECT c.commit_id, c.business_id, c.seq, c."timestamp" AS ts,
        CASE c.event_type WHEN 'ORDER_RECEIVED' THEN CAST(coalesce(p.f_revenue, 0) AS DECIMAL(18,2))
                          WHEN 'ORDER_CANCELLED' THEN -CAST(coalesce(p.f_revenue_reversed, 0) AS DECIMAL(18,2))
                          WHEN 'SUPPLIER_PO_CREATED' THEN -CAST(coalesce(p.f_cost, 0) AS DECIMAL(18,2))
                          ELSE CAST(0 AS DECIMAL(18,2)) END AS d_cash,
        CASE c.event_type WHEN 'ORDER_RECEIVED' THEN -CAST(coalesce(p.f_quantity, 0) AS DECIMAL(24,8))
                          WHEN 'ORDER_CANCELLED' THEN CAST(coalesce(p.f_quantity, 0) AS DECIMAL(24,8))
                          WHEN 'INVENTORY_RESTOCK' THEN CAST(coalesce(p.f_quantity_added, 0) AS DECIMAL(24,8))
                          ELSE CAST(0 AS DECIMAL(24,8)) END AS d_units
      FROM commits c JOIN pc p ON p.seq = c.seq),
bal AS (SELECT commit_id, business_id, seq, ts,
          CAST(sum(d_cash) OVER w AS DOUBLE) AS cash_balance,
          CAST(sum(d_units) OVER w AS DOUBLE) AS inventory_units
        FROM d WINDOW w AS (PARTITION BY business_id ORDER BY ts, seq
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


def _lsql(body: str, more: str = "") -> str:
    return with_views(["commits", "pc"], body, _DELTAS.rstrip() + more)


@query("running_cash", _lsql("SELECT commit_id, business_id, cash_balance FROM bal"))
def running_cash(spark, d):
    """L1: cash balance after every commit (opening balance 0)."""
    return L.running_balances(V.commits(spark, d)).select("commit_id", "business_id", "cash_balance")


@query("running_inventory", _lsql("SELECT commit_id, business_id, inventory_units FROM bal"))
def running_inventory(spark, d):
    """L2: unit balance after every commit (restock applied at receipt)."""
    return L.running_balances(V.commits(spark, d)).select("commit_id", "business_id", "inventory_units")


@query("weekly_snapshot", _lsql("""
SELECT g.business_id, g.week, arg_max(b.cash_balance, {'t': b.ts, 's': b.seq}) AS cash_balance,
       arg_max(b.inventory_units, {'t': b.ts, 's': b.seq}) AS inventory_units,
       count(*) FILTER (WHERE b.week = g.week) AS n_commits
FROM (SELECT business_id, unnest(range(max(week) + 1)) AS week FROM wk GROUP BY business_id) g
JOIN wk b ON b.business_id = g.business_id AND b.week <= g.week
GROUP BY g.business_id, g.week""", """,
wk AS (SELECT b.*, CAST(floor((floor(epoch_us(ts) / 86400000000.0)
                               - floor(epoch_us(min(ts) OVER (PARTITION BY business_id)) / 86400000000.0)) / 7) AS BIGINT) AS week
       FROM bal b)"""))
def weekly_snapshot(spark, d):
    """L3: balances at the end of every 7-day period from the business's first day; carried forward where none."""
    return L.weekly_snapshot(V.commits(spark, d))


@query("price_pct_change", with_views(["unit_prices"], """
SELECT shop_id, created_at, l_orderkey, l_linenumber, l_partkey, price,
       (price - lag(price) OVER w) / NULLIF(lag(price) OVER w, 0) * 100.0 AS pct_change
FROM unit_prices
WINDOW w AS (PARTITION BY shop_id ORDER BY created_at, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)"""))
def price_pct_change(spark, d):
    """L4: percent change of the unit price against the previous order."""
    r = L.price_pct_change(V.unit_prices(spark, d))
    return r.select("shop_id", "created_at", F.col("tie.l_orderkey").alias("l_orderkey"),
                    F.col("tie.l_linenumber").alias("l_linenumber"), F.col("tie.l_partkey").alias("l_partkey"),
                    "price", "pct_change")


def union_columns() -> list[str]:
    cols = list(TRAINING_COLS)
    for c in S.ADAPTER_COLS:
        if c not in cols:
            cols.append(c)
    return cols


_TEXT = {"branch_id", "business_id", "category", "branch_type", "committed_at", "source"}


def union_sql() -> str:
    cols = union_columns()
    sel = ", ".join(c if c in _TEXT else f"coalesce({c}, 0) AS {c}" for c in cols)
    return (f"WITH a AS ({training_rows_sql()}), b AS ({adapter_sql('shop')}), c AS ({adapter_sql('retail')}), "
            f"u AS (SELECT *, 'core' AS source FROM a UNION ALL BY NAME SELECT *, 'shopify' AS source FROM b "
            f"UNION ALL BY NAME SELECT *, 'kaggle' AS source FROM c) SELECT {sel}, source FROM u")


@query("union_sources", union_sql())
def union_sources(spark, d):
    """Core scenario rows + both adapters as one training set; columns a
    source lacks become 0; ``source`` marks the origin (not a feature)."""
    from pitwise.plans.q_lookback import t1
    from pitwise.plans.q_shops import retail, shops
    a = t1(spark, d).withColumn("source", F.lit("core"))
    sizes = V.shop_sizes(spark, d)
    b = S.shop_training_rows(shops(spark, d, sizes=sizes), sizes=sizes).withColumn("source", F.lit("shopify"))
    c = S.txn_training_rows(retail(spark, d, sizes=sizes), sizes=sizes).withColumn("source", F.lit("kaggle"))
    u = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    feats = [x for x in union_columns() if x not in _TEXT]
    return u.na.fill(0, subset=feats).select(*union_columns(), "source")
