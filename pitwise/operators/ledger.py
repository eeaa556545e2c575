"""Ledger reconciliation from the event log (L1-L4).

Balances are running sums in (timestamp, seq) order per business computed
with the skew-safe :func:`segmented_scan`; amounts are summed exactly (``functions/exactsum.py``), so
results do not depend on the order partial sums are combined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pitwise.functions import exactsum
from pitwise.functions.payload import field, parse_payload
from pitwise.functions.timecols import DAY_US, floor_div, micros
from pitwise.operators.lookback import with_seq
from pitwise.operators.scan import segmented_scan


def ledger_deltas(commits: DataFrame) -> DataFrame:
    """Signed cash and unit deltas per commit.

    cash: +revenue on ORDER_RECEIVED, -revenue_reversed on ORDER_CANCELLED,
    -cost on SUPPLIER_PO_CREATED. units: -quantity on ORDER_RECEIVED,
    +quantity on ORDER_CANCELLED, +quantity_added on INVENTORY_RESTOCK
    (applied at receipt). Missing fields count 0."""
    et = F.col("event_type")
    c = with_seq(commits).select("commit_id", "business_id", "seq", "timestamp", et,
                       micros(F.col("timestamp")).alias("t"), parse_payload("payload").alias("_p"))
    p = F.col("_p")
    cash = (F.when(et == "ORDER_RECEIVED", field(p, "revenue", 0.0))
             .when(et == "ORDER_CANCELLED", -field(p, "revenue_reversed", 0.0))
             .when(et == "SUPPLIER_PO_CREATED", -field(p, "cost", 0.0))
             .otherwise(F.lit(0.0)))
    units = (F.when(et == "ORDER_RECEIVED", -field(p, "quantity", 0.0))
              .when(et == "ORDER_CANCELLED", field(p, "quantity", 0.0))
              .when(et == "INVENTORY_RESTOCK", field(p, "quantity_added", 0.0))
              .otherwise(F.lit(0.0)))
    deltas = c.select("commit_id", "business_id", "seq", "timestamp", "t", cash.alias("d_cash"), units.alias("d_units"))
    return exactsum.split(deltas, "d_cash", "d_units")


def running_balances(commits: DataFrame, opening_cash: float = 0.0,
                     opening_units: float = 0.0) -> DataFrame:
    """L1 + L2: cash and unit balance after each commit."""
    d = ledger_deltas(commits)
    r = segmented_scan(d, "business_id", "t", ["seq"], sums=exactsum.names("d_cash") + exactsum.names("d_units"),
                       inclusive=True, prefix="bal_")
    return r.select("commit_id", "business_id", "seq", "timestamp", "t",
                    (exactsum.total("bal_d_cash") + F.lit(float(opening_cash))).alias("cash_balance"),
                    (exactsum.total("bal_d_units") + F.lit(float(opening_units))).alias("inventory_units"))


def weekly_snapshot(commits: DataFrame) -> DataFrame:
    """L3: balance at the end of each 7-day period from the business's first day to its last commit (max_by on (t, seq)
    is a partial aggregate); a period without a commit repeats the balances before it, with ``n_commits`` 0."""
    b = running_balances(commits)
    first = commits.groupBy("business_id").agg(F.min(micros(F.col("timestamp"))).alias("_t0"))
    day = floor_div(F.col("t"), DAY_US)
    day0 = floor_div(F.col("_t0"), DAY_US)
    w = b.join(first, "business_id").withColumn("week", floor_div(day - day0, 7))
    key = F.struct("t", "seq")
    ends = w.groupBy("business_id", "week").agg(
        F.max_by("cash_balance", key).alias("cash_balance"),
        F.max_by("inventory_units", key).alias("inventory_units"),
        F.count(F.lit(1)).alias("n_commits"))
    # one row per business and week with commits: as many weeks as there are up to the next such row
    following = F.lead("week").over(Window.partitionBy("business_id").orderBy("week"))
    weeks = ends.select("*", F.col("week").alias("_at"), F.coalesce(following - 1, F.col("week")).alias("_to")).withColumn(
        "week", F.explode(F.sequence("_at", "_to")))
    return weeks.select("business_id", "week", "cash_balance", "inventory_units",
                        F.when(F.col("week") == F.col("_at"), F.col("n_commits")).otherwise(F.lit(0)).alias("n_commits"))


def price_pct_change(prices: DataFrame) -> DataFrame:
    """L4: (price - previous price) / previous price * 100 per shop, in
    (created_at, tie) order; NULL for the first row or a zero/NULL previous."""
    d = prices.select("shop_id", "created_at", "tie", "price", micros(F.col("created_at")).alias("t"))
    d = d.withColumn("_pt", F.struct(F.col("t").alias("t"), F.col("tie").alias("o"),
                                     F.col("price").alias("v")))
    r = segmented_scan(d, "shop_id", "t", ["tie"], lasts=["_pt"], inclusive=False, prefix="prev")
    prev = F.col("prev_pt.v")
    pct = F.try_divide(F.col("price") - prev, F.when(prev != 0, prev)) * F.lit(100.0)
    return r.select("shop_id", "created_at", "tie", "price", pct.alias("pct_change"))
