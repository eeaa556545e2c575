"""Queries for scalar functions and encoders.

Every function runs as a column expression over a whole table (no UDFs).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from pitwise.functions import encode as E
from pitwise.functions import season as SE
from pitwise.functions.payload import field, json_valid, parse_payload
from pitwise.functions.scenario import parse_params, scenario_magnitudes, terms_delta
from pitwise.functions.timecols import coerce_num, coerce_ts, iso_text, micros, parse_ts, utc_normalize
from pitwise.operators.lookback import history_columns
from pitwise.plans.oracle_lookback import lookback_ctes, scenario_sql, season_sql
from pitwise.plans.oracle_shops import infer_category_sql, map_category_sql, season_shop_sql
from pitwise.plans.oracle_views import with_views
from pitwise.plans.registry import query
from pitwise.sources import views as V


# -- P: parsing and coercion -------------------------------------------------

@query("parse_ts", with_views(["commits"], 'SELECT commit_id, "timestamp" AS parsed_ts FROM commits'))
def parse_ts_q(spark, d):
    """ISO-8601 text (as a CSV export holds it) -> naive timestamp."""
    c = V.commits(spark, d)
    return c.select("commit_id", parse_ts(iso_text(F.col("timestamp"))).alias("parsed_ts"))


@query("utc_normalize", with_views(["lineitem"], """
SELECT CAST(l_suppkey AS VARCHAR) AS shop_id, l_orderkey, l_linenumber, l_partkey,
       l_shipdate - to_hours(l_linenumber) AS created_utc FROM lineitem"""))
def utc_normalize_q(spark, d):
    """created_at text with a +HH:00 offset -> naive UTC."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    text = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0"),
                    F.col("l_linenumber").cast("string"), F.lit(":00"))
    return li.select(F.col("l_suppkey").cast("string").alias("shop_id"), "l_orderkey", "l_linenumber",
                     "l_partkey", utc_normalize(text).alias("created_utc"))


@query("coerce_ts", with_views(["lineitem"], """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS cancelled_at
FROM lineitem"""))
def coerce_ts_q(spark, d):
    """Lenient timestamp parse; junk text -> NULL."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    text = F.when(F.col("l_returnflag") == "R", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.lit("not cancelled"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", coerce_ts(text).alias("cancelled_at"))


@query("coerce_num", with_views(["lineitem"], """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_linenumber = 3 OR l_linenumber = 5 THEN 0.0 ELSE l_extendedprice END AS amount
FROM lineitem"""))
def coerce_num_q(spark, d):
    """to_numeric(errors='coerce').fillna(0): junk and NULL -> 0."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    text = (F.when(F.col("l_linenumber") == 3, F.lit("n/a"))
             .when(F.col("l_linenumber") == 5, F.lit(None).cast("string"))
             .otherwise(F.col("l_extendedprice").cast("string")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", coerce_num(text).alias("amount"))


@query("json_payload", with_views(["commits"],
                                  "SELECT commit_id, coalesce(json_valid(payload), false) AS payload_valid FROM commits"))
def json_payload(spark, d):
    """P5: lenient JSON parse -- is the payload JSON at all?"""
    return V.commits(spark, d).select("commit_id", json_valid("payload").alias("payload_valid"))


_P6 = {"revenue": 0.0, "inventory_after": -1.0, "pct_change": 0.0, "cash_balance": 0.0,
       "inventory_units": 0.0, "quantity_added": 0.0}


@query("json_fields", with_views(["pc", "commits"], "SELECT c.commit_id, " + ", ".join(
    f"coalesce(p.f_{k}, {v}) AS {k}" for k, v in _P6.items())
    + " FROM pc p JOIN commits c ON c.seq = p.seq"))
def json_fields(spark, d):
    """Typed payload fields with the rule defaults (invalid JSON -> defaults)."""
    c = V.commits(spark, d).withColumn("_p", parse_payload("payload"))
    return c.select("commit_id", *[field("_p", k, v).alias(k) for k, v in _P6.items()])


# -- X: encoders over scenarios ---------------------------------------------

def _br(spark, d) -> DataFrame:
    return V.branches(spark, d)


@query("cyclic_encode", with_views(["branches"], "SELECT branch_id, "
                                   "sin(2 * pi() * month(committed_at) / 12.0) AS month_sin, "
                                   "cos(2 * pi() * month(committed_at) / 12.0) AS month_cos FROM branches"))
def cyclic_encode_q(spark, d):
    """sine/cosine of 2*pi*month/12."""
    s, c = SE.cyclic_encode(F.month("committed_at"), 12)
    return _br(spark, d).select("branch_id", s.alias("month_sin"), c.alias("month_cos"))


@query("season_core", with_views(["branches"], "SELECT branch_id, " + ", ".join(
    f"{v} AS {k}" for k, v in season_sql("committed_at", "category").items()) + " FROM branches"))
def season_core_q(spark, d):
    """The 12 seasonality columns of each scenario."""
    cols = SE.season_core("committed_at", "category", rounded=False)
    return _br(spark, d).select("branch_id", *[v.alias(k) for k, v in cols.items()])


@query("days_to_peak", with_views(["branches"], "SELECT branch_id, category, " +
                                  season_sql("committed_at", "category")["days_to_peak"] +
                                  " AS days_to_peak FROM branches"))
def days_to_peak_q(spark, d):
    """Cyclic distance to the category's nearest peak month, x30."""
    return _br(spark, d).select("branch_id", "category",
                                SE.days_to_peak("committed_at", "category").cast("int").alias("days_to_peak"))


@query("peaks_lookup", with_views(["branches"], "SELECT branch_id, month(committed_at) AS month, " +
                                  season_sql("committed_at", "category")["is_peak_month"] +
                                  " AS is_peak_month FROM branches"))
def peaks_lookup(spark, d):
    """Category -> peak months literal lookup (no shuffle)."""
    return _br(spark, d).select("branch_id", F.month("committed_at").alias("month"),
                                SE.is_peak_month("committed_at", "category").alias("is_peak_month"))


@query("season_shop", with_views(["lineitem"], "SELECT CAST(l_suppkey AS VARCHAR) AS shop_id, l_orderkey, "
                                 "l_linenumber, l_partkey, " + ", ".join(
                                     f"{v} AS {k}" for k, v in season_shop_sql("l_shipdate").items())
                                 + " FROM lineitem"))
def season_shop_q(spark, d):
    """Order-export seasonality for every order row."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    cols = SE.season_shop(F.col("l_shipdate"))
    return li.select(F.col("l_suppkey").cast("string").alias("shop_id"), "l_orderkey", "l_linenumber",
                     "l_partkey", *[v.alias(k) for k, v in cols.items()])


@query("decay_weight", with_views(["commits"], """
SELECT commit_id,
       exp(-ln(2) * ((epoch_us(max("timestamp") OVER (PARTITION BY business_id)) - epoch_us("timestamp"))
                     / 86400000000.0) / 30) AS weight
FROM commits"""))
def decay_weight(spark, d):
    """exp(-ln2 * age_days / 30), age measured from the business's latest commit."""
    c = V.commits(spark, d).select("commit_id", "business_id", micros("timestamp").alias("t"))
    last = c.groupBy("business_id").agg(F.max("t").alias("t_last"))
    age_days = (F.col("t_last") - F.col("t")).cast("double") / F.lit(86_400_000_000.0)
    return c.join(last, "business_id").select(
        "commit_id", F.exp(F.lit(-math.log(2)) * age_days / F.lit(30.0)).alias("weight"))


@query("onehot_category", with_views(["branches"], "SELECT branch_id, " + ", ".join(
    f"CAST(category = '{c}' AS INTEGER) AS cat_{c}" for c in E.CATEGORIES) + " FROM branches"))
def onehot_category_q(spark, d):
    """Category one-hot."""
    return _br(spark, d).select("branch_id", *[v.alias(k) for k, v in E.onehot_category("category").items()])


@query("onehot_branch_type", with_views(["branches"], "SELECT branch_id, " + ", ".join(
    f"CAST(branch_type = '{b}' AS INTEGER) AS bt_{b}" for b in E.ALL_BRANCH_TYPES) + " FROM branches"))
def onehot_branch_type_q(spark, d):
    """Branch-type one-hot (unknown -> all 0)."""
    return _br(spark, d).select("branch_id", *[v.alias(k) for k, v in E.onehot_branch_type("branch_type").items()])


@query("round_out", "SELECT event_id, round(value / 7, 4) AS v4, round(value * 100 / 3, 2) AS v2 FROM events")
def round_out(spark, d):
    """round(x, k) on every event value (job default rounding)."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.round(F.col("value") / 7, 4).alias("v4"),
                    F.round(F.col("value") * 100 / 3, 2).alias("v2"))


@query("map_category", with_views(["li_typed"], "SELECT l_orderkey, l_linenumber, l_partkey, product_type, "
                                  + map_category_sql("product_type") + " AS category FROM li_typed"))
def map_category_q(spark, d):
    """Ordered substring match of product types (first hit wins)."""
    li = V.lineitem_types(spark, d)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "product_type", E.map_category("product_type").alias("category"))


@query("infer_category", with_views(["li_typed"], "SELECT l_orderkey, l_linenumber, l_partkey, product_type, "
                                    + infer_category_sql("product_type") + " AS category FROM li_typed"))
def infer_category_q(spark, d):
    """Keyword-list category of transaction product types."""
    li = V.lineitem_types(spark, d)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "product_type", E.infer_category("product_type").alias("category"))


# -- X11-X18: scenario magnitudes (need history aggregates) -----------------

def _mags(spark, d) -> DataFrame:
    from pitwise.plans.q_lookback import _all_raw
    raw = _all_raw(spark, d)
    b = _br(spark, d).select("branch_id", "branch_type", "branch_params")
    x = b.join(raw, "branch_id")
    h = history_columns(x)
    m = scenario_magnitudes("branch_type", parse_params("branch_params"), h["hist_avg_price_change"],
                            h["avg_restock"])
    return x.select("branch_id", "branch_type", *[v.alias(k) for k, v in m.items()])


def _mag_sql(types: list[str], cols: list[str]) -> str:
    sc = scenario_sql()
    sel = ", ".join(f"{sc[c]} AS {c}" for c in cols)
    tl = ", ".join(f"'{t}'" for t in types)
    return with_views(["pc", "branches"],
                      f"SELECT s.branch_id, {sel} FROM branches s JOIN histc h ON h.branch_id = s.branch_id "
                      f"WHERE s.branch_type IN ({tl})", lookback_ctes("branches"))


_MAG_QUERIES = {
    "mag_price": (["price_increase", "price_decrease"], ["mag_price_change_pct", "deviation_from_norm"]),
    "mag_restock": (["bulk_restock"], ["mag_restock_qty_norm", "mag_restock_cost_norm"]),
    "dev_restock": (["bulk_restock"], ["deviation_from_norm"]),
    "mag_discount": (["promo_event", "markdown", "volume_discount"], ["mag_discount_pct", "deviation_from_norm"]),
    "mag_contract": (["contract_change"], ["mag_contract_norm", "deviation_from_norm"]),
    "mag_new_skus": (["new_collection"], ["mag_new_skus", "deviation_from_norm"]),
    "mag_supplier": (["supplier_change"], ["mag_supplier_cost_pct", "deviation_from_norm"]),
    "mag_terms": (["net_terms_change"], ["mag_terms_delta_days", "deviation_from_norm"]),
}


def _register_mag(key, types, cols):
    def _q(spark, d):
        return _mags(spark, d).filter(F.col("branch_type").isin(*types)).select("branch_id", *cols)
    _q.__doc__ = f"{key}: scenario magnitude columns {cols} for {types}."
    query(key, _mag_sql(types, cols))(_q)


for _k, (_t, _c) in _MAG_QUERIES.items():
    _register_mag(_k, _t, _c)


@query("terms_lookup", with_views(["branches"], """
SELECT branch_id, json_extract_string(branch_params, '$.new_terms') AS new_terms,
       CASE coalesce(json_extract_string(branch_params, '$.new_terms'), 'NET30')
            WHEN 'NET15' THEN -15.0 WHEN 'NET30' THEN 0.0 WHEN 'NET45' THEN 15.0 WHEN 'NET60' THEN 30.0
            ELSE 0.0 END AS terms_delta
FROM branches WHERE branch_type = 'net_terms_change'"""))
def terms_lookup(spark, d):
    """Payment-terms map literal with default 0 (no join, no shuffle)."""
    b = _br(spark, d).filter(F.col("branch_type") == "net_terms_change")
    nt = parse_params("branch_params").getField("new_terms")
    return b.select("branch_id", nt.alias("new_terms"),
                    terms_delta(F.coalesce(nt, F.lit("NET30"))).alias("terms_delta"))
