"""Input views derived from the driver's tables (FIXTURES.md section 3).

The driver ships TPC-H-like tables plus an ``events`` stream; these views
re-shape them into the inputs the engine works on:

* ``commits`` / ``branches`` / ``outcomes``  from ``events``
  (non-signup rows are commits, signup rows are scenarios);
* ``shop_orders`` / ``retail_txn`` / ``fashion_sales`` / ``unit_prices``
  from ``lineitem`` (+ ``part`` for the product type).

Every view is a lazy DataFrame over the whole table; nothing is sampled.
The same definitions exist as SQL for the DuckDB oracle
(:mod:`pitwise.plans.oracle`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitwise.functions import exactsum
from pitwise.functions.encode import ALL_BRANCH_TYPES
from pitwise.functions.timecols import micros
from pitwise.operators.scan import KeySizes, key_sizes, segmented_scan


# Tie key of lineitem rows within one supplier and ship date; unique at all
# scale factors ((l_orderkey, l_linenumber) alone is not).
LINEITEM_TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def ev(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))


def _category(user_id: Column) -> Column:
    m = F.pmod(user_id, F.lit(3))
    return F.when(m == 0, "retail").when(m == 1, "apparel").otherwise("b2b")


def commits(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d).filter(F.col("event_type") != "signup")
    k, v, et = F.col("k"), F.col("value"), F.col("event_type")
    kind = (F.when(et == "purchase", "ORDER_RECEIVED")
             .when(et == "view", "ORDER_FULFILLED")
             .when(et == "error", F.when(k % 2 == 0, "ORDER_CANCELLED").otherwise("FULFILLMENT_BLOCKED"))
             .when(et == "click", F.when(k % 4 == 0, "INVENTORY_RESTOCK")
                   .when(k % 4 == 1, "SUPPLIER_PO_CREATED")
                   .when(k % 4 == 2, "PRICE_CHANGE")
                   .otherwise("LEDGER_ENTRY")))
    q = _s(1 + k % 10)
    body = (F.when(kind == "ORDER_RECEIVED",
                   F.concat(F.lit('{"quantity": '), q, F.lit(', "revenue": '), _s(v), F.lit("}")))
             .when(kind == "ORDER_FULFILLED",
                   F.concat(F.lit('{"inventory_after": '), _s(k - 5), F.lit("}")))
             .when(kind == "ORDER_CANCELLED",
                   F.concat(F.lit('{"quantity": '), q, F.lit(', "revenue_reversed": '), _s(v), F.lit("}")))
             .when(kind == "FULFILLMENT_BLOCKED", F.lit("{}"))
             .when(kind == "INVENTORY_RESTOCK",
                   F.concat(F.lit('{"quantity_added": '), _s(k), F.lit(', "cost": '), _s(v), F.lit("}")))
             .when(kind == "SUPPLIER_PO_CREATED",
                   F.concat(F.lit('{"quantity": '), _s(k), F.lit(', "cost": '), _s(v), F.lit("}")))
             .when(kind == "PRICE_CHANGE",
                   F.concat(F.lit('{"pct_change": '), _s(k / 4 - 12), F.lit("}")))
             .otherwise(F.concat(F.lit('{"cash_balance": '), _s(v * 100),
                                 F.lit(', "inventory_units": '), _s(k), F.lit("}"))))
    eid = F.col("event_id")
    payload = (F.when(eid % 97 == 0, F.lit(""))
                .when(eid % 101 == 0, F.lit("{bad"))
                .otherwise(body))
    return e.select(
        _s(eid).alias("commit_id"),
        eid.alias("seq"),
        F.col("ts").alias("timestamp"),
        _s(F.col("user_id")).alias("business_id"),
        _category(F.col("user_id")).alias("business_category"),
        kind.alias("event_type"),
        F.lit(None).cast("string").alias("branch_id"),
        payload.alias("payload"),
    )


def _signups(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).filter(F.col("event_type") == "signup")


def branches(spark: SparkSession, d: str) -> DataFrame:
    e = _signups(spark, d)
    k = F.col("k")
    k10 = k % 10
    bt = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(ALL_BRANCH_TYPES))):
        bt = F.when(k10 == i, F.lit(name)).otherwise(bt)
    terms_i = F.expr("(k div 10) % 4")
    terms = (F.when(terms_i == 0, "NET15").when(terms_i == 1, "NET45")
              .when(terms_i == 2, "NET60").otherwise("NET99"))
    params = (F.when(k10 == 0, F.concat(F.lit('{"pct_change": '), _s(5 + k % 20), F.lit("}")))
               .when(k10 == 1, F.concat(F.lit('{"pct_change": '), _s(-5 - k % 15), F.lit("}")))
               .when(k10 == 2, F.concat(F.lit('{"quantity": '), _s(100 + k * 4),
                                        F.lit(', "cost_per_unit": '), _s(10 + k % 70), F.lit("}")))
               .when(k10 == 3, F.concat(F.lit('{"discount_pct": '), _s(10 + k % 20), F.lit("}")))
               .when(k10 == 4, F.concat(F.lit('{"new_skus": '), _s(5 + k % 25), F.lit("}")))
               .when(k10 == 5, F.concat(F.lit('{"markdown_pct": '), _s(20 + k % 30), F.lit("}")))
               .when(k10 == 6, F.concat(F.lit('{"contract_value": '), _s(5000 + k * 950), F.lit("}")))
               .when(k10 == 7, F.concat(F.lit('{"new_terms": "'), terms, F.lit('"}')))
               .when(k10 == 8, F.concat(F.lit('{"discount_pct": '), _s(5 + k % 10), F.lit("}")))
               .otherwise(F.concat(F.lit('{"cost_change_pct": '), _s(k % 25 - 15), F.lit("}"))))
    eid = F.col("event_id")
    return e.select(
        _s(eid).alias("branch_id"),
        eid.alias("seq"),
        _s(F.col("user_id")).alias("business_id"),
        _category(F.col("user_id")).alias("category"),
        bt.alias("branch_type"),
        params.alias("branch_params"),
        F.col("ts").alias("committed_at"),
        F.when(eid % 10 < 7, "committed").otherwise("discarded").alias("status"),
        k.alias("k"),
        F.col("value").alias("value"),
    )


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = _signups(spark, d).filter(F.col("event_id") % 13 != 0)
    k, eid = F.col("k"), F.col("event_id")
    return e.select(
        _s(eid).alias("outcome_id"),
        eid.alias("seq"),
        _s(eid).alias("branch_id"),
        _s(F.col("user_id")).alias("business_id"),
        _category(F.col("user_id")).alias("category"),
        (F.col("ts") + F.expr("INTERVAL 14 DAYS")).alias("recorded_at"),
        F.lit(14).alias("horizon_days"),
        (k - 50).cast("double").alias("inventory_delta"),
        (F.col("value") * 10 - 500).alias("cashflow_delta"),
        F.when(k % 9 == 0, F.lit(0.0)).otherwise(k / 4 - 10).alias("order_velocity_delta"),
    )


def product_type_of(p_type: Column) -> Column:
    return (F.when(p_type == "ECONOMY", "Home Services")
             .when(p_type == "PROMO", "Fashion Wear")
             .when(p_type == "SMALL", " Wholesale ")
             .when(p_type == "LARGE", "Software Consulting")
             .when(p_type == "MEDIUM", "Electronics")
             .otherwise("Misc"))


def _lineitem_typed(spark: SparkSession, d: str) -> DataFrame:
    li = _read(spark, d, "lineitem")
    part = _read(spark, d, "part").select("p_partkey", "p_type")
    return li.join(part, li.l_partkey == part.p_partkey, "left")


def shop_sizes(spark: SparkSession, d: str) -> KeySizes:
    """Rows of each shop, counted on the key column of the line items alone."""
    return key_sizes(_read(spark, d, "lineitem").select(_s(F.col("l_suppkey")).alias("shop_id")), "shop_id")


def shop_orders(spark: SparkSession, d: str, sizes: KeySizes | None = None) -> DataFrame:
    """Order export view; ``tie`` orders rows of one shop at one timestamp;
    ``cash_balance`` is the running total of ``total_price`` per shop."""
    li = _lineitem_typed(spark, d)
    base = li.select(
        _s(F.col("l_suppkey")).alias("shop_id"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_extendedprice").alias("total_price"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("cancelled_at"),
        product_type_of(F.col("p_type")).alias("product_type"),
        F.col("l_quantity").cast("int").alias("inventory_qty"),
        F.struct(*[F.col(c) for c in LINEITEM_TIE]).alias("tie"),
        micros(F.col("l_shipdate")).alias("_t"),
    )
    run = segmented_scan(base, "shop_id", "_t", ["tie"], sums=exactsum.names("_amt"), inclusive=True,
                         prefix="cum", sizes=sizes or shop_sizes(spark, d),
                         derive=lambda rows: exactsum.split(rows.withColumn("_amt", F.col("total_price")), "_amt"))
    return run.select("shop_id", "created_at", "total_price", "cancelled_at", "product_type",
                      "inventory_qty", exactsum.total("cum_amt").alias("cash_balance"),
                      "tie")


def lineitem_types(spark, d) -> DataFrame:
    """Line keys and product types (no running balances)."""
    return _lineitem_typed(spark, d).select(*LINEITEM_TIE[:3], product_type_of(F.col("p_type")).alias("product_type"))


def _file_seq() -> Column:
    # "File order" of the transaction exports: lineitem's natural order.
    return F.struct(*[F.col(c) for c in LINEITEM_TIE], F.col("l_shipdate"))


def retail_txn(spark: SparkSession, d: str) -> DataFrame:
    li = _lineitem_typed(spark, d)
    return li.select(
        F.concat_ws("-", _s(F.col("l_orderkey")), _s(F.col("l_linenumber"))).alias("transaction_id"),
        _s(F.col("l_partkey")).alias("customer_id"),
        _s(F.col("l_suppkey")).alias("store_id"),
        F.col("l_shipdate").alias("date"),
        F.col("l_quantity").alias("quantity"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
        product_type_of(F.col("p_type")).alias("product_category"),
        F.col("l_extendedprice").alias("total_amount"),
        F.col("l_linestatus").alias("payment_method"),
        _file_seq().alias("row_seq"),
    )


def fashion_sales(spark: SparkSession, d: str) -> DataFrame:
    li = _lineitem_typed(spark, d)
    return li.select(
        _s(F.col("l_orderkey")).alias("Order_ID"),
        _s(F.col("l_suppkey")).alias("Customer_ID"),
        F.col("l_shipdate").alias("Date"),
        product_type_of(F.col("p_type")).alias("Product_Type"),
        F.col("l_quantity").alias("Quantity"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("Price"),
        F.col("l_extendedprice").alias("Total_Sales"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("Returns"),
        _file_seq().alias("row_seq"),
    )


def unit_prices(spark: SparkSession, d: str) -> DataFrame:
    li = _read(spark, d, "lineitem")
    return li.select(
        _s(F.col("l_suppkey")).alias("shop_id"),
        F.col("l_shipdate").alias("created_at"),
        F.struct(*[F.col(c) for c in LINEITEM_TIE]).alias("tie"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
    )
