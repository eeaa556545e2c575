"""Categorical encoders (X6, X7, X9, X10) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Business categories and scenario (branch) types.
CATEGORIES = ["retail", "apparel", "b2b"]
ALL_BRANCH_TYPES = [
    "price_increase", "price_decrease", "bulk_restock", "promo_event",
    "new_collection", "markdown", "contract_change", "net_terms_change",
    "volume_discount", "supplier_change",
]
CAT_COLS = [f"cat_{c}" for c in CATEGORIES]
BT_COLS = [f"bt_{b}" for b in ALL_BRANCH_TYPES]

# Product-type substring -> category for order exports. Order
# matters: the first pattern contained in the lower-cased, stripped text wins
# ("home services" -> retail); no hit -> retail.
SHOP_CATEGORY_PATTERNS = [
    ("apparel", "apparel"),
    ("clothing", "apparel"),
    ("fashion", "apparel"),
    ("accessories", "apparel"),
    ("electronics", "retail"),
    ("home", "retail"),
    ("food", "retail"),
    ("beauty", "retail"),
    ("sports", "retail"),
    ("services", "b2b"),
    ("b2b", "b2b"),
    ("wholesale", "b2b"),
    ("consulting", "b2b"),
]

# Keyword lists for transaction exports (lower-cased, not
# stripped); apparel is tested first, then b2b, else retail.
TXN_APPAREL_KEYWORDS = ["apparel", "fashion", "clothing", "wear", "dress", "shoe"]
TXN_B2B_KEYWORDS = ["service", "consult", "b2b", "wholesale", "software"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def onehot_category(category) -> dict[str, Column]:
    """Three 0/1 ints."""
    cat = _c(category)
    return {f"cat_{c}": F.coalesce((cat == F.lit(c)).cast("int"), F.lit(0)) for c in CATEGORIES}


def onehot_branch_type(branch_type) -> dict[str, Column]:
    """Ten 0/1 ints; unknown type -> all 0."""
    bt = _c(branch_type)
    return {f"bt_{b}": F.coalesce((bt == F.lit(b)).cast("int"), F.lit(0)) for b in ALL_BRANCH_TYPES}


def map_category(product_type) -> Column:
    """Ordered substring match on lower(trim(text)); first hit wins."""
    return category_of_shop_key(shop_key(product_type))


def shop_key(product_type) -> Column:
    return F.lower(F.trim(_c(product_type)))


def category_of_shop_key(key) -> Column:
    """:func:`map_category` of a text that is lower-cased and stripped already."""
    key = _c(key)
    expr = None
    for pattern, cat in SHOP_CATEGORY_PATTERNS:
        cond = key.contains(pattern)
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return expr.otherwise(F.lit("retail"))


def infer_category(product_type) -> Column:
    """Keyword lists, apparel first, then b2b, else retail (no strip)."""
    return category_of_txn_key(txn_key(product_type))


def txn_key(product_type) -> Column:
    return F.lower(_c(product_type))


def category_of_txn_key(key) -> Column:
    """:func:`infer_category` of a text that is lower-cased already."""
    pt = _c(key)
    apparel = None
    for k in TXN_APPAREL_KEYWORDS:
        c = pt.contains(k)
        apparel = c if apparel is None else (apparel | c)
    b2b = None
    for k in TXN_B2B_KEYWORDS:
        c = pt.contains(k)
        b2b = c if b2b is None else (b2b | c)
    return (F.when(F.coalesce(apparel, F.lit(False)), F.lit("apparel"))
             .when(F.coalesce(b2b, F.lit(False)), F.lit("b2b"))
             .otherwise(F.lit("retail")))
