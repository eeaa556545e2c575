"""Scenario magnitude features (X11-X18) as column expressions.

Inputs are the parsed ``branch_params`` struct, the branch type and two
history aggregates (mean past price change, mean past restock quantity).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pitwise.functions.payload import PARAM_SCHEMA, field, parse_payload

# Payment-terms deltas in days (unknown -> 0), baseline NET30.
TERMS_DAYS = {"NET15": -15, "NET30": 0, "NET45": 15, "NET60": 30}
TERMS_BASELINE = "NET30"
# Normalisers.
RESTOCK_QTY_NORM = 500.0
RESTOCK_COST_NORM = 40_000.0
CONTRACT_NORM = 100_000.0

MAG_COLS = [
    "mag_price_change_pct", "mag_restock_qty_norm", "mag_restock_cost_norm",
    "mag_discount_pct", "mag_contract_norm", "mag_new_skus",
    "mag_terms_delta_days", "mag_supplier_cost_pct", "deviation_from_norm",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_params(params) -> Column:
    return parse_payload(params, PARAM_SCHEMA)


def terms_delta(new_terms) -> Column:
    """Map literal lookup with default 0, relative to NET30."""
    m = F.create_map(*[x for k, v in TERMS_DAYS.items() for x in (F.lit(k), F.lit(v))])
    base = TERMS_DAYS[TERMS_BASELINE]
    return (F.coalesce(m[_c(new_terms)], F.lit(0)) - F.lit(base)).cast("double")


def scenario_magnitudes(branch_type, params, hist_avg_price_change,
                        avg_restock_or_null) -> dict[str, Column]:
    """Type-specific magnitudes and the signed deviation.

    ``params`` is the parsed branch_params struct; ``avg_restock_or_null`` is
    the mean prior restock quantity (NULL when there is none, in which case
    the scenario's own quantity is the baseline -> deviation 0).
    """
    bt = _c(branch_type)
    p = _c(params)

    def num(name):
        return field(p, name, 0.0)

    zero = F.lit(0.0)
    pct = num("pct_change")
    qty = num("quantity")
    cpu = num("cost_per_unit")
    disc = num("discount_pct")
    mdown = num("markdown_pct")
    contract = num("contract_value") / F.lit(CONTRACT_NORM)
    skus = num("new_skus")
    supp = num("cost_change_pct")
    # A missing new_terms key means NET30 (delta 0); unknown text -> 0 as well.
    tdelta = terms_delta(F.coalesce(p.getField("new_terms"), F.lit(TERMS_BASELINE)))
    avg_rs = F.coalesce(_c(avg_restock_or_null), qty)

    is_price = bt.isin("price_increase", "price_decrease")
    is_restock = bt == "bulk_restock"
    is_disc = bt.isin("promo_event", "volume_discount")
    is_mdown = bt == "markdown"
    is_contract = bt == "contract_change"
    is_skus = bt == "new_collection"
    is_supp = bt == "supplier_change"
    is_terms = bt == "net_terms_change"

    def w(cond, val):
        return F.when(F.coalesce(cond, F.lit(False)), val).otherwise(zero)

    deviation = (F.when(is_price, pct - _c(hist_avg_price_change))
                 .when(is_restock, (qty - avg_rs) / F.greatest(avg_rs, F.lit(1.0)))
                 .when(is_disc, disc)
                 .when(is_mdown, mdown)
                 .when(is_contract, contract)
                 .when(is_skus, skus)
                 .when(is_supp, supp)
                 .when(is_terms, tdelta)
                 .otherwise(zero))
    return {
        "mag_price_change_pct": w(is_price, F.abs(pct)),
        "mag_restock_qty_norm": w(is_restock, qty / F.lit(RESTOCK_QTY_NORM)),
        "mag_restock_cost_norm": w(is_restock, (qty * cpu) / F.lit(RESTOCK_COST_NORM)),
        "mag_discount_pct": (F.when(F.coalesce(is_disc, F.lit(False)), disc)
                             .when(F.coalesce(is_mdown, F.lit(False)), mdown)
                             .otherwise(zero)),
        "mag_contract_norm": w(is_contract, contract),
        "mag_new_skus": w(is_skus, skus),
        "mag_terms_delta_days": w(is_terms, F.abs(tdelta)),
        "mag_supplier_cost_pct": w(is_supp, F.abs(supp)),
        "deviation_from_norm": F.coalesce(deviation, zero),
    }
