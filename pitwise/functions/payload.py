"""JSON payload parsing.

A payload is parsed once per row with ``from_json`` into one nullable struct
holding every field any event type uses. Rolling and history rules share one
validity rule: the whole text is JSON, as strict as the reference's parser (names
may repeat, the last one counts; NaN and Infinity are numbers; nothing may follow
the value). Spark's parser stops after the first value, so the text is parsed as
the first element of an array whose second element holds the text's md5: only if
the first element ends where the text ends is the second one found there.

NULL and '' payloads both mean "no payload"; a JSON text that is no object has no
fields either (the reference fails on it).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Payload field names per event type, as written by the event
# producer (ORDER_RECEIVED, ORDER_FULFILLED, ORDER_CANCELLED,
# FULFILLMENT_BLOCKED, SUPPLIER_PO_CREATED, INVENTORY_RESTOCK, PRICE_CHANGE,
# LEDGER_ENTRY).
PAYLOAD_FIELDS = [
    "quantity", "revenue", "price_per_unit", "inventory_after",
    "revenue_reversed", "quantity_requested", "inventory_available", "cost",
    "quantity_added", "old_price", "new_price", "pct_change", "cash_balance",
    "inventory_units",
]

# Fields are read as text and cast where used, so that quoted numbers count and
# anything that is no number takes the rule's default.
PAYLOAD_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in PAYLOAD_FIELDS])

# Scenario parameter fields (branch_params); new_terms is text.
PARAM_FIELDS = [
    "pct_change", "direction", "quantity", "cost_per_unit", "discount_pct",
    "duration_days", "new_skus", "avg_price", "markdown_pct", "skus_affected",
    "contract_value", "duration_months", "old_terms", "new_terms",
    "min_order_qty", "new_lead_time_days", "cost_change_pct",
]
PARAM_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in PARAM_FIELDS])


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_MARK = "_md5_of_text"
_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}


def _marked(p: Column) -> Column:
    return F.concat(F.lit("["), p, F.lit(f',{{"{_MARK}":"'), F.md5(p.cast("binary")), F.lit('"}]'))


def _odd_numbers(p: Column) -> Column:
    """Spark's spellings of infinity that are not JSON's usual ones (INF, +Infinity), outside strings."""
    return (p.contains("INF") | p.contains("+I")) & F.regexp_replace(
        p, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "").rlike(r"INF|\+I")


def parse_payload(payload, schema: T.StructType = PAYLOAD_SCHEMA) -> Column:
    """The fields of a valid JSON object; NULL for anything else."""
    p = _c(payload)
    both = T.ArrayType(T.StructType([*schema.fields, T.StructField(_MARK, T.StringType())]))
    two = F.from_json(_marked(p), both, _STRICT)
    whole = (F.size(two) == 2) & (F.get(two, F.lit(1)).getField(_MARK) == F.md5(p.cast("binary"))) & ~_odd_numbers(p)
    return F.when(whole, F.get(two, F.lit(0)))


def json_valid(payload) -> Column:
    """True iff the text is strict JSON ('{}' yes; '', '{bad', single quotes, text after the value, NULL no)."""
    p = _c(payload)
    two = F.from_json(_marked(p), T.ArrayType(T.StringType()), _STRICT)
    whole = (F.size(two) == 2) & (F.get(two, F.lit(1)) == F.concat(F.lit(f'{{"{_MARK}":"'), F.md5(p.cast("binary")), F.lit('"}')))
    return F.coalesce(p.isNotNull() & whole & ~_odd_numbers(p), F.lit(False))


def field(parsed, name: str, default=None) -> Column:
    """Numeric field of a parsed payload with the rule's default (P6); NaN and non-numbers count as missing."""
    v = _c(parsed).getField(name).try_cast("double")
    v = F.when(~F.isnan(v), v)
    return v if default is None else F.coalesce(v, F.lit(default))
