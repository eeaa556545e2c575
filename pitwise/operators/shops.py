"""Order-export adapters: normalisation, sampling, window features, labels
(P7-P10, F5-F9, W1-W4, B1-B13, T2, T3).

Shape of the work (:func:`sampled_rows`): rows are shuffled once, by shop, and sorted
once by time. Everything a sampled row sees of its shop is looked up in that order
(``operators/dense.py``): the row index, shop extent and labels; the additive window
features (B1-B4, B6, B7) as differences of running sums; the rows above a window's
75th percentile of price (B5) by rank descent; the age weights (B8) by binary search.

Shops too large for one task have their rows cut into periods: sums over all rows
before a, a - w and a + h are values at time offsets (:func:`offset_scan`), B5 takes
one prefix count per level of price digits and B8 prefix counts at 90 day offsets.

No pair of a sampled row and another row is made anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pitwise.functions import exactsum
from pitwise.functions.encode import (BT_COLS, CAT_COLS, category_of_shop_key, category_of_txn_key, onehot_category,
                                      shop_key, txn_key)
from pitwise.functions.season import SEASON_COLS, season_shop
from pitwise.functions.timecols import DAY_US, coerce_num, floor_days, from_micros, micros
from pitwise.operators.dense import sampled_features
from pitwise.operators.scan import KeySizes, key_sizes, offset_scan, segmented_scan
from pitwise.session import materialize
from pitwise.sources.schemas import FILE_ORDER, LABELS

WINDOWS = (7, 30, 90)
HORIZON_DAYS = 14
FIRST_SAMPLE = 30
SAMPLE_EVERY = 7
MIN_SHOP_ROWS = 45

SHOP_ROLL = ["order_count", "order_velocity", "revenue_total", "revenue_per_day", "cancel_rate",
             "blocked_rate", "restock_count", "price_change_count", "avg_price_change_pct",
             "latest_cash_balance", "cash_trend", "inventory_trend", "weighted_order_count"]
#: Features that look at each row of a window.
DENSE = ("blocked_rate", "weighted_order_count")
SHOP_DELTA = ["scenario_magnitude", "deviation_from_norm", "history_depth_days",
              "n_past_price_changes", "hist_avg_price_change"]
ADAPTER_COLS = (["branch_id", "business_id", "category", "branch_type", "committed_at"]
                + [f"w{w}_{c}" for w in WINDOWS for c in SHOP_ROLL] + SEASON_COLS + SHOP_DELTA
                + CAT_COLS + BT_COLS + LABELS)

# Normalised shop frame columns.
SHOP_COLS = ["shop_id", "created_at", "total_price", "cancelled_at", "product_type",
             "inventory_qty", "cash_balance", "pos", "tie"]


def _opt(df: DataFrame, name: str, default: Column) -> Column:
    """A column that may be absent from the export -> default (plan time)."""
    return F.col(name) if name in df.columns else default


def _ts(df: DataFrame, name: str, lenient: bool) -> Column:
    c = F.col(name)
    t = dict(df.dtypes).get(name)
    if t == "string":
        return c.try_cast("timestamp_ntz") if lenient else c.cast("timestamp_ntz")
    if t == "timestamp":
        return F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return c


def prepare_shop_orders(df: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """P2/P3/P9/F9 for a shop-order export.

    created_at text is read as UTC (offsets honoured); cancelled_at is parsed
    leniently; optional columns default (cash / inventory 0.0, product type
    'retail'); rows without shop or time are dropped. ``tie`` orders rows of
    one shop at one timestamp (default: the ``tie`` column if present)."""
    from pitwise.functions.timecols import utc_normalize
    ca = dict(df.dtypes).get("created_at")
    created = utc_normalize(F.col("created_at")) if ca == "string" else _ts(df, "created_at", False)
    if tie is None:
        tie = [c for c in ("tie", FILE_ORDER) if c in df.columns][:1]
    out = df.select(
        F.col("shop_id").cast("string").alias("shop_id"),
        created.alias("created_at"),
        F.col("total_price").cast("double").alias("total_price"),
        (_ts(df, "cancelled_at", True) if "cancelled_at" in df.columns
         else F.lit(None).cast("timestamp_ntz")).alias("cancelled_at"),
        _opt(df, "product_type", F.lit(None).cast("string")).alias("product_type"),
        _opt(df, "inventory_qty", F.lit(0.0)).cast("double").alias("inventory_qty"),
        _opt(df, "cash_balance", F.lit(0.0)).cast("double").alias("cash_balance"),
        (F.struct(*[F.col(c) for c in tie]) if tie else F.lit(None).cast("int")).alias("tie"),
    )
    out = out.filter(F.col("shop_id").isNotNull() & F.col("created_at").isNotNull())
    return out.withColumn("pos", micros(F.col("created_at")))


def _running_cash(df: DataFrame, pos: str, order: list[str], sizes: KeySizes | None) -> DataFrame:
    """Per-shop running total of total_price in file order."""
    run = segmented_scan(df, "shop_id", pos, order, sums=exactsum.names("_amt"), inclusive=True, prefix="cum", sizes=sizes,
                         derive=lambda d: exactsum.split(d.withColumn("_amt", F.col("total_price")), "_amt"))
    return run.select(*df.columns, exactsum.total("cum_amt").alias("cash_balance"))


def _file_order(df: DataFrame, pos: str, order: list[str] | None) -> tuple[DataFrame, list[str]]:
    """The numeric position ``pos`` (0 where the source has none) and the order of rows at one position:
    ``order``, or the readers' file-order column."""
    if order is None:
        order = [FILE_ORDER] if FILE_ORDER in df.columns else []
    if pos not in df.columns:
        if not order:
            raise ValueError(f"no file order: neither {pos!r} nor {FILE_ORDER!r} is a column")
        df = df.withColumn(pos, F.lit(0).cast("long"))
    return df, order


def normalize_retail(df: DataFrame, pos: str = "pos", order: list[str] | None = None,
                     sizes: KeySizes | None = None) -> DataFrame:
    """Retail transactions -> shop frame. ``pos``/``order`` give the
    file order (numeric position + tie) used by the running cash proxy."""
    df, order = _file_order(df, pos, order)
    d = df.select(
        F.col("store_id").cast("string").alias("shop_id"),
        _ts(df, "date", True).alias("created_at"),
        coerce_num(F.col("total_amount")).alias("total_price"),
        F.lit(None).cast("timestamp_ntz").alias("cancelled_at"),
        F.coalesce(_opt(df, "product_category", F.lit(None).cast("string")), F.lit("retail")).alias("product_type"),
        (coerce_num(F.col("quantity")) if "quantity" in df.columns else F.lit(0.0)).alias("inventory_qty"),
        F.col(pos).alias("_pos"), *[F.col(o) for o in order],
    ).filter(F.col("shop_id").isNotNull())
    d = _running_cash(d, "_pos", order, sizes)
    d = d.filter(F.col("created_at").isNotNull())
    return d.select(*SHOP_COLS[:-2], micros(F.col("created_at")).alias("pos"),
                    F.struct(*([F.col(o) for o in order] or [F.col("_pos")])).alias("tie"))


def normalize_fashion(df: DataFrame, pos: str = "pos", order: list[str] | None = None,
                      sizes: KeySizes | None = None) -> DataFrame:
    """Fashion sales -> shop frame; Returns > 0 marks the row cancelled at
    its own date."""
    df, order = _file_order(df, pos, order)
    created = _ts(df, "Date", True)
    if "Returns" in df.columns:
        returns = coerce_num(F.col("Returns"))
        cancelled = F.when(returns > 0, created)
    else:
        cancelled = F.lit(None).cast("timestamp_ntz")
    d = df.select(
        F.col("Customer_ID").cast("string").alias("shop_id"),
        created.alias("created_at"),
        coerce_num(F.col("Total_Sales")).alias("total_price"),
        cancelled.alias("cancelled_at"),
        F.coalesce(_opt(df, "Product_Type", F.lit(None).cast("string")), F.lit("apparel")).alias("product_type"),
        (coerce_num(F.col("Quantity")) if "Quantity" in df.columns else F.lit(0.0)).alias("inventory_qty"),
        F.col(pos).alias("_pos"), *[F.col(o) for o in order],
    ).filter(F.col("shop_id").isNotNull())
    d = _running_cash(d, "_pos", order, sizes)
    d = d.filter(F.col("created_at").isNotNull())
    return d.select(*SHOP_COLS[:-2], micros(F.col("created_at")).alias("pos"),
                    F.struct(*([F.col(o) for o in order] or [F.col("_pos")])).alias("tie"))


def shop_stats(shops: DataFrame) -> DataFrame:
    """Per shop: row count, first/last time, modal product type.

    ``mode(x, true)`` takes the smallest value on a frequency tie."""
    return shops.groupBy("shop_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("pos").alias("first_t"),
        F.max("pos").alias("last_t"),
        F.mode(F.col("product_type"), True).alias("mode_type"))


def indexed(shops: DataFrame, sizes: KeySizes | None = None) -> DataFrame:
    """Row index after the time sort and the previous row's values.

    Adds ``idx`` (0-based, (created_at, tie) order), ``prev`` = struct of
    the previous row (t, tie, cash, inv) or NULL for the first row."""
    d = shops.withColumn("_one", F.lit(1).cast("long")).withColumn(
        "_pt", F.struct(F.col("pos").alias("t"), F.col("tie").alias("o0"),
                        F.col("cash_balance").alias("cash"), F.col("inventory_qty").alias("inv")))
    run = segmented_scan(d, "shop_id", "pos", ["tie"], sums=["_one"], lasts=["_pt"],
                         inclusive=False, prefix="b4", sizes=sizes)
    return run.select(*[c for c in run.columns if c not in ("_one", "_pt", "b4_one", "b4_pt")],
                      F.col("b4_one").alias("idx"), F.col("b4_pt").alias("prev"))


def sample_points(ix: DataFrame, stats: DataFrame | None = None, *, min_rows: int | None = None,
                  horizon_days: int | None = None) -> DataFrame:
    """F6 (+F5, F7): sampled as-of rows: idx 30, 37, 44, ...

    ``min_rows`` drops shops with fewer rows; ``horizon_days`` drops points
    whose as_of + horizon lies after the shop's last row."""
    s = ix.filter((F.col("idx") >= FIRST_SAMPLE) & (F.pmod(F.col("idx") - FIRST_SAMPLE, F.lit(SAMPLE_EVERY)) == 0))
    if min_rows is not None or horizon_days is not None:
        s = s.join(stats.select("shop_id", "n_rows", "last_t"), "shop_id")
        if min_rows is not None:
            s = s.filter(F.col("n_rows") >= min_rows)
        if horizon_days is not None:
            s = s.filter(F.col("pos") + F.lit(horizon_days * DAY_US) <= F.col("last_t"))
        s = s.drop("n_rows", "last_t")
    return s.select("shop_id", "idx", F.col("pos").alias("a"), F.col("created_at").alias("as_of"))


#: Digits of a price number in hot shops: each level of the descent tells so many apart.
DIGITS = 16
def _numbered(shops: DataFrame, sizes: KeySizes) -> DataFrame:
    """Rows of hot shops with idx, the shop's n_rows, first_t, last_t, mode_type, the steps to the row before (``d_``) and to
    the row after (``e_``), and ``code``: numbers in the order of the shop's prices, equal for equal ones."""
    price = F.when(~F.isnan("total_price"), F.col("total_price"))
    rows = shops.withColumn("price", price)
    rows = exactsum.split(rows.select("*", F.col("price").alias("rev"), F.col("cash_balance").alias("cash"),
                                      F.col("inventory_qty").cast("double").alias("inv")), "rev", "cash", "inv")
    near = [*exactsum.limbs("cash"), *exactsum.limbs("inv")]
    rows = indexed(rows, sizes).drop("prev")
    for name, shift in (("_b_", 1), ("_a_", -1)):
        other = rows.select(F.col("shop_id").alias("_s"), (F.col("idx") + shift).alias("_i"), *[F.col(x).alias(name + x) for x in near])
        rows = rows.join(other, (F.col("shop_id") == F.col("_s")) & (F.col("idx") == F.col("_i")), "left").drop("_s", "_i")
    prices = rows.where("price IS NOT NULL").select("shop_id", "price").distinct().withColumn("_one", F.lit(1).cast("long"))
    codes = segmented_scan(prices, "shop_id", "price", sums=["_one"], inclusive=False, prefix="c", sizes=sizes)
    rows = rows.join(codes.select("shop_id", "price", F.col("c_one").alias("code")), ["shop_id", "price"], "left")
    rows = rows.join(shop_stats(shops), "shop_id")
    # Differences to the row before (d) and from this row to the next (e), where both have a finite value
    steps = [f"{x} - _b_{x} AS d_{x}" for x in near] + [f"_a_{x} - {x} AS e_{x}" for x in near]
    steps += [f"CASE WHEN {x}_0 IS NOT NULL AND _{k}_{x}_0 IS NOT NULL THEN 1L END AS {p}_{x}_n"
              for x in ("cash", "inv") for k, p in (("b", "d"), ("a", "e"))]
    return rows.selectExpr(
        "shop_id", "idx", "pos", "created_at", "price", "code", "n_rows", "first_t", "last_t", "mode_type", "1L AS one",
        "CAST(cancelled_at IS NOT NULL AS BIGINT) AS canc", *exactsum.names("rev"), *steps,
        "struct(pos AS t, tie AS o0, cash_balance AS cash, inventory_qty AS inv) AS last")


def _sampled(min_rows: int | None, horizon_days: int | None) -> Column:
    """F6 (+F5, F7) over the columns of :func:`_numbered`."""
    cond = (F.col("idx") >= FIRST_SAMPLE) & (F.pmod(F.col("idx") - FIRST_SAMPLE, F.lit(SAMPLE_EVERY)) == 0)
    if min_rows is not None:
        cond = cond & (F.col("n_rows") >= min_rows)
    if horizon_days is not None:
        cond = cond & (F.col("pos") + F.lit(horizon_days * DAY_US) <= F.col("last_t"))
    return cond


def _blocked_hot(rows: DataFrame, codes: int, windows: tuple[int, ...], periods: int) -> DataFrame:
    """The asking rows of ``rows`` (shop_id, idx, pos, code, canc, _asks) with ``bl{w}``: cancelled rows of the window above its 75th percentile of price.

    With n prices in a window the percentile lies between order statistics k = floor(0.75 (n - 1)) and k + 1, and a price
    is above it exactly if it is above statistic k. ``codes``: a number above all price numbers. Each asking row becomes
    one row per window, which moves through the digits of the code of its statistic k; rows move through those of their own.
    """
    levels, span = 1, DIGITS
    while span < codes:
        levels, span = levels + 1, span * DIGITS
    # the row itself (w = 0), and for an asking row one more for each window
    point = "struct(0 AS w, code AS c, canc AS cc)"
    asks = ", ".join(f"struct({w} AS w, CAST(NULL AS BIGINT) AS c, CAST(NULL AS BIGINT) AS cc)" for w in windows)
    now = rows.selectExpr("shop_id", "idx", "pos", f"inline(if(_asks, array({point}, {asks}), array({point})))")
    now = now.selectExpr("*", "0L AS path", "CAST(NULL AS BIGINT) AS k", "0L AS above")
    at = {0: 0} | {w: -w * DAY_US for w in windows}
    every = range(DIGITS)
    counts = [f"n{j}" for j in every] + [f"x{j}" for j in every]
    for level in range(levels):
        span //= DIGITS
        base = now.columns
        points = now.selectExpr("*", "w > 0 AS _asks", f"CAST(floor(c / {span}) % {DIGITS} AS INT) AS _d")
        # rows, and cancelled rows, of a digit of at most j
        points = points.selectExpr("*", *[f"if(_d <= {j}, 1L, NULL) AS n{j}" for j in every], *[f"if(_d <= {j}, cc, NULL) AS x{j}" for j in every])
        seen = offset_scan(points, ["shop_id", "path"], "pos", at, ids=["idx", "w"], sums=counts, periods=periods)
        before = {x: f"CASE w {' '.join(f'WHEN {w} THEN `{x}@{w}`' for w in windows)} END" for x in counts}
        seen = seen.selectExpr(*base, "_d", *[f"`{x}@0` - {before[x]} AS {x}" for x in counts])
        seen = seen.unionByName(points.where("w = 0").select(*base, "_d"), allowMissingColumns=True)
        if not level:
            seen = seen.withColumn("k", F.expr(f"if(w > 0, CAST(floor((n{DIGITS - 1} - 1) * 0.75D) AS BIGINT), NULL)"))
        # the digit of statistic k: as many digits lie below it as have a running count of at most k
        seen = seen.selectExpr(*base, "_d", f"array({', '.join(f'x{j}' for j in every)}) AS _x", f"x{DIGITS - 1} AS _all",
                               " + ".join(f"if(n{j} <= k, 1, 0)" for j in every) + " AS _s",
                               f"greatest({', '.join(f'if(n{j} <= k, n{j}, 0L)' for j in every)}) AS _below")
        # an empty window has k = -1 and goes nowhere (path -1), like a row without price (-2)
        now = seen.selectExpr(
            *[c for c in base if c not in ("path", "k", "above")],
            f"CASE WHEN w = 0 THEN coalesce(path * {DIGITS} + _d, -2L) WHEN k >= 0 THEN path * {DIGITS} + _s ELSE -1L END AS path",
            "CASE WHEN k >= 0 THEN k - _below ELSE k END AS k",
            "CASE WHEN w > 0 AND k >= 0 THEN above + _all - get(_x, _s) ELSE above END AS above")
    return now.where("w > 0").groupBy("shop_id", "idx").agg(*[F.max(F.when(F.col("w") == w, F.col("above"))).alias(f"bl{w}") for w in windows])


def sampled_rows(shops: DataFrame, *, min_rows: int | None = None, horizon_check: bool = False, horizon_days: int = HORIZON_DAYS,
                 windows: tuple[int, ...] = WINDOWS, dense: bool = True, sizes: KeySizes | None = None) -> DataFrame:
    """One row per sampled row (F6; F5 and F7 with ``min_rows`` / ``horizon_check``): shop_id, idx, a (micros), as_of,
    first_t, mode_type, n_rows, the labels B12 and the window features B1-B9 (B5 and B8 only if ``dense``)."""
    sizes = sizes or key_sizes(shops, "shop_id")
    args = (min_rows, horizon_days if horizon_check else None, horizon_days, windows, dense)
    feats = _cold_rows(sizes.part(shops, hot=False), *args)
    if sizes.hot is not None:
        feats = feats.unionByName(_hot_rows(sizes.part(shops, hot=True), sizes, *args))
    late = [c for w in windows for c in (
        f"bl{w} * if(w{w}_order_count > 0, 1D / w{w}_order_count, 0D) AS w{w}_blocked_rate", f"wt{w} AS w{w}_weighted_order_count")]
    return feats.selectExpr("shop_id", "idx", "pos AS a", "created_at AS as_of", "first_t", "n_rows", "mode_type",
                            *[f"w{w}_{c}" for w in windows for c in SHOP_ROLL if c not in DENSE], *late, *LABELS)


def _cold_rows(shops: DataFrame, min_rows: int | None, until: int | None, horizon_days: int, windows: tuple[int, ...], dense: bool) -> DataFrame:
    """The sampled rows of shops that fit one task each: one shuffle, one sort of narrow rows, and what each sampled row
    sees of its shop looked up in that order (``operators/dense.py``)."""
    rows = shops.withColumn("inventory_qty", F.col("inventory_qty").cast("double")).repartition("shop_id")
    rows = rows.sortWithinPartitions("shop_id", "pos", "tie", "cash_balance", "inventory_qty")
    rows = rows.selectExpr("shop_id", "pos", "total_price AS price", "cancelled_at IS NOT NULL AS canc",
                           "mode() WITHIN GROUP (ORDER BY product_type) OVER (PARTITION BY shop_id) AS mode_type",
                           "cash_balance AS cash", "inventory_qty AS inv")
    run, fields = sampled_features(windows, FIRST_SAMPLE, SAMPLE_EVERY, DAY_US, horizon_days * DAY_US, dense)
    seen = rows.mapInArrow(run, fields).where(_sampled(min_rows, until)).withColumn("created_at", from_micros(F.col("pos")))
    none = [] if dense else [F.lit(None).cast(t).alias(f"{c}{w}") for c, t in (("bl", "long"), ("wt", "double")) for w in windows]
    return seen.select("shop_id", "idx", "pos", "created_at", "first_t", "n_rows", "mode_type",
                       *_window_columns(windows, lambda c, w: f"`{c}@{w}`", lambda c, w: f"`{c}@{w}`", "cash@now"),
                       *label_columns(horizon_days, lambda c, k: F.col(f"`{c}@{k}`")), *(F.col(f"{c}{w}") for c in ("bl", "wt") for w in windows if dense), *none)


def _hot_rows(shops: DataFrame, sizes: KeySizes, min_rows: int | None, until: int | None, horizon_days: int,
              windows: tuple[int, ...], dense: bool) -> DataFrame:
    """The sampled rows of hot shops, whose rows are cut into periods."""
    periods = sizes.periods()
    rows = materialize(_numbered(shops, sizes).withColumn("_asks", _sampled(min_rows, until)))
    parts = exactsum.names("rev") + [n for x in ("cash", "inv") for p in "de" for n in [*exactsum.limbs(f"{p}_{x}"), f"{p}_{x}_n"]]
    at = {"now": 0, "post": horizon_days * DAY_US} | {f"lo{w}": -w * DAY_US for w in windows}
    seen = offset_scan(rows, "shop_id", "pos", at, ids=["idx"], sums=["one", "canc", *parts], lasts=["last"], periods=periods).where("_asks")

    def total(c: str, w: int) -> str:
        return f"(`{c}@now` - `{c}@lo{w}`)"

    def steps(c: str, w: int) -> str:
        # the steps into rows before a, less those out of rows before a - w (the first one reaches into the window)
        return f"(`{c}@now` - `e{c[1:]}@lo{w}`)"

    def value(c: str, k: str) -> Column:
        return F.col(f"`one@{k}`") if c == "one" else F.col(f"`last@{k}`.{c}")

    feats = seen.select("shop_id", "idx", "pos", "created_at", "first_t", "n_rows", "mode_type",
                        *_window_columns(windows, total, steps, "last@now`.`cash"), *label_columns(horizon_days, value))
    if not dense:
        return feats.select("*", *[F.lit(None).cast(t).alias(f"{c}{w}") for c, t in (("bl", "long"), ("wt", "double")) for w in windows])
    # rows at most d days old, counted before a - d days and including that instant
    days = {f"d{d}": -d * DAY_US + 1 for d in range(1, max(windows) + 1)} | {k: v for k, v in at.items() if k != "post"}
    aged = offset_scan(rows.select("shop_id", "idx", "pos", "one", "_asks"), "shop_id", "pos", days, ids=["idx"], sums=["one"], periods=periods)
    aged = aged.selectExpr("shop_id", "idx", *[f"CAST({x} AS DOUBLE) AS wt{w}" for w, x in _weights(windows).items()])
    blocked = _blocked_hot(rows.select("shop_id", "idx", "pos", "code", "canc", "_asks"), sizes.hot_rows, windows, periods)
    return feats.join(blocked.join(aged, ["shop_id", "idx"]), ["shop_id", "idx"], "left")


def _weights(windows: tuple[int, ...]) -> dict[int, str]:
    """A row is d days old if it lies after a - (d + 1) days and not after a - d days; ages below one day weigh as one."""
    out, terms = {}, ["(`one@now` - `one@d1`)"]
    for d in range(1, max(windows) + 1):
        if d in windows:
            out[d] = " + ".join([*terms, f"(`one@d{d}` - `one@lo{d}`) / {float(d)}D"])
        terms.append(f"(`one@d{d}` - `one@d{d + 1}`) / {float(d)}D")
    return out


def constant_columns(windows: tuple[int, ...] = WINDOWS) -> dict[str, Column]:
    """Columns of the training rows that an order export says nothing of."""
    none, zero = F.lit(0).cast("long"), F.lit(0.0)
    out = {f"w{w}_{c}": v for w in windows for c, v in (("restock_count", none), ("price_change_count", none), ("avg_price_change_pct", zero))}
    out |= {"scenario_magnitude": zero, "deviation_from_norm": zero, "n_past_price_changes": none, "hist_avg_price_change": zero}
    return out | {b: F.lit(0) for b in BT_COLS}


def _window_columns(windows: tuple[int, ...], total: Callable[[str, int], str], steps: Callable[[str, int], str], cash: str) -> list[Column]:
    """B1-B4 and B6-B9 of each window; ``total`` and ``steps`` give the SQL of a sum over its rows and over its steps,
    ``cash`` is the column of the latest balance."""
    out, constant = [], constant_columns(windows)
    for w in windows:
        n = F.expr(total("one", w))
        rev = exactsum.total("rev", lambda c, w=w: total(c, w))
        rate = F.when(n > 0, F.lit(1.0) / n).otherwise(F.lit(0.0))
        trend = {}
        for x in ("cash", "inv"):
            mean = F.try_divide(exactsum.total(f"d_{x}", lambda c, w=w: "0L" if c.endswith("_i") else steps(c, w)), F.expr(steps(f"d_{x}_n", w)))
            trend[x] = F.when(n > 0, F.coalesce(mean, F.lit(0.0))).otherwise(F.lit(0.0))
        out += [
            n.alias(f"w{w}_order_count"),
            (n / F.lit(float(w))).alias(f"w{w}_order_velocity"),
            rev.alias(f"w{w}_revenue_total"),
            (rev / F.lit(float(w))).alias(f"w{w}_revenue_per_day"),
            (F.expr(total("canc", w)) * rate).alias(f"w{w}_cancel_rate"),
            *[constant[f"w{w}_{c}"].alias(f"w{w}_{c}") for c in ("restock_count", "price_change_count", "avg_price_change_pct")],
            F.when(n > 0, F.col(f"`{cash}`")).otherwise(F.lit(0.0)).alias(f"w{w}_latest_cash_balance"),
            trend["cash"].alias(f"w{w}_cash_trend"),
            trend["inv"].alias(f"w{w}_inventory_trend"),
        ]
    return out


def window_features(shops: DataFrame, windows: tuple[int, ...] = WINDOWS, dense: bool = True, sizes: KeySizes | None = None) -> DataFrame:
    """B1-B9 of every sampled row (shop_id, idx); B5 and B8 only if ``dense``."""
    return sampled_rows(shops, windows=windows, dense=dense, sizes=sizes).select(
        "shop_id", "idx", *[f"w{w}_{c}" for w in windows for c in SHOP_ROLL])


def label_columns(horizon_days: int, value: Callable[[str, str], Column]) -> list[Column]:
    """B12 from the rows before (``one``) and the latest values at ``now`` and ``post``: pre = rows before a, post = rows in [a, a + h); NULL when
    either is empty (those rows are dropped later, F8)."""
    n_pre = value("one", "now")
    n_post = value("one", "post") - n_pre
    ok = (n_pre > 0) & (n_post > 0)
    pre_v = n_pre / F.greatest(floor_days(F.col("pos") - F.col("first_t")), F.lit(1))
    post_v = n_post / F.lit(float(horizon_days))
    return [F.when(ok, value("inv", "post") - value("inv", "now")).alias("label_inventory_delta"),
            F.when(ok, value("cash", "post") - value("cash", "now")).alias("label_cashflow_delta"),
            F.when(ok, post_v - pre_v).alias("label_order_velocity_delta")]


def labels(shops: DataFrame, horizon_days: int = HORIZON_DAYS, sizes: KeySizes | None = None) -> DataFrame:
    """14-day outcome labels of every sampled row, from the values at a and a + h."""
    return sampled_rows(shops, horizon_days=horizon_days, dense=False, sizes=sizes).select("shop_id", "idx", *LABELS)


def adapter_rows(shops: DataFrame, prefix: str, branch_type: str, key, categorize, *,
                 min_rows: int | None = None, horizon_check: bool = False,
                 horizon_days: int = HORIZON_DAYS, sizes: KeySizes | None = None) -> DataFrame:
    """Shared body of T2/T3 on a prepared shop frame."""
    p = sampled_rows(shops, min_rows=min_rows, horizon_check=horizon_check, horizon_days=horizon_days, sizes=sizes)
    # the key is a column of its own, so that a text is lower-cased once and not for every pattern
    p = p.withColumn("_key", key("mode_type")).withColumn("category", categorize("_key"))
    season = season_shop(F.col("as_of"))
    cols = {
        "branch_id": F.concat(F.lit(f"{prefix}_"), F.col("shop_id"), F.lit("_"), F.col("idx").cast("string")),
        "business_id": F.concat(F.lit(f"{prefix}_"), F.col("shop_id")),
        "category": F.col("category"),
        "branch_type": F.lit(branch_type),
        "committed_at": F.col("as_of"),
    }
    cols.update({f"w{w}_{c}": F.col(f"w{w}_{c}") for w in WINDOWS for c in SHOP_ROLL})
    cols.update(season)
    cols["history_depth_days"] = floor_days(F.col("a") - F.col("first_t"))
    cols.update(onehot_category(F.col("category")))
    cols |= {c: v for c, v in constant_columns().items() if c not in cols}
    for lab in LABELS:
        cols[lab] = F.col(lab)
    out = p.select(*[cols[c].alias(c) for c in ADAPTER_COLS])
    return out.dropna(subset=LABELS)


def shop_training_rows(shops: DataFrame, horizon_days: int = HORIZON_DAYS, sizes: KeySizes | None = None) -> DataFrame:
    """Order export -> training rows (category by ordered substring map)."""
    return adapter_rows(shops, "shopify", "shopify_order", shop_key, category_of_shop_key,
                        horizon_days=horizon_days, sizes=sizes)


def txn_training_rows(shops: DataFrame, horizon_days: int = HORIZON_DAYS, sizes: KeySizes | None = None) -> DataFrame:
    """Normalised transactions -> training rows (>= 45 rows per shop,
    future horizon available, category by keyword lists)."""
    return adapter_rows(shops, "kaggle", "kaggle_transaction", txn_key, category_of_txn_key,
                        min_rows=MIN_SHOP_ROWS, horizon_check=True, horizon_days=horizon_days, sizes=sizes)
