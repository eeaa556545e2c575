"""Skew-safe ordered scans: running sums, latest-before, first-at-or-after, values at time offsets.

Every ordered per-key computation in the library (running balances, row
index, lag, point-in-time lookbacks) reduces to *prefix aggregates in
(t, order...) order within a key*.

Ordinary keys take windows partitioned by the key: one read, one shuffle, one
sort. A key with very many rows would be one long task, so hot keys (found by
one count over the key column; they stay a table, whatever their number, and a
NULL key may be one) take another path:

1. Their rows are cut by a range partitioning on (key, t, order...). The cuts
   are quantiles of the rows themselves, so bursts, outliers and rows at one
   instant split evenly. The cut rows are checkpointed, so both steps below see
   the same cuts.
2. A window partitioned by (key, period) computes the running value inside a
   period; one aggregate row per (key, period), combined before its shuffle,
   and a window over that small table give the value carried in.
3. result = carried-in (+) partial, joined on (key, period).

Aggregates:
* ``sums``  - running sum of a numeric column (NULL contributes nothing);
* ``lasts`` - running ``max`` of a struct ``(t, order..., value)``: the latest
  point so far (NULL = "not a point");
* ``firsts`` - ``min`` of such a struct over the rows at or after the current
  one (evaluated with a descending window, never an unbounded-following
  frame, which Spark recomputes per row);
* ``first_t`` - min of a time column over the key's rows up to the current one
  (in a hot key: up to the end of the current period).

:func:`offset_scan` gives the aggregates of all rows before *t + offset* for any
number of offsets. For ordinary keys the running values are taken once, held in one
struct per row, and each offset looks up the struct of the last row before it (one
range frame that Spark moves forward only). Rows of hot keys ask by one probe row for
each offset instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from pitwise.session import materialize

HEAVY_KEY_ROWS = 1_000_000       # keys with more rows are cut into periods
TARGET_PERIOD_ROWS = 500_000     # rows aimed at per period
HOT_BROADCAST = 100_000          # most hot keys that are broadcast

P = "_period"


def _cols(xs) -> list[str]:
    if xs is None:
        return []
    if isinstance(xs, str):
        return [xs]
    return list(xs)


class KeySizes(NamedTuple):
    """What one count over the key column tells."""

    keys: list[str]
    hot: DataFrame | None       # the keys of more than HEAVY_KEY_ROWS rows, or None
    hot_rows: int               # their rows
    most: int                   # rows of the largest other key

    def periods(self) -> int:
        return max(-(-self.hot_rows // TARGET_PERIOD_ROWS), 2)

    def part(self, df: DataFrame, hot: bool) -> DataFrame:
        """The rows of hot keys, or all others."""
        if self.hot is None:
            return df.where("false") if hot else df
        own = [f"_hot_{k}" for k in self.keys]
        table = self.hot.select(*[F.col(k).alias(o) for k, o in zip(self.keys, own, strict=True)])
        same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(self.keys, own, strict=True)]
        return df.join(table, on=same, how="left_semi" if hot else "left_anti")


def key_sizes(df: DataFrame, keys) -> KeySizes:
    """Count the rows of each key of ``df`` (combined before the shuffle); the list of hot ones is never collected."""
    keys = _cols(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    heavy = F.col("_n") > HEAVY_KEY_ROWS
    n, rows, most = counts.agg(F.count_if(heavy), F.sum(F.when(heavy, F.col("_n"))), F.max(F.when(~heavy, F.col("_n")))).first()
    if not n:
        return KeySizes(keys, None, 0, most or 0)
    hot = materialize(counts.where(heavy).select(*keys))
    return KeySizes(keys, F.broadcast(hot) if n <= HOT_BROADCAST else hot, rows, most or 0)


def segmented_scan(df: DataFrame, keys, t: str, order: Sequence[str] = (), *,
                   sums: Sequence[str] = (), lasts: Sequence[str] = (),
                   firsts: Sequence[str] = (), first_t: tuple[str, str] | None = None,
                   inclusive: bool = True, target: str | None = None,
                   prefix: str = "run_", derive=None, sizes: KeySizes | None = None) -> DataFrame:
    """Prefix aggregates per key in ``(t, *order)`` order.

    ``t`` is a long (microseconds). For each row that is a target (all rows
    when ``target`` is None) adds ``{prefix}{name}`` for every name in sums
    and lasts, ``{prefix}first_{name}`` for every name in firsts, and, when
    ``first_t = (src, name)``, ``name`` = the min of column ``src`` so far.
    ``inclusive`` decides whether sums/lasts include the current row (firsts
    always do). ``derive`` (DataFrame -> DataFrame, row-local) runs after the
    exchange and may add the aggregated columns. ``sizes``: key sizes that are
    known already.
    """
    keys, order = _cols(keys), _cols(order)
    sums, lasts, firsts = _cols(sums), _cols(lasts), _cols(firsts)
    sizes = sizes or key_sizes(df, keys)
    args = (keys, t, order, sums, lasts, firsts, first_t, inclusive, target, prefix)
    cold = _scan_keys(sizes.part(df, hot=False), derive, *args)
    if sizes.hot is None:
        return cold
    rows = sizes.part(df, hot=True)
    if derive is not None:
        rows = derive(rows)
    return cold.unionByName(_scan_periods(rows, sizes.periods(), *args))


def _q(c: str) -> str:
    return f"`{c}`"


def _frames(by: list[str], t: str, order: list[str], inclusive: bool) -> tuple[str, str]:
    part_by = ", ".join(_q(k) for k in by)
    asc = ", ".join([_q(t)] + [_q(o) for o in order])
    desc = ", ".join([f"{_q(t)} DESC"] + [f"{_q(o)} DESC" for o in order])
    hi = "CURRENT ROW" if inclusive else "1 PRECEDING"
    return (f"(PARTITION BY {part_by} ORDER BY {asc} ROWS BETWEEN UNBOUNDED PRECEDING AND {hi})",
            f"(PARTITION BY {part_by} ORDER BY {desc} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def _scan_keys(df, derive, keys, t, order, sums, lasts, firsts, first_t, inclusive, target, prefix) -> DataFrame:
    """Whole keys: one exchange, then windows partitioned by the key."""
    if derive is not None:
        # Row-local work (e.g. payload parsing) placed after the exchange
        # runs in every shuffle partition, not only in the scan tasks;
        # placed after the sort, it does not widen the rows sorted.
        df = derive(df.repartition(*keys).sortWithinPartitions(*keys, t, *order))
    w_in, w_desc = _frames(keys, t, order, inclusive)
    cols = ([f"coalesce(sum({_q(x)}) OVER {w_in}, 0) AS `{prefix}{x}`" for x in sums]
            + [f"max({_q(x)}) OVER {w_in} AS `{prefix}{x}`" for x in lasts]
            + [f"min({_q(x)}) OVER {w_desc} AS `{prefix}first_{x}`" for x in firsts])
    if first_t:
        cols.append(f"min({_q(first_t[0])}) OVER {w_in} AS `{first_t[1]}`")
    out = df.selectExpr("*", *cols)
    return out if target is None else out.filter(F.col(target))


def _scan_periods(rows, periods, keys, t, order, sums, lasts, firsts, first_t, inclusive, target, prefix) -> DataFrame:
    """Hot keys: running values inside periods, and carried-in values of the other periods."""
    cut = rows.repartitionByRange(max(periods, 2), *keys, t, *order).withColumn(P, F.spark_partition_id())
    d = materialize(cut)

    # -- running values inside (key, period) ----------------------------------
    w_in, w_desc = _frames([*keys, P], t, order, inclusive)
    part = d.select("*", *[F.expr(c) for c in (
        [f"sum({_q(x)}) OVER {w_in} AS `_ps_{x}`" for x in sums]
        + [f"max({_q(x)}) OVER {w_in} AS `_pl_{x}`" for x in lasts]
        + [f"min({_q(x)}) OVER {w_desc} AS `_pf_{x}`" for x in firsts])])
    if target is not None:
        part = part.filter(F.col(target))

    # -- carried-in values from the per-(key, period) table -------------------
    aggs = ([f"sum({_q(x)}) AS `_AS_{x}`" for x in sums]
            + [f"max({_q(x)}) AS `_AL_{x}`" for x in lasts]
            + [f"min({_q(x)}) AS `_AF_{x}`" for x in firsts])
    if first_t:
        aggs.append(f"min({_q(first_t[0])}) AS `_mint`")
    if not aggs:
        aggs.append("count(1) AS `_n`")
    per = d.groupBy(*keys, P).agg(*[F.expr(a) for a in aggs])
    kb = ", ".join(_q(k) for k in keys)
    before = f"(PARTITION BY {kb} ORDER BY `{P}` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    upto = f"(PARTITION BY {kb} ORDER BY `{P}` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = f"(PARTITION BY {kb} ORDER BY `{P}` DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    car_cols = ([f"sum(`_AS_{x}`) OVER {before} AS `_cs_{x}`" for x in sums]
                + [f"max(`_AL_{x}`) OVER {before} AS `_cl_{x}`" for x in lasts]
                + [f"min(`_AF_{x}`) OVER {after} AS `_cf_{x}`" for x in firsts])
    if first_t:
        car_cols.append(f"min(`_mint`) OVER {upto} AS `_cmint`")
    own = [f"_car_{c}" for c in [*keys, P]]
    carried = per.select(*[F.col(c).alias(o) for c, o in zip([*keys, P], own, strict=True)], *[F.expr(c) for c in car_cols])

    # -- combine --------------------------------------------------------------
    out = part.join(carried, on=[F.col(c).eqNullSafe(F.col(o)) for c, o in zip([*keys, P], own, strict=True)], how="left")
    final = ([f"coalesce(`_cs_{x}`, 0) + coalesce(`_ps_{x}`, 0) AS `{prefix}{x}`" for x in sums]
             + [f"greatest(`_cl_{x}`, `_pl_{x}`) AS `{prefix}{x}`" for x in lasts]
             + [f"least(`_cf_{x}`, `_pf_{x}`) AS `{prefix}first_{x}`" for x in firsts])
    if first_t:
        final.append(f"`_cmint` AS `{first_t[1]}`")
    return out.select(*[F.col(_q(c)) for c in rows.columns], *[F.expr(f) for f in final])


def _bound(offset: int) -> str:
    """Range frame bound at ``offset`` from the current value."""
    return "CURRENT ROW" if not offset else f"{abs(offset)}L {'FOLLOWING' if offset > 0 else 'PRECEDING'}"


def _look_back(df: DataFrame, keys: list[str], t: str, at: dict, sums: list[str], lasts: list[str], firsts: list[str]) -> DataFrame:
    """:func:`offset_scan` of whole keys: running values in one frame, then the last row's struct of them before each offset."""
    order = f"PARTITION BY {', '.join(_q(k) for k in keys)} ORDER BY {_q(t)}"
    upto = f"({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    # the least value among the rows of an instant, then that of the next instant that has one
    rows = df.selectExpr("*", *[f"min({_q(c)}) OVER ({order} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS `_least_{c}`" for c in firsts])
    rows = rows.selectExpr(
        "*", f"row_number() OVER ({order}) AS _rank", *[f"sum({_q(c)}) OVER {upto} AS `_run_{c}`" for c in sums],
        *[f"max({_q(c)}) OVER {upto} AS `_max_{c}`" for c in lasts],
        *[f"lead(`_least_{c}`) IGNORE NULLS OVER ({order}) AS `_next_{c}`" for c in firsts],
        *[f"min({_q(c)}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS `_all_{c}`" for c in firsts])
    held = [f"`_run_{c}`" for c in sums] + [f"`_max_{c}`" for c in lasts] + [f"`_next_{c}`" for c in firsts]
    rows = rows.selectExpr("*", f"struct({', '.join(['_rank', *held])}) AS _held")
    rows = rows.selectExpr("*", *[f"max(_held) OVER ({order} RANGE BETWEEN UNBOUNDED PRECEDING AND {_bound(offset - 1)}) AS `_held@{name}`"
                                  for name, offset in at.items()])
    cols = []
    for name in at:
        cols += [f"coalesce(`_held@{name}`.`_run_{c}`, 0) AS `{c}@{name}`" for c in sums]
        cols += [f"`_held@{name}`.`_max_{c}` AS `{c}@{name}`" for c in lasts]
        cols += [f"if(`_held@{name}` IS NULL, `_all_{c}`, `_held@{name}`.`_next_{c}`) AS `first_{c}@{name}`" for c in firsts]
    return rows.selectExpr(*[_q(c) for c in df.columns], *cols)


def offset_scan(df: DataFrame, keys, t: str, at: dict, *, ids: Sequence[str], sums: Sequence[str] = (),
                lasts: Sequence[str] = (), firsts: Sequence[str] = (), periods: int = 0) -> DataFrame:
    """Every row with its key's aggregates at time offsets: ``at`` maps a name to microseconds.

    For a row at time x and an offset o the columns ``{c}@{name}`` hold, over the rows of its key,
    the sum (``sums``) or the greatest (``lasts``) of c where t < x + o, and ``first_{c}@{name}``
    the least c (``firsts``) where t >= x + o. Rows of ``df`` whose contributions are NULL only ask.
    With ``periods`` the rows belong to hot keys and are cut; then only rows with a column ``_asks``
    that is true are returned, and ``ids`` tell the rows of a key apart.
    """
    keys = _cols(keys)
    sums, lasts, firsts = _cols(sums), _cols(lasts), _cols(firsts)
    if not periods:
        return _look_back(df, keys, t, at, sums, lasts, firsts)
    own = [*keys, *ids]
    asks = df.where("_asks").select(*own, F.struct(*df.columns).alias("_row"), F.col(t).alias("_x"))
    asks = asks.select(*own, F.inline(F.array(*[
        F.struct(F.lit(str(name)).alias("_at"), (F.col("_x") + F.lit(offset)).alias(t),
                 (F.col("_row") if not i else F.when(F.lit(False), F.col("_row"))).alias("_row"))
        for i, (name, offset) in enumerate(at.items())])))
    points = df.select(*own, t, *sums, *lasts, *[c for c in firsts if c not in lasts]).withColumn("_kind", F.lit(1))
    rows = points.unionByName(asks.withColumn("_kind", F.lit(0)), allowMissingColumns=True).withColumn("_ask", F.col("_kind") == 0)
    got = _scan_periods(rows, periods, keys, t, ["_kind"], sums, lasts, firsts, None, True, "_ask", "_v_")
    value = [(name, c, f"_v_{c}", f"{c}@{name}") for name in at for c in [*sums, *lasts]]
    value += [(name, c, f"_v_first_{c}", f"first_{c}@{name}") for name in at for c in firsts]
    back = got.groupBy(*own).agg(F.any_value("_row", True).alias("_row"), *[
        F.max(F.when(F.col("_at") == str(name), F.col(src))).alias(out) for name, _, src, out in value])
    return back.select("_row.*", *[_q(out) for *_, out in value])


def point(t: str, order: Sequence[str], value: Column, when: Column) -> Column:
    """Struct ``(t, order..., v)`` when ``when`` holds, else NULL.

    Struct comparison is field by field, so ``max``/``min`` of these give the
    latest/earliest point in (t, order) order."""
    fields = [F.col(t).alias("t")] + [F.col(o).alias(f"o{i}") for i, o in enumerate(_cols(order))]
    return F.when(when, F.struct(*fields, value.alias("v")))
