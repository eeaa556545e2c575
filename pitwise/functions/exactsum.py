"""Sums of doubles that do not depend on their order, lose nothing and never overflow.

A double below 2^94 (2e28) is split into six whole numbers, one for each 30 bits of
its exponent range from 2^-86 (what is smaller than half of that is rounded off).
Each is at most 2^29, so a column of longs holds the exact sum of 2^34 rows, and the
difference of two prefix sums is the exact sum of the rows between them, whatever
came before: an amount of 1e19 a year ago does not blur today's cents.  Amounts of
2^94 and above count as infinite; infinities of either sign are counted in one more
column (positive ones as 1, negative ones as 2^32).  NULL and NaN count as missing.

Expressions are SQL text: one call builds a column, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

BITS = 30
LIMBS = 6
UNIT = -86                      # exponent of the last limb's unit
LIMIT = f"{2.0 ** (UNIT + BITS * LIMBS)!r}D"
MINUS = 1 << 32


def names(name: str) -> list[str]:
    """The columns that hold the parts of ``name``: limbs, then infinities."""
    return [*limbs(name), f"{name}_i"]


def limbs(name: str) -> list[str]:
    return [f"{name}_{k}" for k in range(LIMBS)]


def split(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the parts of double columns, to be summed; NULL and NaN give NULL.

    The steps are columns of their own, so that none is computed twice."""
    own = df.columns
    near = [f"CASE WHEN abs({c}) < {LIMIT} THEN {c} END AS _v_{c}" for c in columns]
    steps = [f"rint(_v_{c} * {2.0 ** -(UNIT + BITS * k)!r}D) AS _q_{c}_{k}" for c in columns for k in range(LIMBS)]
    parts = []
    for c in columns:
        parts += [f"CAST(_q_{c}_{k} - _q_{c}_{k + 1} * {2.0 ** BITS!r}D AS BIGINT) AS {c}_{k}" for k in range(LIMBS - 1)]
        parts += [f"CAST(_q_{c}_{LIMBS - 1} AS BIGINT) AS {c}_{LIMBS - 1}",
                  f"CASE WHEN isnan({c}) THEN NULL WHEN {c} >= {LIMIT} THEN 1L WHEN {c} <= -{LIMIT} THEN {MINUS}L END AS {c}_i"]
    return df.selectExpr("*", *near).selectExpr(*[f"`{c}`" for c in own], *steps).selectExpr(*[f"`{c}`" for c in own], *parts)


def split_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The limbs (one column each), infinities and finiteness of an array of doubles; NaN counts as missing."""
    known = np.abs(x) < 2.0 ** (UNIT + BITS * LIMBS)
    own = np.where(known, x, 0.0)
    q = [np.rint(own * 2.0 ** -(UNIT + BITS * k)) for k in range(LIMBS)]
    limb = [q[k] - q[k + 1] * 2.0 ** BITS for k in range(LIMBS - 1)] + [q[-1]]
    return np.column_stack(limb).astype(np.int64), np.where(known | np.isnan(x), 0, np.where(x > 0, 1, MINUS)), known


def total(name: str, value: Callable[[str], str] = "`{}`".format) -> Column:
    """The double of summed parts; ``value`` gives the SQL of a part (for instance a difference of two sums).

    Limbs are added from the largest down, so each partial sum is a rounding of the true one."""
    finite = " + ".join(f"coalesce({value(f'{name}_{k}')}, 0L) * {2.0 ** (UNIT + BITS * k)!r}D" for k in reversed(range(LIMBS)))
    many = f"coalesce({value(f'{name}_i')}, 0L)"
    return F.expr(f"CASE WHEN {many} = 0 THEN {finite} WHEN {many} < {MINUS} THEN DOUBLE('Infinity') "
                  f"WHEN {many} % {MINUS}L = 0 THEN DOUBLE('-Infinity') ELSE DOUBLE('NaN') END")
