"""Sharding by jump consistent hashing, in DataFrame functions only.

A 64-bit key seeds a linear congruential generator whose draws let the key
jump forward through the buckets 0, 1, 2, ...; its shard is the last bucket
below the shard count.  No ring or table is kept, and one more shard takes
about 1/(n + 1) of the keys, all of them into itself.

Defined cases: a null key counts as key 0; a null text has no bytes; rows that
are equal in key, size and checksum share a run of slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.llm.storage import fresh, repeat_rows

MULTIPLIER = 2862933555777941757          # of the published generator: key = key * MULTIPLIER + 1 (mod 2^64)
_MASK32 = 0xFFFFFFFF
_HI, _LO = MULTIPLIER >> 32, MULTIPLIER & _MASK32


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _product32(a: Column, c: int) -> Column:
    """``a * c`` mod 2^32 for a < 2^32, c < 2^32, without 64-bit overflow."""
    high = F.shiftleft((F.shiftright(a, 16) * _long(c)).bitwiseAND(_long(0xFFFF)), 16)
    return (high + a.bitwiseAND(_long(0xFFFF)) * _long(c)).bitwiseAND(_long(_MASK32))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state as two 32-bit halves."""
    p0 = lo.bitwiseAND(_long(0xFFFF)) * _long(_LO)
    p1 = F.shiftright(lo, 16) * _long(_LO)
    low = p0 + F.shiftleft(p1.bitwiseAND(_long(0xFFFF)), 16) + _long(1)
    carry = F.shiftright(low, 32) + F.shiftright(p1, 16)
    high = (carry + _product32(lo, _HI) + _product32(hi, _LO)).bitwiseAND(_long(_MASK32))
    return high, low.bitwiseAND(_long(_MASK32))


def jump_state(key: Column, n: int) -> Column:
    """struct<b, j>: the shard among ``n``, and the bucket (>= n) to which the key jumps next."""
    k = F.coalesce(key.cast("long"), _long(0))
    start = F.struct(_long(-1).alias("b"), _long(0).alias("j"),
                     F.shiftrightunsigned(k, 32).alias("hi"), k.bitwiseAND(_long(_MASK32)).alias("lo"))

    def step(acc: Column, _: Column) -> Column:
        hi, lo = _next(acc["hi"], acc["lo"])
        jump = (acc["j"] + 1).cast("double") * (F.lit(2.0 ** 31) / (F.shiftright(hi, 1) + 1).cast("double"))
        moved = F.struct(acc["j"].alias("b"), jump.cast("long").alias("j"), hi.alias("hi"), lo.alias("lo"))
        return F.when(acc["j"] < n, moved).otherwise(acc)

    # every step jumps at least one bucket, so n steps always reach n
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step)


def key_column(df: DataFrame, key: str) -> Column:
    """Integer keys as they are, others by their 64-bit hash."""
    kind = dict(df.dtypes)[key]
    return F.col(key) if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)


def assign_shards(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """All columns and rows of ``df``, with ``shard`` among ``n`` and ``grown_shard`` among ``n + 1``; no shuffle."""
    s, = fresh(df.columns, "state")
    out = df.withColumn(s, jump_state(key_column(df, key), n))
    return out.withColumns({"shard": F.col(s)["b"].cast("int"),
                            "grown_shard": F.when(F.col(s)["j"] <= n, F.col(s)["j"]).otherwise(F.col(s)["b"]).cast("int"),
                            }).drop(s)


def write_shards(df: DataFrame, n: int, path: str, key: str = "doc_id") -> None:
    """Write all columns of ``df`` in one folder per shard."""
    assign_shards(df, n, key).write.partitionBy("shard").parquet(path)


def shard_manifest(df: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per row of ``df``: key, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` counts a shard's rows from 0 without gaps.  It is the rows before
    the row's bucket (one of 4,096 a shard, by a hash of the row) plus its place
    in the bucket, so no task orders a whole shard; equal rows are counted
    before the shuffle, so no key is too frequent.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(F.col(key), (F.octet_length(body) + 16).cast("long").alias("size"),
                     F.crc32(body).alias("text_crc32"))
    order = [F.col(key).asc_nulls_first(), "size", "text_crc32"]
    equal = assign_shards(rows.groupBy(key, "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), n, key)
    equal = equal.withColumn("bucket", F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), "text_crc32").cast("binary")), 1, 3))
    within = Window.partitionBy("shard", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("within", F.coalesce(F.sum("n").over(within), _long(0)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (equal.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
             .withColumn("base", F.coalesce(F.sum("rows").over(before), _long(0))).drop("rows"))
    return repeat_rows(placed.join(bases, ["shard", "bucket"]), "n", "nth").select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("base") + F.col("within") + F.col("nth")).alias("slot"), "grown_shard")
