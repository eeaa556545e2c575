"""The hot-key period split must not change any result.

Small data has no hot key, so the split is forced (every key is "hot",
periods of a few rows) and compared with the unsplit run.
"""

import pytest
from pyspark.sql import functions as F

from pitwise.operators import scan
from tests.conftest import SF_SMALL


@pytest.fixture
def forced_split(monkeypatch):
    monkeypatch.setattr(scan, "HEAVY_KEY_ROWS", 0)
    monkeypatch.setattr(scan, "TARGET_PERIOD_ROWS", 60)


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def _run(spark, monkeypatch, fn):
    plain = _rows(fn())
    monkeypatch.setattr(scan, "HEAVY_KEY_ROWS", 0)
    monkeypatch.setattr(scan, "TARGET_PERIOD_ROWS", 60)
    split = _rows(fn())
    return plain, split


def test_segmented_scan_split_matches_window(spark, monkeypatch):
    from pyspark.sql import Window
    df = spark.range(0, 500).select(
        (F.col("id") % 3).cast("string").alias("k"), (F.col("id") * 7919 % 1000).alias("t"),
        F.col("id").alias("seq"), (F.col("id") % 11).alias("v"))
    w = Window.partitionBy("k").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    expect = _rows(df.select("k", "seq", F.sum("v").over(w).alias("s")))

    def fn():
        r = scan.segmented_scan(df, "k", "t", ["seq"], sums=["v"], inclusive=True, prefix="s_")
        return r.select("k", "seq", F.col("s_v").alias("s"))
    plain, split = _run(spark, monkeypatch, fn)
    assert plain == expect
    assert split == expect


def test_training_rows_split_invariant(spark, monkeypatch):
    from pitwise.plans.q_lookback import t1
    plain, split = _run(spark, monkeypatch, lambda: t1(spark, SF_SMALL))
    assert len(plain) > 0
    assert plain == split


def test_shop_rows_split_invariant(spark, monkeypatch):
    from pitwise.operators import shops as S
    from pitwise.plans.q_shops import shops
    plain, split = _run(spark, monkeypatch, lambda: S.shop_training_rows(shops(spark, SF_SMALL)))
    assert plain == split


def test_ledger_split_invariant(spark, monkeypatch):
    from pitwise.operators.ledger import running_balances
    from pitwise.sources import views as V
    plain, split = _run(spark, monkeypatch,
                        lambda: running_balances(V.commits(spark, SF_SMALL)).select(
                            "commit_id", "cash_balance", "inventory_units"))
    assert plain == split


def _largest_period(spark, monkeypatch, times):
    """Rows of the largest period of one hot key with these times."""
    seen = []
    keep = scan.materialize
    monkeypatch.setattr(scan, "materialize", lambda d: seen.append(keep(d)) or seen[-1])
    monkeypatch.setattr(scan, "HEAVY_KEY_ROWS", 1000)
    monkeypatch.setattr(scan, "TARGET_PERIOD_ROWS", 2000)
    df = times.withColumn("k", F.lit("a")).withColumn("v", F.lit(1).cast("long"))
    out = scan.segmented_scan(df, "k", "t", ["seq"], sums=["v"], prefix="s_")
    n = df.count()
    assert out.agg(F.sum("s_v")).first()[0] == n * (n + 1) // 2
    return seen[-1].groupBy(scan.P).count().agg(F.max("count")).first()[0]


def test_uneven_times_split_evenly(spark, monkeypatch):
    even = spark.range(0, 40_000).select((F.col("id") * 1_000_000).alias("t"), F.col("id").alias("seq"))
    outlier = even.unionByName(spark.range(1).select(F.lit(-10**17).alias("t"), F.lit(-1).cast("long").alias("seq")))
    burst = even.withColumn("t", F.when(F.col("seq") % 2 == 0, F.lit(7)).otherwise(F.col("t")))
    for times in (even, outlier, burst):
        assert _largest_period(spark, monkeypatch, times) <= 6000


def test_scenario_heavy_key_is_hot(spark, monkeypatch):
    """A business of few commits and very many scenarios is cut too, and so is a null business."""
    from pitwise.operators import lookback
    from pyspark.sql import DataFrame
    commits = spark.createDataFrame([(f"c{i}", i, b, "ORDER_RECEIVED", '{"revenue": 1.5}') for i, b in enumerate(["a", "a", "b", None])],
                                    "commit_id string, seq long, business_id string, event_type string, payload string")
    commits = commits.withColumn("timestamp", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(seq AS INT))"))
    scenarios = spark.range(0, 400).select(F.col("id").cast("string").alias("branch_id"), F.expr("if(id % 2 = 0, 'a', NULL)").alias("business_id"),
                                           F.expr("TIMESTAMP_NTZ'2023-12-31 00:00:00' + make_interval(0, 0, 0, CAST(id % 60 AS INT))").alias("committed_at"))

    def run() -> list:
        raw = lookback.lookback_raw(commits, scenarios)
        cols = lookback.rolling_columns(raw)
        return sorted(map(tuple, raw.select("branch_id", "first_t", *[c.alias(n) for n, c in cols.items()]).collect()))
    plain = run()
    monkeypatch.setattr(scan, "HEAVY_KEY_ROWS", 100)
    monkeypatch.setattr(scan, "TARGET_PERIOD_ROWS", 60)
    sizes = []
    keep = lookback.key_sizes
    monkeypatch.setattr(lookback, "key_sizes", lambda *a: sizes.append(keep(*a)) or sizes[-1])
    assert run() == plain and len(plain) == 400
    assert isinstance(sizes[0].hot, DataFrame) and {r.business_id for r in sizes[0].hot.collect()} == {"a", None}


def test_null_key_and_many_hot_keys_are_cut(spark, monkeypatch):
    df = spark.range(0, 60_000).select(F.expr("if(id % 3 = 0, NULL, CAST(id % 2000 AS STRING))").alias("k"), (F.col("id") * 7919 % 60_000).alias("t"),
                                       F.col("id").alias("seq"), F.lit(1).cast("long").alias("v"))
    expect = _rows(df.select("seq", F.expr("sum(v) OVER (PARTITION BY k ORDER BY t, seq)").alias("s")))
    monkeypatch.setattr(scan, "HEAVY_KEY_ROWS", 10)
    monkeypatch.setattr(scan, "TARGET_PERIOD_ROWS", 3_000)
    seen = []
    keep = scan.materialize
    monkeypatch.setattr(scan, "materialize", lambda d: seen.append(keep(d)) or seen[-1])
    assert _rows(scan.segmented_scan(df, "k", "t", ["seq"], sums=["v"], prefix="s_").select("seq", F.col("s_v").alias("s"))) == expect
    hot, cut = seen
    assert hot.count() == 2001                                   # beside the null key, which holds a third of all rows
    assert cut.groupBy(scan.P).count().agg(F.max("count")).first()[0] <= 9_000


@pytest.mark.parametrize("offsets", [{"a": 0, "b": -50, "c": 30, "d": 1}])
def test_offset_scan_equals_brute_force(spark, monkeypatch, offsets):
    import random
    rnd = random.Random(1)
    data = [(rnd.choice("xy"), rnd.randrange(200), i, rnd.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t long, id long, v long").withColumn("p", F.struct("t", "id")).withColumn("_asks", F.expr("id % 3 = 0"))
    names = [f"{c}@{n}" for n in offsets for c in ("v", "p", "first_p")]

    def run(periods):
        got = scan.offset_scan(df, "k", "t", offsets, ids=["id"], sums=["v"], lasts=["p"], firsts=["p"], periods=periods).where("_asks")
        return {r["id"]: tuple(tuple(r[n]) if isinstance(r[n], tuple) else r[n] for n in names) for r in got.collect()}
    want = {}
    for k, t, i, _ in data:
        if i % 3 == 0:
            out = []
            for off in offsets.values():
                own = [x for x in data if x[0] == k]
                before = [x for x in own if x[1] < t + off]
                after = [x for x in own if x[1] >= t + off]
                out += [sum(x[3] for x in before), max(((x[1], x[2]) for x in before), default=None), min(((x[1], x[2]) for x in after), default=None)]
            want[i] = tuple(out)
    assert run(0) == want and run(5) == want
