"""Sources and sinks (S1-S6): CSV round trips with fixed schemas."""

import tempfile

from pyspark.sql import functions as F

from pitwise.plans.training import TRAINING_COLS, training_rows
from pitwise.sources import readers as R
from pitwise.sources import views as V
from tests.conftest import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="pitwise-src-test-")


def test_commits_csv_round_trip_keeps_json_payload(spark):
    c = V.commits(spark, SF_SMALL).drop("seq")
    path = _tmp() + "/commits"
    (c.write.option("header", True).option("quote", '"').option("escape", '"').csv(path))
    back = R.load_commits(spark, path)
    assert back.columns == c.columns
    # payload JSON (with commas and quotes) survives; '' comes back as NULL,
    # which every rule treats like ''.
    a = c.select("commit_id", F.when(F.col("payload") == "", None).otherwise(F.col("payload")).alias("p"))
    b = back.select("commit_id", F.col("payload").alias("p"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_training_rows_csv_sink_and_feature_loader(spark):
    df = training_rows(V.commits(spark, SF_SMALL), V.branches(spark, SF_SMALL), V.outcomes(spark, SF_SMALL))
    path = _tmp() + "/rows"
    R.write_training_rows(df, path, fmt="csv", partition_by=None)
    back = R.load_features(spark, path + "/*.csv")
    assert set(back.columns) == set(TRAINING_COLS)
    assert back.count() == df.count()
    assert dict(back.dtypes)["committed_at"] == "timestamp_ntz"


def test_parquet_sink_partitioned_by_category(spark):
    df = training_rows(V.commits(spark, SF_SMALL), V.branches(spark, SF_SMALL), V.outcomes(spark, SF_SMALL))
    path = _tmp() + "/rows_pq"
    R.write_training_rows(df, path)
    back = spark.read.parquet(path)
    assert back.count() == df.count()
    assert back.select("category").distinct().count() == df.select("category").distinct().count()


def test_shop_export_csv_source(spark):
    from pitwise.operators import shops as S
    path = _tmp() + "/orders.csv"
    rows = [("s1", "2024-01-0%dT10:00:00Z" % (i % 9 + 1), 10.0 + i, None if i % 3 else "2024-01-05",
             "Apparel", i, float(i)) for i in range(12)]
    spark.createDataFrame(rows, "shop_id string, created_at string, total_price double, cancelled_at string, "
                                "product_type string, inventory_qty int, cash_balance double") \
        .coalesce(1).write.option("header", True).csv(path)
    raw = R.read_csv(spark, path, __import__("pitwise.sources.schemas", fromlist=["x"]).SHOP_ORDERS_RAW)
    sh = S.prepare_shop_orders(raw)
    assert sh.count() == 12
    assert sh.filter(F.col("cancelled_at").isNotNull()).count() == 4
