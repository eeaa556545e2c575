"""Jobs on the output of the repository's own readers, and rules for odd input."""

import tempfile

import pytest
from pyspark.sql import functions as F

from pitwise.functions.payload import field, json_valid, parse_payload
from pitwise.operators import model as M
from pitwise.operators import shops as S
from pitwise.operators.ledger import running_balances
from pitwise.plans.training import committed_with_outcome, training_rows
from pitwise.sources import readers as R
from pitwise.sources import schemas, views as V
from tests.conftest import SF_SMALL


def _csv(df, schema, path):
    names = [f.name for f in schema.fields if f.name in df.columns]
    out = df.select(*[F.col(n).cast("string").alias(n) if n in df.columns else F.lit(None).cast("string").alias(n)
                      for n in [f.name for f in schema.fields]])
    assert names
    out.coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def _rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_csv_to_training_rows_and_ledger(spark):
    base = tempfile.mkdtemp(prefix="pitwise-test-")
    c, b, o = V.commits(spark, SF_SMALL), V.branches(spark, SF_SMALL), V.outcomes(spark, SF_SMALL)
    commits = R.read_csv(spark, _csv(c, schemas.COMMITS, f"{base}/c"), schemas.COMMITS)
    branches = R.read_csv(spark, _csv(b, schemas.BRANCHES, f"{base}/b"), schemas.BRANCHES)
    outcomes = R.read_csv(spark, _csv(o, schemas.OUTCOMES, f"{base}/o"), schemas.OUTCOMES)
    assert "seq" not in commits.columns
    got, want = training_rows(commits, branches, outcomes), training_rows(c, b, o)
    assert _rows(got.drop("branch_id", "business_id")) == _rows(want.drop("branch_id", "business_id")) != []
    assert running_balances(commits).count() == c.count()


@pytest.mark.parametrize("kind, view, schema", [("retail", V.retail_txn, schemas.RETAIL_TXN_RAW),
                                                ("fashion", V.fashion_sales, schemas.FASHION_SALES_RAW)])
def test_export_to_rows(spark, kind, view, schema):
    base = tempfile.mkdtemp(prefix="pitwise-test-")
    raw = view(spark, SF_SMALL)
    path = _csv(raw.orderBy("row_seq"), schema, f"{base}/x.csv")
    got = S.txn_training_rows(R.load_export(spark, kind, path))
    prepare = S.normalize_retail if kind == "retail" else S.normalize_fashion
    want = S.txn_training_rows(prepare(raw.withColumn("pos", F.col("row_seq.l_orderkey")), order=["row_seq"]))
    assert got.columns == want.columns and got.count() == want.count() > 0
    with pytest.raises(ValueError):
        R.load_export(spark, "other", path)


def test_shop_export_to_rows(spark):
    """The rows of a shop export in file order are those of the view it was written from."""
    base = tempfile.mkdtemp(prefix="pitwise-test-")
    raw = V.shop_orders(spark, SF_SMALL)
    path = _csv(raw.orderBy("shop_id", "created_at", "tie"), schemas.SHOP_ORDERS_RAW, f"{base}/x.csv")
    got = S.shop_training_rows(R.load_export(spark, "shop", path))
    want = S.shop_training_rows(S.prepare_shop_orders(raw))
    assert got.columns == want.columns and _rows(got) == _rows(want) != []


def test_payload_rules(spark):
    texts = ['{"revenue": "12.5"}', '{"revenue": NaN}', '{"revenue": 2}', "{'revenue': 2}", '{"revenue": 1}xyz', "{bad", "", None,
             '{"revenue": "abc"}', "{}", "1,2"]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    got = df.select("p", field(parse_payload("p"), "revenue", 0.0).alias("r"), json_valid("p").alias("ok")).collect()
    by = {r.p: r for r in got}
    assert by['{"revenue": "12.5"}'].r == 12.5 and by['{"revenue": NaN}'].r == 0.0 and by['{"revenue": 2}'].r == 2.0
    assert by['{"revenue": "abc"}'].r == 0.0
    assert [by[t].ok for t in ('{"revenue": 2}', "{}")] == [True, True]
    assert not any(by[t].ok for t in ("{'revenue': 2}", '{"revenue": 1}xyz', "{bad", "", None, "1,2"))


def test_wrong_horizon_raises(spark):
    b, o = V.branches(spark, SF_SMALL), V.outcomes(spark, SF_SMALL)
    assert committed_with_outcome(b, o).count() > 0
    with pytest.raises(Exception, match="horizon"):
        committed_with_outcome(b, o.withColumn("horizon_days", F.lit(30))).collect()


def test_rows_without_time_split_last(spark):
    df = spark.createDataFrame([(i, f"2024-01-{i + 1:02d} 00:00:00") for i in range(8)] + [(8, None), (9, None)], "i int, s string")
    df = df.select("i", F.col("s").cast("timestamp_ntz").alias("committed_at"))
    got = {r.i: r.split for r in M.temporal_split(df, train_ratio=0.5).collect()}
    assert got == {i: "train" if i < 5 else "test" for i in range(10)}
