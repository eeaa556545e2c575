import os
import sys
import tempfile
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from pitwise.session import SESSION_CONF, STATIC_CONF
    b = (SparkSession.builder.master("local[4]").appName("pitwise-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in {**SESSION_CONF, **STATIC_CONF}.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pitwise-test-ckpt-"))
    yield s


COMMIT_SCHEMA = ("commit_id string, seq long, timestamp timestamp_ntz, business_id string, "
                 "business_category string, event_type string, branch_id string, payload string")
BRANCH_SCHEMA = ("branch_id string, seq long, business_id string, category string, branch_type string, "
                 "branch_params string, committed_at timestamp_ntz, status string")
OUTCOME_SCHEMA = ("outcome_id string, seq long, branch_id string, business_id string, category string, "
                  "recorded_at timestamp_ntz, horizon_days int, inventory_delta double, "
                  "cashflow_delta double, order_velocity_delta double")


def dt(s: str) -> datetime:
    return datetime.fromisoformat(s)


@pytest.fixture
def make_commits(spark):
    def mk(rows):
        out = []
        for i, r in enumerate(rows):
            ts, et, payload = r[0], r[1], r[2]
            biz = r[3] if len(r) > 3 else "b1"
            seq = r[4] if len(r) > 4 else i
            out.append((f"c{seq}", seq, dt(ts), biz, "retail", et, None, payload))
        return spark.createDataFrame(out, COMMIT_SCHEMA)
    return mk


@pytest.fixture
def make_branch(spark):
    def mk(ts, branch_type="price_increase", params='{"pct_change": 10}', category="retail",
           biz="b1", bid="x1", status="committed"):
        b = spark.createDataFrame([(bid, 1, biz, category, branch_type, params, dt(ts), status)],
                                  BRANCH_SCHEMA)
        o = spark.createDataFrame([(f"o{bid}", 1, bid, biz, category, dt(ts), 14, 1.0, 2.0, 3.0)],
                                  OUTCOME_SCHEMA)
        return b, o
    return mk
