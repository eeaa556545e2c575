"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: naive timestamps are interpreted as UTC,
# ANSI arithmetic (errors instead of silent nulls), AQE for runtime
# re-planning (coalescing and skew-join splitting).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Methods of more bytecode are not compiled by the JVM: plans of very wide
    # rows then run operator by operator, with expressions in methods of their own.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Static (builder-time) settings. Plans here are wide (dozens of feature
# columns); per-call call-site capture costs several JVM round trips per
# expression while a plan is built.
STATIC_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "pitwise") -> SparkSession:
    """Local/test session. On a cluster the submitter's session is used."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", "8g"))
    for k, v in {**SESSION_CONF, **STATIC_CONF}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Runtime-settable session defaults (idempotent)."""
    for k, v in SESSION_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; where it is unset, a
    local session gets a scratch folder and a cluster's raises.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
        d = tempfile.mkdtemp(prefix="pitwise-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint dir.

    Used before multi-pass consumers (model fitting, several metrics over
    one prediction table) so a lost executor recomputes from the
    checkpoint instead of the whole feature plan.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def default_data_dir() -> str:
    return os.environ.get("PITWISE_DATA", "/root/testdata/sf0.01")
