"""Shared-folder storage: lineage cuts, written tables, size-checked broadcasts."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a narrow (at most ~100 bytes a row) table that may be broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets its own, a cluster must name one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="pitwise-ckpt-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, written now and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within ``most``; beyond that a shuffle join stays."""
    return F.broadcast(df) if rows <= most else df


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names that do not clash (case-insensitively) with ``columns``."""
    have, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def repeat_rows(df: DataFrame, count: str, number: str) -> DataFrame:
    """Each row ``count`` times, ``number`` = 0, 1, ...; no array is longer than 65,536."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(1 << 16).cast("long")))
    out = df.withColumn(number, chunk)
    last = F.least(F.col(number) + ((1 << 16) - 1), F.col(count) - 1)
    return out.withColumn(number, F.explode(F.sequence(F.col(number), last)))


def worker_cache() -> dict:
    """Objects that a Python worker keeps between tasks (tokenizers, tables)."""
    return sys.modules.setdefault("_pitwise_llm_cache", types.ModuleType("_pitwise_llm_cache")).__dict__
