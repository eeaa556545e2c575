"""Sources and sinks.

CSV is read with a fixed schema, a header and RFC-4180 quoting: JSON payloads
carry doubled quotes, so ``escape='"'`` is required (without it a payload is
cut at its first comma). Parquet is read as is. Spark gives no row order for
files; rules that need file order take an explicit sequence column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pitwise.sources import schemas


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a declared schema (no inference)."""
    return (spark.read.schema(schema)
            .option("header", True).option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").csv(path))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV by extension."""
    if path.endswith(".csv") or (schema is not None and not path.endswith(".parquet")):
        return read_csv(spark, path, schema)
    return spark.read.parquet(path)


def load_commits(spark, path):
    return read_table(spark, path, schemas.COMMITS)


def load_branches(spark, path):
    return read_table(spark, path, schemas.BRANCHES)


def load_outcomes(spark, path):
    return read_table(spark, path, schemas.OUTCOMES)


def _with_file_order(df: DataFrame) -> DataFrame:
    """Adds the row's place: file, start of its split in the file, row in the split (ids grow with it)."""
    return df.withColumn(schemas.FILE_ORDER, F.struct(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("start"),
        F.monotonically_increasing_id().alias("row")))


def load_shop_orders(spark, path):
    return _with_file_order(read_table(spark, path, schemas.SHOP_ORDERS_RAW))


def load_retail(spark, path):
    return _with_file_order(read_table(spark, path, schemas.RETAIL_TXN_RAW))


def load_fashion(spark, path):
    return _with_file_order(read_table(spark, path, schemas.FASHION_SALES_RAW))


EXPORTS = {"shop": load_shop_orders, "retail": load_retail, "fashion": load_fashion}


def load_export(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The shop frame of an order export, by the name of its kind (shop, retail or fashion)."""
    from pitwise.operators import shops

    if kind not in EXPORTS:
        raise ValueError(f"unknown export {kind!r}; known: {', '.join(sorted(EXPORTS))}")
    prepare = {"shop": shops.prepare_shop_orders, "retail": shops.normalize_retail, "fashion": shops.normalize_fashion}
    return prepare[kind](EXPORTS[kind](spark, path))


def load_features(spark: SparkSession, path: str) -> DataFrame:
    """A training table written by :func:`write_training_rows`."""
    if path.endswith(".csv"):
        df = (spark.read.option("header", True).option("inferSchema", False).csv(path))
        cols = []
        for c in df.columns:
            if c in ("branch_id", "business_id", "category", "branch_type", "source"):
                cols.append(F.col(c))
            elif c == "committed_at":
                cols.append(F.col(c).try_cast("timestamp_ntz").alias(c))
            else:
                cols.append(F.col(c).try_cast("double").alias(c))
        return df.select(*cols)
    return spark.read.parquet(path)


def write_training_rows(df: DataFrame, path: str, fmt: str = "parquet",
                        partition_by: str | None = "category", mode: str = "overwrite") -> None:
    """Fixed column order; parquet partitioned by category by default,
    or header CSV."""
    w = df.write.mode(mode)
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
