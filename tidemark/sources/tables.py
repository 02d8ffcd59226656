"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named table, of it only the columns given, so that the scan reads no others."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def once(df: DataFrame, *keys: str, spread: bool = False) -> DataFrame:
    """One row per key, for tables in which a record may be delivered again word for word.

    The copies of a key are alike, so equal rows are dropped by hashing; where a column's type can't be compared (maps,
    variants) any row of the key is taken. Null keys count as one key. With spread the result keeps all shuffle
    partitions, however small they are: right before much computing on few bytes.
    """
    if spread:
        # The aggregation takes over this partitioning, so there's still one shuffle, which isn't coalesced.
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    rest = [c for c in df.columns if c not in keys]
    if not any(x in df.schema[c].dataType.simpleString() for c in rest for x in ("map<", "variant")):
        return df.distinct()
    return df.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("__row")).select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)
