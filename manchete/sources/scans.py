"""Reading tables with enough parallelism for the work that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Up to this many scan splits (4 GiB at the default split size) a table may be
# redistributed before CPU-heavy work; beyond it the scan is parallel enough.
_SMALL_SCAN_SPLITS = 32


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute a small scan over all cores by a unique key; leave a large one alone.

    A Parquet row group is read by one task, so a small file keeps one core busy
    however many there are. ``df`` must be a plain scan (no shuffle): counting its
    splits then runs no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > min(_SMALL_SCAN_SPLITS, 2 * cores):
        return df
    return df.repartition(2 * cores, key)


def read_table(spark: SparkSession, path: str, columns: list[str], spread_by: str | None = None) -> DataFrame:
    """Read the named columns of a Parquet table, optionally spread by a unique key."""
    df = spark.read.parquet(path).select(*columns)
    return spread(df, spread_by) if spread_by else df
