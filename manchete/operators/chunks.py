"""Left join of many rows to one row per key, in tasks of a stated size."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that a task gets, about.
CHUNK_ROWS = 200_000


def key_chunks(left: DataFrame, key: str, buckets: int, chunk_rows: int) -> DataFrame:
    """(key, __bucket, __chunks): keys with more than ``chunk_rows`` rows and how many chunks they take.

    ``left`` has a column ``__bucket`` that spreads its rows over ``buckets``. A key has a
    row for each of its buckets, so no task meets more than ``buckets`` rows of a key.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
    chunks = F.ceil(F.sum("__n").over(Window.partitionBy(key)) / chunk_rows).cast("long")
    return counts.select(key, "__bucket", chunks.alias("__chunks")).where("__chunks > 1")


def chunked_left_join(
    left: DataFrame, right: DataFrame, key: str, spread_by: list[str], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row per key; nulls where it has none.

    Keys with more than ``chunk_rows`` rows on the left are cut into chunks of about that
    size by a hash of ``spread_by``, and their row of ``right`` is copied to each chunk; all
    others meet on the key alone. How many chunks a key takes is a table partitioned by
    key and bucket, of which Spark broadcasts what it finds small. Rows without a key are
    spread likewise and meet nothing. ``left`` is counted first and read more than once, so
    it should be a written table.
    """
    buckets = ceil(left.count() / chunk_rows)
    if buckets <= 1:
        return left.join(right, key, "left")
    bucket = F.pmod(F.xxhash64(*spread_by), F.lit(buckets)).cast("long")
    spread = left.withColumn("__bucket", bucket)
    chunks = key_chunks(spread, key, buckets, chunk_rows)
    marked = spread.join(chunks, [key, "__bucket"], "left")
    small = F.col("__chunks").isNull() & F.col(key).isNotNull()
    usual = marked.where(small).drop("__bucket", "__chunks").join(right, key, "left")
    copied = (
        right.join(chunks.select(key, "__chunks").distinct(), key)
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__chunks") - 1)))
        .drop("__chunks")
    )
    own = F.coalesce(F.pmod(F.col("__bucket"), F.col("__chunks")), F.col("__bucket"))
    split = marked.where(~small).withColumn("__chunk", own).drop("__bucket", "__chunks")
    return usual.unionByName(split.join(copied, [key, "__chunk"], "left").drop("__chunk"))
