"""Row numbers and cuts in a stated order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manchete.workspace import materialise

# Counts that come to the driver at a time while a cut is sought.
_BINS = 1024


def ordered_ranges(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Ranges of the order of ``keys``, each sorted by the task that holds it.

    Rows with equal keys go on by a hash of the row, and equal rows by the partition they
    come from, so that a key with very many rows is shared by several ranges. All of that
    depends on the rows alone and is the same when a task is repeated.
    """
    dealt = df.select("*", F.xxhash64(*df.columns).alias("_sorte"), F.spark_partition_id().alias("_origem"))
    ranges = dealt.repartitionByRange(*keys, F.col("_sorte").asc(), F.col("_origem").asc())
    return ranges.sortWithinPartitions(*keys, "_sorte").drop("_sorte", "_origem")


def number_rows(df: DataFrame, order: list[Column], within: str | None = None, name: str = "numero") -> DataFrame:
    """Number the rows from 1 in ``order``; in every ``within`` anew, which then leads the order.

    Ranges of the order are sorted apart and written to the working folder with their
    place in the range. What the ranges before hold, one number each, is then added. Rows
    with equal keys are numbered in an order that depends on their content.
    """
    keys = ([F.col(within).asc()] if within else []) + order
    ranges = materialise(
        ordered_ranges(df, keys).select(
            "*", F.spark_partition_id().alias("_faixa"), F.monotonically_increasing_id().alias("_ordem")
        )
    )
    # The lower 33 bits of that id count the rows of a partition.
    placed = ranges.withColumn("_ordem", F.col("_ordem").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["_faixa"]: r["n"] for r in placed.groupBy("_faixa").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    offsets = df.sparkSession.createDataFrame(starts, "_faixa int, _antes long")  # a row per range
    numbered = placed.join(F.broadcast(offsets), "_faixa").withColumn(name, F.col("_antes") + F.col("_ordem") + 1)
    if within:
        # As few rows as there are values to number within, sections or clouds.
        first = numbered.groupBy(within).agg((F.min(name) - 1).alias("_primeiro"))
        numbered = numbered.join(F.broadcast(first), within).withColumn(name, F.col(name) - F.col("_primeiro"))
    return numbered.select(*df.columns, name)


def cut_at(df: DataFrame, column: str, n: int) -> tuple[int, int] | None:
    """The smallest value that ``n`` rows do not exceed, and how many rows lie below it.

    None if there are not more than ``n`` rows. ``column`` is an integer without nulls. A
    thousand counts of equal intervals narrow the values down to one interval, and so on;
    nothing is sorted or shuffled but these counts. ``df`` is read for every round, so it
    should be a written table.
    """
    low, high, total = df.agg(F.min(column), F.max(column), F.count("*")).first()
    if total <= n:
        return None
    below = 0
    while low < high:
        width = (high - low) // _BINS + 1
        inside = df.where(F.col(column).between(low, high))
        bins = inside.groupBy(F.floor((F.col(column).cast("long") - low) / width).alias("bin")).count().collect()
        for k, count in sorted(bins):
            if below + count >= n:
                low, high = low + k * width, min(high, low + (k + 1) * width - 1)
                break
            below += count
    return low, below
