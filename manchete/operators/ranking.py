"""Frequency ranking with ties broken by first appearance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manchete.operators.numbering import number_rows

# Positions inside one text are below 2^31, so a row's number times 2^31 plus the
# position orders by row, then position.
_POSITIONS_PER_ROW = "2147483648"


def row_key(df: DataFrame, row_id: str) -> Column:
    """Part of the arrival key that is the same for the whole row."""
    if isinstance(df.schema[row_id].dataType, T.IntegralType):
        base = F.lit(_POSITIONS_PER_ROW).cast(T.DecimalType(10, 0))
        return F.col(row_id).cast(T.DecimalType(19, 0)) * base
    return F.col(row_id)


def arrival(df: DataFrame, key: str, position: str) -> Column:
    """Comparable arrival key of one token.

    For a numeric row id it is a decimal, because the minimum of a decimal can be kept
    in a hash aggregation buffer and that of a struct needs a sort aggregation.
    """
    if isinstance(df.schema[key].dataType, T.DecimalType):
        return F.col(key) + F.col(position).cast(T.DecimalType(10, 0))
    return F.struct(key, position)


# The most rows that Spark cuts every task to before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
_CUT_BEFORE_SHUFFLE = 1000


def _order(df: DataFrame) -> list[Column]:
    order = [F.desc("frequencia"), F.col("primeira").asc()]
    if isinstance(df.schema["primeira"].dataType, T.DecimalType):
        # Rare terms tie on the frequency, and comparing wide decimals is slow. A double
        # orders them the same way up to rounding, so the decimal settles the rest.
        order.insert(1, F.col("primeira").cast("double").asc())
    return order


def top_by_frequency(df: DataFrame, section: str, limit: int, then: Sequence[Column] = ()) -> DataFrame:
    """Keep the ``limit`` most frequent rows of every section and number them ``posicao``.

    Expects ``frequencia`` and ``primeira``; ``then`` decides where both are equal. For
    limits that Spark does not cut the tasks to before the shuffle, rows are numbered
    range by range; the result is the same.
    """
    order = [*_order(df), *then]
    if limit > _CUT_BEFORE_SHUFFLE:
        numbered = number_rows(df, order, within=section, name="posicao")
        return numbered.where(F.col("posicao") <= limit).withColumn("posicao", F.col("posicao").cast("int"))
    by_rank = Window.partitionBy(section).orderBy(*order)
    return df.withColumn("posicao", F.row_number().over(by_rank)).where(F.col("posicao") <= limit)


def with_ties(df: DataFrame, section: str, limit: int) -> DataFrame:
    """The ``limit`` most frequent rows of every section and all that equal the last of them."""
    order = _order(df)
    if limit <= _CUT_BEFORE_SHUFFLE:
        by_rank = Window.partitionBy(section).orderBy(*order)
        return df.withColumn("_lugar", F.rank().over(by_rank)).where(F.col("_lugar") <= limit).drop("_lugar")
    numbered = number_rows(df, order, within=section, name="_lugar")
    last = numbered.where(F.col("_lugar") == limit).select(  # a row per section
        F.col(section).alias("_secao"), F.col("frequencia").alias("_frequencia"), F.col("primeira").alias("_primeira")
    )
    met = numbered.join(F.broadcast(last), F.col(section) == F.col("_secao"), "left")
    equal = (F.col("frequencia") == F.col("_frequencia")) & (F.col("primeira") == F.col("_primeira"))
    return met.where((F.col("_lugar") <= limit) | equal).select(*df.columns)
