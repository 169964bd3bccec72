"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import manchete

# Ship the operators with the tasks, so executors need no installed package.
cloudpickle.register_pickle_by_value(manchete)

#: Texts handed to a Python function at once, so that what it holds stays small.
TEXTS_AT_ONCE = 256

#: A key with more than one in this many rows is hot; there are fewer such keys than this.
HOT_SHARE = 1000

#: A table to look up in is broadcast whole up to so many (narrow) rows.
BROADCAST_ROWS = 50_000

Rows = dict[str, list]


def remainder(column: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo divisor."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def map_texts(
    df: DataFrame, keep: list[str], text: str, function: Callable[[list[str]], Rows], outputs: str
) -> DataFrame:
    """Rows of `keep`, with what `function` makes of each text (null: empty) as columns beside it.

    `function` gets a list of texts and returns lists of the same length for the columns
    that `outputs` (DDL) names. Nothing is shuffled and only the named columns are read.
    """
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = StructType([*source.drop("__text").schema, *StructType.fromDDL(outputs)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                made = function(part.column("__text").to_pylist())
                columns = [
                    part.column(f.name).cast(f.type) if f.name in keep else pa.array(made[f.name], f.type)
                    for f in arrow
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, schema)


def left_lookup(left: DataFrame, right: DataFrame, key: str, rows: str, spread_by: str) -> DataFrame:
    """Left join of `left` to `right`, which has one row per `key`, safe for hot and null keys.

    A `right` of at most BROADCAST_ROWS rows is broadcast. Beyond that its hot keys are:
    `rows` is a column of `right`: how many rows of `left` the key has, about. Keys with
    more than one in HOT_SHARE of all those rows are fewer than HOT_SHARE, so their part
    of `right` is broadcast; all others go through a shuffled join whose keys are small.
    Rows of `left` that need no lookup are spread by the column `spread_by` meanwhile.
    """
    total, count = right.agg(F.coalesce(F.sum(rows), F.lit(0)), F.count("*")).first()
    if count <= BROADCAST_ROWS:
        small = F.broadcast(right.drop(rows).withColumnRenamed(key, "__right_key"))
        return left.join(small, F.col(key) == F.col("__right_key"), "left").drop("__right_key")
    is_hot = F.col(rows) * HOT_SHARE > total
    values = [c for c in right.columns if c not in (key, rows)]
    hot = right.where(is_hot).select(F.col(key).alias("__hot_key"), F.struct(*values).alias("__hot"))
    cold = right.where(~is_hot).select(
        F.col(key).alias("__cold_key"), F.lit(0).cast("long").alias("__zero"), F.struct(*values).alias("__cold")
    )
    needed = F.col("__hot").isNull() & F.col(key).isNotNull()
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left").withColumns(
        {
            "__key": F.when(needed, F.col(key)),
            "__own": F.when(needed, F.lit(0).cast("long")).otherwise(F.xxhash64(spread_by)),
        }
    )
    met = marked.join(
        cold, (F.col("__key") == F.col("__cold_key")) & (F.col("__own") == F.col("__zero")), "left"
    )
    return met.select(*left.columns, *[F.coalesce(f"__hot.{v}", f"__cold.{v}").alias(v) for v in values])
