"""How filters interact: what each of them removes, in every order of applying them.

Every document is reduced to the set of filters that it fails, and documents with the same
set, part and labels to one count. All orders and steps follow from these counts, so nothing
but a small table is ever taken through the orders.

The filters: A, under 200 words; B, distinct words under half the words; C, over 3 % of the
code points in `[A-Z]`; D, any of `#$%&*|`; E, the text of a document with a smaller id.
Words and distinct words are row sums and non-zero entries of the document-term matrix.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manchete.llm.term_matrix import row_totals
from manchete.workspace import materialise

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Per cent of the words that are distinct at least, of the code points in capitals at most.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _steps() -> list[dict]:
    """Every step of every order: its filter, and the filters before it, as bits."""
    return [
        {"filter_order": "".join(o), "step": k + 1, "own": _bit(o[k]), "before": sum(map(_bit, o[:k]))}
        for o in permutations(FILTERS)
        for k in range(len(o))
    ]


def failures(df: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, fails, rows): the filters that documents fail, as bits of ABCDE, and how many rows.

    A text is a copy if a document with a smaller id has the same text; rows with the same
    id are no copies of each other, and a row without id is no copy and makes none.
    """
    totals = row_totals(df, id, text, part)
    fails = (
        F.when(F.col("words") < LEAST_WORDS, _bit("A")).otherwise(0)
        + F.when(100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"), _bit("B")).otherwise(0)
        + F.when(100 * F.col("capitals") > MOST_CAPITALS * F.col("points"), _bit("C")).otherwise(0)
        + F.when(F.col("marked"), _bit("D")).otherwise(0)
    )
    named = F.when(F.col("id").isNotNull(), F.col("digest"))
    rows = materialise(totals.select("id", "part", fails.alias("fails"), named.alias("digest")))
    # Joined by id and text, so that copies of a text meet no single key.
    rows = rows.groupBy("id", "part", "fails", "digest").agg(F.count("*").alias("rows"))
    first = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    met = rows.join(first, ["id", "digest"], "left")
    copy = F.when(F.col("digest").isNotNull() & F.col("first").isNull(), _bit("E")).otherwise(0)
    return met.groupBy("id", "part", (F.col("fails") + copy).alias("fails")).agg(F.sum("rows").alias("rows"))


def audit_filters(
    df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """Counts of every part, order and step: one row each, zeros included.

    Columns part (null: empty string), filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley (what the step's filter removes, summed
    over all orders). `labels` has `id`, quality and toxic: a document is good or toxic if
    any of its label rows says 1; null labels say nothing. Null and empty texts fail A only,
    or E as well. Repeated rows count as often as they come. An empty table has no part and
    gives no row. Other columns are not read.
    """
    marks = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    counted = (
        failures(df, id, text, part)
        .join(marks, "id", "left")
        .groupBy(F.coalesce(F.col("part"), F.lit("")).alias("part"), "fails", yes("good"), yes("toxic"))
        .agg(F.sum("rows").alias("n"))
    )
    steps = F.from_json(
        F.lit(json.dumps(_steps())), "array<struct<filter_order: string, step: int, own: int, before: int>>"
    )
    at = counted.select("*", F.inline(steps))
    fails, own, before = F.col("fails"), F.col("own"), F.col("before")
    fails_own, passed = fails.bitwiseAND(own) != 0, fails.bitwiseAND(before) == 0

    def total(condition, name: str):
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    result = at.groupBy("part", "filter_order", "step", "own").agg(
        total(passed & ~fails_own, "kept"),
        total(passed & fails_own, "removed"),
        total(~passed & fails_own, "redundant"),
        total(fails == own, "unique_fails"),
        total(passed & fails_own & F.col("good"), "good_lost"),
        total(passed & fails_own & F.col("toxic"), "toxic_lost"),
    )
    # A window holds a row for each order.
    shapley = F.sum("removed").over(Window.partitionBy("part", "own"))
    return result.withColumn("shapley", shapley).drop("own")
