"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of a source are cut into shards by a seeded hash, and the documents of a shard,
in seeded order, into blocks of equally many words (the last of a shard may be shorter).
Blocks are seats: they go to sources by the highest quotients target / (2k + 1), and the
seats of a source go to its shards in the same way, by shard size. A shard with quota q
and n blocks takes all its blocks q div n times and its first q mod n blocks once more.

Only quotients that can win are formed: seats differ from the exact share by less than
one plus half the share of the number of parties, so all seats below that range are sure.
Everything is DataFrame operations. Tables by source hold one row for each source that
has a weight; they are ranked in one task. Shards of a source grow with the root of its
documents, so that neither a shard nor the list of a source's shards becomes large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manchete.llm.common import left_lookup
from manchete.workspace import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block.
BLOCK_WORDS = 16
#: Copies of a document at most.
MOST_COPIES = 3

OUTPUTS = ("size", "source_size", "target", "taken")


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def seeded(id: str, text: str, seed: int) -> Column:
    """A number below 2^60 from a document's id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string"), F.col(text)).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def cyclic_weights(df: DataFrame, source: str = "source", cycle: int = 3) -> DataFrame:
    """(source, weight): 1, 2, ... `cycle`, repeating, over the sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = df.select(F.col(source).alias("source")).distinct()
    return sources.select("source", (place % cycle + 1).cast("long").alias("weight"))


def targets(sizes: DataFrame, share: float = 1.0, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, weight) with `target`: shares by weight, none above `most` times its size.

    Sources ordered by limit over weight reach their limits in that order while the level
    rises; the level of the others is what remains over the weights that remain.
    """
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    remains = F.floor(F.sum("source_size").over(everything) * F.lit(float(share))).cast("long")
    full = F.coalesce(F.sum("limit").over(before), F.lit(0).cast("long"))
    weighed = F.coalesce(F.sum("weight").over(before), F.lit(0).cast("long"))
    level = (remains - full).cast("double") / (F.sum("weight").over(everything) - weighed)
    levels = sizes.withColumn("limit", F.col("source_size") * most).withColumn("level", level)
    limited = F.col("limit") <= F.col("weight") * F.col("level")
    common = F.max(F.when(~limited, F.col("level"))).over(everything)
    target = F.when(limited, F.col("limit").cast("double")).otherwise(F.col("weight") * common)
    return levels.select("source", "source_size", "weight", target.alias("target"))


def seats(
    parties: DataFrame, votes: str, total: Column, limit: str, within: list[str], order: list[Column]
) -> DataFrame:
    """`parties` with `seats`: `total` seats of each group `within` go to the highest quotients.

    `total` is the number of seats of the row's group; `limit` is the column of the most
    seats a party takes. Equal quotients go by `order`. A group without votes has no seats.
    """
    group = Window.partitionBy(*within)
    asked = F.sum(F.col(votes).cast("double")).over(group)
    exact = F.when(asked > 0, F.col(votes).cast("double") * F.col("__total") / asked).otherwise(0.0)
    spare = F.ceil(F.col("__parties") * F.col("__exact") / (2 * F.col("__total"))) + 1
    sure = F.greatest(F.floor("__exact") - F.coalesce("__spare", F.lit(1)), F.lit(0).cast("long"))
    placed = (
        parties.withColumn("__total", total)
        .withColumn("__exact", exact)
        .withColumn("__parties", F.count("*").over(group))
        .withColumn("__spare", F.when(F.col("__total") > 0, spare).otherwise(1).cast("long"))
        .withColumn("__sure", F.least(sure, F.col(limit)))
        .withColumn("__left", F.col("__total") - F.sum("__sure").over(group))
    )
    last = F.least(F.floor("__exact") + F.col("__spare"), F.col(limit)) - 1
    numbers = F.when(last >= F.col("__sure"), F.sequence(F.col("__sure"), last)).otherwise(F.array())
    quotient = F.col(votes).cast("double") / (2 * F.col("__k") + 1)
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.col("__q").desc(), *order))
    won = (
        placed.withColumn("__k", F.explode_outer(numbers))
        .withColumn("__q", F.when(F.col(votes) > 0, quotient))
        .withColumn("__won", (F.col("__q").isNotNull() & (rank <= F.col("__left"))).cast("long"))
    )
    return won.groupBy(*parties.columns).agg((F.first("__sure") + F.sum("__won")).cast("long").alias("seats"))


def _name(source: str) -> Column:
    """A source as a text that is never null; a null source begins otherwise than any other."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))


def _place(source: str, shard: str) -> Column:
    """A shard of a source as one text."""
    return F.concat(F.col(shard).cast("string"), _name(source))


def mix(
    df: DataFrame,
    weights: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: tuple[str, ...] | None = None,
    share: float = 1.0,
    seed: int = 7,
) -> DataFrame:
    """What a mix takes of every document: `keep` (else the id), size, source_size, target, taken.

    `weights` has one row (source, weight above 0) for each source of `df`. All sources
    together give `share` of all words; no source gives more than MOST_COPIES times its
    own, and no document more than that times its words. `taken` counts repeats. A null
    text has no words, a null source is a source, rows without id or repeated rows are
    documents like others, and an empty table gives an empty result. Columns of `keep`
    named like a result column are left out. The same table, seed and weights give the
    same result, however the table is dealt out.
    """
    block = F.lit(BLOCK_WORDS)
    keep = [c for c in (keep or (id,)) if c not in OUTPUTS]
    own = {f"__keep_{k}": F.col(c) for k, c in enumerate(keep)}
    hashed = [F.col(source).alias("source"), words(F.col(text)).alias("size"), seeded(id, text, seed).alias("key")]
    carried = df.select(*[c.alias(k) for k, c in own.items()], F.col(id).alias("__id"), *hashed)
    narrow = materialise(carried.select("source", "size", "key"))

    by_source = narrow.groupBy("source").agg(
        F.count("*").alias("docs"),
        F.sum("size").alias("source_size"),
        F.ceil(F.sqrt(F.count("*").cast("double")) / 2).cast("long").alias("shards"),
    )
    weighed = weights.select(F.col("source").alias("__source"), "weight")
    known = materialise(by_source.join(weighed, F.col("source").eqNullSafe(F.col("__source"))).drop("__source"))
    aimed = targets(known.select("source", "source_size", "weight"), share)
    weight_of_keys = known.select(F.col("source").alias("__source"), "docs")

    def beside(left: DataFrame, right: DataFrame, spread_by: str) -> DataFrame:
        """Join a table by source to rows of these sources, of which one may have most."""
        counted = right.join(weight_of_keys, F.col("source").eqNullSafe(F.col("__source")))
        keyed = counted.withColumn("__name", _name("source")).drop("source", "__source")
        return left_lookup(left.withColumn("__name", _name("source")), keyed, "__name", "docs", spread_by).drop("__name")

    shard_of = F.pmod(F.col("key"), F.col("shards")).alias("shard")
    by_shard = materialise(
        beside(narrow, known.select("source", "shards"), "key")
        .groupBy("source", shard_of)
        .agg(F.sum("size").alias("shard_size"))
        .withColumn("blocks", F.ceil(F.col("shard_size") / block))
        .withColumn("limit", F.col("blocks") * MOST_COPIES)
    )
    limits = by_shard.groupBy("source").agg(F.sum("limit").alias("limit")).withColumnRenamed("source", "__source")
    offered = aimed.join(limits, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    asked = F.floor((F.sum("target").over(Window.partitionBy()) + block / 2) / block).cast("long")
    in_order = [F.col("source").asc_nulls_last()]
    given = materialise(seats(offered, "target", asked, "limit", [], in_order))
    of_source = given.select("source", "source_size", "target", F.col("seats").alias("source_seats"))
    quotas = seats(
        beside(by_shard, of_source, "shard"), "shard_size", F.col("source_seats"), "limit", ["source"], [F.col("shard").asc()]
    ).select(
        F.col("source").alias("__source"), F.col("shard").alias("__shard"), "source_size", "target", "blocks", "seats"
    )

    placed = beside(carried, known.select("source", "shards"), "key").withColumn("shard", shard_of).drop("shards")
    # The join and the running sum share one key without nulls, and so one shuffle.
    met = placed.withColumn("__at", _place("source", "shard")).join(
        quotas.withColumn("__to", _place("__source", "__shard")), F.col("__at") == F.col("__to")
    )
    order = Window.partitionBy("__at").orderBy("key", "__id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("size").over(order) - F.col("size")
    # A shard without words has no blocks: div and mod by zero are avoided there.
    blocks = F.greatest(F.col("blocks"), F.lit(1).cast("long"))
    whole = F.floor(F.col("seats") / blocks)
    once_more = F.greatest(
        F.least((F.col("seats") - whole * blocks) * block - F.col("start"), F.col("size")), F.lit(0).cast("long")
    )
    return met.withColumn("start", start).select(
        *[F.col(k).alias(c) for k, c in zip(own, keep, strict=True)],
        "size",
        "source_size",
        "target",
        (whole * F.col("size") + once_more).cast("long").alias("taken"),
    )
