"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most k
bits differ in at most k bytes, so they share at least 8 - k positional bytes. Lists of
single bytes would hold a 256th of all fingerprints each, so the index lists every set of
five positions with the bytes there: a pair that shares m positional bytes meets in C(m, 5)
lists. Pairs are tallied over the lists in which they meet, and only those that reach the
guaranteed minimum, C(8 - k, 5) lists, have their bit distance verified.

Copies collapse to one fingerprint before anything is paired. Lists longer than
`LONG_LIST` are not paired, so a pair that meets in one may miss the minimum; instead the
fingerprints of such lists meet at the points one bit away from them,
which links exactly the same fingerprints and puts at most 65 in one place.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manchete.llm.common import left_lookup, map_texts
from manchete.llm.graph import components
from manchete.workspace import materialise

BYTES = 8
SEED = 42
#: Positions that a list goes by.
LISTED = 5
#: Longest list whose pairs are formed; longer ones are linked through points one bit away.
LONG_LIST = 128
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16


def fingerprint(text: str, words: int) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit number; 0 without words."""
    tokens = text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(words, len(tokens)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [
        digest(joined[a:b], SEED)
        for a, b in zip(starts[: len(tokens) - last].tolist(), ends[last:].tolist(), strict=True)
    ]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = np.array(hashes[at : at + _BLOCK], ">u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """`id` and `fp`, the fingerprint of each whole text (null: empty)."""
    return map_texts(df, [id], text, lambda texts: {"fp": [fingerprint(t, words) for t in texts]}, "fp long")


def _postings(prints: DataFrame) -> DataFrame:
    """(list, bytes, fp): the lists that each fingerprint is in, one for each set of positions."""
    masks = [sum(255 << (8 * p) for p in positions) for positions in combinations(range(BYTES), LISTED)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    lists = F.array(*[F.struct(F.lit(k).alias("list"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for k, m in enumerate(signed)])
    return prints.select("fp", F.explode(lists).alias("p")).select("p.list", "p.bytes", "fp")


def tallies(postings: DataFrame) -> DataFrame:
    """(a, b, lists): how many lists every pair of fingerprints a < b meets in."""
    left, right = postings.alias("l"), postings.alias("r")
    a, b = F.col("l.fp"), F.col("r.fp")
    met = left.join(right, (F.col("l.list") == F.col("r.list")) & (F.col("l.bytes") == F.col("r.bytes")) & (a < b))
    return met.select(a.alias("a"), b.alias("b")).groupBy("a", "b").agg(F.count("*").alias("lists"))


def links(prints: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) with a < b over distinct fingerprints `fp`, connecting all within `max_bits` bits.

    Fingerprints in short lists give every linked pair. Those in long lists give enough
    pairs to connect the same fingerprints.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    nothing = prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    if max_bits == 0:
        return nothing
    postings = _postings(prints)
    lengths = materialise(postings.groupBy("list", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    short = postings.join(lengths.where(F.col("n") <= LONG_LIST).drop("n"), ["list", "bytes"], "left_semi")
    enough = tallies(short).where(F.col("lists") >= comb(BYTES - max_bits, LISTED)).drop("lists")
    tallied = enough.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    long = lengths.where(F.col("n") > LONG_LIST)
    if long.isEmpty():
        return tallied.distinct()
    crowded = materialise(postings.join(long, ["list", "bytes"], "left_semi").select("fp").distinct())
    near = F.array(*[F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0))) for k in range(64)])
    if max_bits == 1:
        points = crowded.select("fp", F.explode(near).alias("point"))
        met = points.join(crowded.select(F.col("fp").alias("other")), F.col("point") == F.col("other"))
        around = met.where("fp < other").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    else:
        points = crowded.select("fp", F.explode(F.concat(near, F.array("fp"))).alias("point"))
        first = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
        around = points.join(first, "point").where("a < fp").select("a", F.col("fp").alias("b"))
    return tallied.unionByName(around).distinct()


def _known(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, n, first, root, component_id) of every fingerprint of the rows (`__id`, `fp`).

    `n` rows have it, the smallest id of which is `first`; `root` is the smallest
    fingerprint reachable from it, and `component_id` the smallest id of all of these.
    """
    distinct = materialise(prints.groupBy("fp").agg(F.min("__id").alias("first"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), max_bits))
    # The smallest fingerprint of a component stands for it; it is no node of its own.
    linked = materialise(
        roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        .join(distinct, F.col("node") == F.col("fp"))
        .select("fp", "root", "first", "n")
    )
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    grouped = left_lookup(linked, smallest, "root", "size", spread_by="fp").select("fp", "n", "first", "root", "component_id")
    single = distinct.join(linked.select("fp"), "fp", "left_anti")
    alone = single.select("fp", "n", "first", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    return materialise(grouped.unionByName(alone))


def near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 2
) -> DataFrame:
    """`id`, `fingerprint` (16 hex digits) and `component_id` of every row.

    `component_id` is the smallest id among all texts reachable over links of at most
    `max_bits` differing bits. Null and empty texts have fingerprint zero and are linked
    like any other. Repeated rows each give a row. A null id gives a row too but names no
    component: a component of null ids only has a null `component_id`. An empty table gives
    an empty result; other columns are not read.
    """
    prints = materialise(fingerprints(df, id, text, words).withColumnRenamed(id, "__id"))
    known = _known(prints, max_bits).select("fp", "n", "component_id")
    return left_lookup(prints, known, "fp", "n", spread_by="__id").select(
        F.col("__id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 2
) -> DataFrame:
    """The rows of `df` with one document of each component: the one with the smallest id.

    If texts of a component share that id, the one with the smaller fingerprint stays;
    texts of different components stay, whether they share an id or not. A row without id
    stays if all of its component lack one. Of rows with the same id and fingerprint one
    stays, which the content of the rows decides. All columns are kept.
    """
    place = {c: f"c{k}" for k, c in enumerate(df.columns)}
    source = df.select(*[F.col(f"`{c}`").alias(n) for c, n in place.items()])
    rows = materialise(map_texts(source, source.columns, place[text], lambda texts: {"fp": [fingerprint(t, words) for t in texts]}, "fp long"))
    known = _known(rows.select(F.col(place[id]).alias("__id"), "fp"), max_bits)
    # Rows without id are chosen only where there is no other.
    best = known.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "fp")).alias("best"))
    chosen = best.select(F.col("best.first").alias("first"), F.col("best.fp").alias("print"))
    times = rows.groupBy(F.col(place[id]).alias("__id"), F.col("fp").alias("__fp")).agg(F.count("*").alias("times"))
    same = (F.col("__fp") == F.col("print")) & F.col("__id").eqNullSafe(F.col("first"))
    counted = chosen.join(times, same).select("first", "print", "times")
    kept = rows.join(counted, (F.col("fp") == F.col("print")) & F.col(place[id]).eqNullSafe(F.col("first")))
    # Only rows that repeat are shuffled once more.
    content = [F.col(n) for n in place.values()]
    one = kept.where("times > 1").groupBy("print", "first").agg(
        F.min_by(F.struct(*content), F.xxhash64(*content)).alias("row")
    )
    result = kept.where("times = 1").select(*content).unionByName(one.select("row.*"))
    return result.select(*[F.col(n).alias(c) for c, n in place.items()])
