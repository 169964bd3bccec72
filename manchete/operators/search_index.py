"""A trigram index over the texts of articles, for many searches in the same corpus.

The index is a folder of four tables: the articles in blocks of consecutive row ids, the
postings (trigram, row ids of a chunk of texts) sorted by trigram, how many rows hold each
trigram, and the block size. A search reads the counts of the term's trigrams, intersects the postings of the
rarest of them, and verifies the term in the blocks that are left. It finds exactly what
:func:`manchete.operators.selection.search_articles` finds by reading everything.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manchete import schema as S
from manchete.operators.selection import search_articles

_ARTICLES, _POSTINGS, _COUNTS, _SETTINGS = "artigos", "ocorrencias", "frequencias", "ajustes"

#: Row ids that a block spans.
BLOCK_ROWS = 4096
#: Trigrams whose postings are intersected: the rarest of a term.
_RAREST = 4
#: Tasks that share the postings of a trigram, or the rows without id.
_SHARES = 8
#: Characters whose trigrams are made at a time; a longer text is a chunk by itself.
_CHUNK_CHARS = 1_000_000
#: Blocks that a search names to the scan; where more are left, all are read.
_NAMED_BLOCKS = 10_000


def trigrams(text: Column) -> Column:
    """All runs of three characters of a text in lower case, each once."""
    # No run begins within a character that takes two units.
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{3}))"), F.lit(1))
    )


def _postings(texts: list[tuple[str, ...]], rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(trigrama, linhas)``: the trigrams of rows of texts in lower case, each with the rows that hold it."""
    cells = [cell for row in texts for cell in row]
    points = np.frombuffer("".join(cells).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.zeros(0x110000, bool)
    known[points] = True
    alphabet = np.flatnonzero(known)
    if len(texts) > 1 and len(alphabet) ** 3 * len(texts) >= 1 << 63:  # numbers of trigrams and rows would not fit
        half = len(texts) // 2
        yield from _postings(texts[:half], rows[:half])
        yield from _postings(texts[half:], rows[half:])
        return
    places = np.zeros(0x110000, np.int64)
    places[alphabet] = np.arange(len(alphabet))
    signs, many = places[points], len(alphabet)
    # No trigram begins in the last two characters of a text.
    sizes = np.array([len(c) for c in cells], np.int64)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begins = np.flatnonzero(place < np.repeat(sizes, sizes) - 2)
    row = np.repeat(np.arange(len(texts)), sizes.reshape(len(texts), -1).sum(axis=1))
    numbers = (signs[begins] * many + signs[begins + 1]) * many + signs[begins + 2]
    pairs = np.unique(numbers * len(texts) + row[begins])
    if not len(pairs):
        return
    numbers, row = pairs // len(texts), pairs % len(texts)
    starts = np.flatnonzero(np.diff(numbers, prepend=-1))
    found = numbers[starts]
    signs = np.stack([alphabet[found // many**2], alphabet[found // many % many], alphabet[found % many]], axis=1)
    spelled = signs.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    yield pa.RecordBatch.from_pydict(
        {
            "trigrama": pa.array([spelled[k : k + 3] for k in range(0, len(spelled), 3)], pa.string()),
            "linhas": pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(rows[row], pa.int64())),
        }
    )


def postings(articles: DataFrame, fields: list[str], row_id: str, chunk_chars: int = _CHUNK_CHARS) -> DataFrame:
    """``(trigrama, linhas)`` of the text columns; a trigram has a row for each chunk of texts that holds it.

    The same trigrams as :func:`trigrams` makes, whatever the number of fields they are in.
    """

    def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            columns = [[(t or b"").decode("utf-8", "replace") for t in c.to_pylist()] for c in batch.columns[1:]]
            texts = list(zip(*columns))
            begin, size = 0, 0
            for k, row in enumerate(texts):
                more = sum(map(len, row))
                if size and size + more > chunk_chars:
                    yield from _postings(texts[begin:k], rows[begin:k])
                    begin, size = k, 0
                size += more
            if begin < len(texts):
                yield from _postings(texts[begin:], rows[begin:])

    lowered = articles.where(F.col(row_id).isNotNull()).select(
        F.col(row_id).cast("long"), *(F.lower(F.col(c)).cast("binary") for c in fields)
    )
    return lowered.mapInArrow(of_chunks, "trigrama string, linhas array<long>")


def _block(row_id: str, block_rows: int) -> Column:
    return F.floor(F.col(row_id) / F.lit(block_rows)).cast("long")


def _share(number: Column) -> Column:
    return F.pmod(number, F.lit(_SHARES))


def write_search_index(articles: DataFrame, path: str, row_id: str = "row_id", block_rows: int = BLOCK_ROWS) -> None:
    """Write the index of the text columns that the table has; ``row_id`` is an integer.

    Every task makes the trigrams of its rows, chunk by chunk, each with a list of the rows of
    the chunk that hold it. Lists are dealt by trigram, each to a few tasks in case most
    rows hold it, and sorted, so that a search reads few pages of a file. Rows without id are
    in a block of their own, which every search reads.
    """
    fields = [c for c, _ in S.TEXT_FIELDS if c in articles.columns]
    if not fields:
        raise ValueError("no text column to search in")
    blocked = articles.withColumn("bloco", _block(row_id, block_rows))
    spread = F.when(F.col("bloco").isNull(), _share(F.xxhash64(*fields)))
    blocked.repartition("bloco", spread).sortWithinPartitions("bloco", row_id).write.partitionBy("bloco").parquet(
        f"{path}/{_ARTICLES}"
    )
    stored = articles.sparkSession.read.schema(articles.schema).parquet(f"{path}/{_ARTICLES}")
    found = postings(stored, fields, row_id)
    dealt = found.repartition("trigrama", _share(F.xxhash64("linhas"))).sortWithinPartitions("trigrama")
    dealt.write.parquet(f"{path}/{_POSTINGS}")
    written = articles.sparkSession.read.parquet(f"{path}/{_POSTINGS}")
    counts = written.groupBy("trigrama").agg(F.sum(F.size("linhas")).alias("linhas"))
    counts.sortWithinPartitions("trigrama").write.parquet(f"{path}/{_COUNTS}")
    settings = [(row_id, block_rows, articles.schema.json())]
    articles.sparkSession.createDataFrame(settings, "linha string, bloco long, esquema string").coalesce(1).write.parquet(
        f"{path}/{_SETTINGS}"
    )


def candidate_rows(spark: SparkSession, path: str, term: str) -> DataFrame | None:
    """``linha`` of the rows that hold the rarest trigrams of a term, or none if it has no trigram."""
    wanted = [r[0] for r in spark.range(1).select(F.explode(trigrams(F.lit(term)))).collect()]
    if not wanted:
        return None
    counts = spark.read.parquet(f"{path}/{_COUNTS}").where(F.col("trigrama").isin(wanted))
    known = {r["trigrama"]: r["linhas"] for r in counts.collect()}  # a row for each trigram of the term at most
    rarest = sorted(wanted, key=lambda t: (known.get(t, 0), t))[:_RAREST]
    lists = spark.read.parquet(f"{path}/{_POSTINGS}").where(F.col("trigrama").isin(rarest))
    lines = lists.select("trigrama", F.explode("linhas").alias("linha"))
    if len(known) < len(wanted):  # a trigram that no row holds
        return lines.select("linha").limit(0)
    return lines.groupBy("linha").count().where(F.col("count") == len(rarest)).select("linha")


def search_index(spark: SparkSession, path: str, term: str) -> DataFrame:
    """Articles of the index whose title, subtitle or body holds the term, ignoring case.

    Terms of fewer than three characters are looked for in all articles.
    """
    row_id, block_rows, columns = spark.read.parquet(f"{path}/{_SETTINGS}").first()
    schema = T.StructType.fromJson(json.loads(columns))
    articles = spark.read.schema(T.StructType([*schema, T.StructField("bloco", T.LongType())])).parquet(f"{path}/{_ARTICLES}")
    rows = candidate_rows(spark, path, term)
    if rows is not None:
        blocks = rows.select(_block("linha", block_rows).alias("bloco")).distinct().limit(_NAMED_BLOCKS + 1).collect()
        if len(blocks) <= _NAMED_BLOCKS:
            articles = articles.where(F.col("bloco").isNull() | F.col("bloco").isin([r["bloco"] for r in blocks]))
    return search_articles(articles, term).select(*schema.names)
