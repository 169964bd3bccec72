"""A sparse document-term matrix over a global dictionary, in CSR shards.

Documents are cut into shards of bounded size where they are read. A shard first encodes its
words by a dictionary of its own. Then the words of the shards, each once for a shard, are
dealt to buckets by hash, a bucket numbers its words, and each shard gets the numbers of its
own words back and is rewritten with them. So no occurrence of a word is ever shuffled, and
a word that all documents hold goes to its bucket once for each shard.

A shard is a row: `docs` (its documents in order), `starts` (int64, where each document's
entries begin, with the end of the last), `terms` (int64, numbers of words) and `counts`
(int32, how often), the last three as flat binary arrays. A word's number is its bucket,
shifted by 32 bits, plus its place there.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import manchete.llm.common  # noqa: F401  (ships the package with the tasks)
from manchete.workspace import materialise

#: Row of a shard, starts, terms and counts -> columns.
Emit = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]

#: A shard holds so many documents and bytes of text at most; a longer text is a shard alone.
SHARD_DOCUMENTS = 4096
SHARD_BYTES = 4 << 20
#: A task that puts the numbers in gets so many shards, about.
SHARDS_A_TASK = 4
#: A bucket gets so many words of shards, about, and has fewer different ones in its memory.
BUCKET_WORDS = 1 << 18
#: Bytes that make a document marked, besides what its caller asks for.
_MARKS = b"#$%&*|"


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unsqueeze(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def _pack(numbers: np.ndarray) -> bytes:
    """Integers in few bytes: all their lowest bytes, then all the next, and so on, compressed."""
    return _squeeze(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_unsqueeze(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _pack_rising(numbers: np.ndarray) -> bytes:
    return _pack(np.diff(numbers, prepend=0))


def _unpack_rising(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed))


def _totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values between each two offsets."""
    found = np.zeros(len(offsets) - 1, np.int64)
    real = offsets[1:] > offsets[:-1]
    if real.any():  # runs without values have no place in reduceat
        found[real] = np.add.reduceat(values[: offsets[-1]], offsets[:-1][real], dtype=np.int64)
    return found


def _cuts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that fit a shard."""
    first, held = 0, 0
    for at, length in enumerate(lengths.tolist()):
        if at > first and (held + length > SHARD_BYTES or at - first == SHARD_DOCUMENTS):
            yield first, at
            first, held = at, 0
        held += length
    if len(lengths) > first:
        yield first, len(lengths)


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins, without a copy."""
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def _csr(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of the shard, and its entries with their counts: row times number of words, plus the word's place."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    tokens = lists.flatten()
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.not_equal(tokens, "")  # blanks at the ends of a text leave empty strings
    encoded = tokens.filter(real).dictionary_encode()
    rows, codes = rows[real.to_numpy(zero_copy_only=False)], encoded.indices.to_numpy(zero_copy_only=False)
    size = max(len(encoded.dictionary), 1)
    entries, counts = np.unique(rows * size + codes, return_counts=True)
    return encoded.dictionary.cast(pa.large_binary()).to_pylist(), entries, counts


def _local_shards(df: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """Shards over dictionaries of their own, with what else filters need.

    `size` is the number of a shard's words, which a blank parts in `words`; `entries` are
    those of :func:`_csr`. The last three columns are packed.
    """
    source = df.select(F.col(id).alias("id"), F.col(part).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    doc = T.StructType([
        source.schema["id"], source.schema["part"],
        *T.StructType.fromDDL("capitals long, points long, marked boolean, digest binary"),
    ])
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("docs", T.ArrayType(doc)),
        *T.StructType.fromDDL("size long, words binary, entries binary, counts binary"),
    ])
    arrow = to_arrow_schema(schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            for first, end in _cuts(lengths):
                rows = batch.slice(first, end - first)
                texts = rows.column("text")
                data, offsets = _bytes(texts)
                marked = np.isin(data, np.frombuffer(_MARKS, np.uint8))
                points = pa.array(_totals((data & 0xC0) != 0x80, offsets))
                digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                values = [
                    rows.column("id"), rows.column("part"), pa.array(_totals((data >= 65) & (data <= 90), offsets)),
                    points, pa.array(_totals(marked, offsets) > 0), pa.array(digests, pa.binary()),
                ]
                inner = arrow.field("docs").type.value_type
                docs = pa.StructArray.from_arrays([v.cast(f.type) for v, f in zip(values, inner, strict=True)], fields=list(inner))
                words, entries, counts = _csr(texts)
                columns = [
                    pa.array([task << 32 | made], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs).cast(arrow.field("docs").type),
                    pa.array([len(words)], pa.int64()),
                    *(pa.array([x], pa.binary()) for x in (_squeeze(b" ".join(words)), _pack_rising(entries), _pack(counts))),
                ]
                made += 1
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(build, schema)


def _dealt(shards: DataFrame, buckets: int) -> DataFrame:
    """(bucket, shard, words, codes): the words of every shard that fall into a bucket, and their places there."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "shard", "words", "codes"]
        for batch in batches:
            for at in range(batch.num_rows):
                words = np.array(_unsqueeze(batch.column("words")[at].as_py()).split(b" "), object)
                own = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                order = np.argsort(own, kind="stable")
                starts = np.flatnonzero(np.diff(own[order], prepend=-1))
                parts = np.split(order, starts[1:])
                columns = [
                    pa.array(own[order][starts], pa.int64()),
                    pa.array([batch.column("shard")[at].as_py()] * len(parts), pa.int64()),
                    pa.array([_squeeze(b" ".join(words[p].tolist())) for p in parts], pa.binary()),
                    pa.array([_pack_rising(p) for p in parts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = shards.where("size > 0").select("shard", "words")
    return source.mapInArrow(deal, "bucket long, shard long, words binary, codes binary")


def _numbered(dealt: DataFrame) -> DataFrame:
    """`dealt` with `places`, the numbers of the words in their bucket.

    Rows come ordered by bucket and shard, so that a task that is repeated gives the same
    numbers, and holds the different words of one bucket at a time.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for batch in batches:
            places = []
            for bucket, words in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if bucket != at:
                    at, known = bucket, {}
                found = [known.setdefault(w, len(known)) for w in _unsqueeze(words).split(b" ")]
                places.append(_pack(np.array(found, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.binary())], names=[*batch.schema.names, "places"])

    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "shard")
    return ordered.mapInArrow(number, "bucket long, shard long, words binary, codes binary, places binary")


def _buckets(shards: DataFrame) -> int:
    return (shards.agg(F.sum("size")).first()[0] or 0) // BUCKET_WORDS + 1


def dictionary(shards: DataFrame) -> DataFrame:
    """(word, term): all words of local shards with their numbers."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, words, places in zip(*(batch.column(c).to_pylist() for c in ("bucket", "words", "places")), strict=True):
                texts = pa.array(_unsqueeze(words).split(b" "), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([texts, pa.array((bucket << 32) + _unpack(places))], names=["word", "term"])

    numbered = _numbered(_dealt(shards, _buckets(shards)))
    return numbered.mapInArrow(unpack, "word string, term long").distinct()


def _numbered_shards(shards: DataFrame, schema: T.StructType, emit: Emit) -> DataFrame:
    """What `emit` makes of local shards, a written table, once they have the numbers of the global dictionary.

    It gets the row of a shard, with its `starts`, `terms` and `counts` as arrays beside it,
    and gives the columns of a batch. A task holds one shard at a time.
    """
    tasks = shards.count() // SHARDS_A_TASK + 1
    dealt = _numbered(_dealt(shards, _buckets(shards))).drop("words").repartition(tasks, "shard")
    # A group is what one shard has in the buckets.
    numbers = dealt.groupBy("shard").agg(F.collect_list(F.struct("bucket", "codes", "places")).alias("numbers"))
    met = shards.drop("words").repartition(tasks, "shard").join(numbers, "shard", "left")
    arrow = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                size = row.column("size")[0].as_py()
                numbers = np.zeros(size, np.int64)
                for piece in row.column("numbers")[0].as_py() or ():
                    numbers[_unpack_rising(piece["codes"])] = (piece["bucket"] << 32) + _unpack(piece["places"])
                entries, rows = _unpack_rising(row.column("entries")[0].as_py()), len(row.column("docs")[0])
                starts = np.searchsorted(entries, np.arange(rows + 1) * max(size, 1)).astype(np.int64)
                terms = numbers[entries % size] if size else numbers
                counts = _unpack(row.column("counts")[0].as_py()).astype(np.int32)
                columns = emit(row, starts, terms, counts)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return met.select("shard", "docs", "size", "entries", "counts", "numbers").mapInArrow(number, schema)


def term_matrix(df: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """CSR shards over the words (`[^\\x20\\x09-\\x0D]+`, case-sensitive) of whole texts.

    `docs` holds for each document `id`, `part`, the number of its code points and of
    `[A-Z]` among them, whether it is marked (holds any `#$%&*|`) and a SHA-256 of its
    text. Null texts count as empty ones, whose rows of the matrix are empty. Repeated rows
    each are a row. An empty table has no shard. Other columns are not read.
    """
    return number_terms(materialise(_local_shards(df, id, text, part)))


def number_terms(shards: DataFrame) -> DataFrame:
    """Local shards, a written table, with the numbers of the global dictionary."""

    def shard(row: pa.RecordBatch, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        arrays = (pa.array([a.tobytes()], pa.binary()) for a in (starts, terms, counts))
        return [row.column("shard"), row.column("docs"), *arrays]

    flat = T.StructType.fromDDL("starts binary, terms binary, counts binary")
    return _numbered_shards(shards, T.StructType([shards.schema["shard"], shards.schema["docs"], *flat]), shard)


def row_totals(df: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each document: what `docs` of :func:`term_matrix` holds, `words` (the sum
    of its row of the matrix) and `distinct` (the non-zero entries of it)."""
    shards = materialise(_local_shards(df, id, text, part))

    def totals(row: pa.RecordBatch, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        return [*row.column("docs").flatten().flatten(), pa.array(_totals(counts, starts)), pa.array(np.diff(starts))]

    doc = shards.schema["docs"].dataType.elementType
    return _numbered_shards(shards, T.StructType([*doc, *T.StructType.fromDDL("words long, distinct long")]), totals)
