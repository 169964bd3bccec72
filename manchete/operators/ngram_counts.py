"""N-grams of many texts at a time, as numbers, inside tasks.

Texts become arrays of letters; a word is a span of such an array and an n-gram a run of
words. Every n-gram has a number of 64 bits, which falls into one of 2^18 buckets. Numbers
may coincide, so they only tell which n-grams are worth counting: these are then counted
by their words, which are compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manchete import schema as S
from manchete.operators.ranking import top_by_frequency
from manchete.workspace import materialise

#: Sections are numbered field by field, words before bigrams before trigrams.
SIZES = (1, 2, 3)
_SECTIONS = len(S.TEXT_FIELDS) * len(SIZES) + 1

_BUCKET_BITS = 18
BUCKETS = 1 << _BUCKET_BITS
#: Buckets of a section that are counted term by term at first.
_FIRST_BUCKETS = 512
#: Buckets whose counters travel together.
_SLICE = 1 << 14
#: Characters that are cut at a time; a longer text is cut by itself.
_CHUNK_CHARS = 2_000_000

# Kinds of characters: deleted, whitespace, then the letters; ends of texts are marked apart.
_LETTERS = S.ASCII_LETTERS + S.ACCENTED_LETTERS + "-"
_SPACE, _FIRST_LETTER, _END = 1, 2, 255
_SHORTEST = 3

_random = np.random.default_rng(19)
_WEIGHTS = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(b) | 1 for b in _random.integers(1 << 40, 1 << 62, 16)]


@lru_cache
def _kinds() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    for first, last in S.WHITESPACE_RANGES:
        kinds[first : last + 1] = _SPACE
    for k, letter in enumerate(_LETTERS, _FIRST_LETTER):
        kinds[ord(letter)] = kinds[ord(letter.upper())] = k
    return kinds


@lru_cache(maxsize=2)
def _powers(base: int, length: int) -> np.ndarray:
    powers = np.full(length, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        numbers = (numbers ^ (numbers >> np.uint64(33))) * np.uint64(factor)
    return numbers ^ (numbers >> np.uint64(33))


class Words(NamedTuple):
    """Words of a chunk of texts in order: text they lie in, number in the chunk, and letters."""

    row: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    #: By number in the chunk: the hash that is the same in every chunk.
    hashes: np.ndarray


def _spans(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(letters) + 2, np.int8)
    inside[1:-1] = (letters >= _FIRST_LETTER) & (letters != _END)
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = end - start >= _SHORTEST
    return start[long], end[long]


def _hashes(letters: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of each span, whatever its place: a polynomial modulo 2^64, divided by the power it begins with."""
    length = 1 << max(20, int(len(letters)).bit_length())
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(_WEIGHTS[letters] * _powers(base, length)[: len(letters)], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * _powers(pow(base, -1, 1 << 64), length)[start])


def _same_letters(letters: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> bool:
    """Whether every span equals the span of the same place in the other list."""
    size = end - start
    if not np.array_equal(size, other_end - other):
        return False
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return bool(np.array_equal(letters[np.repeat(start, size) + step], letters[np.repeat(other, size) + step]))


def cut_words(texts: Sequence[str], stop_words: str, bases: Sequence[int] = _BASES) -> Words:
    """Words longer than two letters that are not among ``stop_words``, which are separated by spaces.

    The same rules as :func:`manchete.functions.text.long_words`. The stop words are cut as
    a text before the others, so that they get numbers like all other words.
    """
    texts = [stop_words, *texts]
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    kinds[np.cumsum([len(t) + 1 for t in texts[:-1]]) - 1] = _END
    letters = kinds[kinds != 0]
    start, end = _spans(letters)
    row = np.searchsorted(np.flatnonzero(letters == _END), start) - 1
    hashes = None
    for base in bases:
        found = _hashes(letters, start, end, base)
        seen, first, word = np.unique(found, return_index=True, return_inverse=True)
        hashes = found if hashes is None else hashes
        if _same_letters(letters, start, end, start[first][word], end[first][word]):
            break
    else:
        raise ArithmeticError("different words have the same hashes for all bases")
    hashes = hashes[first]
    stopped = np.zeros(len(seen), bool)
    stopped[word[row < 0]] = True
    kept = (row >= 0) & ~stopped[word]
    return Words(row[kept], word[kept], start[kept], end[kept], letters, hashes)


def _grams(words: Words, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, places of the first words, and numbers of 64 bits."""
    hashes = words.hashes[words.word]
    numbers = hashes
    for n in range(1, max(sizes) + 1):
        if n > 1:
            numbers = _mixed(numbers[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[n - 1 :])
        if n in sizes:
            at = np.flatnonzero(words.row[n - 1 :] == words.row[: len(words.row) - n + 1])
            yield n, at, numbers[at]


def _bucket(numbers: np.ndarray) -> np.ndarray:
    return (numbers >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)


def _chunks(batches: Iterable[pa.RecordBatch], stop: str, chunk_chars: int) -> Iterator[tuple[Words, np.ndarray, pa.Array]]:
    """Words, fields and row ids of chunks of texts; the texts of a chunk are in order of their ids."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column("chave")))
        keys, fields = batch.column("chave"), batch.column("campo").to_numpy(zero_copy_only=False)
        texts = [t.decode("utf-8", "replace") for t in batch.column("texto").to_pylist()]
        begin, size = 0, 0
        for k, text in enumerate(texts):
            if size and size + len(text) > chunk_chars:
                yield cut_words(texts[begin:k], stop), fields[begin:k], keys.slice(begin, k - begin)
                begin, size = k, 0
            size += len(text) + 1
        if begin < len(texts):
            yield cut_words(texts[begin:], stop), fields[begin:], keys.slice(begin)


class Ngrams:
    """The n-grams of a table of texts ``(chave, campo, texto)``, none of them null."""

    def __init__(self, texts: DataFrame, stop_words: Iterable[str], sizes: Sequence[int], chunk_chars: int = _CHUNK_CHARS):
        self.texts = texts.select("chave", F.col("campo").cast("int").alias("campo"), F.col("texto").cast("binary").alias("texto"))
        letters = set(_LETTERS)
        self.stop = " ".join(sorted(w for w in set(stop_words) if len(w) >= _SHORTEST and letters.issuperset(w)))
        self.sizes = tuple(sizes)
        self.chunk_chars = chunk_chars

    def bucket_totals(self) -> DataFrame:
        """``(secao, balde, total)``: how many n-grams of a section fall into a bucket, where any do."""
        stop, sizes, chunk_chars = self.stop, self.sizes, self.chunk_chars

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros(_SECTIONS * BUCKETS, np.int64)
            for words, fields, _ in _chunks(batches, stop, chunk_chars):
                for n, at, numbers in _grams(words, sizes):
                    section = fields[words.row[at]].astype(np.int64) * len(SIZES) + n
                    np.add.at(totals, section * BUCKETS + _bucket(numbers), 1)
            for k in range(0, len(totals), _SLICE):
                part = totals[k : k + _SLICE]
                if part.any():  # the empty high bytes lie together, which compresses well
                    planes = part.view(np.uint8).reshape(-1, 8).T.tobytes()
                    yield pa.RecordBatch.from_pydict({"fatia": pa.array([k], pa.int64()), "contagens": pa.array([planes], pa.binary())})

        def add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, planes in zip(batch.column(0).to_pylist(), batch.column(1)):
                    part = np.frombuffer(planes.as_buffer(), np.uint8).reshape(8, -1).T.copy().view(np.int64)[:, 0]
                    sums[k] = sums[k] + part if k in sums else part
            for k, part in sums.items():
                at = np.flatnonzero(part)
                yield pa.RecordBatch.from_pydict(
                    {
                        "secao": pa.array((at + k) // BUCKETS, pa.int32()),
                        "balde": pa.array((at + k) % BUCKETS, pa.int32()),
                        "total": pa.array(part[at], pa.int64()),
                    }
                )

        slices = self.texts.mapInArrow(add_up, "fatia long, contagens binary")
        return slices.repartition("fatia").mapInArrow(add_slices, "secao int, balde int, total long")

    def numbers(self) -> DataFrame:
        """``(secao, termo)`` of every n-gram, where ``termo`` is its number."""
        stop, sizes, chunk_chars = self.stop, self.sizes, self.chunk_chars

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for words, fields, _ in _chunks(batches, stop, chunk_chars):
                for n, at, numbers in _grams(words, sizes):
                    section = fields[words.row[at]].astype(np.int32) * len(SIZES) + n
                    yield pa.RecordBatch.from_pydict(
                        {"secao": pa.array(section, pa.int32()), "termo": pa.array(numbers.view(np.int64), pa.int64())}
                    )

        return self.texts.mapInArrow(number, "secao int, termo long")

    def counted(self, wanted: np.ndarray) -> DataFrame:
        """``(secao, termo, frequencia, primeira)`` of all n-grams in the wanted buckets of each section."""
        stop, sizes, chunk_chars = self.stop, self.sizes, self.chunk_chars
        packed = np.packbits(wanted)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            is_wanted = np.unpackbits(packed).view(bool)
            for words, fields, keys in _chunks(batches, stop, chunk_chars):
                # Spaces between words, so that a slice of the text is a word.
                signs = np.full(256, ord(" "), np.uint32)
                signs[_FIRST_LETTER : _FIRST_LETTER + len(_LETTERS)] = [ord(c) for c in _LETTERS]
                text = signs[words.letters].tobytes().decode("utf-32-le")
                start, end, many = words.start.tolist(), words.end.tolist(), len(words.hashes)
                for n, at, numbers in _grams(words, sizes):
                    section = fields[words.row[at]].astype(np.int64) * len(SIZES) + n
                    met = is_wanted[section * BUCKETS + _bucket(numbers)]
                    at, section = at[met], section[met]
                    same = section
                    for k in range(n):
                        same = np.unique(same, return_inverse=True)[1] * many + words.word[at + k]
                    _, first, times = np.unique(same, return_index=True, return_counts=True)
                    terms = [" ".join([text[start[p] : end[p]] for p in range(a, a + n)]) for a in at[first].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(section[first], pa.int32()),
                            pa.array(terms, pa.string()),
                            keys.take(pa.array(words.row[at[first]])),
                            pa.array(times, pa.int64()),
                        ],
                        names=["secao", "termo", "chave", "vezes"],
                    )

        schema = T.StructType(
            [
                T.StructField("secao", T.IntegerType()),
                T.StructField("termo", T.StringType()),
                T.StructField("chave", self.texts.schema["chave"].dataType),
                T.StructField("vezes", T.LongType()),
            ]
        )
        return self.texts.mapInArrow(count, schema).groupBy("secao", "termo").agg(
            F.sum("vezes").alias("frequencia"), F.min("chave").alias("primeira")
        )


def wanted_buckets(buckets: DataFrame) -> np.ndarray:
    """A mark for every bucket of every section, set for the rows of ``(secao, balde)``; the size is fixed."""
    found = buckets.select("secao", "balde").toArrow()
    wanted = np.zeros((_SECTIONS, BUCKETS), bool)
    wanted[found["secao"].to_numpy(), found["balde"].to_numpy()] = True
    return wanted


def buckets_of_numbers(numbers: DataFrame) -> np.ndarray:
    """The marks of the buckets that hold the numbers ``(secao, termo)``."""
    return wanted_buckets(numbers.select("secao", F.shiftrightunsigned("termo", 64 - _BUCKET_BITS).alias("balde")))


def buckets_of_sections(sections: Iterable[int]) -> np.ndarray:
    wanted = np.zeros((_SECTIONS, BUCKETS), bool)
    wanted[list(sections)] = True
    return wanted


def last_ranked(counted: DataFrame, limit: int) -> dict[int, int]:
    """Frequency of the last ranked term of each section that has so many."""
    last = top_by_frequency(counted, "secao", limit).where(F.col("posicao") == limit)
    return dict(last.select("secao", "frequencia").collect())


def count_by_buckets(ngrams: Ngrams, limit: int, first_buckets: int = _FIRST_BUCKETS) -> DataFrame:
    """Exact counts of enough n-grams to contain the ``limit`` most frequent of each section, ties included.

    A first pass adds up all n-grams by bucket, in tables of a fixed size. An n-gram is at
    most as frequent as its bucket is full, so a second pass counts the n-grams of the
    fullest buckets, and those that could still reach the last ranked of these are counted
    in a third, if there are any.
    """
    totals = materialise(ngrams.bucket_totals())
    fullest = Window.partitionBy("secao").orderBy(F.desc("total"), "balde")
    first = totals.withColumn("_lugar", F.row_number().over(fullest)).where(F.col("_lugar") <= max(first_buckets, 4 * limit))
    chosen = wanted_buckets(first)
    counted = materialise(ngrams.counted(chosen))
    ranked = last_ranked(counted, limit)
    reached = [F.when(F.col("secao") == s, F.lit(n)) for s, n in ranked.items()]
    others = totals.where(F.col("total") >= F.coalesce(*reached, F.lit(1)))
    rest = wanted_buckets(others) & ~chosen
    return counted.unionByName(ngrams.counted(rest)) if rest.any() else counted
