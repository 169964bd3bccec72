"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages and windows of documents are TF-IDF vectors over the passages' words,
with document frequencies counted in all documents. A randomised singular value
decomposition of the passages' matrix, its products formed where the rows are, gives a
latent space. Every document is covered by half-overlapping windows of several lengths;
windows whose weight lies in the passages' words to some part are projected, and passages
near by cosine are candidates. A candidate is a leak if the longest common subsequence of
passage and document words is long, or less long and the passage's answer, its last words,
is there too. Beside that, the words of every passage are looked up as a sequence, so copies
do not depend on windows or weights.

Passages are handled about `AT_ONCE` at a time, so what is broadcast is bounded; documents are
read once for the frequencies and once for each such part, and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manchete.llm.common import map_texts
from manchete.workspace import materialise

#: Passages searched for at once, about, latent dimensions, and random directions beyond these.
#: A part of more passages has a dimension for each: with fewer, copies would lose cosine.
AT_ONCE = 256
RANK, BEYOND = 256, 16
SEED = 7
#: Shortest passages that can be found in other words, and word for word.
LEAST_WORDS, EXACT_WORDS = 5, 3
#: A window is projected if so much of its squared weight lies in words of passages.
LEAST_MASS = 0.3
COSINE = 0.3
#: Shares of a passage's words in common order: enough alone, and with the answer.
VERBATIM, PARAPHRASE = 0.8, 0.5
#: Words of the answer, and the share of them in common order.
ANSWER_WORDS, ANSWER_SHARE = 5, 0.8

#: Windows projected at once.
_WINDOWS = 1024

_WORD = re.compile(r"[^\W_]+")
_HITS = "array<struct<item_id:long,first_word:int,n_words:int,cosine:double,lcs:double,answer:boolean>>"


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def common_length(own: list[str], other: list[str]) -> int:
    """Length of the longest common subsequence, a bit of an integer for each word of `own`."""
    places: dict[str, int] = {}
    for k, word in enumerate(own):
        places[word] = places.get(word, 0) | 1 << k
    full = (1 << len(own)) - 1
    open = full
    for word in other:
        at = open & places.get(word, 0)
        open = ((open + at) | (open - at)) & full
    return len(own) - open.bit_count()


@dataclass
class Passages:
    """Passages of one part, the weights of their words, and their latent space."""

    ids: list[int]
    words: list[list[str]]
    terms: dict[str, int]
    weights: np.ndarray
    anchors: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    numbers: list[np.ndarray] = field(default_factory=list)
    squares: np.ndarray = field(default_factory=lambda: np.zeros(2))
    weighed: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    places: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def __post_init__(self) -> None:
        self.numbers = [np.array([self.terms[w] for w in own], np.int64) for own in self.words]
        # Each passage by the rarest of its words, with the word's place in it.
        for k, own in enumerate(self.numbers):
            if len(own):
                place = int(np.argmax(self.weights[own]))
                self.anchors.setdefault(int(own[place]), []).append((k, place))
        # Squared weights by term; other words (-1) have the usual one.
        usual = float(np.median(self.weights)) if len(self.weights) else 0.0
        self.squares = np.concatenate((self.weights**2, [usual**2]))

    def vector(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of passage `k`, none if it is only found word for word."""
        at = np.unique(self.numbers[k] if len(self.words[k]) >= LEAST_WORDS else np.zeros(0, np.int64))
        return at, self.weights[at]

    def lengths(self) -> list[int]:
        """Window lengths: powers of two from about the shortest passage up to the longest."""
        sizes = [len(w) for w in self.words if len(w) >= LEAST_WORDS] or [16]
        least = 4 if min(sizes) >= 12 else 3 if min(sizes) >= 6 else 2
        return [1 << k for k in range(least, max(least, (max(sizes) - 1).bit_length()) + 1)]

    def candidates(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, passage, start, length, cosine) of windows near a passage.

        `ids` has the words of several documents as terms, or -1 for other words; document k
        is between bounds k and k + 1.
        """
        squares, sizes = self.squares, np.diff(bounds)
        # Repeated terms count each time here, which can only let more windows through.
        inside = np.concatenate(([0.0], np.cumsum(np.where(ids >= 0, squares[ids], 0.0))))
        outside = np.concatenate(([0.0], np.cumsum(np.where(ids < 0, squares[ids], 0.0))))
        for length in self.lengths():
            step = length // 2
            windows = np.where(sizes > 0, np.maximum(-(-(sizes - step) // step), 1), 0)
            document = np.repeat(np.arange(len(sizes)), windows)
            number = np.arange(len(document)) - np.repeat(np.cumsum(windows) - windows, windows)
            starts = bounds[document] + number * step
            ends = np.minimum(starts + length, bounds[document + 1])
            mass, rest = inside[ends] - inside[starts], outside[ends] - outside[starts]
            near = np.flatnonzero((mass > 0) & (mass >= LEAST_MASS * (mass + rest)))
            for at in range(0, len(near), _WINDOWS):
                some = near[at : at + _WINDOWS]
                # (window, term) pairs, each once and in order.
                spans = ends[some] - starts[some]
                window = np.repeat(np.arange(len(some)), spans)
                term = ids[np.arange(len(window)) + np.repeat(starts[some] - np.cumsum(spans) + spans, spans)]
                window, term = np.divmod(np.unique((window * len(squares) + term)[term >= 0]), len(squares))
                first = np.searchsorted(window, np.arange(len(some)))
                latent = np.add.reduceat(self.weighed[term], first, axis=0)
                # The window's length counts in full, what lies outside the latent space included.
                norms = np.sqrt(np.bincount(window, squares[term], len(some)) + rest[some])
                cosines = latent @ self.places.T / norms[:, None]
                for row, passage in zip(*np.nonzero(cosines >= COSINE), strict=True):
                    k = some[row]
                    yield int(document[k]), int(passage), int(number[k]) * step, length, float(cosines[row, passage])

    def verbatim(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, passage, first word) of passages whose words all follow each other."""
        known = np.zeros(len(self.squares), bool)
        known[list(self.anchors)] = True
        places = np.flatnonzero(known[ids])
        places = places[np.argsort(ids[places], kind="stable")]
        terms, first = np.unique(ids[places], return_index=True)
        for term, own in zip(terms.tolist(), np.split(places, first[1:]), strict=False):
            for passage, place in self.anchors[term]:
                numbers, starts = self.numbers[passage], own - place
                document = np.searchsorted(bounds, own, "right") - 1
                inside = (starts >= bounds[document]) & (starts + len(numbers) <= bounds[document + 1])
                starts, document = starts[inside], document[inside]
                for k, number in enumerate(numbers):
                    same = ids[starts + k] == number
                    starts, document = starts[same], document[same]
                    if not len(starts):
                        break
                for d, start in zip(document.tolist(), starts.tolist(), strict=True):
                    yield d, passage, start - int(bounds[d])

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, float, float, bool]]]:
        """Leaks in each text: item, first word, words, cosine, share in common order, answer found."""
        documents = [_words(t) for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in documents], dtype=np.int64)))
        flat = map(self.terms.get, chain.from_iterable(documents), repeat(-1))
        ids = np.fromiter(flat, np.int64, bounds[-1])
        best: dict[tuple[int, int], tuple] = {}
        tried: set[tuple[int, int, int]] = set()
        for document, passage, start in self.verbatim(ids, bounds):
            best.setdefault((document, passage), (self.ids[passage], start, len(self.words[passage]), 1.0, 1.0, True))
        copied = set(best)
        for document, passage, start, length, cosine in self.candidates(ids, bounds):
            if (document, passage) in copied:
                continue
            words, own = documents[document], self.words[passage]
            size = len(own) + len(own) // 4
            step = max(1, len(own) // 4)
            first = max(0, start - len(own)) // step * step
            # Words in common order are words in common: places of a part that have one of the
            # passage's words, and words of the passage that a part has.
            inside = np.zeros(len(self.squares), bool)
            inside[self.numbers[passage]] = True
            shared = np.concatenate(([0], np.cumsum(inside[ids[bounds[document] + first : bounds[document] + start + length + size]])))
            # A document's end cuts its last parts short; what follows it is not theirs.
            shared = shared[: len(words) - first + 1]
            parts = np.arange(first, min(len(words), start + length), step)
            counts = shared[np.minimum(parts - first + size, len(shared) - 1)] - shared[parts - first]
            for at in parts[counts >= PARAPHRASE * len(own)].tolist():
                if (document, passage, at) in tried:
                    continue
                tried.add((document, passage, at))
                part = words[at : at + size]
                present = set(part)
                if sum(w in present for w in own) < PARAPHRASE * len(own):
                    continue
                share = common_length(own, part) / len(own)
                known = best.get((document, passage))
                if share >= PARAPHRASE and (known is None or share > known[4]):
                    answer = own[-ANSWER_WORDS:]
                    found = common_length(answer, part) >= ANSWER_SHARE * len(answer)
                    if found or share >= VERBATIM:
                        best[document, passage] = (self.ids[passage], at, len(part), cosine, share, found)
        found_in: list[list[tuple]] = [[] for _ in texts]
        for document, passage in sorted(best):
            found_in[document].append(best[document, passage])
        return found_in


def _frequencies(df: DataFrame, text: str, terms: dict[str, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and for each term the number of documents that have it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                n[-1] += 1
                n[[terms[w] for w in terms.keys() & set(_words(body))]] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": at, "n": n[at]})

    rows = df.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(terms) + 1, np.int64)
    for row in rows:
        total[row.term] = row.n
    return int(total[-1]), total[:-1]


def _summed(df: DataFrame, function, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks of the matrix that `function` makes of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += function(batch)
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    return sum((np.frombuffer(r.m).reshape(shape) for r in df.mapInArrow(run, "m binary").toLocalIterator()), np.zeros(shape))


def _decompose(rows: DataFrame, terms: int, rank: int = RANK) -> np.ndarray:
    """At most `rank` right singular vectors of the matrix whose rows are `at` and `weight` arrays, a row per term.

    Halko's method: the range of random combinations of the columns is made orthonormal
    through its Gram matrix; projecting the rows on it leaves a small matrix to decompose.
    """
    directions = rank + BEYOND

    def image(batch: pa.RecordBatch) -> np.ndarray:
        chance = np.random.default_rng(SEED).standard_normal((terms, directions))
        pairs = zip(batch.column("at").to_pylist(), batch.column("weight").to_pylist(), strict=True)
        return np.array([np.array(w) @ chance[np.array(a, np.int64)] for a, w in pairs]).reshape(-1, directions)

    def gram(batch: pa.RecordBatch) -> np.ndarray:
        y = image(batch)
        return y.T @ y

    values, vectors = np.linalg.eigh(_summed(rows, gram, (directions, directions)))
    good = values > max(values.max(initial=0.0), 0.0) * 1e-10
    whiten = vectors[:, good] / np.sqrt(values[good])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            q = image(batch) @ whiten
            for k, (at, weight) in enumerate(zip(batch.column("at").to_pylist(), batch.column("weight").to_pylist(), strict=True)):
                for a, w in zip(at, weight, strict=True):
                    total[a] = total.get(a, 0.0) + w * q[k]
        keys = sorted(total)
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(keys, pa.int64()), "b": pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))}
        )

    parts = rows.mapInArrow(projected, "term long, b array<double>").groupBy("term").agg(
        F.array(*[F.sum(F.col("b")[k]) for k in range(int(good.sum()))]).alias("b")
    )
    small = np.zeros((terms, int(good.sum())))
    for row in parts.toLocalIterator():
        small[row.term] = row.b
    values, vectors = np.linalg.eigh(small.T @ small)
    top = np.argsort(-values)[:rank]
    top = top[values[top] > max(values.max(initial=0.0), 0.0) * 1e-10]
    return small @ vectors[:, top] / np.sqrt(values[top])


def _parts(df: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str) -> Iterator[Passages]:
    """The benchmark, about AT_ONCE passages at a time, each part with its latent space."""
    spark = df.sparkSession
    long_enough = F.size(F.regexp_extract_all(F.lower(item_text), F.lit(r"([\p{L}\p{N}]+)"), 1)) >= EXACT_WORDS
    known = benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).where(long_enough)
    numbered = materialise(known.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).distinct())
    parts = max(1, -(-numbered.count() // AT_ONCE))
    for part in range(parts):
        rows = numbered.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).orderBy("item", "text").collect()
        words = [_words(r.text) for r in rows]
        if not rows:
            continue
        terms = {w: k for k, w in enumerate(sorted({w for own in words for w in own}))}
        documents, found = _frequencies(df, text, terms)
        weights = np.log((documents + 1) / (found + 1)) + 1
        passages = Passages([r.item for r in rows], words, terms, weights)
        vectors = [passages.vector(k) for k in range(len(rows))]
        matrix = spark.createDataFrame(
            [(at.tolist(), w.tolist()) for at, w in vectors if len(at)], "at array<long>, weight array<double>"
        )
        searched = any(len(at) for at, _ in vectors)
        axes = _decompose(matrix, len(terms), max(RANK, len(rows))) if searched else np.zeros((len(terms), 1))
        passages.weighed = (axes * weights[:, None]).astype(np.float32)
        latent = np.array([passages.weighed[at].sum(axis=0) for at, _ in vectors]).reshape(len(rows), -1)
        norms = np.linalg.norm(latent, axis=1, keepdims=True)
        passages.places = (latent / np.where(norms > 0, norms, 1)).astype(np.float32)
        yield passages


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Leaks: `id`, item_id, first_word, n_words, cosine, lcs, answer, at most one per row and item.

    Whole texts are searched. Null and empty texts hold no leak; passages that are null,
    without id or of fewer than EXACT_WORDS words cannot be found, those of fewer than
    LEAST_WORDS only word for word. Repeated documents give their rows each, repeated passages count
    once. Empty tables give an empty result; other columns are not read.
    """
    result = None
    for passages in _parts(df, benchmark, text, item, item_text):
        hits = map_texts(df, [id], text, lambda texts, own=passages: {"hits": _rows(own, texts)}, f"hits {_HITS}")
        found = hits.select(id, F.explode("hits").alias("hit")).select(id, "hit.*")
        result = found if result is None else result.unionByName(found)
    if result is None:
        nothing = df.select(id, F.explode(F.array().cast(_HITS)).alias("hit"))
        result = nothing.select(id, "hit.*")
    return result


def drop_leaking(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of `df` whose text holds no leak; all columns are kept."""
    kept = df
    for passages in _parts(df, benchmark, text, item, item_text):
        flagged = map_texts(
            kept, df.columns, text, lambda texts, own=passages: {"__leaks": [bool(h) for h in own.find(texts)]}, "__leaks boolean"
        )
        kept = flagged.where("not __leaks").drop("__leaks")
    return kept


def _rows(passages: Passages, texts: list[str]) -> list[list[dict]]:
    names = ("item_id", "first_word", "n_words", "cosine", "lcs", "answer")
    return [[dict(zip(names, hit, strict=True)) for hit in hits] for hits in passages.find(texts)]
