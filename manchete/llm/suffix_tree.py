"""Language-model scores by a probabilistic suffix tree.

A text is read as its words, separated by one blank, and one end sign; the symbols are the
bytes of that. The tree holds contexts of up to `DEPTH` bytes. A context enters if it is
frequent (at least `LEAST_SHARE` of all positions) and if its next-symbol distribution
diverges from the one of its longest kept suffix: its symbols must be likelier by
`DIVERGENCE` nats in all. A kept context's distribution is its counts, smoothed by its
suffix's distribution with as much weight as it has distinct next symbols. A position is
scored in the state of the longest kept suffix of what precedes it.

Counts come from all training texts: their number of distinct byte sequences grows with
the corpus and is only ever held in a shuffled table. What is broadcast has a bound:
sequences of each length that have at least LEAST_SHARE of all positions are at most
1 / LEAST_SHARE, and words with FREQUENT of all tokens at most 1 / FREQUENT. The counts of
all other words reach their documents through a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manchete.llm.common import TEXTS_AT_ONCE
from manchete.workspace import materialise

#: Bytes of the longest context.
DEPTH = 5
LEAST_SHARE = 2e-7
DIVERGENCE = 2.0
FREQUENT = 5e-7

_END = b"\n"
_PAD = _END * DEPTH
#: Positions counted or scored at once, and distinct words a task counts before it hands them over.
_POSITIONS = 1 << 19
_WORDS = 200_000


def _mask(symbols: int) -> int:
    return (1 << 8 * symbols) - 1


def _tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space only


def _hash(words: Iterator[bytes]) -> list[int]:
    """Words as signed 64-bit numbers."""
    digest = xxhash.xxh64_intdigest
    return [h - (1 << 64) if h >> 63 else h for h in map(digest, words)]


def _sequences(bodies: list[bytes]) -> np.ndarray:
    """For every position of the bodies the DEPTH bytes before it and its own, packed."""
    stream = np.frombuffer(b"".join([_PAD + b for b in bodies]), np.uint8)
    packed = np.zeros(len(stream) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        packed <<= 8
        packed |= stream[k : len(stream) - DEPTH + k]
    # Bodies follow each other with a pad between them, whose positions are none.
    lengths = np.array([len(b) for b in bodies])
    own = np.ones(len(packed), bool)
    for end in np.cumsum(lengths + DEPTH)[:-1] - DEPTH:
        own[end : end + DEPTH] = False
    return packed[own]


class _Counts:
    """Distinct numbers with counts. Parts wait until merging them pays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.distinct = 0

    def add(self, values: np.ndarray) -> None:
        self.parts.append(np.unique(values, return_counts=True))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > max(self.distinct, _POSITIONS):
            self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([n for _, n in self.parts])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.parts = [(keys[starts], np.add.reduceat(counts, starts))]
        self.waiting, self.distinct = 0, len(starts)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._merge()
        keys, counts = self.parts[0]
        self.__init__()
        return keys, counts


def _counted(texts: DataFrame) -> DataFrame:
    """(is_word, key, n): words (hashed, with the end sign) and byte sequences of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        sequences, bodies, held = _Counts(), [], 0

        def rows(is_word: bool, keys, counts) -> pa.RecordBatch:
            flags = pa.array(np.full(len(keys), is_word))
            return pa.RecordBatch.from_arrays(
                [flags, pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["is_word", "key", "n"]
            )

        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = _tokens(text)
                words.update(found)
                words[_END] += 1
                bodies.append(b" ".join(found) + _END)
                held += len(bodies[-1])
                if held >= _POSITIONS:
                    sequences.add(_sequences(bodies))
                    bodies, held = [], 0
                    if sequences.distinct >= 2 * _POSITIONS:
                        yield rows(False, *sequences.take())
                if len(words) >= _WORDS:
                    yield rows(True, _hash(words), list(words.values()))
                    words.clear()
        if bodies:
            sequences.add(_sequences(bodies))
        yield rows(False, *sequences.take())
        yield rows(True, _hash(words), list(words.values()))

    parts = texts.mapInArrow(count, "is_word boolean, key long, n long")
    return parts.groupBy("is_word", "key").agg(F.sum("n").alias("n"))


class Tree:
    """Kept contexts and the smoothed distributions of their next symbols, in logarithms of ten.

    `sequences[d]` and `counts[d]` are the frequent sequences of d + 1 bytes, sorted;
    `contexts[d]`, `totals[d]` and `followers[d]` the frequent contexts of d bytes with the
    number of their positions and of their distinct next symbols.
    """

    def __init__(self, sequences, counts, contexts, totals, followers):
        parent = np.full(len(sequences[0]), 1 / 256)
        self.contexts, self.rest, self.sequences, self.logs = [], [], [], []
        for d in range(DEPTH + 1):
            if d:
                # Whatever is frequent has a frequent suffix, which is found exactly.
                parent = effective[np.searchsorted(sequences[d - 1], sequences[d] & _mask(d))]
            at = np.searchsorted(contexts[d], sequences[d] >> 8)
            kept = np.bincount(at, counts[d], len(contexts[d]))
            spread = followers[d] + totals[d] - kept  # the weight of the suffix's distribution
            own = (counts[d] + spread[at] * parent) / (totals[d] + followers[d])[at]
            gain = np.bincount(at, counts[d] * np.log(own / parent), len(contexts[d]))
            keeps = (gain >= DIVERGENCE) | (d == 0)
            effective = np.where(keeps[at], own, parent)
            self.contexts.append(contexts[d][keeps])
            self.rest.append(np.log10(spread / (totals[d] + followers[d]))[keeps])
            self.sequences.append(sequences[d][keeps[at]])
            self.logs.append(np.log10(own[keeps[at]]))
        # The empty context knows every symbol.
        first = np.full(256, (self.rest[0][0] if len(self.rest[0]) else 0.0) - np.log10(256))
        first[self.sequences[0]] = self.logs[0]
        self.first = first

    def score(self, packed: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each packed sequence, given those before it."""
        total, open = np.zeros(len(packed)), np.arange(len(packed))
        for d in range(DEPTH, 0, -1):
            if not len(self.contexts[d]):
                continue
            context = packed[open] >> 8 & _mask(d)
            at = np.minimum(np.searchsorted(self.contexts[d], context), len(self.contexts[d]) - 1)
            state = self.contexts[d][at] == context
            sequence = packed[open] & _mask(d + 1)
            if len(self.sequences[d]):
                to = np.minimum(np.searchsorted(self.sequences[d], sequence), len(self.sequences[d]) - 1)
                known = state & (self.sequences[d][to] == sequence)
                total[open[known]] += self.logs[d][to[known]]
            else:
                known = np.zeros(len(open), bool)
            unseen = state & ~known
            total[open[unseen]] += self.rest[d][at[unseen]]
            open = open[~known]
        total[open] += self.first[packed[open] & 255]
        return total


def _grow(counted: DataFrame, positions: int) -> Tree:
    """The tree of the counted byte sequences."""
    least = max(2, int(np.ceil(LEAST_SHARE * positions)))
    lengths = F.array(
        *[F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND(F.lit(_mask(d + 1))).alias("key")) for d in range(DEPTH + 1)]
    )
    each = counted.where("not is_word").select(F.explode(lengths).alias("s"), "n")
    sequences = materialise(each.groupBy("s.d", "s.key").agg(F.sum("n").alias("n")))
    contexts = sequences.groupBy("d", F.shiftright("key", 8).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("f"))

    def frequent(df: DataFrame) -> list[dict[str, np.ndarray]]:
        rows = df.where(F.col("n") >= least).toArrow()
        columns = {c: rows.column(c).to_numpy() for c in df.columns}
        order = np.lexsort((columns["key"], columns["d"]))
        columns = {c: v[order] for c, v in columns.items()}
        return [{c: v[columns["d"] == d] for c, v in columns.items()} for d in range(DEPTH + 1)]

    s, c = frequent(sequences), frequent(contexts)
    return Tree(
        [x["key"] for x in s], [x["n"] for x in s], [x["key"] for x in c], [x["n"] for x in c], [x["f"] for x in c]
    )


def score_texts(
    df: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Scores of all whole texts (null: empty), learnt from those not `held_out` (null: held out).

    `id`, held_out, n_tokens (words and the end), n_known (tokens that training has),
    train_tokens, base_score (of a smoothed word model) and score (the tree's log10
    probability of the text). Rows that repeat count each time and give a row each;
    without training texts no token is known and every byte is equally likely.
    """
    source = df.select(
        F.col(id).alias("__id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    counted = materialise(_counted(source.where("not held_out").select("text")))
    sums = {r.is_word: r for r in counted.groupBy("is_word").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    tokens, distinct = (sums[True].n, sums[True].v) if True in sums else (0, 0)
    tree = _grow(counted, sums[False].n if False in sums else 0)
    words = counted.where("is_word").select("key", "n")
    often = max(1, int(np.ceil(FREQUENT * tokens)))
    table = words.where(F.col("n") >= often).toArrow()
    keys, counts = table.column("key").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(keys)
    keys, logs = keys[order], np.log10(counts[order] + 0.1)
    unknown = float(np.log10(0.1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                found = [_tokens(t) for t in part.column("text").to_pylist()]
                counted = [Counter(f) for f in found]
                for c in counted:
                    c[_END] = 1
                sizes = np.array([len(c) for c in counted])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                hashed = np.array([h for c in counted for h in _hash(c)], np.int64)
                times = np.array([n for c in counted for n in c.values()], np.int64)
                to = np.minimum(np.searchsorted(keys, hashed), max(len(keys) - 1, 0))
                frequent = keys[to] == hashed if len(keys) else np.zeros(len(hashed), bool)
                log = np.where(frequent, logs[to] if len(logs) else 0.0, unknown) * times
                rare = [
                    (hashed[a : a + n][~frequent[a : a + n]].tolist(), times[a : a + n][~frequent[a : a + n]].tolist())
                    for a, n in zip(starts, sizes, strict=True)
                ]
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": np.arange(row, row + len(found)),
                        "__id": part.column("__id"),
                        "held_out": part.column("held_out"),
                        "n_tokens": np.array([len(f) + 1 for f in found], np.int64),
                        "n_frequent": np.add.reduceat(times * frequent, starts),
                        "log": np.add.reduceat(log, starts),
                        "score": _scores(tree, [b" ".join(f) + _END for f in found]),
                        "rare": pa.array([r for r, _ in rare], pa.list_(pa.int64())),
                        "times": pa.array([t for _, t in rare], pa.list_(pa.int64())),
                    }
                )
                row += len(found)

    id_type = source.schema["__id"].dataType.simpleString()
    made = source.mapInArrow(
        score,
        f"row long, __id {id_type}, held_out boolean, n_tokens long, n_frequent long, log double, score double, "
        "rare array<long>, times array<long>",
    )
    scored = materialise(made)
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("key"), F.col("r.times").alias("times")
    )
    # A word that is not frequent has few rows by definition, so the join has no hot key.
    known = rare.join(words.where(F.col("n") < often), "key").groupBy("row").agg(
        F.sum("times").alias("known"),
        F.sum(F.col("times") * (F.log10(F.col("n") + 0.1) - F.lit(unknown))).alias("more"),
    )
    none = float(np.log10(tokens + 0.1 * (distinct + 1)))
    return scored.join(known, "row", "left").select(
        F.col("__id").alias(id),
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(none)).alias("base_score"),
        "score",
    )


def _scores(tree: Tree, bodies: list[bytes]) -> list[float]:
    """Score of every body, for groups of bodies that have about _POSITIONS bytes together."""
    scores, at = [], 0
    while at < len(bodies):
        to, size = at, 0
        while to < len(bodies) and (to == at or size + len(bodies[to]) <= _POSITIONS):
            size += len(bodies[to])
            to += 1
        packed, where = np.unique(_sequences(bodies[at:to]), return_inverse=True)
        values = tree.score(packed)[where]
        starts = np.concatenate(([0], np.cumsum([len(b) for b in bodies[at:to]])[:-1])).astype(np.int64)
        scores += np.add.reduceat(values, starts).tolist()
        at = to
    return scores
