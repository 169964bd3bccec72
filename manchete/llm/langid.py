"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams of a language, in order. A document's
most frequent n-grams are ranked in the same way, and its distance to a language is the
sum of how far each n-gram is out of place there; n-grams that the profile lacks count as
the length of a profile. The nearest language is the document's.

N-grams have one to three characters, words being padded with a blank on either side. Each
is packed into one integer, 21 bits a character, so counting is a sort of integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manchete.llm.common import map_texts

#: N-grams in a profile.
PROFILE = 300
#: Code points of texts counted together while learning, about.
_CHUNK = 1 << 19
#: What stands for a text without a letter.
UNKNOWN = "und"

Profiles = list[tuple[str, np.ndarray]]


def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_table: np.ndarray | None = None


def _codes(text: str) -> np.ndarray:
    """Lower-case letters of a text between single blanks; empty without a letter."""
    global _table
    if _table is None:
        _table = _letters()
    points = _table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate(([32], points, [32])).astype(np.int64)
    blank = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    points = points[keep]
    return points if len(points) > 1 else points[:0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts together, packed, and how often each occurs."""
    parts = []
    for text in texts:
        c = _codes(text)
        if not len(c):
            continue
        two = c[:-1] << 21 | c[1:]
        # A blank alone says nothing, nor does it in the middle of three.
        parts += [c[c != 32], two, (two[:-1] << 21 | c[2:])[c[1:-1] != 32]]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(parts), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent n-grams in order; equally frequent ones by their number."""
    if len(counts) > PROFILE:
        # Everything down to the least count that can be in the list, ties included.
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:PROFILE]


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """One profile for each non-null `lang`, from all n-grams of all its whole texts.

    Tasks count for themselves and hand over sums, so a language with most of the rows
    is no heavier than others after the map side. What comes to the driver is PROFILE
    numbers a language. Null and empty texts add nothing; a language without a letter
    has no profile; an empty table gives no profile.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[str]] = {}
        held: dict[str, int] = {}

        def out(name: str) -> pa.RecordBatch:
            grams, counts = ngrams(waiting.pop(name))
            held.pop(name)
            return pa.RecordBatch.from_pydict(
                {"lang": pa.array([name] * len(grams), pa.string()), "gram": pa.array(grams), "n": pa.array(counts)}
            )

        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                waiting.setdefault(name, []).append(body)
                held[name] = held.get(name, 0) + len(body)
                if held[name] >= _CHUNK or sum(held.values()) >= 4 * _CHUNK:
                    yield out(max(held, key=held.get))
        for name in list(waiting):
            yield out(name)

    texts = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    total = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    lists: dict[str, list[tuple[int, int]]] = {}
    for row in best.select("lang", "rank", "gram").collect():
        lists.setdefault(row.lang, []).append((row.rank, row.gram))
    return [(name, np.array([g for _, g in sorted(found)], np.int64)) for name, found in sorted(lists.items())]


class Identifier:
    """Nearest profile of a text."""

    def __init__(self, profiles: Profiles):
        self.names = [name for name, _ in profiles]
        # All n-grams of all profiles, sorted, and for each language its rank there.
        self.known = np.unique(np.concatenate([grams for _, grams in profiles] or [np.zeros(0, np.int64)]))
        self.ranks = np.full((len(profiles), len(self.known) + 1), -1, np.int64)
        for k, (_, grams) in enumerate(profiles):
            self.ranks[k, np.searchsorted(self.known, grams)] = np.arange(len(grams))

    def __call__(self, text: str) -> tuple[str, float]:
        """Language and score: 1 less the distance as a share of the largest possible."""
        best = ranked(*ngrams([text]))
        if not len(best) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, best)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != best)] = len(self.known)
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(best))))
        distances = np.minimum(away, PROFILE).sum(axis=1)
        nearest = int(distances.argmin())
        return self.names[nearest], float(1 - distances[nearest] / (PROFILE * len(best)))


def identify(
    df: DataFrame, profiles: Profiles, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns `keep` with lang_pred (`und` without a letter or profile) and score (0 to 1).

    Whole texts are read; equally near languages go by name. Rows stay as they are dealt
    out. Columns of `keep` with a result's name are left out.
    """
    made = Identifier(profiles)

    def predict(texts: list[str]) -> dict[str, list]:
        found = [made(t) for t in texts]
        return {"lang_pred": [name for name, _ in found], "score": [score for _, score in found]}

    rest = [c for c in keep if c not in ("lang_pred", "score")]
    return map_texts(df, rest, text, predict, "lang_pred string, score double")
