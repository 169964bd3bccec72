"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed words. Beside a weight for each term the machine
learns a short vector for it, and the product of two terms' vectors is the weight of their
meeting in one document: an insult beside the mention of a group counts for more, or less,
than the two alone.

Which terms enter is decided on all labelled documents: a term does if its likelihood
ratio against the label is significant. The machine is then fitted by Spark's FMClassifier on
at most `FIT_ROWS` labelled documents, chosen by a hash of their id and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manchete.llm.common import map_texts
from manchete.workspace import materialise

#: Hashed terms: few enough words share one that the terms of a long text stay its own.
BUCKETS = 1 << 26
#: Likelihood ratio from which a term enters (one chance in a million), and how many may.
SIGNIFICANT = 24.0
MOST_TERMS = 4096
#: Labelled documents that the machine is fitted on at most.
FIT_ROWS = 20_000
#: Labels up to so many are joined by broadcast.
BROADCAST_LABELS = 1_000_000
#: Terms that a task gathers before it counts them.
_GATHERED = 1 << 21

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> list[int]:
    """Hashed distinct lower-case words of a text."""
    digest = xxhash.xxh64_intdigest
    return [digest(w, 42) % BUCKETS for w in set(_WORD.findall(text.lower()))]


@dataclass
class Machine:
    """A fitted machine: its hashed terms, sorted, and their weights and vectors."""

    terms: np.ndarray
    intercept: float
    linear: np.ndarray
    factors: np.ndarray

    def active(self, text: str) -> np.ndarray:
        """Places of the text's terms among the machine's."""
        found = np.unique(np.array(terms(text), np.int64))
        at = np.searchsorted(self.terms, found)
        inside = at < len(self.terms)
        at, found = at[inside], found[inside]
        return at[self.terms[at] == found]

    def __call__(self, text: str) -> float:
        at = self.active(text)
        vectors = self.factors[at]
        # The sum over all pairs of products is half of (square of the sum less sum of squares).
        pairs = 0.5 * float((vectors.sum(axis=0) ** 2 - (vectors**2).sum(axis=0)).sum())
        margin = self.intercept + float(self.linear[at].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def _labelled(df: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> DataFrame:
    """(text, label, order) of documents that have a label; several labels count as their maximum."""
    one = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("__id"))
    known = one.agg(F.max((F.col(label) != 0).cast("long")).alias("label"))
    small = labels.count() <= BROADCAST_LABELS
    texts = df.select(F.col(id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.xxhash64(F.col("__id").cast("string"), "text").alias("order")
    return texts.join(F.broadcast(known) if small else known, "__id").select("text", "label", order)


def _counted(labelled: DataFrame) -> DataFrame:
    """(term, n, toxic): labelled documents that have the term, and those of them labelled 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[list[int]] = [[], []]

        def out() -> pa.RecordBatch:
            either = np.array(gathered[0] + gathered[1], np.int64)
            found, n = np.unique(either, return_counts=True)
            toxic_terms, toxic_n = np.unique(np.array(gathered[1], np.int64), return_counts=True)
            toxic = np.zeros(len(found), np.int64)
            toxic[np.searchsorted(found, toxic_terms)] = toxic_n
            gathered[:] = [[], []]
            return pa.RecordBatch.from_pydict({"term": found, "n": n.astype(np.int64), "toxic": toxic})

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                gathered[label] += terms(text)
                if len(gathered[0]) + len(gathered[1]) >= _GATHERED:
                    yield out()
        yield out()

    parts = labelled.select("text", "label").mapInArrow(count, "term long, n long, toxic long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _telling(counted: DataFrame, documents: int, toxic: int) -> np.ndarray:
    """The most telling terms by likelihood ratio, MOST_TERMS at most, sorted by their number."""
    a, n = F.col("toxic").cast("double"), F.col("n").cast("double")
    total, ones = float(documents), float(toxic)

    def part(seen: Column, rows: Column, columns: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (rows * columns))).otherwise(0.0)

    # The two-by-two table of having the term and being labelled 1.
    score = 2 * (
        part(a, n, F.lit(ones))
        + part(n - a, n, F.lit(total - ones))
        + part(F.lit(ones) - a, total - n, F.lit(ones))
        + part(total - ones - (n - a), total - n, F.lit(total - ones))
    )
    best = counted.withColumn("score", score).where(F.col("score") >= SIGNIFICANT)
    rows = best.orderBy(F.desc("score"), "term").limit(MOST_TERMS).select("term").collect()
    return np.array(sorted(r.term for r in rows), np.int64)


def learn(
    df: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rounds: int = 100,
) -> Machine:
    """A machine fitted to the documents of `df` that `labels` (id, label) marks 1 or 0.

    Null labels and ids are no labels; a null text is empty. Without labelled documents,
    or without telling terms, the machine knows the share of label 1 only (0.5 if none).
    """
    labelled = _labelled(df, labels, id, text, label)
    documents, toxic = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = (toxic + 1) / (documents + 2)
    machine = Machine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, 1)))
    if not 0 < toxic < documents:
        return machine
    machine.terms = _telling(_counted(labelled), documents, toxic)
    if not len(machine.terms):
        return machine

    width = len(machine.terms)
    known = machine

    @F.udf(VectorUDT())
    def vector(body: str):
        at = known.active(body)
        return Vectors.sparse(width, at.tolist(), [1.0] * len(at))

    chosen = labelled.orderBy("order").limit(FIT_ROWS)
    rows = materialise(chosen.select(vector("text").alias("features"), F.col("label").cast("double").alias("label")))
    classifier = FMClassifier(factorSize=4, maxIter=rounds, stepSize=1.0, regParam=1e-5, initStd=0.01, seed=7)
    fitted = classifier.fit(rows)
    return Machine(machine.terms, fitted.intercept, fitted.linear.toArray(), fitted.factors.toArray())


def score(
    df: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3
) -> DataFrame:
    """Columns `keep` with score (0 to 1) and predicted (1 from `threshold` on), of whole texts.

    Null and empty texts have the score of a document without terms. Every row gives a
    row. Columns of `keep` with a result's name are left out.
    """
    rest = [c for c in keep if c not in ("score", "predicted")]
    scored = map_texts(df, rest, text, lambda texts: {"score": [machine(t) for t in texts]}, "score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
