"""Factorization machine: held-out accuracy, pairs of terms, odd inputs."""

import numpy as np
import pytest

from manchete.llm import toxicity
from manchete.llm.common import remainder
from pyspark.sql import functions as F

from .helpers import by_id, clashing, documents

LABELS = "doc_id long, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(11)
    words, rows, labels = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)], [], []
    for i in range(1500):
        own = list(rng.choice(words, 40))
        toxic = i % 5 == 0
        if toxic:
            own[int(rng.integers(40))] = ["zzinsult", "zzmean", "zzfoul"][i % 3]
        rows.append((i, " ".join(own).title() + "."))
        labels += [(i, int(toxic))] if i % 4 != 3 else []
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


def test_held_out_documents(corpus):
    docs, labels = corpus
    held = remainder("doc_id", 4) == 2
    machine = toxicity.learn(clashing(docs.where(~held)), labels.withColumn("term", F.lit(1)))
    found = toxicity.score(clashing(docs), machine, keep=("doc_id", "fp", "score")).where(held).collect()
    assert "fp" in found[0].asDict() and len(found) > 300
    assert all(r.predicted == (r.doc_id % 5 == 0) == (r.score >= 0.3) and 0 <= r.score <= 1 for r in found)


def test_pairs_are_half_the_square_of_sums_less_the_sum_of_squares():
    rng = np.random.default_rng(12)
    terms = np.sort(np.array([toxicity.terms(w)[0] for w in ("aa", "bb", "cc")]))
    machine = toxicity.Machine(terms, -1.0, rng.normal(size=3), rng.normal(size=(3, 4)))
    margin = -1 + machine.linear.sum() + sum(machine.factors[i] @ machine.factors[j] for i in range(3) for j in range(i))
    assert machine("cc bb AA aa other") == pytest.approx(1 / (1 + np.exp(-margin)))
    assert machine("") == machine("other") == pytest.approx(1 / (1 + np.e))


def test_an_insult_beside_a_group_is_learnt_as_a_pair(spark):
    rng = np.random.default_rng(13)
    rows, labels = [], []
    for i in range(2000):
        insult, group = bool(rng.integers(2)), bool(rng.integers(2))
        text = " ".join([*(["insult"] if insult else []), *(["group"] if group else []), f"x{chr(97 + i % 20)}"])
        rows.append((i, text)), labels.append((i, int(insult and group)))
    machine = toxicity.learn(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    assert machine("insult group") > 0.5 > max(machine("insult"), machine("group"), machine(""))


def test_counts_in_pieces_are_the_same(corpus, monkeypatch):
    docs, labels = corpus
    labelled = toxicity._labelled(docs, labels, "doc_id", "text", "toxic")
    whole = sorted(map(tuple, toxicity._counted(labelled).collect()))
    monkeypatch.setattr(toxicity, "_GATHERED", 100)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    labelled = toxicity._labelled(docs, labels, "doc_id", "text", "toxic")
    assert sorted(map(tuple, toxicity._counted(labelled).collect())) == whole


def test_missing_and_repeated_labels_and_empty_tables(spark):
    docs = documents(spark, [(1, None), (2, ""), (None, "x"), (1, None)])
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (9, 1)], LABELS)
    for labels in (none, odd):
        machine = toxicity.learn(docs, labels)
        assert len(machine.terms) == 0
        assert len({r.score for r in toxicity.score(docs, machine).collect()}) == 1
    assert toxicity._labelled(docs, odd, "doc_id", "text", "toxic").select("label").collect() == [(1,)]
    empty = documents(spark, [])
    assert toxicity.score(empty, toxicity.learn(empty, none)).collect() == []
    assert by_id(toxicity.score(docs, toxicity.learn(docs, none)))[2].score == 0.5


def test_a_very_long_text_through_spark(spark):
    machine = toxicity.Machine(np.sort(np.array(toxicity.terms("bad"), np.int64)), -2.0, np.array([5.0]), np.zeros((1, 4)))
    rows = [(1, "word and more of it " * 80_000 + "bad"), (2, "word " * 400_000)]
    got = by_id(toxicity.score(documents(spark, rows), machine))
    assert got[1].score == machine(rows[0][1]) > 0.9 and got[1].predicted == 1 and got[2].predicted == 0
