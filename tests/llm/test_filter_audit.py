"""Document-term matrix and filter audit against brute force."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from manchete.llm import filter_audit, term_matrix

from .helpers import clashing, documents

LABELS = "doc_id long, quality int, toxic int"


def brute_fails(rows):
    """Filters that every row fails, as a set of letters."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    found = []
    for i, text, *_ in rows:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and first[t] < i else set()
        found.append(fails)
    return found


def brute_audit(rows, labels):
    fails = brute_fails(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    result = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order):
                gone = [d for d in left if letter in d[1]]
                result[part, "".join(order), step + 1] = [
                    len(left) - len(gone), len(gone), sum(letter in f for _, f in own) - len(gone),
                    sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
                shapley[letter] += len(gone)
                left = [d for d in left if letter not in d[1]]
        for (p, order, step), row in result.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return result


def audited(spark, rows, labels, clash=False):
    df = documents(spark, rows)
    df = clashing(df).selectExpr("*", "0 AS fails", "0 AS part", "0 AS digest", "0 AS words") if clash else df
    found = filter_audit.audit_filters(df, spark.createDataFrame(labels, LABELS)).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(400)] + ["É", "Über", "naïve", "日本"]
    made = []
    for i in range(160):
        text = " ".join(rng.choice(words[: int(rng.integers(20, 400))], int(rng.integers(1, 500))))
        text = text.upper() if i % 7 == 0 else text
        text += " 5 % off\x0b|\x1cx" if i % 5 == 0 else ""
        made.append((i, text, ["en", "de", None, ""][i % 4]))
    made += [(1000 + i, made[3 * i][1], "en") for i in range(20)]
    made += [(2000, None, "fr"), (2001, "", "fr"), (2002, " \t\n ", None), (None, made[0][1], "en"), (None, None, None)]
    made += [(2003, "long " * 300_000 + "A", "en"), (2004, "  one word A", "de")]
    # Repeated rows, and an id with two texts, one of them another document's.
    return [*made, made[5], made[5], (3, made[1][1], "en"), (3, made[150][1], "en")]


def test_same_as_brute_force(spark, rows):
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 170, 2)] + [(4, 1, 1), (6, None, None), (None, 1, 1), (9999, 1, 1)]
    assert audited(spark, rows, labels, clash=True) == brute_audit(rows, labels)


def test_small_shards_and_buckets_give_the_same_matrix(spark, rows, monkeypatch):
    monkeypatch.setattr(term_matrix, "SHARD_DOCUMENTS", 3)
    monkeypatch.setattr(term_matrix, "SHARD_BYTES", 2000)
    monkeypatch.setattr(term_matrix, "BUCKET_WORDS", 100)
    shards = term_matrix.materialise(term_matrix._local_shards(documents(spark, rows).coalesce(2), "doc_id", "text", "lang"))
    assert term_matrix._buckets(shards) > 5
    words = {r.word: r.term for r in term_matrix.dictionary(shards).collect()}
    wanted = {w for r in rows for w in re.findall("[^\x20\x09-\x0d]+", r[1] or "")}
    assert set(words) == wanted and len(set(words.values())) == len(wanted)
    names = {v: k for k, v in words.items()}
    found, sizes = [], []
    for r in term_matrix.number_terms(shards).collect():
        starts, terms, counts = np.frombuffer(r.starts, np.int64), np.frombuffer(r.terms, np.int64), np.frombuffer(r.counts, np.int32)
        sizes.append(len(r.docs))
        for k, d in enumerate(r.docs):
            a, b = starts[k : k + 2]
            found.append((d.id, tuple(sorted((names[t], c) for t, c in zip(terms[a:b].tolist(), counts[a:b].tolist(), strict=True)))))
    assert max(sizes) <= 3
    plain = [(r[0], tuple(sorted(Counter(re.findall("[^\x20\x09-\x0d]+", r[1] or "")).items()))) for r in rows]
    assert sorted(found, key=repr) == sorted(plain, key=repr)


def test_empty_table_and_no_labels(spark, rows):
    assert audited(spark, [], []) == {}
    assert audited(spark, rows[:9], []) == brute_audit(rows[:9], [])
    assert audited(spark, [(1, None, None)], [(1, 1, 1)]) == brute_audit([(1, None, None)], [(1, 1, 1)])


def test_words_are_shuffled_once_a_shard(spark):
    """A word that all documents hold goes to its bucket once for each shard."""
    df = documents(spark, [(i, "the same words again") for i in range(9000)]).coalesce(2)
    shards = term_matrix.materialise(term_matrix._local_shards(df, "doc_id", "text", "lang"))
    dealt = term_matrix._dealt(shards, 3).collect()
    assert shards.count() < 8 and sorted(w for r in dealt for w in term_matrix._unsqueeze(r.words).split(b" ")) == sorted(b"the same words again".split() * shards.count())


def test_packed_numbers():
    for a in ([], [0], [5, 3, -7, 1 << 40], list(range(0, 10**6, 997))):
        a = np.array(a, np.int64)
        assert (term_matrix._unpack(term_matrix._pack(a)) == a).all()
        assert (term_matrix._unpack_rising(term_matrix._pack_rising(a)) == a).all()
