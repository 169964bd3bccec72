"""Decontamination: verbatim and paraphrased passages, the decomposition, odd inputs."""

import numpy as np
import pytest

from manchete.llm import latent

from .helpers import clashing, documents

ITEMS = "item_id long, text string"


def prose(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) if rng.random() < 0.6 else "the" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(14)
    items = [(k, " ".join(prose(rng, int(rng.integers(20, 70))))) for k in range(120)]
    docs, wanted = [], set()
    for i in range(240):
        words = prose(rng, int(rng.integers(5, 400)))
        if i % 2:
            item, text = items[(7 * i) % 120]
            own = text.upper().split()
            if i % 4 == 1:  # a quarter of the words are others, the answer stays
                own = [w if rng.random() > 0.25 or k >= len(own) - 5 else "other" for k, w in enumerate(own)]
            at = int(rng.integers(len(words)))
            words[at:at] = own
            wanted.add((i, item))
        docs.append((i, ", ".join(words)))
    return documents(spark, docs), spark.createDataFrame(items, ITEMS), wanted


def pairs(found):
    return {(r.doc_id, r.item_id) for r in found.collect()}


def test_leaks_are_found_and_nothing_else(corpus):
    docs, items, wanted = corpus
    assert pairs(latent.find_leaks(clashing(docs), clashing(items))) == wanted
    kept = latent.drop_leaking(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(0, 240, 2))


def test_in_several_parts(corpus, monkeypatch):
    docs, items, wanted = corpus
    monkeypatch.setattr(latent, "AT_ONCE", 50)
    assert pairs(latent.find_leaks(docs, items)) == wanted
    assert latent.drop_leaking(docs, items).count() == 120


def test_common_length_by_the_usual_table():
    rng = np.random.default_rng(15)
    for _ in range(300):
        a, b = (list(rng.choice(list("abcd"), rng.integers(0, 12))) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert latent.common_length(a, b) == table[-1, -1]


def test_decomposition_spans_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(16)
    matrix = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 90)) * (rng.random(90) < 0.5)
    rows = [(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r in matrix]
    axes = latent._decompose(spark.createDataFrame(rows, "at array<long>, weight array<double>"), 90)
    assert axes.shape[1] == 6 and np.allclose(axes.T @ axes, np.eye(6), atol=1e-8)
    assert np.allclose(matrix @ axes @ axes.T, matrix, atol=1e-8)
    values = np.linalg.svd(matrix, compute_uv=False)[:6]
    assert np.allclose(np.linalg.norm(matrix @ axes, axis=0), values)


def test_missing_short_repeated_and_empty(spark):
    passage = "one two three four five six seven"
    docs = documents(spark, [(1, passage), (1, passage), (2, None), (3, ""), (None, passage), (4, "one two"), *[(k, "filler words") for k in range(10, 30)]])
    items = spark.createDataFrame([(7, passage), (7, passage), (8, None), (None, passage), (9, "one two"), (10, "!?")], ITEMS)
    found = latent.find_leaks(docs, items)
    assert sorted((r.doc_id or 0, r.item_id) for r in found.collect()) == [(0, 7), (1, 7), (1, 7)]
    assert latent.drop_leaking(docs, items).count() == 23
    nothing = spark.createDataFrame([], ITEMS)
    assert latent.find_leaks(docs, nothing).collect() == [] and latent.drop_leaking(docs, nothing).count() == docs.count()
    empty = documents(spark, [])
    assert latent.find_leaks(empty, items).collect() == latent.drop_leaking(empty, items).collect() == []


def test_a_very_long_text(corpus, spark):
    docs, items, _ = corpus
    text = "the word " * 60_000 + items.where("item_id = 5").first().text + " end" * 10
    found = latent.find_leaks(docs.limit(50).unionByName(documents(spark, [(999, text)])), items)
    assert [(r.item_id, r.lcs) for r in found.where("doc_id = 999").collect()] == [(5, 1.0)]


def test_copies_of_very_many_passages_keep_their_cosine(spark):
    """1400 passages of unequal lengths: each one's copy, and its copy with every tenth word replaced."""
    rng = np.random.default_rng(18)
    vocabulary = [f"v{k}" for k in range(9000)]
    items = [(k, " ".join(rng.choice(vocabulary, int(rng.integers(15, 300) if k % 2 else rng.integers(15, 60))))) for k in range(1400)]
    docs = [(k, text) for k, text in items]
    docs += [(2000 + k, " ".join("other" if j % 10 == 3 else w for j, w in enumerate(text.split()))) for k, text in items]
    found = pairs(latent.find_leaks(documents(spark, docs).repartition(8), spark.createDataFrame(items, ITEMS)))
    assert found == {(k, k) for k in range(1400)} | {(2000 + k, k) for k in range(1400)}


def test_short_passages_and_few_telling_words(spark):
    """Passages of 8 to 69 words, and one whose kept words are half of its words but not of their weight."""
    rng = np.random.default_rng(19)
    items = [(k, " ".join(prose(rng, int(rng.integers(8, 70))))) for k in range(120)]
    docs, wanted = [], set()
    for k, text in items:
        own = [w if rng.random() > 0.25 or j >= len(text.split()) - 5 or k % 2 else "other" for j, w in enumerate(text.split())]
        docs.append((k, " ".join([*prose(rng, 60), *own, *prose(rng, 60)])))
        wanted |= {(k, k)} if k % 2 else set()
    items.append((500, "zalpha zbeta zgamma zdelta zepsilon the of and"))
    docs.append((500, "other1 other2 other3 zdelta zepsilon the of and"))
    docs += [(1000 + k, " ".join([*["the of and"] * (k % 3 == 0), *prose(rng, 100)])) for k in range(200)]
    found = pairs(latent.find_leaks(documents(spark, docs), spark.createDataFrame(items, ITEMS)))
    assert wanted | {(500, 500)} <= found
    texts, own = dict(docs), dict(items)
    for doc, item in found:  # each is one by the rule, and all but a few altered copies are found
        a, b = own[item].split(), texts[doc].split()
        assert latent.common_length(a, b) >= latent.PARAPHRASE * len(a)
    assert sum((k, k) in found for k in range(0, 120, 2)) >= 57


def test_common_words_and_short_passages_are_found(spark):
    """Word for word: passages that most documents hold or whose words most documents have, and one of three words."""
    rng = np.random.default_rng(20)
    common, spread, short = "what is the name of the one that was here", "how far is it to the moon", "zed why ex"
    docs = [(k, " ".join([*rng.permutation(common.split()), *prose(rng, 30), *spread.split() * (k % 2), *prose(rng, 30)])) for k in range(100)]
    docs += [(200, f"Yes, {common}?"), (201, " ".join([*prose(rng, 50), *common.split(), *prose(rng, 50)])), (202, f"a {short} b"), (203, "zed ex why")]
    items = spark.createDataFrame([(1, common), (2, spread), (3, short)], ITEMS)
    found = latent.find_leaks(documents(spark, docs), items)
    wanted = {(200, 1), (201, 1), (202, 3)} | {(k, 2) for k in range(1, 100, 2)}
    assert wanted <= pairs(found) and {p for p in pairs(found) if p[1] != 1} == wanted - {(200, 1), (201, 1)}
    assert all(r.lcs == 1.0 for r in found.collect() if (r.doc_id, r.item_id) in wanted)
    assert pairs(latent.find_leaks(documents(spark, docs), items.where("item_id = 3"))) == {(202, 3)}
