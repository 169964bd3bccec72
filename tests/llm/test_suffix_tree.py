"""Suffix-tree scores: base scores by brute force, distributions that sum to one, odd inputs."""

import math
from collections import Counter

import numpy as np
import pytest

from manchete.llm import suffix_tree
from manchete.llm.common import remainder

from .helpers import by_id, clashing, documents


def scored(docs):
    return suffix_tree.score_texts(docs, remainder("doc_id", 10) == 0)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    words = ["the", "then", "there", "of", "often", "é", "Über", "x" * 40]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(200)]
    rows += [(200, None), (201, ""), (202, "\x0b \t"), (203, "new words Only here"), (204, "THE the The"), (None, "the lost")]
    return documents(spark, rows + [rows[3], rows[4]])


def test_base_scores_by_brute_force(corpus):
    rows = corpus.select("doc_id", "text", (remainder("doc_id", 10) == 0).alias("held")).collect()

    def tokens(text):
        return [*(text or "").encode().lower().split(), None]

    counts = Counter(t for r in rows if r.held is False for t in tokens(r.text))
    total, distinct = sum(counts.values()), len(counts)
    got = by_id(scored(corpus))
    for r in rows:
        own, found = tokens(r.text), got[r.doc_id]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own)
        assert found.base_score == pytest.approx(base, rel=1e-12)
        assert (found.n_tokens, found.n_known) == (len(own), sum(t in counts for t in own))
        assert (found.train_tokens, found.held_out) == (total, r.held is not False)


def test_rows_repeat_and_other_columns_do_not_matter(corpus):
    plain, other = scored(corpus), scored(clashing(corpus))
    assert plain.count() == corpus.count()
    assert sorted(map(str, plain.collect())) == sorted(map(str, other.collect()))


def test_held_out_texts_are_likelier_than_under_words_alone(spark):
    rng = np.random.default_rng(4)
    parts = ["un", "break", "able", "read", "ing", "re", "do"]
    texts = ["".join(rng.choice(parts, 3)) + " of the " + "".join(rng.choice(parts, 4)) for _ in range(3000)]
    corpus = documents(spark, [(i, " ".join(texts[10 * i : 10 * i + 10])) for i in range(300)])
    held = [r for r in scored(corpus).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_next_symbols_sum_to_one():
    bodies = [b"the then of\n", b"often the\n", b"then there\n"] * 20
    packed = suffix_tree._sequences(bodies)
    sequences, counts, contexts, totals, followers = [], [], [], [], []
    for d in range(suffix_tree.DEPTH + 1):
        keys, n = np.unique(packed & suffix_tree._mask(d + 1), return_counts=True)
        before, at = np.unique(keys >> 8, return_inverse=True)
        # Some sequences are left out, as rare ones are.
        kept = n > 20
        sequences.append(keys[kept]), counts.append(n[kept])
        contexts.append(before), totals.append(np.bincount(at, n).astype(int)), followers.append(np.bincount(at))
    tree = suffix_tree.Tree(sequences, counts, contexts, totals, followers)
    for before in (b"\n\n\n\n\n", b"\n\nthe", b"often", b"zzzzz", b"\n\n\n\no"):
        context = int.from_bytes(before, "big") << 8
        assert (10 ** tree.score(np.arange(256) + context)).sum() == pytest.approx(1, abs=1e-9)


def test_positions_of_bodies_do_not_mix():
    bodies = [b"ab\n", b"\n", b"abcdefgh\n"]
    apart = np.concatenate([suffix_tree._sequences([b]) for b in bodies])
    assert suffix_tree._sequences(bodies).tolist() == apart.tolist()
    assert suffix_tree._sequences([b"abcdefgh\n"])[-1] == int.from_bytes(b"defgh\n", "big")


def test_empty_table_and_nothing_to_learn_from(spark):
    assert scored(documents(spark, [])).collect() == []
    held = [i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 10 == 0][:2]
    rows = scored(documents(spark, [(held[0], "some words"), (held[1], None)])).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [(1, 0, 0), (3, 0, 0)]


def test_a_very_long_text_through_spark(spark):
    text = "some Words of a long text " * 60_000
    found = {r.doc_id: r for r in scored(documents(spark, [(k, "some words") for k in range(20)] + [(100, text)])).collect()}
    long = found[100]
    assert (long.n_tokens, long.n_known if not long.held_out else long.n_tokens) == (6 * 60_000 + 1, 6 * 60_000 + 1)
    assert np.isfinite(long.score) and long.score < long.n_tokens * -0.0 and np.isfinite(long.base_score)
