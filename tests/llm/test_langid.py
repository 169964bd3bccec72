"""Rank-order profiles against a plain version, held-out accuracy and odd inputs."""

import zlib
from collections import Counter

import pytest

from manchete.llm import langid

from .helpers import clashing, documents


def plain_ranks(texts):
    """The most frequent n-grams of texts, in order, as tuples of code points."""
    counts = Counter()
    for text in texts:
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        if not words:
            continue
        line = f" {' '.join(words)} "
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                gram = line[i : i + n]
                if not (gram == " " or n == 3 and gram[1] == " "):
                    counts[sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(gram))] += 1
    return sorted(counts, key=lambda g: (-counts[g], g))[: langid.PROFILE]


def plain_language(text, profiles):
    own = plain_ranks([text])
    if not own:
        return langid.UNKNOWN, 0.0
    far = {}
    for name, profile in profiles.items():
        place = {g: k for k, g in enumerate(profile)}
        far[name] = sum(abs(place[g] - k) if g in place else langid.PROFILE for k, g in enumerate(own))
    name = min(far, key=lambda n: (far[n], n))
    return name, 1 - far[name] / (langid.PROFILE * len(own))


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_same_as_the_plain_version(corpus):
    rows = corpus.collect()
    plain = {}
    for lang in {r.lang for r in rows}:
        plain[lang] = plain_ranks([r.text for r in rows if r.lang == lang])
    learnt = langid.learn_profiles(corpus)
    assert {name: grams.tolist() for name, grams in learnt} == plain
    for r in langid.identify(corpus, learnt, keep=("doc_id", "text")).limit(60).collect():
        name, score = plain_language(r.text, plain)
        assert (r.lang_pred, pytest.approx(score)) == (name, r.score)


def test_held_out_accuracy(corpus):
    rows = {r.doc_id: r for r in corpus.collect()}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    profiles = langid.learn_profiles(corpus.where(~corpus.doc_id.isin(list(held))))
    found = langid.identify(corpus, profiles).collect()
    right = [rows[r.doc_id].lang == r.lang_pred for r in found if r.doc_id in held]
    assert sum(right) >= 0.99 * len(right)


def test_odd_texts_and_clashing_columns(spark, corpus):
    profiles = langid.learn_profiles(clashing(corpus))
    texts = [None, "", "12 345 !", "日本語", "The", "İ ẞ", "a" * 300_000, "und der die " * 40_000]
    docs = clashing(documents(spark, list(enumerate(texts)))).withColumnRenamed("score", "lang_pred")
    found = langid.identify(docs, profiles, keep=("doc_id", "lang_pred", "rank")).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found[:3]] == ["und"] * 3 and [r.score for r in found[:3]] == [0.0] * 3
    assert all(0 <= r.score <= 1 and r["rank"] == "x" for r in found)
    assert found[7].lang_pred == "de"


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "words", None), (2, None, "en"), (3, "123", "de")])
    assert langid.learn_profiles(docs) == langid.learn_profiles(documents(spark, [])) == []
    assert [r.lang_pred for r in langid.identify(docs, []).collect()] == ["und"] * 3
    assert langid.identify(documents(spark, []), []).collect() == []


def test_texts_counted_in_pieces(spark, corpus, monkeypatch):
    whole = {name: grams.tolist() for name, grams in langid.learn_profiles(corpus)}
    monkeypatch.setattr(langid, "_CHUNK", 500)
    assert {name: grams.tolist() for name, grams in langid.learn_profiles(corpus)} == whole
