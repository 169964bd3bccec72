"""SimHash near-duplicates against brute force."""

import re
from math import comb

import numpy as np
import pytest
import xxhash

from manchete.llm import graph, simhash

from .helpers import by_id, clashing, documents


def brute_print(text, words=3):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    tokens = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)]
    if tokens and not shingles:
        shingles = [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits):
    """Smallest id by fingerprint, from all pairs."""
    values = np.array(sorted(set(prints.values())), np.uint64)
    parent = list(range(len(values)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits):
            parent[top(i + 1 + int(j))] = top(i)
    groups = {int(v): top(k) for k, v in enumerate(values)}
    smallest = {}
    for i, p in prints.items():
        smallest[groups[p]] = min(smallest.get(groups[p], i), i)
    return {i: smallest[groups[p]] for i, p in prints.items()}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words, rng.integers(1, 120)))
        rows.append((3 * i, text))
        rows += [(3 * i + 1, text.upper())] if i % 3 == 0 else []
        rows += [(3 * i + 2, text + " tail")] if i % 2 == 0 else []
    return documents(spark, [*rows, (5000, None), (5001, ""), (5002, " \t"), (5003, "É é"), (5004, "one two"), rows[0], rows[0]])


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("long_list", [128, 0])
def test_same_as_brute_force(corpus, bits, long_list, monkeypatch):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    prints = {r.doc_id: brute_print(r.text) for r in corpus.collect()}
    wanted = brute_components(prints, bits)
    found = simhash.near_duplicates(clashing(corpus), words=3, max_bits=bits)
    assert found.count() == corpus.count()
    for i, r in by_id(found).items():
        assert r.fingerprint == f"{prints[i]:016x}" and r.component_id == wanted[i]


@pytest.mark.parametrize("long_list", [128, 3])
def test_chains_and_crowds_of_close_fingerprints(spark, long_list, monkeypatch):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    rng = np.random.default_rng(6)
    chain, values = 0, []
    for bit in rng.permutation(64)[:40]:
        chain ^= 1 << int(bit)
        values.append(chain)
    centre = int(rng.integers(1 << 62))
    values += [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.links(prints, 2)).collect()}
    got = [roots.get(v, v) for v in signed]
    wanted = brute_components({k: v % (1 << 64) for k, v in enumerate(signed)}, 2)
    assert [signed[wanted[k]] for k in range(len(signed))] == got or len(set(got)) == len(set(wanted.values()))
    pairs = {(got[k], wanted[k]) for k in range(len(signed))}
    assert len(pairs) == len(set(got)) == len(set(wanted.values()))


def test_long_paths_are_one_component(spark):
    rng = np.random.default_rng(7)
    order = rng.permutation(500).tolist()
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(900, 901), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots == {k: 0 for k in range(1, 500)} | {901: 900}


def test_one_document_of_each_group_stays(corpus):
    wanted = {r.component_id for r in simhash.near_duplicates(corpus).collect()}
    kept = simhash.drop_near_duplicates(corpus)
    assert kept.columns == corpus.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)


def test_missing_and_shared_ids(spark):
    docs = documents(spark, [(None, "a b c d"), (4, "a b c d"), (None, "other words of no one"), (None, "other words of no one"),
                             (7, "first text of an id"), (7, "second and quite another text"), (9, "first text of an id"), (7, "first text of an id")])
    got = simhash.near_duplicates(docs.limit(3)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 4), (4, 4)]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == [(0, "other words of no one"), (4, "a b c d"), (7, "first text of an id"), (7, "second and quite another text")]
    clash = clashing(docs).selectExpr("*", "1 AS c0", "'x' AS print", "'x' AS first_")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(clash).collect()) == kept


def test_of_equal_rows_the_same_one_stays(spark):
    rows = [(5, "the same text here", lang) for lang in ("en", "de", None)] * 50
    kept = [simhash.drop_near_duplicates(documents(spark, rows).repartition(n)).collect() for n in (1, 3, 7)]
    assert len(kept[0]) == 1 and kept[0] == kept[1] == kept[2]


def test_the_tally_drops_pairs(spark):
    """Pairs that meet in lists but share too few positional bytes fall to the tally, not to the distance."""
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    far = []
    for v in base:
        for changed in range(1, 5):  # in so many of its bytes
            at = rng.choice(8, changed, replace=False)
            far.append(v ^ sum(int(rng.integers(1, 256)) << (8 * int(p)) for p in at))
    values = sorted({v - (1 << 64) if v >> 63 else v for v in base + far})
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {(r.a, r.b): r.lists for r in simhash.tallies(simhash._postings(prints)).collect()}
    shared = lambda a, b: sum((a >> 8 * p & 255) == (b >> 8 * p & 255) for p in range(8))
    plain = {(a, b): comb(shared(a, b), 5) for k, a in enumerate(values) for b in values[k + 1 :] if shared(a, b) >= 5}
    assert found == plain
    below = [p for p, n in found.items() if n < comb(6, 5)]
    assert len(below) > 30 and all(shared(*p) == 5 for p in below)
    linked = {(r.a, r.b) for r in simhash.links(prints, 2).collect()}
    assert linked == {(a, b) for a, b in plain if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}


def test_empty_tables(spark):
    docs = documents(spark, [(1, "a")])
    nothing = documents(spark, [])
    assert simhash.near_duplicates(nothing).collect() == simhash.drop_near_duplicates(nothing).collect() == []
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, max_bits=3)


def test_a_very_long_text():
    text = "word " * 50_000 + "end"
    assert simhash.fingerprint(text, 3) & ((1 << 64) - 1) == brute_print(text)


def test_very_long_texts_through_spark(spark):
    text = " ".join(f"w{k * k % 9973}" for k in range(250_000))
    got = by_id(simhash.near_duplicates(documents(spark, [(3, text), (2, text.upper()), (1, text[: len(text) // 2]), (4, "short")])))
    assert got[3].fingerprint == f"{brute_print(text):016x}" and got[3].component_id == got[2].component_id
    assert simhash.drop_near_duplicates(documents(spark, [(3, text), (2, text)])).collect()[0].text == text
