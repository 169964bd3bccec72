"""Repeated lines against brute force; the filters on their own."""

import re

import numpy as np
import pytest
import xxhash

from manchete.llm import line_dedup

from .helpers import clashing, documents


def brute_key(line):
    key = re.sub("[A-Z]", lambda m: m.group().lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    return key if len(key) >= 40 else None


def brute(rows, min_docs=5):
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and brute_key(line) is not None:
                held.setdefault(brute_key(line), set()).add(i)
    last = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    result = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or brute_key(x) not in last or last[brute_key(x)] == i]
        result.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(result, key=repr)


def found(df, **options):
    rows = line_dedup.drop_repeated_lines(df, **options)
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    shared = [f"a shared line number {k} that is long enough to count" for k in range(30)]
    shared += ["ÉÀ" * 19 + "ab", "ÉÀ" * 19 + "a", "x" * 40, "y" * 39, "a cookie notice\tof the site, which all have\x0bhere"]
    made = []
    for i in range(120):
        lines = [f"own line {i} {k} " + "word " * int(rng.integers(0, 20)) for k in range(int(rng.integers(0, 6)))]
        lines += [("  " + s.upper() + "\t\r") if rng.random() < 0.3 and s.isascii() else s for s in rng.choice(shared, int(rng.integers(0, 8)))]
        made.append((i, "\n".join(rng.permutation(lines)) if lines else None))
    four = "this line is in four documents only, and so it stays there"
    made += [(500 + i, f"{four}\n{i}") for i in range(4)]
    made += [(600 + i, "this line closes five documents, the last of which keeps it\n" * 2) for i in range(5)]
    made += [(700, ""), (701, "\n"), (702, "\n\n" + shared[0] + "\n"), (703, "z" * 200_000 + "\n" + shared[1])]
    # Rows without id, repeated rows, and an id with several texts.
    made += [(None, shared[2] + "\nnone"), (None, None), (None, four), made[7], made[7], (8, shared[3]), (8, shared[3] + "\n" + shared[4])]
    return made


def test_same_as_brute_force(spark, rows):
    assert found(documents(spark, rows)) == brute(rows)
    assert found(documents(spark, rows), min_docs=1) == brute(rows, min_docs=1)


def test_full_filters_change_nothing(spark, rows, monkeypatch):
    """One slice that 30 times its bits pass through lets all lines be candidates."""
    monkeypatch.setattr(line_dedup, "MOST_SLICES", 1)
    monkeypatch.setattr(line_dedup, "HASHES", 4)
    monkeypatch.setattr(line_dedup, "_GATHERED", 7)
    assert found(documents(spark, rows).repartition(5)) == brute(rows)


def test_hot_lines_go_in_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK_DOCUMENTS", 9)
    assert found(documents(spark, rows)) == brute(rows)


def test_empty_table_and_clashing_columns(spark, rows):
    assert found(documents(spark, [])) == []
    assert found(documents(spark, [(1, None)])) == [(1, "", 1, 0)]
    df = clashing(documents(spark, rows)).selectExpr("*", "'x' AS c0", "'x' AS c1", "'x' AS lines", "'x' AS n_dropped", "'x' AS drops", "'x' AS doc")
    kept = line_dedup.drop_repeated_lines(df)
    assert kept.columns == [c for c in df.columns if c != "n_dropped"] + ["n_lines", "n_dropped"]
    assert {r.c1 for r in kept.collect()} == {"x"}
    assert found(df) == brute(rows)


def test_filters_lose_nothing_and_leave_most_out(spark):
    """What occurs twice is in the filter; of what occurs once, next to nothing is."""
    line = "a line of text with number {} that is long enough for the filter".format
    once = [(i, "\n".join(line(f"{i}-{k}") for k in range(20))) for i in range(300)]
    twice = [(1000 + i, line(f"{i}-0")) for i in range(300)]
    df = documents(spark, once + twice).repartition(6)
    slices = line_dedup._slices_for(df, "text")
    filter = line_dedup.twice_filter(df, "text", 40, slices)
    hashes = lambda texts: np.array([xxhash.xxh3_64_intdigest(t.encode()) for t in texts], np.uint64)
    assert line_dedup.in_filter(filter, hashes([t for _, t in twice])).all()
    single = [x for _, t in once for x in t.split("\n")[1:]]
    assert line_dedup.in_filter(filter, hashes(single)).mean() < 0.01
