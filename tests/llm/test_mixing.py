"""Mixing: exact against the SQL form, targets, seats and odd inputs."""

import duckdb
import pytest

from manchete.llm import mixing, oracles
from pyspark.sql import functions as F

from .helpers import clashing, documents

TEXT = "aa bb cc dd "


def mixed(docs):
    return mixing.mix(docs, mixing.cyclic_weights(docs))


def expected(docs):
    documents = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841 (read by name)
    with duckdb.connect() as con:
        con.register("documents", documents)
        return con.execute(oracles.MIX).fetchall()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, TEXT * (1 + i % 40), None, ["a", "b", "c", None, "é"][min(i % 9, 4)]) for i in range(400)]
    rows += [(i, None if i % 2 else "", None, "empty") for i in range(400, 410)]
    return documents(spark, rows + [rows[7], rows[7], (None, "x y z", None, "b")])


def test_same_as_sql(corpus):
    assert rows_of(mixed(corpus)) == sorted(expected(corpus), key=str)


def test_takes_near_targets_and_three_copies_at_most(corpus):
    result = mixed(corpus)
    assert result.where("taken > 3 * size or taken < 0").isEmpty()
    per = result.withColumn("source", F.col("source_size")).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target")
    )
    for r in per.collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target + mixing.BLOCK_WORDS


def test_reruns_agree_however_dealt_out(corpus):
    assert rows_of(mixed(corpus)) == rows_of(mixed(corpus.repartition(7, "text")))


def test_sources_too_many_to_broadcast(corpus, monkeypatch):
    from manchete.llm import common

    wanted = rows_of(mixed(corpus))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert rows_of(mixed(corpus)) == wanted
    monkeypatch.setattr(common, "HOT_SHARE", 3)  # a few sources are hot
    assert rows_of(mixed(corpus)) == wanted


def test_small_sources_stop_at_three_times_their_size(spark):
    docs = documents(spark, [(1, TEXT, None, "b"), (2, TEXT * 100, None, "a")])
    targets = {r.source_size: r.target for r in mixed(docs).collect()}
    assert targets == {4: 12.0, 400: 392.0}


def test_seats_are_those_of_the_highest_quotients(spark):
    votes = {"a": 53_000, "b": 24_000, "c": 23_000, "d": 500}
    for total in (1, 4, 7, 20, 101):
        won = dict.fromkeys(votes, 0)
        for _ in range(total):
            won[max(votes, key=lambda p: (votes[p] / (2 * won[p] + 1), -ord(p)))] += 1
        parties = spark.createDataFrame([(p, v, 10**6) for p, v in votes.items()], "p string, v long, most long")
        got = mixing.seats(parties, "v", F.lit(total).cast("long"), "most", [], [F.col("p")]).collect()
        assert {r.p: r.seats for r in got} == won


def test_a_limit_on_seats_holds(spark):
    parties = spark.createDataFrame([("a", 100, 2), ("b", 100, 50)], "p string, v long, most long")
    got = mixing.seats(parties, "v", F.lit(10).cast("long"), "most", [], [F.col("p")]).collect()
    assert {r.p: r.seats for r in got}["a"] == 2


def test_empty_tables_and_no_words(spark):
    assert mixed(documents(spark, [])).collect() == []
    nothing = mixed(documents(spark, [(1, None), (2, " \n")])).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_clashing_columns(corpus):
    other = clashing(corpus)
    kept = mixing.mix(other, mixing.cyclic_weights(other), keep=("doc_id", "size", "key", "shard"))
    assert kept.columns == ["doc_id", "key", "shard", "size", "source_size", "target", "taken"]
    assert rows_of(kept.drop("key", "shard")) == rows_of(mixed(corpus))
