"""Searches in a trigram index against reading everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from manchete.operators.search_index import _postings, candidate_rows, postings, search_index, trigrams, write_search_index
from manchete.operators.selection import search_articles

COLUMNS = "row_id long, titulo string, subtitulo string, texto_completo string, nome_reporter string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = ["galo", "Água", "ÁGUA", "São João", "eleição", "de", "a", "I", "İstanbul", "日本語", "🙂🙂🙂", "ΟΔΟΣ", "x.y*z", "linha\nnova", "ﬁm"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(k * 3, text(3), text(4) if k % 3 else None, text(12), "galo") for k in range(900)]
    rows += [(5000, "raríssimo", None, None, None), (None, "sem número, raríssimo", None, None, None), (5001, None, None, None, None)]
    rows += [(5002, None, None, "muito longo " * 20_000 + "agulha", None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("indice") / "i")
    write_search_index(corpus, path, block_rows=64)
    return path


TERMS = ["galo", "GALO", "água", "são joão", "João galo", "eleição de", "日本語", "🙂🙂", "🙂🙂🙂", "οδος", "ΟΔΟΣ ", "x.y*z", "linha\nnova", "ﬁm",
         "i̇stanbul", "İSTANBUL", "raríssimo", "agulha", "longo agulha", "não está", "zzz", "a", "de", "", "I", "%", "\\", "'"]


@pytest.mark.parametrize("term", TERMS)
def test_same_as_reading_everything(spark, corpus, index, term):
    wanted = search_articles(corpus, term)
    got = search_index(spark, index, term)
    assert got.schema == corpus.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))


def test_trigrams(column):
    assert column(trigrams, ["abcabcd", "ab", "", None, "🙂aÉ", "a\nb"]) == [["abc", "bca", "cab", "bcd"], [], [], None, ["🙂aé"], ["a\nb"]]


def test_a_search_reads_few_blocks(spark, corpus, index):
    """Of the blocks of a rare term only its own, and that of rows without id, are opened."""
    everything = len(spark.read.parquet(f"{index}/artigos").inputFiles())
    rare = search_index(spark, index, "raríssimo")
    scanned = rare._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(isnull(bloco" in scanned
    read = rare.select(F.input_file_name()).distinct().count()
    assert read <= 2 < everything
    assert [r.linha for r in candidate_rows(spark, index, "raríssimo").collect()] == [5000]
    assert candidate_rows(spark, index, "não está").count() == 0 and candidate_rows(spark, index, "ab") is None


def test_postings_are_pruned_by_trigram(spark, index):
    postings = spark.read.parquet(f"{index}/ocorrencias").where(F.col("trigrama").isin("gal", "alo"))
    assert "PushedFilters: [In(trigrama, [alo,gal])]" in postings._jdf.queryExecution().executedPlan().toString()


def test_empty_table_and_no_text_column(spark, corpus, tmp_path):
    write_search_index(corpus.limit(0), str(tmp_path / "e"))
    assert search_index(spark, str(tmp_path / "e"), "galo").count() == 0
    assert search_index(spark, str(tmp_path / "e"), "g").columns == corpus.columns
    with pytest.raises(ValueError, match="no text column"):
        write_search_index(corpus.select("row_id", "nome_reporter"), str(tmp_path / "n"))


def brute_postings(rows):
    return sorted((t, k) for k, texts in rows for t in {x.lower()[i : i + 3] for x in texts if x for i in range(len(x.lower()) - 2)})


@pytest.mark.parametrize("chunk_chars", [1, 60, 1_000_000])
def test_postings_hold_every_trigram_of_every_row_once(spark, chunk_chars):
    rng = random.Random(3)
    signs = "abAÉ \n\x00日\U0001f642%"
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
    rows = [(k * 7 - 40, text(), text()) for k in range(60)] + [(2**60, "aaaa", "aaa"), (2**61, None, None), (2**62, "", "ab")]
    df = spark.createDataFrame([*rows, (None, "abc", "abc")], "n long, titulo string, texto_completo string").repartition(2)
    lists = postings(df, ["titulo", "texto_completo"], "n", chunk_chars).collect()
    got = [(r.trigrama, k) for r in lists for k in r.linhas]
    assert sorted(got) == brute_postings([(k, texts) for k, *texts in rows])


def test_a_chunk_has_one_list_a_trigram(spark, tmp_path):
    """Far fewer rows are dealt and sorted than there are pairs of trigram and article."""
    df = spark.createDataFrame([(k, "muitas vezes a mesma coisa") for k in range(500)], "row_id long, titulo string").coalesce(1)
    write_search_index(df, str(tmp_path / "l"), block_rows=1000)
    stored = spark.read.parquet(str(tmp_path / "l" / "ocorrencias"))
    assert stored.count() == 24
    assert {r.linhas for r in spark.read.parquet(str(tmp_path / "l" / "frequencias")).collect()} == {500}
    assert search_index(spark, str(tmp_path / "l"), "MESMA").count() == 500


def test_very_many_different_characters():
    """Numbers of trigrams and rows that 63 bits cannot hold: the rows are halved."""
    everything = "".join(chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000)
    found = [(t, k) for batch in _postings([(everything,), ("abc",)] * 5, np.arange(10)) for t, rows in zip(*(c.to_pylist() for c in batch.columns)) for k in rows if t in ("abc", "\U0010fffd\U0010fffe\U0010ffff")]
    assert sorted(found) == sorted([("abc", k) for k in range(10)] + [("\U0010fffd\U0010fffe\U0010ffff", k) for k in range(0, 10, 2)])
    assert list(_postings([("",), ("ab",)], np.arange(2))) == []
    assert list(_postings([("",)], np.arange(1))) == []
