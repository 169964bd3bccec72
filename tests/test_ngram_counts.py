"""N-grams cut from arrays against those cut by SQL expressions."""

import random

import pytest
from pyspark.sql import functions as F

from manchete import schema as S
from manchete.functions.text import portuguese_stop_words
from manchete.operators import ngram_counts, terms
from manchete.operators.ngram_counts import Ngrams, buckets_of_sections, count_by_buckets, cut_words
from manchete.sinks.csv_tables import write_term_stats
from manchete.sources.news_csv import CSV_OPTIONS

STOP = ["uma", "tempo", "de", "DIA", "x y z"]
FIELDS = [(0, "titulo"), (1, "subtitulo"), (2, "texto_completo")]
COLUMNS = "row_id long, titulo string, subtitulo string, texto_completo string"


def odd_text(rng):
    signs = "abcAÇçãÃñß-−.,0\x00�́\U0001f642日" + "".join(chr(p) for first, last in S.WHITESPACE_RANGES for p in (first, last))
    words = ["casa", "Uma", "tempo", "DIA", "dia", "pão-de-ló", "ab", "fim.Depois", "ÀÉÇ", "x"]
    return "".join(rng.choice(words) + rng.choice(signs) if rng.random() < 0.7 else rng.choice(signs) for _ in range(rng.randrange(40)))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    rows = [(k // 2 if k % 7 else None, *(None if rng.random() < 0.1 else odd_text(rng) for _ in range(3))) for k in range(200)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def rows(df):
    return sorted(map(repr, df.select("secao", "termo", "frequencia", "primeira").collect()))


@pytest.mark.parametrize("sizes", [(1, 2, 3), (3,), (1,)])
@pytest.mark.parametrize("stop", [STOP, []])
def test_same_terms_as_the_expressions(spark, odd, sizes, stop):
    texts = terms.stack_texts(odd, FIELDS, "row_id")
    got = Ngrams(texts, stop, sizes).counted(buckets_of_sections(range(10)))
    assert rows(got) == rows(terms._counted(terms._ngrams(texts, stop, sizes)))


def test_bytes_that_are_no_text_and_chunks(spark, odd):
    broken = odd.select("row_id", F.decode(F.encode("titulo", "UTF-16"), "ISO-8859-1").alias("titulo"), F.expr("cast(unhex('63617361FF80206E6F7661') as string)").alias("subtitulo"), "texto_completo")
    texts = terms.stack_texts(broken, FIELDS, "row_id")
    got = Ngrams(texts, STOP, (1, 2, 3), chunk_chars=50).counted(buckets_of_sections(range(10)))
    assert rows(got) == rows(terms._counted(terms._ngrams(texts, STOP, (1, 2, 3))))


def test_chunks_have_the_same_numbers():
    def numbers(texts):
        words = cut_words(texts, "uma")
        return [int(x) for n, _, found in ngram_counts._grams(words, (1, 2, 3)) for x in found]

    assert sorted(numbers(["casa nova", "velha casa uma nova casa"])) == sorted(numbers(["casa nova"]) + numbers(["velha casa uma nova casa"]))


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    true, used = ngram_counts._hashes, []

    def alike(letters, start, end, base):
        used.append(base)
        return true(letters, start, end, base) % 2 if len(used) == 1 else true(letters, start, end, base)

    monkeypatch.setattr(ngram_counts, "_hashes", alike)
    words = cut_words(["casa nova uma casa velha"], "uma")
    assert len(used) == 2
    assert words.word[0] == words.word[2] and len(set(words.word.tolist())) == 3
    monkeypatch.setattr(ngram_counts, "_hashes", lambda *a: true(*a) % 2)
    with pytest.raises(ArithmeticError):
        cut_words(["casa nova velha"], "")


def frequent(spark):
    """A few frequent terms among very many that are found once or twice."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    rows = [(k, None, None, " ".join([*(word() for _ in range(30)), *["galo doido"] * (k % 3), "vai bem"])) for k in range(1500)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def test_rare_terms_are_not_counted_one_by_one(spark):
    """Of some 140,000 different terms only those of the fullest buckets are shuffled."""
    texts = terms.stack_texts(frequent(spark), FIELDS, "row_id")
    counted = terms.count_ngrams(Ngrams(texts, [], (1, 2, 3)), 2)
    found = counted.collect()
    assert len(found) < 10_000
    top = {(r.secao, r.termo): r.frequencia for r in found if r.frequencia >= 1000}
    assert top == {(7, "galo"): 1500, (7, "doido"): 1500, (7, "vai"): 1500, (7, "bem"): 1500, (8, "galo doido"): 1500, (8, "vai bem"): 1500, (8, "doido vai"): 1000, (9, "galo doido vai"): 1000, (9, "doido vai bem"): 1000}


@pytest.mark.parametrize("first_buckets", [1, 3, 512])
@pytest.mark.parametrize("limit", [1, 4, 60])
def test_what_could_still_be_ranked_is_counted(spark, odd, first_buckets, limit):
    texts = terms.stack_texts(odd, FIELDS, "row_id")
    wanted = terms.with_ties(terms._counted(terms._ngrams(texts, STOP, (1, 2, 3))), "secao", limit)
    got = terms.with_ties(count_by_buckets(Ngrams(texts, STOP, (1, 2, 3)), limit, first_buckets), "secao", limit)
    assert rows(got) == rows(wanted)


def test_full_buckets_of_rare_terms_do_not_hide_frequent_ones(spark, odd, monkeypatch):
    """All terms share sixteen buckets, so that most buckets hold many."""
    monkeypatch.setattr(ngram_counts, "_bucket", lambda numbers: (numbers >> ngram_counts.np.uint64(60)).astype("int64"))
    texts = terms.stack_texts(odd, FIELDS, "row_id")
    wanted = terms.with_ties(terms._counted(terms._ngrams(texts, STOP, (1, 2, 3))), "secao", 3)
    got = terms.with_ties(count_by_buckets(Ngrams(texts, STOP, (1, 2, 3)), 3, 1), "secao", 3)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("two_pass", [False, True])
def test_text_ids_and_missing_texts(spark, two_pass):
    df = spark.createDataFrame([("é", "novo velho"), ("z", "velho novo"), ("a", None), (None, "outro novo")], "link string, titulo string")
    got = terms.top_ngrams(df, sizes=(1,), row_id="link", stop_words=[], two_pass=two_pass).orderBy("posicao").collect()
    assert [(r.termo, r.frequencia) for r in got] == [("novo", 3), ("velho", 2), ("outro", 1)]
    none = terms.top_ngrams(df.limit(0), row_id="link", two_pass=two_pass)
    assert none.collect() == []


def test_both_modes_rank_the_same(spark, odd):
    stop = portuguese_stop_words()
    first = [tuple(r) for r in terms.term_stats(odd, limit=7, stop_words=stop).collect()]
    assert first == [tuple(r) for r in terms.term_stats(odd, limit=7, stop_words=stop, two_pass=True).collect()]
    assert len({r[0] for r in first}) == 9


def test_two_passes_shuffle_few_terms(spark):
    texts = terms.stack_texts(frequent(spark), FIELDS, "row_id")
    found = terms.count_ngrams(Ngrams(texts, [], (1, 2, 3)), 2, two_pass=True).collect()
    assert len(found) < 80_000
    assert {r.termo for r in found if r.frequencia == 1500} == {"galo", "doido", "vai", "bem", "galo doido", "vai bem"}


def test_without_a_subtitle_few_terms_are_counted(spark, monkeypatch):
    """The term table without subtitles, from counts of a few of 140,000 terms."""
    seen = []
    rank = terms._rank
    monkeypatch.setattr(terms, "_rank", lambda counted, *a: seen.append(counted.count()) or rank(counted, *a))
    df = frequent(spark).drop("subtitulo").withColumn("titulo", F.lit("vai bem"))
    got = [tuple(r) for r in terms.term_stats(df, limit=2, stop_words=[]).collect()]
    assert seen[0] < 10_000
    assert got == [
        ("Palavras - Títulos", "vai", 1500),
        ("Palavras - Títulos", "bem", 1500),
        ("Bigrams - Títulos", "vai bem", 1500),
        ("Palavras - Texto Completo", "vai", 1500),
        ("Palavras - Texto Completo", "bem", 1500),
        ("Bigrams - Texto Completo", "vai bem", 1500),
        ("Bigrams - Texto Completo", "galo doido", 1500),
        ("Trigrams - Texto Completo", "galo doido vai", 1000),
        ("Trigrams - Texto Completo", "doido vai bem", 1000),
    ]


def test_written_statistics_come_from_few_counts(spark, tmp_path, monkeypatch):
    """The term table as CSV, from counts of a few of 140,000 terms."""
    seen = []
    rank = terms._rank
    monkeypatch.setattr(terms, "_rank", lambda counted, *a: seen.append(counted.count()) or rank(counted, *a))
    df = frequent(spark).withColumn("tags_noticia", F.when(F.col("row_id") < 3, "Galo, Minas"))
    write_term_stats(terms.term_stats(df, limit=1, stop_words=[]), str(tmp_path / "e"))
    back = spark.read.options(**CSV_OPTIONS).schema("secao string, termo string, vezes long").csv(str(tmp_path / "e"))
    assert seen[0] < 10_000
    assert [tuple(r) for r in back.collect()] == [
        ("Palavras - Texto Completo", "vai", 1500),
        ("Bigrams - Texto Completo", "vai bem", 1500),
        ("Trigrams - Texto Completo", "galo doido vai", 1000),
        ("Tags Mais Frequentes", "Galo", 3),
    ]
