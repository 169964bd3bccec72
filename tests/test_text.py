import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from manchete import schema as S
from manchete.functions import text
from manchete.operators import terms

STOP = ["uma", "para", "tempo"]


def brute_words(value, stop):
    kept = "".join(c for c in value if c.isspace() or c == "-" or c in LETTERS)
    return [w for w in kept.lower().split() if len(w) > 2 and w not in stop]


LETTERS = set(
    S.ASCII_LETTERS + S.ASCII_LETTERS.upper() + S.ACCENTED_LETTERS + S.ACCENTED_LETTERS.upper()
)


def brute_top(texts, n, stop, top):
    counts = Counter()
    for value in texts:
        if value is None:
            continue
        words = brute_words(value, stop)
        counts.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return counts.most_common(top)


def test_cleaning_deletes_and_keeps_whitespace(column):
    values = ["fim.Depois ÀÉÇ", "ñandu è ï 123—x", "a b c\td-e", "", None]
    got = column(text.clean_text, values)
    assert got == ["fimdepois àéç", "andu   x", "a b c\td-e", "", None]


def test_kept_words(spark):
    values = [
        "Uma casa-grande  para já TEMPO novo",
        "--- a bc abc",
        "abc def　ghi jkl\x85mno\x1fpqr",
        "a1b2c3",
        "",
        None,
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    words = df.withColumn("w", text.long_words(F.col("v"))).orderBy("i")
    assert [r[0] for r in words.select(text.without_stop_words("w", STOP)).collect()] == [
        ["casa-grande", "novo"],
        ["---", "abc"],
        ["abc", "def", "ghi", "jkl", "mno", "pqr"],
        ["abc"],
        [],
        None,
    ]


def test_stop_list_is_the_standard_one_plus_extras(spark):
    words = text.portuguese_stop_words()
    assert {"de", "não", "feira", "de acordo", "notícias"} <= set(words)
    assert len(words) == len(set(words)) == 203 + 21 - 4


def test_split_tags(column):
    got = column(text.split_tags, ["x, , y ", "a", " ,", " Galo\t,Minas Gerais", None])
    assert got == [["x", "y"], ["a"], [], ["Galo", "Minas Gerais"], None]


def random_texts(seed, n):
    rng = random.Random(seed)
    words = ["casa", "Uma", "tempo", "São", "pão-de-ló", "x", "de", "çãé", "fim.Depois", "ñandu", "ação!", "1998"]
    gaps = [" ", "  ", "\n", "\t", " ", " ", ", ", ". "]
    return [
        None if rng.random() < 0.05 else "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 30)))
        for _ in range(n)
    ]


@pytest.mark.parametrize("top", [3, 50])
def test_top_ngrams_equal_brute_force(spark, top):
    titles, bodies = random_texts(1, 60), random_texts(2, 60)
    rows = [(i, t, b) for i, (t, b) in enumerate(zip(titles, bodies))]
    df = spark.createDataFrame(rows, "row_id bigint, titulo string, texto_completo string").repartition(5)
    got = terms.top_ngrams(df, stop_words=STOP, limit=top).orderBy("secao", "posicao").collect()
    for column, texts in (("Títulos", titles), ("Texto Completo", bodies)):
        for n, label in enumerate(S.NGRAM_LABELS, 1):
            section = [(r.termo, r.frequencia) for r in got if r.tipo == f"{label} - {column}"]
            assert section == brute_top(texts, n, STOP, top)


def test_row_ids_may_be_text(spark):
    rows = [("b", "novo velho"), ("a", "velho novo"), ("c", "outro")]
    df = spark.createDataFrame(rows, "link string, titulo string")
    got = terms.top_ngrams(df, sizes=(1,), row_id="link", stop_words=[])
    assert [(r.termo, r.frequencia) for r in got.orderBy("posicao").collect()] == [
        ("velho", 2),
        ("novo", 2),
        ("outro", 1),
    ]


def test_large_and_negative_row_ids_keep_their_order(spark):
    rows = [(2**62, "zebra"), (-(2**62), "macaco"), (0, "abelha")]
    df = spark.createDataFrame(rows, "row_id bigint, titulo string")
    got = terms.top_ngrams(df, sizes=(1,), stop_words=[])
    assert [r.termo for r in got.orderBy("posicao").collect()] == ["macaco", "abelha", "zebra"]


def test_top_tags(spark):
    rows = [(0, "Galo, Minas"), (1, None), (2, "minas,Galo, "), (3, " , "), (4, "Minas")]
    df = spark.createDataFrame(rows, "row_id bigint, tags_noticia string")
    got = [(r.termo, r.frequencia) for r in terms.top_tags(df).orderBy("posicao").collect()]
    assert got == [("Galo", 2), ("Minas", 2), ("minas", 1)]
    assert [r.termo for r in terms.top_tags(df, limit=1).collect()] == ["Galo"]


def test_term_stats_sections(spark):
    rows = [(0, "casa nova azul", "Galo"), (1, "casa nova", "Galo, Minas")]
    df = spark.createDataFrame(rows, "row_id bigint, titulo string, tags_noticia string")
    got = [tuple(r) for r in terms.term_stats(df, stop_words=[]).collect()]
    assert got == [
        ("Palavras - Títulos", "casa", 2),
        ("Palavras - Títulos", "nova", 2),
        ("Palavras - Títulos", "azul", 1),
        ("Bigrams - Títulos", "casa nova", 2),
        ("Bigrams - Títulos", "nova azul", 1),
        ("Trigrams - Títulos", "casa nova azul", 1),
        ("Tags Mais Frequentes", "Galo", 2),
        ("Tags Mais Frequentes", "Minas", 1),
    ]
    assert terms.term_stats(df, stop_words=[]).columns == ["Tipo de Análise", "Termo", "Frequência"]


def test_term_stats_need_a_title_but_no_text(spark):
    with pytest.raises(ValueError, match="titulo"):
        terms.term_stats(spark.createDataFrame([(1, "x")], "row_id bigint, subtitulo string"))
    empty = spark.createDataFrame([(1, None), (2, " ")], "row_id bigint, titulo string")
    assert terms.term_stats(empty).collect() == []


def test_hash_aggregation_is_used(spark):
    df = spark.createDataFrame([(0, "casa nova")], "row_id bigint, titulo string")
    plan = terms.top_ngrams(df, stop_words=[])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan and "WindowGroupLimit" in plan


def test_word_pattern_is_not_a_negated_class():
    assert not re.search(r"\[\^", text._DELETED + text._WORD)


@pytest.mark.parametrize("tracked, candidates", [(20, 20), (64, 20), (1024, 30), (1 << 16, 4096), (2_000_000, 20)])
def test_two_passes_give_the_same_terms(spark, tracked, candidates):
    """Few counters leave sections unsettled, many settle them: both are exact."""
    rows = [(i, t, b) for i, (t, b) in enumerate(zip(random_texts(3, 80), random_texts(4, 80)))]
    df = spark.createDataFrame(rows, "row_id bigint, titulo string, texto_completo string")
    grams = terms._ngrams(terms.stack_texts(df, [(0, "titulo"), (2, "texto_completo")], "row_id"), STOP, (1, 2, 3))

    def top(counted):
        ranked = terms.top_by_frequency(counted, "secao", 5).orderBy("secao", "posicao")
        return [tuple(r)[:3] for r in ranked.collect()]

    assert top(terms.count_frequent(grams, 5, tracked, candidates)) == top(terms._counted(grams))


def test_two_passes_count_few_terms_when_settled(spark):
    rows = [(i, f"comum um{i} dois{i}") for i in range(300)]
    df = spark.createDataFrame(
        [(i, t.translate(str.maketrans("0123456789", "abcdefghij"))) for i, t in rows], "row_id bigint, titulo string"
    )
    grams = terms._ngrams(terms.stack_texts(df, [(0, "titulo")], "row_id"), [], (1,))
    counted = terms.count_frequent(grams, 1, tracked=200, candidates=4)
    found = {r.termo: r.frequencia for r in counted.collect()}
    assert found["comum"] == 300 and len(found) <= 4


@pytest.mark.parametrize("tracked, candidates", [(8, 8), (30, 10), (30, 30), (100, 40), (400, 400)])
def test_no_other_term_exceeds_the_bound(spark, tracked, candidates):
    """Streams of every shape: what is not among the candidates is no more frequent than stated."""
    rng = random.Random(tracked)
    rows = []
    for section, size in enumerate([1, 50, 400, 3000]):
        rows += [(section, f"t{int(rng.paretovariate(0.7)) % size}") for _ in range(4000)]
        rows += [(section, f"u{rng.randrange(size)}") for _ in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "secao int, termo string").repartition(6)
    best, others = terms.frequent_items(df, tracked, candidates)
    chosen = {(r.secao, i.item) for r in best.collect() for i in r.melhores}
    counts = Counter(rows)
    for section, bound in others.items():
        left_out = [n for (s, t), n in counts.items() if s == section and (s, t) not in chosen]
        assert max(left_out, default=0) <= bound
    assert others.keys() == {0, 1, 2, 3} and others[0] == 0 or candidates == 8
