import random
import re
from collections import Counter

import pytest

from manchete.operators import cloud

STOP = ["uma", "para", "de acordo"]


def brute_cloud(texts, stop, limit):
    """Words of a cloud by the documented rules, on plain Python data."""
    stop = {w.lower() for w in stop}
    spellings: dict[str, Counter] = {}
    for text in texts:
        for word in re.findall(r"\w[\w']*", text or ""):
            if word.lower().endswith("'s"):
                word = word[:-2]
            if not word.isdigit() and word.lower() not in stop:
                spellings.setdefault(word.lower(), Counter())[word] += 1
    for plural in [k for k in spellings if k.endswith("s") and not k.endswith("ss")]:
        singular = plural[:-1]
        if singular in spellings:
            for word, n in spellings.pop(plural).items():
                spellings[singular][word[:-1]] += n
    # most_common and sorted are stable, so equal counts keep the order of appearance.
    totals = [(forms.most_common(1)[0][0], sum(forms.values())) for forms in spellings.values()]
    ranked = sorted(totals, key=lambda t: -t[1])[:limit]
    return [(w, n, n / ranked[0][1]) for w, n in ranked]


def clouds(spark, texts, limit=100, stop=STOP):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, titulo string").repartition(4)
    rows = cloud.cloud_terms(df, limit=limit, stop_words=stop).orderBy("posicao").collect()
    return [(r.termo, r.frequencia, r.peso) for r in rows]


def test_rules(spark):
    texts = [
        "Gatos e gato: GATO's 2024 ²³ uma Para a",
        "d'água casa-grande Casa casas CASAS x_1 'aspas' mass massa massas",
        None,
        "",
    ]
    assert clouds(spark, texts) == brute_cloud(texts, STOP, 100)
    terms = {t for t, _, _ in clouds(spark, texts)}
    assert {"a", "e", "d'água", "grande", "x_1", "aspas'", "mass", "massa"} <= terms
    assert not terms & {"2024", "²³", "uma", "Para", "massas"}


def test_plural_without_singular_stays(spark):
    assert clouds(spark, ["ônibus bus bu deus"]) == [
        ("bu", 2, 1.0), ("ônibus", 1, 0.5), ("deus", 1, 0.5),
    ]


def test_spelling_ties_prefer_the_first_and_the_terms_own(spark):
    texts = ["GATOS gato", "Mesas MESAS mesa", "casa Casa"]
    got = [t for t, _, _ in clouds(spark, texts)]
    assert got == [t for t, _, _ in brute_cloud(texts, STOP, 100)]


@pytest.mark.parametrize("seed, limit", [(1, 100), (2, 7), (3, 2)])
def test_random_texts_equal_brute_force(spark, seed, limit):
    rng = random.Random(seed)
    words = ["gato", "Gato", "GATOS", "gatos", "gass", "ga", "Gas", "uma", "São", "são", "12", "d'Ana", "Ana's", "mês", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    assert clouds(spark, texts, limit) == brute_cloud(texts, STOP, limit)


def test_all_four_clouds(spark):
    df = spark.createDataFrame(
        [(1, "Galo, Galo Doido", "t um", None, "corpo"), (2, "Minas,galo", "t", "s", None)],
        "row_id bigint, tags_noticia string, titulo string, subtitulo string, texto_completo string",
    )
    rows = cloud.cloud_terms(df, stop_words=["um"]).orderBy("nuvem", "posicao").collect()
    assert [(r.nuvem, r.termo, r.frequencia) for r in rows] == [
        (0, "Galo", 3), (0, "Doido", 1), (0, "Minas", 1), (1, "t", 2), (2, "s", 1), (3, "corpo", 1),
    ]
    assert {r.tipo for r in rows} == {name for _, name in cloud.CLOUDS}


def test_only_stop_words_give_an_empty_cloud(spark):
    assert clouds(spark, ["uma para", " "]) == []


def test_filters_run_on_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "a b")], "row_id bigint, titulo string")
    plan = cloud.cloud_terms(df, stop_words=STOP)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "RLIKE" not in plan[plan.rindex("Generate posexplode") - 400 :]
