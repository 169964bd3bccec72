import datetime as dt

import pytest

from manchete.functions.dates import with_dates
from manchete.operators import counts

TEXTS = [
    "30 de junho de 2023",
    "1 de julho de 2023",
    "1 de julho de 2023",
    "02 de janeiro de 2024",
    "10 de dezembro de 2024",
    "30 de junho de 2025",
    "1 de julho de 2025",
    "1º de maio de 2024",
    None,
]


@pytest.fixture(params=["texts", "dates"])
def news(spark, request):
    df = spark.createDataFrame(
        [(t, f"t{i}", f"l{i}") for i, t in enumerate(TEXTS)],
        "data_pura string, titulo string, link_noticia string",
    )
    return df if request.param == "texts" else with_dates(df)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_monthly(news):
    assert rows(counts.monthly_counts(news)) == [
        (2023, "junho", 6, 1),
        (2023, "julho", 7, 2),
        (2024, "janeiro", 1, 1),
        (2024, "dezembro", 12, 1),
        (2025, "junho", 6, 1),
        (2025, "julho", 7, 1),
    ]


def test_monthly_in_default_range_includes_both_ends(news):
    df = counts.monthly_counts_in_range(news)
    assert df.columns == ["ano_publicacao", "mes_publicacao", "total_noticias"]
    assert rows(df) == [
        (2023, "julho", 2),
        (2024, "janeiro", 1),
        (2024, "dezembro", 1),
        (2025, "junho", 1),
    ]


def test_monthly_in_a_given_range(news):
    df = counts.monthly_counts_in_range(news, dt.date(2024, 1, 2), "2024-12-09")
    assert rows(df) == [(2024, "janeiro", 1)]


def test_yearly(news):
    assert rows(counts.yearly_counts(news)) == [(2023, 3), (2024, 2), (2025, 2)]


def test_date_texts_are_sorted_as_text_and_may_be_unparseable(news):
    got = rows(counts.date_text_counts(news))
    assert got == sorted((t, TEXTS.count(t)) for t in set(TEXTS) if t)
    assert ("1º de maio de 2024", 1) in got


def test_newest(spark, news):
    dated = news if "data_dt" in news.columns else with_dates(news)
    got = rows(counts.newest_articles(dated))
    assert [r[0] for r in got] == ["t6", "t5", "t4", "t3", "t1"]
    assert rows(counts.newest_articles(dated, n=9))[-1][1] is None


def test_parsing_stays_above_the_aggregate(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "data_pura string")
    plan = counts.monthly_counts_in_range(df)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Aggregate [data_pura") :]
    assert "regexp_extract" not in below and "regexp_extract" in plan
