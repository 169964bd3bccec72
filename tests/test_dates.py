import datetime as dt

import pytest

from manchete.functions import dates

CASES = {
    "11 de junho de 2025": dt.date(2025, 6, 11),
    "1 de maio de 2024": dt.date(2024, 5, 1),
    "01 de MARÇO de 2025": dt.date(2025, 3, 1),
    "09 de fevereiro de 2024": dt.date(2024, 2, 9),
    " 5 de maio de 2024": dt.date(2024, 5, 5),
    "5  maio 2024": dt.date(2024, 5, 5),
    "29 de fevereiro de 2024": dt.date(2024, 2, 29),
    "29 de fevereiro de 2023": None,
    "31 de fevereiro de 2024": None,
    "32 de janeiro de 2024": None,
    "0 de janeiro de 2024": None,
    "1º de maio de 2024": None,
    "11 DE junho DE 2025": None,
    "05 de maio de 2024 ": None,
    "5 de maio de 24": None,
    "5 de maio de 20245": None,
    "5 de may de 2024": None,
    "Erro ao coletar data": None,
    "": None,
    None: None,
    "21 de setembro de 1677": None,
    "22 de setembro de 1677": dt.date(1677, 9, 22),
    "11 de abril de 2262": dt.date(2262, 4, 11),
    "12 de abril de 2262": None,
}


def test_parse_date(column):
    assert dict(zip(CASES, column(dates.parse_date, list(CASES)))) == CASES


def test_every_month_name(column):
    from manchete.schema import MONTHS

    got = column(dates.parse_date, [f"2 de {m.title()} de 2024" for m in MONTHS])
    assert got == [dt.date(2024, i, 2) for i in range(1, 13)]


def test_with_dates(spark):
    df = spark.createDataFrame([("11 de março de 2025",), ("nada",)], "data_pura string")
    rows = dates.with_dates(df).collect()
    assert tuple(rows[0])[1:] == (dt.date(2025, 3, 11), 2025, "março", 3)
    assert tuple(rows[1])[1:] == (None, None, None, None)
    assert [t for _, t in dates.with_dates(df).dtypes] == ["string", "date", "int", "string", "int"]


def test_without_a_date_column_dates_are_null(spark):
    df = spark.createDataFrame([("x",)], "titulo string")
    assert dates.with_dates(df).first().data_dt is None


@pytest.mark.parametrize("value", ["11 de junho de 2025", "10 de de 2024"])
def test_normalise(column, value):
    assert column(dates.normalise_date_text, [value]) == [value.replace(" de ", " ")]
