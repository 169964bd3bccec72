"""Portuguese publication dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manchete import schema as S
from manchete.functions.literals import text_array

# "5 junho 2025": one- or two-digit day, month name, four-digit year, nothing else.
_DATE_TEXT = (
    r"^(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])"
    rf"[{S.WHITESPACE}]+(\p{{L}}+)[{S.WHITESPACE}]+([0-9]{{4}})\z"
)


def normalise_date_text(c: Column) -> Column:
    """``11 de junho de 2025`` → ``11 junho 2025``; the ``de`` is case-sensitive."""
    return F.replace(c, F.lit(" de "), F.lit(" "))


def parse_date(c: Column) -> Column:
    """DATE of a Portuguese date text, null for anything that is not one."""
    text = normalise_date_text(c)
    day, month, year = (F.regexp_extract(text, _DATE_TEXT, i) for i in (1, 2, 3))
    number = F.nullif(F.array_position(text_array(S.MONTHS), F.lower(month)), F.lit(0))
    parsed = F.try_to_date(
        F.concat(year, F.lit("-"), number.cast("string"), F.lit("-"), F.btrim(day)), "y-M-d"
    )
    # As a one-element array, so that the range test does not parse the text again.
    first, last = (F.lit(d).cast("date") for d in (S.FIRST_DATE, S.LAST_DATE))
    return F.get(F.filter(F.array(parsed), lambda d: d.between(first, last)), 0)


def month_name(number: Column) -> Column:
    return F.get(text_array(S.MONTHS), number - 1)


def date_parts(date: str = "data_dt") -> list[Column]:
    """Year, Portuguese month name and month number of a DATE column."""
    return [
        F.year(date).alias("ano_publicacao"),
        month_name(F.month(date)).alias("mes_publicacao"),
        F.month(date).alias("mes_numero"),
    ]


def with_dates(df: DataFrame, text: str = "data_pura") -> DataFrame:
    """Add the parsed date and its parts; without a date-text column they are null."""
    source = F.col(text) if text in df.columns else F.lit(None).cast("string")
    return df.withColumn("data_dt", parse_date(source)).select("*", *date_parts())
