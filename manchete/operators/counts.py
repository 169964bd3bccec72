"""Article counts over time.

All of them start from one row per distinct date text (or date), which collapses
map-side; date parsing and calendar grouping then touch a handful of rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manchete import schema as S
from manchete.functions.dates import date_parts, month_name, parse_date


def _date_text_totals(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("data_pura").isNotNull())
        .groupBy("data_pura")
        .agg(F.count("*").alias("total_noticias"))
    )


def _date_totals(df: DataFrame) -> DataFrame:
    """Articles per date text or date: ``(data_dt, total_noticias)``, known dates only."""
    if "data_dt" in df.columns:
        totals = df.groupBy("data_dt").agg(F.count("*").alias("total_noticias"))
    else:
        # The test of the total is always true. Without it the optimiser moves filters
        # on the date below the aggregate, where every row's text would be parsed.
        date = F.when(F.col("total_noticias") > 0, parse_date(F.col("data_pura")))
        totals = _date_text_totals(df).select(date.alias("data_dt"), "total_noticias")
    return totals.where(F.col("data_dt").isNotNull())


def _by_month(date_totals: DataFrame) -> DataFrame:
    return (
        date_totals.select(*date_parts(), "total_noticias")
        .groupBy("ano_publicacao", "mes_numero")
        .agg(F.sum("total_noticias").alias("total_noticias"))
        .select(
            "ano_publicacao",
            month_name(F.col("mes_numero")).alias("mes_publicacao"),
            "mes_numero",
            "total_noticias",
        )
        .orderBy("ano_publicacao", "mes_numero")
    )


def monthly_counts(df: DataFrame) -> DataFrame:
    """Articles per year and month, all time, in calendar order."""
    return _by_month(_date_totals(df))


def monthly_counts_in_range(
    df: DataFrame,
    start: str | dt.date = S.RANGE_START,
    end: str | dt.date = S.RANGE_END,
) -> DataFrame:
    """Articles per year and month between two dates, both included."""
    first, last = (F.lit(str(d)).cast("date") for d in (start, end))
    in_range = _date_totals(df).where(F.col("data_dt").between(first, last))
    return _by_month(in_range).drop("mes_numero")


def yearly_counts(df: DataFrame) -> DataFrame:
    return (
        _date_totals(df)
        .groupBy(F.year("data_dt").alias("ano_publicacao"))
        .agg(F.sum("total_noticias").alias("total_noticias"))
        .orderBy("ano_publicacao")
    )


def date_text_counts(df: DataFrame) -> DataFrame:
    """Articles per date text, parseable or not, ordered by the text itself."""
    return (
        _date_text_totals(df)
        .withColumnRenamed("data_pura", "data_publicacao_limpa")
        .orderBy("data_publicacao_limpa")
    )


def newest_articles(df: DataFrame, n: int = S.NEWEST) -> DataFrame:
    """Title, date and link of the most recent articles; unknown dates come last."""
    return (
        df.select("titulo", "data_dt", "link_noticia")
        .orderBy(F.col("data_dt").desc_nulls_last(), "link_noticia")
        .limit(n)
    )
