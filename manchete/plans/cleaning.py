"""Raw news CSV → cleaned table, monthly and yearly counts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from manchete import schema as S
from manchete.functions.dates import with_dates
from manchete.operators.cleaning import clean, clean_report, profile
from manchete.operators.counts import (
    date_text_counts,
    monthly_counts,
    monthly_counts_in_range,
    newest_articles,
    yearly_counts,
)
from manchete.sinks.csv_tables import saved_columns, write_clean_articles, write_counts, write_csv
from manchete.sources.news_csv import read_news_csv
from manchete.workspace import materialise

ROW_ID = "row_id"

#: Tables that the job can write besides its three.
EXTRA_TABLES = ("monthly_all", "by_date_text", "newest", "report", "profile")


def clean_articles(df: DataFrame) -> DataFrame:
    """Cleaned articles with parsed dates, in the saved column order."""
    return saved_columns(with_dates(clean(df)))


def run_cleaning(
    spark: SparkSession,
    csv_path: str,
    clean_path: str,
    monthly_path: str,
    yearly_path: str,
    start: str | dt.date = S.RANGE_START,
    end: str | dt.date = S.RANGE_END,
    extras: dict[str, str] | None = None,
) -> DataFrame:
    """Write the three outputs, and those of EXTRA_TABLES that ``extras`` has a path for; return the cleaned table for further reports.

    The CSV is parsed once, into a columnar table in the shared working folder; cleaning
    is a projection of it, and each count reads only the columns it needs.
    """
    raw = materialise(read_news_csv(spark, csv_path, row_id=ROW_ID))
    cleaned = clean(raw)
    dated_articles = with_dates(cleaned)
    articles = saved_columns(dated_articles)
    # Counting date texts is cheaper than parsing every row; a table without any date
    # text has no known dates either.
    dated = cleaned if "data_pura" in cleaned.columns else articles
    write_counts(monthly_counts_in_range(dated, start, end), monthly_path)
    write_counts(yearly_counts(dated), yearly_path)
    tables: dict[str, Callable[[], DataFrame]] = {
        "monthly_all": lambda: monthly_counts(dated),
        "by_date_text": lambda: date_text_counts(dated),
        "newest": lambda: newest_articles(articles),
        "report": lambda: clean_report(raw.drop(ROW_ID)),
        "profile": lambda: profile(articles).orderBy("ordem"),
    }
    for name, path in (extras or {}).items():
        write_csv(tables[name](), path)
    # In the order of the rows read, which the names of the files follow.
    in_order = dated_articles.orderBy(ROW_ID) if ROW_ID in dated_articles.columns else dated_articles
    write_clean_articles(in_order, clean_path)
    return articles
