"""CSV outputs: articles, cleaned articles, count tables and text statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from manchete import schema as S
from manchete.sources.news_csv import CSV_OPTIONS


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header, comma, doubled quotes, UTF-8; null is an empty cell."""
    df.write.options(**CSV_OPTIONS).mode(mode).csv(path)


def write_articles(df: DataFrame, path: str, mode: str = "errorifexists") -> bool:
    """Write the ten article columns; nothing is written when there is no article.

    Looks for a first row before writing, so ``df`` should be a table or a projection of
    one; the capture job settles emptiness from its hits instead.
    """
    articles = df.select(*S.ARTICLE_COLUMNS)
    if articles.isEmpty():
        return False
    write_csv(articles, path, mode)
    return True


def saved_columns(df: DataFrame) -> DataFrame:
    """The article and date columns that exist, in their fixed order."""
    return df.select(*(c for c in (*S.ARTICLE_COLUMNS, *S.DATE_COLUMNS) if c in df.columns))


def write_clean_articles(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(saved_columns(df), path, mode)


def write_counts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a monthly or yearly count table as one file, keeping its order.

    Such a table has at most twelve rows per year, so one file is one small task.
    """
    write_csv(df.coalesce(1), path, mode)


def write_term_stats(df: DataFrame, path: str, mode: str = "errorifexists") -> bool:
    """Write the text statistics (at most fifty rows per section) as one file, if any."""
    rows = df.coalesce(1).persist()
    try:
        if rows.isEmpty():
            return False
        write_csv(rows, path, mode)
        return True
    finally:
        rows.unpersist()
