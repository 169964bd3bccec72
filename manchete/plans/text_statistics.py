"""News CSV → term statistics and word-cloud terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from manchete import schema as S
from manchete.operators.cloud import cloud_terms
from manchete.operators.terms import term_stats, top_tags
from manchete.sinks.csv_tables import write_term_stats
from manchete.sources.news_csv import read_news_csv
from manchete.workspace import materialise

ROW_ID = "row_id"


def run_text_statistics(
    spark: SparkSession, csv_path: str, stats_path: str, two_pass: bool = False
) -> dict[str, DataFrame]:
    """Write the statistics; return the tables behind the tag chart and the clouds.

    ``two_pass`` reads the texts twice to shuffle fewer n-grams; the result is the same.
    """
    articles = materialise(read_news_csv(spark, csv_path, row_id=ROW_ID))
    write_term_stats(term_stats(articles, row_id=ROW_ID, two_pass=two_pass), stats_path)
    tables = {"clouds": cloud_terms(articles, row_id=ROW_ID)}
    if "tags_noticia" in articles.columns:
        tables["tag_chart"] = top_tags(articles, limit=S.TOP_CHART_TAGS, row_id=ROW_ID)
    return tables
