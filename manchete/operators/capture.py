"""Putting article details next to the hits that link to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manchete import schema as S
from manchete.operators.chunks import CHUNK_ROWS, chunked_left_join

# Sentinel values of the detail fields of an article that was not collected.
_NOT_COLLECTED = {
    "data_pura": S.SENTINEL_DATE,
    "horario": S.SENTINEL_TIME,
    "texto_completo": S.SENTINEL_TEXT,
    "link_imagem_principal": S.SENTINEL_IMAGE,
    "tem_video": False,
    "nome_reporter": S.SENTINEL_REPORTER,
    "tags_noticia": S.SENTINEL_TAGS,
}

def one_article_per_link(articles: DataFrame) -> DataFrame:
    """Keep the earliest captured page of every link.

    An aggregate rather than a window: copies of a link collapse before the shuffle.
    """
    details = [c for c in articles.columns if c not in ("page_id", "link_noticia")]
    return (
        articles.groupBy("link_noticia")
        .agg(F.min_by(F.struct(*details), "page_id").alias("artigo"))
        .select("link_noticia", *(F.col("artigo")[c].alias(c) for c in details))
    )


def join_details(hits: DataFrame, articles: DataFrame, hot_link_hits: int = CHUNK_ROWS) -> DataFrame:
    """Left outer join hit → article; what was not collected gets sentinel fields.

    Every hit gives one row, duplicates included. Most links are joined on the
    partitioning that picking one article per link leaves behind, so bodies are shuffled
    once. Links with more than ``hot_link_hits`` hits are joined apart, in chunks of that size.
    ``hits`` are read more than once, so they should be a written table.
    """
    joined = chunked_left_join(hits, one_article_per_link(articles), "link_noticia", ["page_no", "pos"], hot_link_hits)
    collected = F.coalesce(F.col("coletado"), F.lit(False))
    return joined.select(
        "page_no",
        "pos",
        *(
            F.when(collected, F.col(c)).otherwise(F.lit(_NOT_COLLECTED[c])).alias(c)
            if c in _NOT_COLLECTED
            else F.col(c)
            for c in S.ARTICLE_COLUMNS
        ),
    )


def captured_count(hits: DataFrame) -> DataFrame:
    """Number of captured articles: every usable hit gives one, so no article is read."""
    return hits.agg(F.count("*").alias("total_noticias"))
