"""Choosing articles: usable hits, page and article limits, search term."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manchete import schema as S
from manchete.operators.numbering import cut_at, number_rows
from manchete.workspace import materialise


# Up to so many first articles, every task keeps as many of its own.
_KEPT_BY_TASKS = 1000


def usable_hits(hits: DataFrame) -> DataFrame:
    """Hits that have both a title and a link."""
    return hits.where((F.col("titulo") != "") & (F.col("link_noticia") != ""))


def _check_limit(what: str, n: int, total: int | None) -> None:
    if n < 1 or (total is not None and n > total):
        upper = "" if total is None else f" and {total}"
        raise ValueError(f"number of {what} must be between 1{upper}, got {n}")


def first_pages(hits: DataFrame, pages: int, total_pages: int | None = None) -> DataFrame:
    """Hits of the first ``pages`` result pages."""
    _check_limit("pages", pages, total_pages)
    return hits.where(F.col("page_no") <= pages)


def until_empty_page(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits of the pages before the first captured page without any hit, where results end.

    ``hits`` are all hits of ``pages``, usable or not, as a written table. A page number
    that was not captured ends nothing; a page without number has no place in the order,
    and its hits stay. Only page numbers are read and compared.
    """
    with_hits = hits.select("page_no").distinct()
    empty = pages.select(F.col("page_no").cast("int")).distinct().join(with_hits, "page_no", "left_anti")
    first = empty.agg(F.min("page_no")).first()[0]
    return hits if first is None else hits.where(F.col("page_no").isNull() | (F.col("page_no") < first))


def first_articles(hits: DataFrame, articles: int, total_pages: int | None = None) -> DataFrame:
    """First ``articles`` usable hits in order of arrival, i.e. by page and position.

    Hits without a page number have no place in that order and are not counted. They come
    out in order; hits of the same place in an order that depends on their content. Every
    task keeps up to a thousand of them. Beyond that the page that reaches the number is found by counting hits by page, and
    the place in it likewise; only among hits of the same place is any numbering needed.
    """
    _check_limit(
        "articles", articles, None if total_pages is None else total_pages * S.HITS_PER_PAGE
    )
    placed = usable_hits(hits).where(F.col("page_no").isNotNull())
    arrival = [F.col("page_no").asc(), F.col("pos").asc(), F.xxhash64(*placed.columns).asc()]
    if articles <= _KEPT_BY_TASKS:
        return placed.orderBy(*arrival).limit(articles)
    placed = materialise(placed)
    page = cut_at(placed, "page_no", articles)
    if page is None:
        return placed.orderBy(*arrival)
    last, missing = placed.where(F.col("page_no") == page[0]), articles - page[1]
    kept = placed.where(F.col("page_no") < page[0])
    place = cut_at(last, "pos", missing)
    if place is None:
        return kept.unionByName(last).orderBy(*arrival)
    kept = kept.unionByName(last.where(F.col("pos") < place[0]))
    equal, missing = last.where(F.col("pos") == place[0]), missing - place[1]
    if equal.count() > missing:
        equal = number_rows(equal, arrival).where(F.col("numero") <= missing).drop("numero")
    return kept.unionByName(equal).orderBy(*arrival)


def first_rows(df: DataFrame, order_by: str | list[str], n: int = S.PREVIEW) -> DataFrame:
    """Preview of a table: its first rows in a stated order."""
    return df.orderBy(order_by).limit(n)


def search_articles(df: DataFrame, term: str) -> DataFrame:
    """Articles whose title, subtitle or body holds the term, ignoring case."""
    wanted = F.lower(F.lit(term))
    fields = [c for c, _ in S.TEXT_FIELDS if c in df.columns]
    if not fields:
        raise ValueError("no text column to search in")
    return df.where(
        reduce(
            lambda a, b: a | b,
            (F.coalesce(F.contains(F.lower(F.col(c)), wanted), F.lit(False)) for c in fields),
        )
    )
