"""Captured pages → article table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manchete import schema as S
from manchete.operators.capture import join_details
from manchete.operators.selection import (
    first_articles,
    first_pages,
    search_articles,
    until_empty_page,
    usable_hits,
)
from manchete.sinks.csv_tables import write_csv
from manchete.sources.captured_pages import declared_totals, extract_articles, extract_hits
from manchete.sources.site_profile import SiteProfile
from manchete.workspace import materialise


def capture_hits(
    list_pages: DataFrame,
    profile: SiteProfile,
    max_pages: int | None = None,
    max_articles: int | None = None,
    total_pages: int | None = None,
    until_empty: bool = True,
) -> DataFrame:
    """Usable hits of all result pages, of the first pages, or the first so many articles.

    The results end at the first page without any hit; with ``until_empty`` false the pages
    captured after it count as well. The hits are parsed once and written to the working folder; what follows reads them
    several times.
    """
    if max_pages is not None and max_articles is not None:
        raise ValueError("limit either the pages or the articles, not both")
    if max_pages is not None:  # before parsing, so that later pages are not parsed
        list_pages = first_pages(list_pages, max_pages, total_pages)
    hits = materialise(extract_hits(list_pages, profile))
    hits = usable_hits(until_empty_page(hits, list_pages) if until_empty else hits)
    return hits if max_articles is None else first_articles(hits, max_articles, total_pages)


def capture_articles(
    list_pages: DataFrame, article_pages: DataFrame, profile: SiteProfile, **limits: int | bool | None
) -> DataFrame:
    """One row per usable hit with its article fields.

    ``list_pages`` holds ``(page_no, html)``, ``article_pages`` ``(page_id, url, html)``;
    the limits are those of :func:`capture_hits`. Columns ``page_no`` and ``pos`` give the
    order of arrival.
    """
    hits = capture_hits(list_pages, profile, **limits)
    return join_details(hits, extract_articles(article_pages, profile))


def declared_pages(list_pages: DataFrame, profile: SiteProfile) -> int | None:
    """The number of result pages that the first page with a declaration gives, if any does."""
    declared = declared_totals(list_pages, profile).where("paginas IS NOT NULL")
    return declared.agg(F.min_by("paginas", "page_no")).first()[0]


def run_capture(
    list_pages: DataFrame,
    article_pages: DataFrame,
    profile: SiteProfile,
    path: str,
    term: str | None = None,
    **limits: int | bool | None,
) -> bool:
    """Write the captured articles as CSV; false, and nothing written, if there are none.

    The articles come in order of arrival, page by page; the names of the files follow it.

    Every hit gives one article, so the hits alone tell whether there are any. With a
    ``term`` only articles that hold it are written, which may be none.
    """
    hits = capture_hits(list_pages, profile, **limits)
    if hits.isEmpty():
        return False
    articles = join_details(hits, extract_articles(article_pages, profile))
    if term is not None:
        articles = materialise(search_articles(articles, term))
        if articles.isEmpty():
            return False
    write_csv(articles.orderBy("page_no", "pos").select(*S.ARTICLE_COLUMNS), path)
    return True
