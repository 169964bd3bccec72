"""Captured HTML pages → result hits and article records.

Parsing runs in Arrow-batched Python workers, page by page, on whatever partitions
the scan has; no shuffle. The workers only pick raw fragments, the field rules are
JVM expressions. The HTML itself is dropped in the same step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import manchete
from manchete.functions import fields
from manchete.sources._html import PageIndex
from manchete.sources.site_profile import SiteProfile

# Ship the page readers with the tasks, so executors need no installed package.
cloudpickle.register_pickle_by_value(manchete)

_ROWS_PER_BATCH = 256

_HITS_DDL = (
    "page_no int, pos int, titulo string, subtitulo string, link_noticia string"
)
_HITS_ARROW = pa.schema(
    [
        ("page_no", pa.int32()),
        ("pos", pa.int32()),
        ("titulo", pa.string()),
        ("subtitulo", pa.string()),
        ("link_noticia", pa.string()),
    ]
)
_FRAGMENTS_DDL = (
    "page_id bigint, link_noticia string, assinado boolean, autor string, carimbo string, "
    "paragrafos array<string>, imagem string, reprodutor boolean, quadros array<string>, "
    "tags array<string>"
)
_FRAGMENTS_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("link_noticia", pa.string()),
        ("assinado", pa.bool_()),
        ("autor", pa.string()),
        ("carimbo", pa.string()),
        ("paragrafos", pa.list_(pa.string())),
        ("imagem", pa.string()),
        ("reprodutor", pa.bool_()),
        ("quadros", pa.list_(pa.string())),
        ("tags", pa.list_(pa.string())),
    ]
)
_INFO_DDL = "page_no int, info string"
_INFO_ARROW = pa.schema([("page_no", pa.int32()), ("info", pa.string())])


def _parsed(
    pages: DataFrame, ddl: str, arrow: pa.Schema, read: Callable[[dict], Iterator[dict]]
) -> DataFrame:
    """Apply ``read`` to every captured page; it yields any number of rows per page."""
    def run(batches):
        for batch in batches:
            rows = []
            for page in batch.to_pylist():
                if page["html"] is not None:
                    rows.extend(read(page))
                if len(rows) >= _ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pages.mapInArrow(run, ddl)


def _resolved(base_url: str, address: str | None) -> str | None:
    """Absolute address; null for none and for one that is no address."""
    try:
        return None if address is None else urljoin(base_url, address)
    except ValueError:
        return None


def _hit_rows(profile: SiteProfile) -> Callable[[dict], Iterator[dict]]:
    def read(row):
        page = PageIndex(row["html"])
        for pos, item in enumerate(page.find_all(profile.hit)):
            link = page.find(profile.hit_link, item)
            title = subtitle = href = None
            if link is not None:
                href = page.attribute(link, "href")
                # A title selector that is the link's own means "the text of the link".
                heading = link if profile.hit_title == profile.hit_link else page.find(profile.hit_title, link)
                below = page.find(profile.hit_subtitle, link)
                title = None if heading is None else page.text(heading, " ")
                subtitle = None if below is None else page.text(below, " ")
            yield {
                "page_no": row["page_no"],
                "pos": pos,
                "titulo": title,
                "subtitulo": subtitle,
                "link_noticia": _resolved(profile.base_url, href),
            }

    return read


def _author(page: PageIndex, profile: SiteProfile) -> str | None:
    box = page.find(profile.author_box)
    name = None if box is None else page.find(profile.author_name, box)
    if name is None:
        return None
    for inner in (("span", None), ("a", None)):
        found = page.find(inner, name)
        if found is not None:
            return page.text(found)
    return page.text(name)


def _stamp(page: PageIndex, profile: SiteProfile) -> str | None:
    outer = page.find(profile.publication)
    inner = None if outer is None else page.find(("span", None), outer)
    return None if inner is None else page.text(inner)


def _paragraphs(page: PageIndex, profile: SiteProfile) -> list[str] | None:
    body = page.find(profile.body)
    if body is None:
        return None
    texts = (page.text(p) for p in page.find_all(("p", None), body))
    return [t for t in texts if t]


def _image(page: PageIndex, profile: SiteProfile) -> str | None:
    box = page.find(profile.gallery)
    image = None if box is None else page.find(profile.gallery_image, box)
    src = None if image is None else page.attribute(image, "src")
    return src if src is None or src.startswith("http") else urljoin(profile.base_url, src)


def _frames(page: PageIndex, profile: SiteProfile) -> list[str]:
    box = page.find(profile.frames_box)
    if box is None:
        return []
    return [page.attribute(i, "src") or "" for i in page.find_all(("iframe", None), box)]


def _tags(page: PageIndex, profile: SiteProfile) -> list[str]:
    box = page.find(profile.tags_box)
    listed = None if box is None else page.find(profile.tags_list, box)
    return [] if listed is None else [page.text(i) for i in page.find_all(profile.tag, listed)]


def _article_rows(profile: SiteProfile) -> Callable[[dict], Iterator[dict]]:
    def read(row):
        own = {"page_id": row["page_id"], "link_noticia": row["url"]}
        try:
            yield own | fragments(PageIndex(row["html"]))
        except Exception:  # whatever is wrong with a page, it only makes that page uncollected
            yield own | {"assinado": False}

    def fragments(page):
        return {
            "assinado": profile.signature is None or page.find(profile.signature) is not None,
            "autor": _author(page, profile),
            "carimbo": _stamp(page, profile),
            "paragrafos": _paragraphs(page, profile),
            "imagem": _image(page, profile),
            "reprodutor": page.find(profile.video_frame) is not None
            or page.find(profile.video) is not None,
            "quadros": _frames(page, profile),
            "tags": _tags(page, profile),
        }

    return read


def extract_hits(pages: DataFrame, profile: SiteProfile) -> DataFrame:
    """Result-list pages ``(page_no, html)`` → one row per hit, ``pos`` counting from 0.

    Rows keep what was found: a hit without link or title has nulls there, and so has a
    hit whose link is no address.
    """
    pages = pages.select(F.col("page_no").cast("int"), "html")
    return _parsed(pages, _HITS_DDL, _HITS_ARROW, _hit_rows(profile))


def extract_articles(pages: DataFrame, profile: SiteProfile) -> DataFrame:
    """Article pages ``(page_id, url, html)`` → article detail fields per page.

    ``coletado`` says whether the page carries the article signature; without it the
    page counts as not collected, and so does a page of which some part cannot be read
    (see :func:`manchete.operators.capture.join_details`).
    """
    pages = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    raw = _parsed(pages, _FRAGMENTS_DDL, _FRAGMENTS_ARROW, _article_rows(profile))
    return raw.select(
        "page_id",
        "link_noticia",
        F.col("assinado").alias("coletado"),
        fields.stamp_date(F.col("carimbo")).alias("data_pura"),
        fields.stamp_time(F.col("carimbo")).alias("horario"),
        fields.body_text(F.col("paragrafos")).alias("texto_completo"),
        F.col("imagem").alias("link_imagem_principal"),
        fields.has_video(F.col("reprodutor"), F.col("quadros"), profile.video_addresses).alias(
            "tem_video"
        ),
        fields.clean_byline(F.col("autor")).alias("nome_reporter"),
        fields.joined_tags(F.col("tags")).alias("tags_noticia"),
    )


def declared_totals(pages: DataFrame, profile: SiteProfile) -> DataFrame:
    """Result-list pages → ``(page_no, paginas, noticias_estimadas)``, null if not declared."""

    def read(row):
        page = PageIndex(row["html"])
        info = page.find(profile.page_info)
        yield {"page_no": row["page_no"], "info": None if info is None else page.text(info)}

    pages = pages.select(F.col("page_no").cast("int"), "html")
    declared = fields.declared_pages(F.col("info"))
    return _parsed(pages, _INFO_DDL, _INFO_ARROW, read).select(
        "page_no",
        declared.alias("paginas"),
        fields.estimated_articles(declared).alias("noticias_estimadas"),
    )
