"""Rules that turn raw page fragments into article fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from manchete import schema as S
from manchete.functions.text import collapse_spaces, strip


def clean_byline(c: Column) -> Column:
    """Drop one leading ``Por``/``Redação`` (any case, no word boundary), tidy spaces."""
    return collapse_spaces(F.regexp_replace(c, rf"(?iu)^(Por|Redação)[{S.WHITESPACE}]*", ""))


def _stamp(c: Column) -> Column:
    return strip(F.substring_index(c, " - ", 1))


def stamp_date(c: Column) -> Column:
    """Date part of ``11 de junho de 2025 | 18:05 - Atualizado …``."""
    return strip(F.substring_index(_stamp(c), "|", 1))


def stamp_time(c: Column) -> Column:
    """Time part of the stamp; ``N/A`` when it has none."""
    stamp = _stamp(c)
    return F.when(stamp.contains("|"), strip(F.split_part(stamp, F.lit("|"), F.lit(2)))).when(
        stamp.isNotNull(), F.lit(S.NOT_AVAILABLE)
    )


def body_text(paragraphs: Column) -> Column:
    return F.array_join(paragraphs, "\n")


def joined_tags(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise(S.NOT_AVAILABLE)


def has_video(player: Column, frame_sources: Column, markers: tuple[str, ...]) -> Column:
    """A player element, or an embedded frame whose address holds one of the markers."""
    known = F.exists(
        frame_sources,
        lambda src: _any_of(src, markers),
    )
    return player | known


def _any_of(src: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | src.contains(marker)
    return found


def declared_pages(info: Column) -> Column:
    """Number of result pages announced by ``Página 1 de 37``; null if not announced."""
    return F.regexp_extract(info, r"Página \d+ de (\d+)", 1).try_cast("int")


def estimated_articles(pages: Column) -> Column:
    return pages.cast("bigint") * S.HITS_PER_PAGE
