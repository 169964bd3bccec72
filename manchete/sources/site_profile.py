"""Where the fields of an article sit in the pages of a news site."""

from __future__ import annotations

from dataclasses import dataclass, replace

Selector = tuple[str | None, str | None] | None  # (tag, class)


@dataclass(frozen=True)
class SiteProfile:
    """Selectors of one site; the defaults fit the newspaper layout they are made for.

    ``base_url`` is the address relative links are resolved against. A selector of
    ``None`` says that the site has no such element.
    """

    base_url: str

    # -------------------------------------------------------------- fixed values
    # Result-list pages.
    hit: Selector = ("li", "ais-Hits-item")
    hit_link: Selector = ("a", "search-results")
    hit_title: Selector = ("h2", "search-results__texto--title")
    hit_subtitle: Selector = ("h3", "search-results__texto--subtitle")
    page_info: Selector = ("div", "pagination__info")
    # Article pages.
    signature: Selector = (None, "cp023-assinatura-do-artigo")
    author_box: Selector = ("div", "cmp__author-info")
    author_name: Selector = ("span", "cmp__author-name")
    publication: Selector = ("span", "cmp__author-publication")
    body: Selector = ("div", "read-controller materia__tts article-whole article-body")
    gallery: Selector = ("div", "gallery__container gallery_highlight")
    gallery_image: Selector = ("img", "gallery__image")
    video_frame: Selector = ("iframe", "c-video__frame")
    video: Selector = ("video", None)
    frames_box: Selector = ("div", "c-news-body")
    tags_box: Selector = ("div", "tags")
    tags_list: Selector = ("ul", "cmp__tagbox")
    tag: Selector = ("a", "label__tag")
    # Address parts that mark an embedded frame as a video; a site's own video host is
    # passed along with them.
    video_addresses: tuple[str, ...] = (
        "https://www.youtube.com/embed/G8jXv_yjVVI?si=A-jPxoZqLkP8I1Ry",
        "vimeo.com",
    )
    # ---------------------------------------------------------- end fixed values

    def with_video_addresses(self, *addresses: str) -> SiteProfile:
        """The profile with further address parts of videos, such as the site's own host."""
        return replace(self, video_addresses=(*self.video_addresses, *addresses))


def generic_profile(base_url: str) -> SiteProfile:
    """Plain pages: links in list items, paragraphs in ``<article>``, nothing else."""
    return SiteProfile(
        base_url,
        hit=("li", None),
        hit_link=("a", None),
        hit_title=("a", None),
        hit_subtitle=None,
        page_info=None,
        signature=None,
        author_box=None,
        publication=None,
        body=("article", None),
        gallery=None,
        video_frame=None,
        frames_box=None,
        tags_box=None,
    )
