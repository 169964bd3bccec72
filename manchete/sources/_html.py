"""Small helper that runs inside Spark tasks: look-ups on one captured page."""

from __future__ import annotations

from html.parser import HTMLParser

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_SILENT = frozenset(("script", "style", "template"))


class PageIndex(HTMLParser):
    """Preorder list of the elements and texts of a page.

    ``items[i]`` is ``[tag, attributes, end]`` or ``[None, text, end]``; what lies
    inside element ``i`` are the items from ``i + 1`` up to its ``end``.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self._open: list[int] = []
        self._open_tags: dict[str, int] = {}
        self._merge = False
        try:
            self.feed(html)
            if html.rfind("<!--") > html.rfind("-->"):
                self.feed("-->")  # an open comment hides the rest of the page, as in a browser
            self.close()
        except (AssertionError, ValueError):  # markup the parser refuses: a page without content
            self.items.clear()
            self._open.clear()
        while self._open:
            self._close_top()

    def _close_top(self) -> str:
        item = self.items[self._open.pop()]
        item[2] = len(self.items)
        self._open_tags[item[0]] -= 1
        return item[0]

    def _close_last(self, tag: str) -> None:
        """Close the innermost open ``tag`` with all it holds; a stray end tag does nothing."""
        if self._open_tags.get(tag):
            while self._close_top() != tag:
                pass

    def handle_starttag(self, tag, attrs):
        self._merge = False
        if tag == "p":  # a paragraph ends where the next one starts, as in a browser
            self._close_last("p")
        self.items.append([tag, {k: v or "" for k, v in reversed(attrs)}, len(self.items) + 1])
        if tag not in _VOID:
            self._open.append(len(self.items) - 1)
            self._open_tags[tag] = self._open_tags.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._merge = False
        self._close_last(tag)

    def handle_comment(self, data):
        self._merge = False

    def handle_data(self, data):
        if self._open and self.items[self._open[-1]][0] in _SILENT:
            return
        if self._merge:
            self.items[-1][1] += data
        else:
            self.items.append([None, data, len(self.items) + 1])
            self._merge = True

    def find_all(self, selector, within=None):
        """Positions of the elements that match ``(tag, class)``, in page order.

        The class matches when it is one of the element's classes or its whole
        class attribute; ``None`` for tag or class matches anything.
        """
        tag, cls = selector
        first, last = (0, len(self.items)) if within is None else (within + 1, self.items[within][2])
        for i in range(first, last):
            name, attrs, _ = self.items[i]
            if name is None or (tag is not None and name != tag):
                continue
            if cls is not None:
                classes = attrs.get("class", "").split()
                if cls not in classes and cls != " ".join(classes):
                    continue
            yield i

    def find(self, selector, within=None):
        """First match or None; a selector of None means "not on this site"."""
        return None if selector is None else next(self.find_all(selector, within), None)

    def text(self, within: int, separator: str = "") -> str:
        pieces = (
            item[1].strip() for item in self.items[within + 1 : self.items[within][2]] if item[0] is None
        )
        return separator.join(p for p in pieces if p)

    def attribute(self, i: int, name: str):
        return self.items[i][1].get(name)
