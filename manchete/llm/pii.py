"""Personal data, found through offset-preserving deobfuscation.

A text is first read as it is. Then small transducers rewrite a copy of it: homoglyphs
become the ASCII characters they look like, spelled digits become digits, and at/dot
disguises become the signs. Each rewrite keeps, for every stretch of the copy, where it
came from, so identifiers detected in the copy are mapped back to the source characters.
Identifiers of the plain text always stay; those of the copy are added where they overlap
none of the same kind.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manchete.llm.common import map_texts

#: The kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits starts, so a long run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Emails by their @: what stands before it is one run of characters without @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


_FINDERS: dict[str, tuple[str, Callable[[str], Iterator[tuple[int, int]]]]] = {
    "email": ("@", _emails),
    "ip": (".", _ips),
    "card": ("", _cards),
    "phone": ("+", _phones),
}


def plain_spans(text: str) -> list[Span]:
    """Identifiers of the text as it stands, by kind and start; ends are exclusive."""
    return [(kind, a, b) for kind, (sign, find) in _FINDERS.items() if sign in text for a, b in find(text)]


# ---- transducers ------------------------------------------------------------------------

#: Characters that look like ASCII ones, beside those that Unicode itself
#: holds to be forms of them.
_LOOKALIKES = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еє", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "k": "κ",
    "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "ν", "w": "ԝ",
    "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    ".": "․。｡", "-": "‐‑‒–−", "@": "﹫", " ": "    ",
}
#: Characters without width, which a disguise puts between others.
_INVISIBLE = "​‌‍⁠﻿­"
#: Digits spelled in the languages of the corpus.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8",
    "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}

_word = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
# Four digits or more of which one at least is spelled; words alone are prose. Runs of
# digits are possessive, so that a long number is read once.
_DIGITS = re.compile(
    rf"(?<![^\W_])(?:[0-9]++|{_word})(?:[ ,-]{{1,2}}(?:[0-9]++|{_word})(?![^\W\d_]))+", re.IGNORECASE
)
_ANY_SPELLED = re.compile(rf"(?<![^\W_]){_word}(?![^\W_])", re.IGNORECASE)
_PART = re.compile(rf"{_word}|[0-9]+", re.IGNORECASE)
_PLUS = re.compile(r"(?<![^\W_])plus +(?=\d)", re.IGNORECASE)

_bracketed_at = r"\s?[\[({<]\s?(?:at|arroba|@)\s?[\])}>]\s?"
_bracketed_dot = r"\s?[\[({<]\s?(?:dot|punto|punkt|point|\.)\s?[\])}>]\s?"
_name = r"[A-Za-z0-9_%+-]{1,64}"
# A bracketed sign is a disguise by itself. A spelled one is only if both signs are there,
# as the words are common in prose.
_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-]){_bracketed_at}(?=[A-Za-z0-9-])", re.IGNORECASE)
_DOT = re.compile(rf"(?<=[A-Za-z0-9_%+-]){_bracketed_dot}(?=[A-Za-z0-9-])", re.IGNORECASE)
#: The signs as words of the corpus' languages.
_AT_WORDS, _DOT_WORDS = ("at", "arroba", "arobase"), ("dot", "punto", "punkt", "point")
_spelled_at, _spelled_dot = (f" (?:{'|'.join(words)}) " for words in (_AT_WORDS, _DOT_WORDS))
_AT_DOT = re.compile(
    rf"(?<![A-Za-z0-9_%+-])({_name}(?:(?:{_spelled_dot}|\.){_name}){{0,4}})({_spelled_at}| @ ?|@)"
    rf"([A-Za-z0-9-]{{1,63}}(?:(?:{_spelled_dot}|\.)[A-Za-z0-9-]{{1,63}}){{1,4}})(?![A-Za-z0-9-])",
    re.IGNORECASE,
)
_SPELLED_DOT = re.compile(_spelled_dot, re.IGNORECASE)
_UNDERSCORED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9.%+-]{1,64}(?:_[A-Za-z0-9.%+-]{1,64}){0,4}?(_at_)"
    r"([A-Za-z0-9-]{1,63}(?:_dot_[A-Za-z0-9-]{1,63}){1,4})(?![A-Za-z0-9_-])",
    re.IGNORECASE,
)
_UNDERSCORED_DOT = re.compile("_dot_", re.IGNORECASE)


@functools.cache
def _homoglyphs() -> dict[int, str]:
    """ASCII characters by what stands for them, one for one.

    Characters whose compatibility form is one ASCII character (full-width, mathematical,
    circled) and the decimal digits of all scripts, beside the look-alikes. Signs of the
    Latin scripts' own blocks, such as superscripts and ordinals, are usual prose.
    """
    table = {}
    for code in range(0x250, sys.maxunicode + 1):
        form, digit = unicodedata.normalize("NFKC", chr(code)), unicodedata.decimal(chr(code), None)
        if digit is not None:
            table[code] = str(digit)
        elif len(form) == 1 and "!" <= form <= "~":
            table[code] = form
    return table | {ord(c): ascii for ascii, alike in _LOOKALIKES.items() for c in alike}


Edit = tuple[int, int, str]


class Copy:
    """A rewritten text whose stretches know where they came from."""

    def __init__(self, text: str):
        self.text = text
        # Stretch k of the copy begins at at[k] and stands for source[k]: shifted one by one,
        # or as a whole if it was replaced.
        self.at, self.source, self.replaced = [0], [(0, len(text))], [False]
        self.changed = False

    def rewrite(self, edits: list[Edit]) -> None:
        """Replace stretches (start, end, new text) of the copy, given in order."""
        if not edits:
            return
        self.changed = True
        text, parts, at, source, replaced = self.text, [], [], [], []
        done = length = 0

        def put(a: int, b: int, new: str | None) -> None:
            nonlocal length
            if new is None:
                k = bisect.bisect_right(self.at, a) - 1
                while a < b:
                    stop = min(b, self.at[k + 1] if k + 1 < len(self.at) else len(text))
                    at.append(length)
                    source.append((self.start(a), self.end(stop)))
                    replaced.append(self.replaced[k])
                    parts.append(text[a:stop])
                    length += stop - a
                    a, k = stop, k + 1
            elif new:
                at.append(length)
                source.append((self.start(a), self.end(b)))
                replaced.append(True)
                parts.append(new)
                length += len(new)

        for a, b, new in edits:
            put(done, a, None)
            put(a, b, new)
            done = b
        put(done, len(text), None)
        self.text, self.at, self.source, self.replaced = "".join(parts), at or [0], source or [(0, 0)], replaced or [False]

    def start(self, at: int) -> int:
        """Source offset of the character at `at`."""
        k = bisect.bisect_right(self.at, at) - 1
        return self.source[k][0] + (0 if self.replaced[k] else at - self.at[k])

    def end(self, at: int) -> int:
        """Source offset just after the character before `at`."""
        k = bisect.bisect_left(self.at, at) - 1
        return self.source[k][1] if self.replaced[k] else self.source[k][0] + at - self.at[k]


def _digit_edits(text: str) -> Iterator[Edit]:
    for m in _DIGITS.finditer(text):
        parts = [p for p in _PART.findall(m.group())]
        spelled = sum(not p[0].isdigit() for p in parts)
        if spelled and len(parts) >= 3 and sum(1 if not p[0].isdigit() else len(p) for p in parts) >= 3:
            yield m.start(), m.end(), "".join(_SPELLED.get(p.lower(), p) for p in parts)


def _address_edits(text: str) -> Iterator[Edit]:
    for m in _AT_DOT.finditer(text):
        spelled_at, spelled_dot = m.group(2) != "@", " " in m.group(1) or " " in m.group(3)
        if not (spelled_at or spelled_dot) or (
            m.group(2).strip().lower() == "at" and not _SPELLED_DOT.search(m.group(3))
        ):
            continue
        for group in (1, 2, 3):
            a, b = m.span(group)
            if group == 2:
                yield a, b, "@"
            else:
                for dot in _SPELLED_DOT.finditer(text, a, b):
                    yield dot.start(), dot.end(), "."


def _underscore_edits(text: str) -> Iterator[Edit]:
    for m in _UNDERSCORED.finditer(text):
        yield *m.span(1), "@"
        for dot in _UNDERSCORED_DOT.finditer(text, *m.span(2)):
            yield *dot.span(), "."


_DOTTED = re.compile(
    rf"(?<![^\W_])(?:[0-9]{{1,3}}|{_word}(?:[ -]{_word}){{0,2}})(?: ?(?:dot|punto|punkt|point) ?(?:[0-9]{{1,3}}|{_word}(?:[ -]{_word}){{0,2}})){{3}}(?![^\W_])",
    re.IGNORECASE,
)
_DOT_WORD = re.compile(r" ?(?:dot|punto|punkt|point) ?", re.IGNORECASE)


def _dotted_edits(text: str) -> Iterator[Edit]:
    """Spelled addresses of four numbers."""
    for m in _DOTTED.finditer(text):
        numbers = [_PART.findall(n) for n in _DOT_WORD.split(m.group())]
        yield m.start(), m.end(), ".".join("".join(_SPELLED.get(p.lower(), p) for p in n) for n in numbers)


def normalised(text: str) -> Copy:
    """The text after all transducers."""
    copy = Copy(text)
    if not text.isascii():
        copy.rewrite([(m.start(), m.end(), "") for m in re.finditer(f"[{_INVISIBLE}]+", text)])
        plain = copy.text.translate(_homoglyphs())  # one character for one: no offset moves
        if plain != copy.text:
            copy.text, copy.changed = plain, True
    lower = copy.text.lower()
    dotted = any(f" {w} " in lower for w in _DOT_WORDS)
    if dotted:
        copy.rewrite(list(_dotted_edits(copy.text)))
    if _ANY_SPELLED.search(copy.text):
        copy.rewrite(list(_digit_edits(copy.text)))
        copy.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(copy.text)])
    copy.rewrite([(m.start(), m.end(), "@") for m in _AT.finditer(copy.text)])
    copy.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(copy.text)])
    lower = copy.text.lower()
    if dotted or "@ " in lower or " @" in lower or any(f" {w} " in lower for w in _AT_WORDS[1:]):
        copy.rewrite(list(_address_edits(copy.text)))
    if "_at_" in lower:
        copy.rewrite(list(_underscore_edits(copy.text)))
    return copy


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """(plain, all) spans of a text, each by kind as listed, then start."""
    plain = plain_spans(text)
    copy = normalised(text)
    if not copy.changed:
        return plain, plain
    every = list(plain)
    for kind, a, b in plain_spans(copy.text):
        start, end = copy.start(a), copy.end(b)
        # Beside a plain span of its kind only a longer one that holds it is new.
        met = [(s, e) for k, s, e in plain if k == kind and s < end and start < e]
        if all(start <= s and e <= end and (s, e) != (start, end) for s, e in met):
            every.append((kind, start, end))
    return plain, sorted(every, key=lambda s: (KINDS.index(s[0]), *s[1:]))


def _joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def find_pii(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data of every whole text (null: empty), offsets in code points, ends exclusive.

    `id`, n_email, n_ip, n_card, n_phone (of all spans), base_sha256 (of the spans that the
    plain text shows), spans (all, joined), n_added. Every row gives a row; an empty table
    gives none; other columns are not read.
    """

    def found(texts: list[str]) -> dict[str, list]:
        both = [spans(t) for t in texts]
        counts = {f"n_{kind}": [sum(s[0] == kind for s in every) for _, every in both] for kind in KINDS}
        return counts | {
            "base_sha256": [hashlib.sha256(_joined(plain).encode()).hexdigest() for plain, _ in both],
            "spans": [_joined(every) for _, every in both],
            "n_added": [len(every) - len(plain) for plain, every in both],
        }

    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return map_texts(df, [id], text, found, f"{counts}, base_sha256 string, spans string, n_added long")


def masked(text: str) -> str:
    """The text with every span replaced by its kind; overlapping spans are replaced together."""
    parts, done = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans(text)[1]):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def mask_pii(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep` and the text with every identifier replaced by its kind; a null stays null."""
    rest = [c for c in keep if c != text]
    flagged = df.select(*rest, F.col(text), F.col(text).isNull().alias("__null"))
    done = map_texts(
        flagged, [*rest, "__null"], text, lambda texts: {"__masked": [masked(t) for t in texts]}, "__masked string"
    )
    result: Column = F.when(~F.col("__null"), F.col("__masked")).alias(text)
    return done.select(*[result if c == text else F.col(c) for c in (keep or (text,))])
