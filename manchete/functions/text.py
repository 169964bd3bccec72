"""Text cleaning, tokenising and tag splitting as JVM-side expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from manchete import schema as S
from manchete.functions.literals import listed, name

_LETTERS = (
    S.ASCII_LETTERS + S.ASCII_LETTERS.upper() + S.ACCENTED_LETTERS + S.ACCENTED_LETTERS.upper()
)

# Characters that cleaning deletes. Written as the positive complement of the
# kept set: the JVM matches a positive class about ten times faster than a
# negated class that mixes single characters and ranges.
_DELETED = S.code_point_class(
    S.complement([(ord(c), ord(c)) for c in _LETTERS + "-"] + list(S.WHITESPACE_RANGES))
)
# After cleaning and lower-casing a word consists of these characters only.
_WORD = S.code_point_class([(ord(c), ord(c)) for c in S.ASCII_LETTERS + S.ACCENTED_LETTERS + "-"])

_CLOUD_WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"
_ALL_DIGITS = rf"^[\p{{Nd}}{S.code_point_class(S.OTHER_DIGIT_RANGES)}]+$"


def portuguese_stop_words() -> list[str]:
    """Spark's bundled Portuguese list plus the extra entries, sorted."""
    return sorted({*StopWordsRemover.loadDefaultStopWords("portuguese"), *S.EXTRA_STOP_WORDS})


def clean_text(c: Column) -> Column:
    """Delete (not blank out) everything but letters, whitespace and ``-``; lower-case."""
    return F.lower(F.regexp_replace(c, f"[{_DELETED}]", ""))


def long_words(c: Column) -> Column:
    """Words of a text in order that are longer than two characters.

    Cleaned text holds only letters, hyphens and whitespace, so the maximal runs
    of three or more non-space characters are exactly the whitespace-separated
    words that pass the length rule.
    """
    return F.regexp_extract_all(clean_text(c), F.lit(f"[{_WORD}]{{3,}}"), F.lit(0))


def without_stop_words(words: str, stop_words: Iterable[str]) -> Column:
    """The words of an array column, by name, that are not stop words; order is kept."""
    stop = [w for w in stop_words if len(w) > 2]
    kept = f"filter({name(words)}, w -> w NOT IN ({listed(stop)}))"
    return F.expr(kept) if stop else F.col(words)


def strip(c: Column) -> Column:
    """Trim every kind of whitespace, not only the space character."""
    return F.btrim(c, F.lit(S.WHITESPACE_CHARS))


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{S.WHITESPACE}]+", " "))


def split_tags(c: Column) -> Column:
    """Comma-separated tags in order, trimmed, empty ones dropped, case kept."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")


def cloud_tokens(c: Column) -> Column:
    """Raw word-cloud tokens in order: word characters, apostrophes inside, any case."""
    return F.regexp_extract_all(c, F.lit(_CLOUD_WORD), F.lit(0))


def cut_possessive(c: Column) -> Column:
    return F.regexp_replace(c, "'[sS]$", "")


def is_number(c: Column) -> Column:
    return c.rlike(_ALL_DIGITS)
