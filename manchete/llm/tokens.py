"""Token counts by the whole-token shortcut.

Most words of a text are entries of the tokenizer's vocabulary. For an entry that encodes
alone as one token, that is proved once per worker from the vocabulary itself: every
vocabulary string is encoded by the library, and those that give exactly their own id form
the set of whole tokens. A text is then split into pre-tokens by the tokenizer's pattern;
whole tokens are counted by look-up and only the other distinct pre-tokens are merged.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of the word-level vocabulary, for characters up to U+017F.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼½¾"
_SPACES = "\t-\r \x85\xa0"
_PRE_TOKEN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
)
#: How a tokenizer of this kind prepares a text. Others are refused.
_PREPARES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: White space between words; other kinds of it stay in a word and are the library's matter.
_BETWEEN_WORDS = re.compile("[\t-\r ]+")
#: Beyond these the library's own normaliser and pattern decide: composed forms, other
#: scripts, a capital whose lower case has two characters, and special strings.
_UNUSUAL = re.compile("[^\\x00-ſ]|İ|<\\|")

#: Merged pre-tokens that a worker remembers; a full memory is emptied, which costs time only.
_REMEMBERED = 500_000


class Counting:
    """Counts of tokens in texts, as the library gives them without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        if any(made[k] != v for k, v in _PREPARES.items()) or made["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError(f"not a tokenizer of the word-level kind: {path}")
        self.whole = self._prove()
        self.merged: dict[str, int] = {}

    def _prove(self) -> frozenset[str]:
        """Vocabulary strings that are one pre-token and encode alone as their own token."""
        ends = [
            (t.removesuffix("</w>"), i)
            for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
            if t.endswith("</w>") and len(t) > 4
        ]
        # In the byte alphabet printable ASCII stands for itself; other entries are
        # spelled through the decoder, and count only if they are text.
        spelled = [(t if t.isascii() else _spelled(t), i) for t, i in ends]
        spelled = [(t, i) for t, i in spelled if t]
        found = self.tokenizer.encode_batch_fast([t for t, _ in spelled], add_special_tokens=False)
        return frozenset(
            t for (t, i), e in zip(spelled, found, strict=True) if e.ids == [i] and _PRE_TOKEN.fullmatch(t)
        )

    def _library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        found: list[Counter[str]] = []
        unknown: set[str] = set()
        merged, whole = self.merged, self.whole
        if len(merged) > _REMEMBERED:
            merged.clear()
        for text in texts:
            odd: list[str] = []
            if _UNUSUAL.search(text):
                words = _BETWEEN_WORDS.split(text)
                odd = [w for w in words if _UNUSUAL.search(w)]
                text = " ".join(w for w in words if not _UNUSUAL.search(w))
            parts = Counter(_PRE_TOKEN.findall(text.lower()))
            parts.update(odd)  # a word as it stands counts as much as alone, like a pre-token
            found.append(parts)
            unknown.update(p for p in parts if p not in whole and p not in merged)
        rest = list(unknown)
        merged.update(zip(rest, self._library(rest), strict=True))
        return [sum(n if p in whole else n * merged[p] for p, n in parts.items()) for parts in found]


@functools.cache
def _alphabet() -> dict[str, int]:
    """The byte that each character of the byte alphabet stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _spelled(token: str) -> str | None:
    try:
        return bytes(_alphabet()[c] for c in token).decode()
    except (KeyError, UnicodeDecodeError):
        return None


@functools.cache
def _counting(path: str) -> Counting:
    return Counting(path)


def token_counts(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: `id`, n_bytes (UTF-8), n_tokens, over_limit (more than `limit`).

    `tokenizer` is the path of a tokenizer file of the word-level kind (lower case, white
    space dropped, word ends marked), at the same place on all machines; a file that prepares
    texts in another way is an error. Special strings
    in a text count as the library's default has it, as one token each. Null and empty
    texts have no tokens; rows that repeat an id each give a row; other columns are not read.
    """
    from manchete.llm.common import map_texts

    def counted(texts: list[str]) -> dict[str, list]:
        return {
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": _counting(tokenizer).count(texts),
        }

    counts = map_texts(df, [id], text, counted, "n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
