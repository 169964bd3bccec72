"""Fixed names, values and result schemas of the news-corpus tables."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Everything in this block is data the results depend on; it is stated as is.

# Order of the columns in an article table.
ARTICLE_COLUMNS = (
    "titulo",
    "subtitulo",
    "data_pura",
    "horario",
    "link_noticia",
    "texto_completo",
    "link_imagem_principal",
    "tem_video",
    "nome_reporter",
    "tags_noticia",
)

# Columns that date parsing adds, in the order in which they are saved.
DATE_COLUMNS = ("data_dt", "ano_publicacao", "mes_publicacao", "mes_numero")

# Texts that stand for "could not be collected" in a captured article.
SENTINEL_DATE = "Erro ao coletar data"
SENTINEL_TIME = "Erro"
SENTINEL_TEXT = "Erro ao coletar texto"
SENTINEL_IMAGE = "Erro ao coletar imagem"
SENTINEL_REPORTER = "Erro ao coletar repórter"
SENTINEL_TAGS = "Erro ao coletar tags"
SENTINELS = (
    SENTINEL_DATE,
    SENTINEL_TIME,
    SENTINEL_TEXT,
    SENTINEL_IMAGE,
    SENTINEL_REPORTER,
    SENTINEL_TAGS,
)

# Written for "no tags" and "no time".
NOT_AVAILABLE = "N/A"

# A CSV cell that is exactly one of these is a missing value (pandas' defaults).
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Letters that survive text cleaning, besides whitespace and the hyphen.
ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyz"
ACCENTED_LETTERS = "áéíóúãõâêôàçü"

# Code points Python counts as whitespace, as inclusive ranges.
WHITESPACE_RANGES = (
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)

# Digits outside the decimal-number category (superscripts, circled digits, …),
# as inclusive code point ranges.
OTHER_DIGIT_RANGES = (
    (0xB2, 0xB3),
    (0xB9, 0xB9),
    (0x1369, 0x1371),
    (0x19DA, 0x19DA),
    (0x2070, 0x2070),
    (0x2074, 0x2079),
    (0x2080, 0x2089),
    (0x2460, 0x2468),
    (0x2474, 0x247C),
    (0x2488, 0x2490),
    (0x24EA, 0x24EA),
    (0x24F5, 0x24FD),
    (0x24FF, 0x24FF),
    (0x2776, 0x277E),
    (0x2780, 0x2788),
    (0x278A, 0x2792),
    (0x10A40, 0x10A43),
    (0x10E60, 0x10E68),
    (0x11052, 0x1105A),
    (0x1F100, 0x1F10A),
)

# Stop words added to the standard Portuguese list.
EXTRA_STOP_WORDS = (
    "tempo",
    "de acordo",
    "noticia",
    "notícias",
    "diz",
    "vai",
    "pode",
    "anos",
    "um",
    "uma",
    "dois",
    "duas",
    "ser",
    "ter",
    "fazer",
    "são",
    "deve",
    "feira",
    "conforme",
    "segundo",
    "em",
)

MONTHS = (
    "janeiro",
    "fevereiro",
    "março",
    "abril",
    "maio",
    "junho",
    "julho",
    "agosto",
    "setembro",
    "outubro",
    "novembro",
    "dezembro",
)

# First and last day a nanosecond timestamp can hold; other dates are missing.
FIRST_DATE = "1677-09-22"
LAST_DATE = "2262-04-11"

# Default bounds of the monthly report, both inclusive.
RANGE_START = "2023-07-01"
RANGE_END = "2025-06-30"

# Labels of the text-statistics sections, in output order.
TEXT_FIELDS = (
    ("titulo", "Títulos"),
    ("subtitulo", "Subtítulos"),
    ("texto_completo", "Texto Completo"),
)
NGRAM_LABELS = ("Palavras", "Bigrams", "Trigrams")
TAGS_LABEL = "Tags Mais Frequentes"

# Result-size limits of the reports.
TOP_TERMS = 50
TOP_CHART_TAGS = 20
TOP_CLOUD_TERMS = 100
NEWEST = 5
PREVIEW = 5
HITS_PER_PAGE = 8
# ------------------------------------------------------------ end fixed values

ARTICLE = T.StructType(
    [
        T.StructField(c, T.BooleanType() if c == "tem_video" else T.StringType())
        for c in ARTICLE_COLUMNS
    ]
)

# Types of every column that may appear in a saved news table.
COLUMN_TYPES: dict[str, T.DataType] = {f.name: f.dataType for f in ARTICLE.fields} | {
    "data_dt": T.DateType(),
    "ano_publicacao": T.IntegerType(),
    "mes_publicacao": T.StringType(),
    "mes_numero": T.IntegerType(),
}


def code_point_class(ranges) -> str:
    """Inside of a regex character class for inclusive code point ranges.

    Code points below 256 are listed one by one: the JVM keeps those in a bit
    table, whereas every range is one more predicate to try per character.
    """
    parts = []
    for first, last in ranges:
        low_end = min(last, 0xFF)
        parts += [f"\\x{{{p:x}}}" for p in range(first, low_end + 1)]
        start = max(first, 0x100)
        if start < last:
            parts.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
        elif start == last:
            parts.append(f"\\x{{{start:x}}}")
    return "".join(parts)


def complement(ranges) -> list[tuple[int, int]]:
    """Code point ranges not covered by ``ranges``."""
    out, nxt = [], 0
    for first, last in sorted(ranges):
        if first > nxt:
            out.append((nxt, first - 1))
        nxt = max(nxt, last + 1)
    if nxt <= 0x10FFFF:
        out.append((nxt, 0x10FFFF))
    return out


WHITESPACE = code_point_class(WHITESPACE_RANGES)
WHITESPACE_CHARS = "".join(
    chr(p) for first, last in WHITESPACE_RANGES for p in range(first, last + 1)
)
