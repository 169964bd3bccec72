"""DuckDB SQL that states the expected result of every registered query."""

from __future__ import annotations

import glob
import os
import zipfile

import pyspark

from manchete import schema as S
from manchete.functions.text import portuguese_stop_words
from manchete.operators.cloud import CLOUDS
from standins import BASE_URL, DAYS, FIRST_DAY

_WS = S.WHITESPACE
_LETTERS = (
    S.ASCII_LETTERS + S.ASCII_LETTERS.upper() + S.ACCENTED_LETTERS + S.ACCENTED_LETTERS.upper()
)
_SENTINELS = ", ".join(f"'{s}'" for s in S.SENTINELS)
_MONTHS = "[" + ", ".join(f"'{m}'" for m in S.MONTHS) + "]"
_WS_CHARS = " || ".join(
    f"chr({p})" for first, last in S.WHITESPACE_RANGES for p in range(first, last + 1)
)


def stop_words() -> list[str]:
    """The list Spark bundles, read from its jar so that no session is needed."""
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    if not jars:
        return portuguese_stop_words()
    with zipfile.ZipFile(jars[0]) as z:
        listed = z.read("org/apache/spark/ml/feature/stopwords/portuguese.txt").decode().split("\n")
    return sorted({w.strip() for w in listed if w.strip()} | set(S.EXTRA_STOP_WORDS))


def _stop_sql() -> str:
    return ", ".join(f"'{w}'" for w in stop_words())


# ------------------------------------------------------------------ table stand-ins
_TAGS = f"""
    CASE WHEN l.doc_id IS NULL THEN '{S.NOT_AVAILABLE}'
         ELSE concat_ws(', ', d.lang, d.source,
                        CASE WHEN l.quality = 1 THEN 'boa' END,
                        CASE WHEN l.toxic = 1 THEN 'tóxica' END) END"""
_LINE1 = "string_split(d.text, chr(10))[1]"
_LINE2 = "string_split(d.text, chr(10))[2]"
_TEXTS = f"""
    SELECT d.doc_id AS row_id, {_LINE1} AS titulo, {_LINE2} AS subtitulo, d.text AS texto_completo,
           nullif({_TAGS}, '{S.NOT_AVAILABLE}') AS tags_noticia
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
_DOC_DAY = f"(DATE '{FIRST_DAY}' + CAST(d.n_chars % {DAYS} AS INTEGER))"


def _spelled(day: str) -> str:
    return f"(day({day}) || ' de ' || {_MONTHS}[month({day})] || ' de ' || year({day}))"


_RAW = f"""
    SELECT d.doc_id,
           CASE WHEN d.source = 'src18' THEN '{S.SENTINEL_TIME}' WHEN d.source <> 'src19' THEN {_LINE1} END AS titulo,
           {_LINE2} AS subtitulo,
           CASE WHEN d.lang = 'de' THEN '{S.SENTINEL_DATE}' ELSE {_spelled(_DOC_DAY)} END AS data_pura,
           CASE WHEN d.lang = 'de' THEN '{S.SENTINEL_TIME}' WHEN d.lang = 'es' THEN '{S.NOT_AVAILABLE}' ELSE '18:05' END AS horario,
           CASE WHEN d.source <> 'src17' THEN '{BASE_URL}/' || d.doc_id END AS link_noticia,
           CASE WHEN l.toxic = 1 THEN '{S.SENTINEL_TEXT}' ELSE d.text END AS texto_completo,
           CASE WHEN d.lang = 'de' THEN '{S.SENTINEL_IMAGE}' END AS link_imagem_principal,
           d.source = 'src1' AS tem_video,
           CASE WHEN l.quality = 0 THEN '{S.SENTINEL_REPORTER}' ELSE 'Repórter ' || d.source END AS nome_reporter,
           {_TAGS} AS tags_noticia,
           {_DOC_DAY} AS dia, d.lang
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
_RAW_TEXT_COLUMNS = [c for c in S.ARTICLE_COLUMNS if c != "tem_video"]
_NA_LIST = ", ".join(f"'{t}'" for t in S.NA_TOKENS)


def _decoded(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({_NA_LIST}) THEN {c} END AS {c}"


_DECODED = f"""
    SELECT doc_id, dia, lang, tem_video, {', '.join(_decoded(c) for c in _RAW_TEXT_COLUMNS)} FROM ({_RAW})"""
_COMPLETE = f"SELECT * FROM ({_DECODED}) WHERE titulo IS NOT NULL AND link_noticia IS NOT NULL"


def _unmarked(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({_SENTINELS}) THEN {c} END AS {c}"


# The image column is empty in every complete row, so cleaning drops it.
_KEPT = [c for c in _RAW_TEXT_COLUMNS if c != "link_imagem_principal"]
_CLEAN = f"""
    SELECT {', '.join(_unmarked(c) for c in _KEPT)}, tem_video,
           CASE WHEN lang <> 'de' THEN dia END AS data_dt,
           CAST(CASE WHEN lang <> 'de' THEN year(dia) END AS INTEGER) AS ano_publicacao,
           CASE WHEN lang <> 'de' THEN {_MONTHS}[month(dia)] END AS mes_publicacao,
           CAST(CASE WHEN lang <> 'de' THEN month(dia) END AS INTEGER) AS mes_numero
    FROM ({_COMPLETE})"""


# --------------------------------------------------------------------------- terms
def _grams(fields: tuple[int, ...], sizes: tuple[int, ...]) -> str:
    texts = " UNION ALL ".join(
        f"SELECT row_id, {i} AS campo, {S.TEXT_FIELDS[i][0]} AS texto FROM textos" for i in fields
    )
    grams = " UNION ALL ".join(
        f"SELECT row_id, i, campo * 3 + {n} AS secao, "
        + " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
        + f" AS termo FROM inicios WHERE i + {n - 1} <= len(w)"
        for n in sizes
    )
    return f"""
    textos AS ({_TEXTS}),
    palavras AS (
        SELECT row_id, campo,
               list_filter(
                   regexp_split_to_array(
                       lower(regexp_replace(texto, '[^{_LETTERS}{_WS}-]', '', 'g')), '[{_WS}]+'),
                   lambda x: length(x) > 2 AND x NOT IN ({_stop_sql()})) AS w
        FROM ({texts}) WHERE texto IS NOT NULL),
    inicios AS (SELECT row_id, campo, w, unnest(range(1, len(w) + 1)) AS i FROM palavras),
    gramas AS ({grams})"""


_TAG_ROWS = f"""
    SELECT row_id, i, 10 AS secao, t[i] AS termo
    FROM (SELECT row_id, t, unnest(range(1, len(t) + 1)) AS i
          FROM (SELECT row_id, list_filter(list_transform(string_split(tags_noticia, ','),
                                                          lambda x: trim(x, {_WS_CHARS})),
                                           lambda x: x <> '') AS t
                FROM textos WHERE tags_noticia IS NOT NULL))"""


def _section_name(secao: str) -> str:
    names = [f"{n} - {f}" for _, f in S.TEXT_FIELDS for n in S.NGRAM_LABELS] + [S.TAGS_LABEL]
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][{secao}]"


def _ranked(rows: str, limit: int) -> str:
    return f"""
    SELECT secao, posicao, {_section_name('secao')} AS tipo, termo, frequencia
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY secao ORDER BY frequencia DESC, primeira) AS INTEGER) AS posicao
          FROM (SELECT CAST(secao AS INTEGER) AS secao, termo, count(*) AS frequencia, min((row_id, i)) AS primeira
                FROM ({rows}) GROUP BY ALL))
    WHERE posicao <= {limit}"""


def _top_ngrams(n: int) -> str:
    return f"WITH {_grams((2,), (n,))} {_ranked('SELECT * FROM gramas', S.TOP_TERMS)}"


def _top_tags(limit: int) -> str:
    return f"WITH textos AS ({_TEXTS}) {_ranked(_TAG_ROWS, limit)}"


def _term_stats() -> str:
    rows = f"SELECT * FROM gramas UNION ALL {_TAG_ROWS}"
    return f"""WITH {_grams((0, 1, 2), (1, 2, 3))}
    SELECT tipo AS "Tipo de Análise", termo AS "Termo", frequencia AS "Frequência"
    FROM ({_ranked(rows, S.TOP_TERMS)})"""


def _cloud_terms(table: str) -> str:
    columns = [c for c, _ in CLOUDS]
    names = "[" + ", ".join(f"'{n}'" for _, n in CLOUDS) + "]"
    texts = " UNION ALL ".join(
        f"SELECT row_id, {i} AS nuvem, {c} AS texto FROM textos" for i, c in enumerate(columns)
    )
    digits = S.code_point_class(S.OTHER_DIGIT_RANGES)
    return rf"""
    WITH textos AS ({table}),
    listas AS (SELECT row_id, nuvem, regexp_extract_all(texto, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_'']*') AS w
               FROM ({texts}) WHERE texto IS NOT NULL),
    fichas AS (SELECT row_id, nuvem, i, CASE WHEN lower(w[i]) LIKE '%''s' THEN left(w[i], length(w[i]) - 2) ELSE w[i] END AS palavra
               FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM listas)),
    aceitas AS (SELECT *, lower(palavra) AS chave FROM fichas
                WHERE NOT regexp_full_match(palavra, '[\p{{Nd}}{digits}]+') AND lower(palavra) NOT IN ({_stop_sql()})),
    chaves AS (SELECT DISTINCT nuvem, chave FROM aceitas),
    plurais AS (SELECT p.nuvem, p.chave FROM chaves p JOIN chaves s
                ON p.nuvem = s.nuvem AND p.chave = s.chave || 's'
                WHERE p.chave NOT LIKE '%ss'),
    unidas AS (SELECT a.nuvem, a.row_id, a.i, p.chave IS NOT NULL AS unido,
                      CASE WHEN p.chave IS NULL THEN a.chave ELSE left(a.chave, length(a.chave) - 1) END AS chave,
                      CASE WHEN p.chave IS NULL THEN a.palavra ELSE left(a.palavra, length(a.palavra) - 1) END AS forma
               FROM aceitas a LEFT JOIN plurais p ON a.nuvem = p.nuvem AND a.chave = p.chave),
    formas AS (SELECT nuvem, chave, forma, count(*) AS n,
                      min((row_id, i)) FILTER (NOT unido) AS propria, min((row_id, i)) AS qualquer
               FROM unidas GROUP BY ALL),
    escolhidas AS (SELECT *, row_number() OVER (PARTITION BY nuvem, chave
                          ORDER BY n DESC, propria IS NULL, coalesce(propria, qualquer)) AS k FROM formas),
    contadas AS (SELECT nuvem, chave, max(CASE WHEN k = 1 THEN forma END) AS termo,
                        CAST(sum(n) AS BIGINT) AS frequencia, min(propria) AS primeira
                 FROM escolhidas GROUP BY ALL),
    postas AS (SELECT *, CAST(row_number() OVER (PARTITION BY nuvem ORDER BY frequencia DESC, primeira) AS INTEGER) AS posicao,
                      max(frequencia) OVER (PARTITION BY nuvem) AS maior FROM contadas)
    SELECT CAST(nuvem AS INTEGER) AS nuvem, posicao, {names}[nuvem + 1] AS tipo, termo, frequencia,
           round(frequencia / maior, 6) AS peso
    FROM postas WHERE posicao <= {S.TOP_CLOUD_TERMS}"""


# -------------------------------------------------------------------------- counts
def _monthly(table: str, day: str, where: str, month_number: bool) -> str:
    number = f"CAST(month({day}) AS INTEGER) AS mes_numero," if month_number else ""
    return f"""
    SELECT CAST(year({day}) AS INTEGER) AS ano_publicacao, {_MONTHS}[month({day})] AS mes_publicacao,
           {number} count(*) AS total_noticias
    FROM {table} WHERE {where} GROUP BY year({day}), month({day})"""


# ------------------------------------------------------------------- captured pages
def _plain(c: str) -> str:
    """Text of an HTML fragment without tags."""
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{char}')"
    return c


_LIST_HITS = f"""
    SELECT CAST(page_id + 1 AS INTEGER) AS page_no, CAST(i - 1 AS INTEGER) AS pos,
           trim({_plain("texts[i]")}, {_WS_CHARS}) AS titulo, CAST(NULL AS VARCHAR) AS subtitulo,
           '{BASE_URL}' || {_plain("links[i]")} AS link_noticia
    FROM (SELECT *, unnest(range(1, len(links) + 1)) AS i
          FROM (SELECT page_id,
                       regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS links,
                       regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS texts
                FROM pages))"""
_HIT_ORDER = "page_no, pos"

_DOC_TEXT = f"""
    array_to_string(list_filter(list_transform(string_split(d.text, chr(10)), lambda x: trim(x, {_WS_CHARS})),
                                lambda x: x <> ''), chr(10))"""


def _captured() -> str:
    def field(c: str, value: str, sentinel: str) -> str:
        return f"CASE WHEN ok THEN {value} ELSE {sentinel} END AS {c}"

    return f"""
    SELECT CAST(d.doc_id // 8 + 1 AS INTEGER) AS page_no, CAST(d.doc_id % 8 AS INTEGER) AS pos,
           trim({_LINE1}, {_WS_CHARS}) AS titulo, trim({_LINE2}, {_WS_CHARS}) AS subtitulo,
           {field('data_pura', _spelled('dia'), f"'{S.SENTINEL_DATE}'")},
           {field('horario', "CASE WHEN d.lang <> 'es' THEN '18:05' ELSE 'N/A' END", f"'{S.SENTINEL_TIME}'")},
           '{BASE_URL}/noticia/' || d.doc_id AS link_noticia,
           {field('texto_completo', _DOC_TEXT, f"'{S.SENTINEL_TEXT}'")},
           {field('link_imagem_principal', f"'{BASE_URL}/foto/' || d.doc_id || '.jpg'", f"'{S.SENTINEL_IMAGE}'")},
           {field('tem_video', "d.source IN ('src1', 'src2', 'src3', 'src4')", 'false')},
           {field('nome_reporter', "CASE WHEN d.lang IN ('en', 'fr') THEN d.source ELSE 'Repórter ' || d.source END", f"'{S.SENTINEL_REPORTER}'")},
           {field('tags_noticia', 'tags', f"'{S.SENTINEL_TAGS}'")}
    FROM (SELECT d.*, d.lang <> 'de' AND coalesce(l.toxic, 0) = 0 AND d.source NOT IN ('src6', 'src7') AS ok, {_DOC_DAY} AS dia, {_TAGS} AS tags
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) d
    WHERE d.source NOT IN ('src19', 'src8') AND trim({_LINE1}, {_WS_CHARS}) <> ''"""


_PAGE_ARTICLES = f"""
    SELECT page_id, url AS link_noticia,
           array_to_string(
               list_filter(
                   list_transform(
                       string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')[2:],
                       lambda p: array_to_string(
                           list_transform(regexp_split_to_array(p, '<[^>]*>'),
                                          lambda t: trim({_plain("t")}, {_WS_CHARS})), '')),
                   lambda p: p <> ''), chr(10)) AS texto_completo,
           false AS tem_video, 'N/A' AS tags_noticia
    FROM pages"""


def _profile(stage: str, source: str, columns: list[str]) -> tuple[str, str]:
    types = {"tem_video": "boolean", "data_dt": "date", "ano_publicacao": "int", "mes_numero": "int"}
    counts = ", ".join(f"count({c}) AS {c}" for c in columns)
    lines = " UNION ALL ".join(
        f"SELECT '{stage}' AS etapa, {i} AS ordem, '{c}' AS coluna, '{types.get(c, 'string')}' AS tipo, "
        f"{c} AS nao_nulos, linhas FROM {stage}"
        for i, c in enumerate(columns)
    )
    return f"{stage} AS (SELECT count(*) AS linhas, {counts} FROM ({source}))", lines


def _profiles() -> str:
    final = [c for c in (*S.ARTICLE_COLUMNS, *S.DATE_COLUMNS) if c != "link_imagem_principal"]
    cleaned = [c for c in S.ARTICLE_COLUMNS if c != "link_imagem_principal"]
    parts = [
        _profile("original", _DECODED, list(S.ARTICLE_COLUMNS)),
        _profile("limpo", _CLEAN, cleaned),
        _profile("final", _CLEAN, final),
    ]
    return f"WITH {', '.join(c for c, _ in parts)} {' UNION ALL '.join(q for _, q in parts)}"


def _survives(c: str) -> str:
    value = f"{c} IS NOT NULL" if c == "tem_video" else f"{c} NOT IN ({_SENTINELS})"
    return f"(count(*) FILTER (titulo IS NOT NULL AND link_noticia IS NOT NULL AND {value}) > 0)"


_REPORT = f"""
    SELECT *, linhas_antes - linhas_depois AS linhas_removidas,
           colunas_antes - colunas_depois AS colunas_removidas
    FROM (SELECT count(*) AS linhas_antes,
                 count(*) FILTER (titulo IS NOT NULL AND link_noticia IS NOT NULL) AS linhas_depois,
                 {len(S.ARTICLE_COLUMNS)} AS colunas_antes,
                 {' + '.join(f"CAST({_survives(c)} AS INTEGER)" for c in S.ARTICLE_COLUMNS)} AS colunas_depois
          FROM ({_DECODED}))"""


_AROUND = "CAST(DATE '2023-06-25' + CAST(o_orderkey % 745 AS INTEGER) AS DATE)"

# The rows of the second file have three columns only.
_FEW = "coalesce(link_noticia LIKE '%7', false)"
_KEPT = ("link_noticia", "texto_completo", "titulo")
_MANY_FILES = ", ".join(
    c if c in _KEPT else f"CASE WHEN NOT {_FEW} THEN {c} END AS {c}" for c in S.ARTICLE_COLUMNS
)


_SEARCH = f"""
    SELECT row_id, titulo, subtitulo, texto_completo FROM ({_TEXTS})
    WHERE contains(lower(concat_ws(chr(10), titulo, subtitulo, texto_completo)), lower('Auréa'))"""


def oracle_sql(limits: dict[str, int]) -> dict[str, str]:
    day = "CAST(o_orderdate AS DATE)"
    return {
        "top_words_body": _top_ngrams(1),
        "top_bigrams_body": _top_ngrams(2),
        "top_trigrams_body": _top_ngrams(3),
        "term_stats": _term_stats(),
        "term_stats_two_pass": _term_stats(),
        "top_tags": _top_tags(S.TOP_TERMS),
        "top_tags_chart": _top_tags(S.TOP_CHART_TAGS),
        "cloud_terms": _cloud_terms(_TEXTS),
        "parse_dates": f"""
            SELECT o_orderkey,
                   CASE o_orderkey % 10 WHEN 3 THEN '31 de fevereiro de 2024' WHEN 7 THEN '1º de maio de 2024'
                        ELSE {_spelled(day)} END AS data_pura,
                   d AS data_dt, CAST(year(d) AS INTEGER) AS ano_publicacao, {_MONTHS}[month(d)] AS mes_publicacao,
                   CAST(month(d) AS INTEGER) AS mes_numero
            FROM (SELECT *, CASE WHEN o_orderkey % 10 NOT IN (3, 7) THEN {day} END AS d FROM orders)""",
        "monthly_all": _monthly("orders", day, "o_orderdate IS NOT NULL", True),
        "monthly_range": _monthly("orders", day, f"{day} BETWEEN DATE '1996-07-01' AND DATE '1998-06-30'", False),
        "monthly_default_range": _monthly(
            "orders", _AROUND, f"{_AROUND} BETWEEN DATE '{S.RANGE_START}' AND DATE '{S.RANGE_END}'", False
        ),
        "yearly": f"SELECT CAST(year({day}) AS INTEGER) AS ano_publicacao, count(*) AS total_noticias FROM orders GROUP BY ALL",
        "by_date_text": f"SELECT {_spelled(day)} AS data_publicacao_limpa, count(*) AS total_noticias FROM orders GROUP BY ALL",
        "newest5": f"""
            SELECT o_orderpriority AS titulo, {day} AS data_dt, '{BASE_URL}/' || o_orderkey AS link_noticia
            FROM orders ORDER BY 2 DESC NULLS LAST, 3 LIMIT {S.NEWEST}""",
        "clean_rows": _CLEAN,
        "clean_report": _REPORT,
        "profile": _profiles(),
        "csv_roundtrip": f"SELECT {', '.join(S.ARTICLE_COLUMNS)} FROM ({_DECODED})",
        "csv_split_files": f"SELECT {', '.join(S.ARTICLE_COLUMNS)} FROM ({_DECODED})",
        "clean_csv_roundtrip": _CLEAN,
        "csv_many_files": f"SELECT {_MANY_FILES} FROM ({_DECODED})",
        "monthly_csv": _monthly("orders", day, f"{day} BETWEEN DATE '1996-07-01' AND DATE '1998-06-30'", False),
        "yearly_csv": f"SELECT CAST(year({day}) AS INTEGER) AS ano_publicacao, count(*) AS total_noticias FROM orders GROUP BY ALL",
        "term_stats_csv": _term_stats(),
        "term_stats_no_subtitle": f"SELECT * FROM ({_term_stats()}) WHERE \"Tipo de Análise\" NOT LIKE '%Subtítulos'",
        "cloud_all_stop_words": _cloud_terms(f"""
            SELECT row_id, CAST(NULL AS VARCHAR) AS tags_noticia, 'De para QUE' AS titulo, 'De para QUE' AS subtitulo, CASE WHEN row_id =
                (SELECT min(doc_id) FROM documents) THEN texto_completo ELSE 'De para QUE' END AS texto_completo
            FROM ({_TEXTS})"""),
        "captured_order": f"""
            SELECT row_number() OVER (ORDER BY page_no, pos) AS numero, link_noticia FROM ({_captured()})""",
        "list_hits": _LIST_HITS,
        "page_articles": _PAGE_ARTICLES,
        "capture_articles": _captured(),
        "captured_count": f"SELECT count(*) AS total_noticias FROM ({_captured()})",
        "declared_totals": """
            SELECT page_no, CASE WHEN page_no % 5 > 0 THEN n END AS paginas,
                   CASE WHEN page_no % 5 > 0 THEN CAST(n * 8 AS BIGINT) END AS noticias_estimadas
            FROM (SELECT CAST(doc_id // 8 + 1 AS INTEGER) AS page_no, CAST(count(*) AS INTEGER) AS n
                  FROM documents GROUP BY 1)""",
        "byline_clean": """
            SELECT doc_id, CASE WHEN lang = 'de' THEN 'tela' ELSE source || ' e ' || lang END AS nome_reporter
            FROM documents""",
        "publication_split": f"""
            SELECT d.doc_id, {_spelled(_DOC_DAY)} AS data_pura,
                   CASE WHEN d.lang = 'es' THEN 'N/A' ELSE '18:05' END AS horario
            FROM documents d""",
        "first_n_hits": f"SELECT * FROM ({_LIST_HITS}) WHERE titulo <> '' ORDER BY {_HIT_ORDER} LIMIT {limits['articles']}",
        "first_n_hits_by_block": f"SELECT * FROM ({_LIST_HITS}) WHERE titulo <> '' ORDER BY {_HIT_ORDER} LIMIT {limits['articles']}",
        "first_many_hits": f"SELECT * FROM ({_LIST_HITS}) WHERE titulo <> '' ORDER BY {_HIT_ORDER} LIMIT {limits['many_articles']}",
        "until_empty_page": f"""
            SELECT page_no, pos, titulo, subtitulo, link_noticia FROM ({_captured()})
            WHERE page_no < coalesce((SELECT min(CAST(doc_id // 8 + 1 AS INTEGER)) FROM documents
                WHERE (doc_id // 8 + 1) % 7 = 3
                    AND 4 * (doc_id // 8 + 1) > 3 * (SELECT max(doc_id // 8 + 1) FROM documents)), 2147483647)""",
        "first_p_pages": f"SELECT * FROM ({_LIST_HITS}) WHERE titulo <> '' AND page_no <= {limits['pages']}",
        "preview5": f"""
            SELECT * REPLACE (coalesce(tags_noticia, 'N/A') AS tags_noticia) FROM ({_TEXTS})
            ORDER BY row_id LIMIT {S.PREVIEW}""",
        "search_articles": _SEARCH,
        "search_index": _SEARCH,
    }
