"""The given tables in the shape of a news corpus: articles, dates, captured pages.

Everything here is a projection or join of the given Parquet tables. Title and subtitle
are the first two lines of a document, its id is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manchete import schema as S
from manchete.functions.dates import month_name
from manchete.sources.news_csv import CSV_OPTIONS
from manchete.sources.scans import read_table

BASE_URL = "https://www.noticias.example"
VIDEO_ADDRESS = "cdn.jornalnoticias.example/videos"
FIRST_DAY = "2023-01-01"
DAYS = 1200


def _lines(n: int) -> Column:
    return F.get(F.split("text", "\n", 3), n)


def portuguese_date(date: Column) -> Column:
    return F.concat_ws(
        " de ", F.day(date).cast("string"), month_name(F.month(date)), F.year(date).cast("string")
    )


def documents(spark: SparkSession, sf: str, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    return read_table(spark, f"{sf}/documents.parquet", list(columns), spread_by="doc_id")


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.col("doc_id").alias("row_id"), F.col("text").alias("texto_completo"))


def tagged(spark: SparkSession, sf: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Documents with their tags, ``N/A`` where they carry no label."""
    docs = documents(spark, sf, ("doc_id", "lang", "source", *columns))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    tags = F.concat_ws(
        ", ",
        "lang",
        "source",
        F.when(F.col("quality") == 1, "boa"),
        F.when(F.col("toxic") == 1, "tóxica"),
    )
    labelled = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    return docs.join(labels, "doc_id", "left").withColumn(
        "tags_noticia", F.when(labelled, tags).otherwise(S.NOT_AVAILABLE)
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """``(row_id, titulo, subtitulo, texto_completo, tags_noticia)``, tags as stored."""
    return tagged(spark, sf, ("text",)).select(
        F.col("doc_id").alias("row_id"),
        _lines(0).alias("titulo"),
        _lines(1).alias("subtitulo"),
        F.col("text").alias("texto_completo"),
        "tags_noticia",
    )


def raw_articles(spark: SparkSession, sf: str) -> DataFrame:
    """A raw article table with missing titles and links, error texts and an empty column."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("n_chars"), F.lit(DAYS)).cast("int"))
    df = tagged(spark, sf, ("text", "n_chars"))
    return df.select(
        F.when(F.col("source") == "src18", S.SENTINEL_TIME)
        .when(F.col("source") != "src19", _lines(0))
        .alias("titulo"),
        _lines(1).alias("subtitulo"),
        F.when(F.col("lang") == "de", S.SENTINEL_DATE).otherwise(portuguese_date(day)).alias("data_pura"),
        F.when(F.col("lang") == "de", S.SENTINEL_TIME)
        .when(F.col("lang") == "es", S.NOT_AVAILABLE)
        .otherwise("18:05")
        .alias("horario"),
        F.when(F.col("source") != "src17", F.concat(F.lit(BASE_URL + "/"), "doc_id")).alias("link_noticia"),
        F.when(F.col("toxic") == 1, S.SENTINEL_TEXT).otherwise(F.col("text")).alias("texto_completo"),
        F.when(F.col("lang") == "de", S.SENTINEL_IMAGE).alias("link_imagem_principal"),
        (F.col("source") == "src1").alias("tem_video"),
        F.when(F.col("quality") == 0, S.SENTINEL_REPORTER)
        .otherwise(F.concat(F.lit("Repórter "), "source"))
        .alias("nome_reporter"),
        "tags_noticia",
    )


def order_dates(spark: SparkSession, sf: str, spread_by: str | None = None) -> DataFrame:
    """Orders as articles that carry only a Portuguese date text."""
    columns = ["o_orderkey", "o_orderpriority", "o_orderdate"]
    orders = read_table(spark, f"{sf}/orders.parquet", columns, spread_by=spread_by)
    return orders.select(
        "o_orderkey",
        F.col("o_orderpriority").alias("titulo"),
        F.concat(F.lit(BASE_URL + "/"), "o_orderkey").alias("link_noticia"),
        portuguese_date(F.col("o_orderdate")).alias("data_pura"),
    )


def dates_around_default_range(spark: SparkSession, sf: str) -> DataFrame:
    """Orders on days from before the default range to after it, both bounds included."""
    day = F.date_add(F.lit("2023-06-25").cast("date"), F.pmod(F.col("o_orderkey"), F.lit(745)).cast("int"))
    orders = read_table(spark, f"{sf}/orders.parquet", ["o_orderkey"])
    return orders.select(portuguese_date(day).alias("data_pura"))


def doubtful_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates of which some are no dates."""
    text = (
        F.when(F.col("o_orderkey") % 10 == 3, "31 de fevereiro de 2024")
        .when(F.col("o_orderkey") % 10 == 7, "1º de maio de 2024")
        .otherwise(F.col("data_pura"))
    )
    return order_dates(spark, sf, spread_by="o_orderkey").withColumn("data_pura", text)


def split_articles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The raw articles in three tables, the second with few columns in another order."""
    raw = raw_articles(spark, sf)
    few, apart = (F.coalesce(F.col("link_noticia").endswith(end), F.lit(False)) for end in "73")
    return (
        raw.where(~few & ~apart),
        raw.where(few).select("link_noticia", "texto_completo", "titulo"),
        raw.where(apart),
    )


def write_after_blank_lines(df: DataFrame, path: str, files: int = 3) -> None:
    """CSV files that begin with two empty lines, as some exports do."""
    number = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    rows = df.select(number.alias("file"), F.lit(2).alias("at"), F.to_csv(F.struct(*df.columns), CSV_OPTIONS).alias("value"))
    lines = F.array(F.struct(F.lit(0).alias("at"), F.lit("\n").alias("value")), F.struct(F.lit(1).alias("at"), F.lit(",".join(df.columns)).alias("value")))
    heads = df.sparkSession.range(files).select(F.col("id").alias("file"), F.inline(lines))
    ordered = heads.unionByName(rows).repartition("file").sortWithinPartitions("file", "at")
    ordered.select("file", "value").write.partitionBy("file").text(path)


def only_stop_words(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of stop words only, but for the body of the document with the smallest id."""
    first = spark.read.parquet(f"{sf}/documents.parquet").agg(F.min("doc_id")).first()[0]
    blank = F.lit("De para QUE")
    kept = F.when(F.col("row_id") == first, F.col("texto_completo")).otherwise(blank)
    return texts(spark, sf).withColumns({"titulo": blank, "subtitulo": blank, "texto_completo": kept}).drop("tags_noticia")


def list_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The given web pages as result pages, in the order of their ids."""
    pages = read_table(spark, f"{sf}/pages.parquet", ["page_id", "html"], spread_by="page_id")
    return pages.select((F.col("page_id") + 1).cast("int").alias("page_no"), "html")


def web_pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, f"{sf}/pages.parquet", ["page_id", "url", "html"], spread_by="page_id")


def _escaped(c: Column) -> Column:
    return F.replace(
        F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit(">"),
        F.lit("&gt;"),
    )


def _path() -> Column:
    return F.concat(F.lit("/noticia/"), "doc_id")


def result_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Result-list pages with up to eight documents each.

    Some hits lack their link, some have one that is no address, and every fifth page
    declares no total.
    """
    pages = F.floor(F.col("doc_id") / 8).alias("page")
    hit = F.concat(
        F.lit('<li class="ais-Hits-item"><div>'),
        F.when(F.col("source") == "src19", F.lit("<a>")).otherwise(
            F.concat(
                F.lit('<a class="search-results" href="'),
                F.when(F.col("source") == "src8", "http://[bad").otherwise(_path()),
                F.lit('">'),
            )
        ),
        F.lit('<h2 class="search-results__texto--title"> '),
        _escaped(_lines(0)),
        F.lit("</h2>"),
        F.coalesce(
            F.concat(
                F.lit('<h3 class="search-results__texto--subtitle">'),
                _escaped(_lines(1)),
                F.lit("</h3>"),
            ),
            F.lit(""),
        ),
        F.lit("</a></div></li>"),
    )
    grouped = (
        documents(spark, sf, ("doc_id", "text", "source"))
        .groupBy(pages)
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", hit.alias("hit")))).alias("hits"))
    )
    page_no = (F.col("page") + 1).cast("int")
    return grouped.select(
        page_no.alias("page_no"),
        F.concat(
            F.when(page_no % 5 == 0, "<div> Página ").otherwise('<div class="pagination__info"> Página '),
            page_no.cast("string"),
            F.lit(" de "),
            F.size("hits").cast("string"),
            F.lit('</div><div id="hits"><ol>'),
            F.array_join(F.col("hits.hit"), ""),
            F.lit("</ol></div>"),
        ).alias("html"),
    )


def ending_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The result pages, of which some in the last quarter are without hits."""
    last = spark.read.parquet(f"{sf}/documents.parquet").agg(F.max(F.floor(F.col("doc_id") / 8) + 1)).first()[0]
    empty = (F.col("page_no") * 4 > 3 * last) & (F.col("page_no") % 7 == 3)
    page = F.concat(F.lit('<div class="pagination__info"> Página '), F.col("page_no").cast("string"), F.lit('</div><div id="hits"><ol></ol></div>'))
    return result_pages(spark, sf).withColumn("html", F.when(empty, page).otherwise(F.col("html")))


def article_pages(spark: SparkSession, sf: str) -> DataFrame:
    """An article page per document.

    Those of German ones are of other addresses than the hits name, toxic ones are unsigned,
    and two sources have pages that cannot be read: an image whose address is none, and a
    character reference that no parser takes.
    """
    df = tagged(spark, sf, ("text", "n_chars"))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("n_chars"), F.lit(DAYS)).cast("int"))
    paragraphs = F.concat(
        F.lit("<p>"), F.replace(_escaped(F.col("text")), F.lit("\n"), F.lit("</p>\n<p> ")), F.lit("</p>")
    )
    tag_items = F.transform(
        F.split("tags_noticia", ", "),
        lambda t: F.concat(F.lit('<li><a class="label__tag">'), t, F.lit("</a></li>")),
    )
    html = F.concat(
        F.lit("<html><body>"),
        F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 0, F.lit('<div class="x cp023-assinatura-do-artigo">')).otherwise(
            F.lit("<div>")
        ),
        F.lit('<div class="cmp__author-info"><span class="cmp__author-name">'),
        # The three places an author may be found in.
        F.when(F.col("lang") == "en", F.concat(F.lit("<span>Por "), "source", F.lit(" </span>")))
        .when(F.col("lang") == "fr", F.concat(F.lit("<a> redação  "), "source", F.lit("</a>")))
        .otherwise(F.concat(F.lit("Repórter  "), "source")),
        F.lit('</span></div><span class="cmp__author-publication"><span>'),
        portuguese_date(day),
        F.when(F.col("lang") != "es", " | 18:05 - Atualizado").otherwise(" - Atualizado"),
        F.lit('</span></span></div><div class="gallery__container gallery_highlight">'),
        F.concat(F.lit('<img class="gallery__image" src="'), F.when(F.col("source") == "src6", "//[bad").when(F.col("lang") == "en", "/").otherwise(BASE_URL + "/"), F.lit("foto/"), "doc_id", F.lit('.jpg">')),
        F.lit("</div>"),
        F.when(F.col("source") == "src1", '<iframe class="c-video__frame"></iframe>')
        .when(F.col("source") == "src2", "<video src='v'></video>")
        .when(F.col("source") == "src3", '<div class="c-news-body"><iframe src="https://player.vimeo.com/1"></iframe></div>')
        .when(F.col("source") == "src4", '<div class="c-news-body"><iframe src="https://' + VIDEO_ADDRESS + '/1"></iframe></div>')
        .when(F.col("source") == "src5", '<div class="c-news-body"><iframe src="https://other.example/1"></iframe></div>')
        .otherwise(""),
        F.lit('<div class="read-controller materia__tts article-whole article-body">'),
        paragraphs,
        F.lit("</div>"),
        F.when(
            F.col("tags_noticia") != S.NOT_AVAILABLE,
            F.concat(
                F.lit('<div class="tags"><ul class="cmp__tagbox">'),
                F.array_join(tag_items, ""),
                F.lit("</ul></div>"),
            ),
        ).otherwise(""),
        F.when(F.col("source") == "src7", "&#" + "9" * 5000 + ";").otherwise(""),
        F.lit("</body></html>"),
    )
    url = F.concat(F.lit(BASE_URL), F.when(F.col("lang") == "de", "/outra").otherwise(""), _path())
    return df.select(
        F.col("doc_id").alias("page_id"), url.alias("url"), html.alias("html")
    )
