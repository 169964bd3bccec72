import pytest
from pyspark.sql import functions as F

from manchete import schema as S
from manchete.operators import capture, chunks, selection
from manchete.plans.capture import capture_articles, capture_hits, run_capture
from manchete.sources.news_csv import read_news_csv
from manchete.sources.site_profile import SiteProfile

BASE = "https://www.jornal.example"
SITE = SiteProfile(BASE)
DETAILS = (
    "page_id bigint, link_noticia string, coletado boolean, data_pura string, horario string, "
    "texto_completo string, link_imagem_principal string, tem_video boolean, nome_reporter string, "
    "tags_noticia string"
)


def hits_table(spark, rows):
    return spark.createDataFrame(
        rows, "page_no int, pos int, titulo string, subtitulo string, link_noticia string"
    )


def detail(page_id, link, ok=True, text="t"):
    return (page_id, link, ok, "1 de maio de 2024", "10:00", text, None, True, "Ana", "Galo")


def test_missing_and_unsigned_articles_get_sentinels(spark):
    hits = hits_table(spark, [(1, 0, "A", "s", "a"), (1, 1, "B", None, "b"), (1, 2, "C", None, "c")])
    articles = spark.createDataFrame([detail(1, "a"), detail(2, "b", ok=False)], DETAILS)
    got = {r.titulo: r for r in capture.join_details(hits, articles).collect()}
    assert got["A"].texto_completo == "t" and got["A"].tem_video and got["A"].subtitulo == "s"
    assert got["A"].link_imagem_principal is None
    for title in "BC":
        assert [got[title][c] for c in S.ARTICLE_COLUMNS[2:4]] == [S.SENTINEL_DATE, S.SENTINEL_TIME]
        assert [got[title][c] for c in S.ARTICLE_COLUMNS[5:]] == [
            S.SENTINEL_TEXT, S.SENTINEL_IMAGE, False, S.SENTINEL_REPORTER, S.SENTINEL_TAGS,
        ]


def test_earliest_page_of_a_link_wins_and_duplicate_hits_stay(spark):
    hits = hits_table(spark, [(1, 0, "A", None, "a"), (1, 1, "A2", None, "a"), (2, 0, "A", None, "a")])
    articles = spark.createDataFrame(
        [detail(7, "a", text="novo"), detail(3, "a", text="velho"), detail(9, "z")], DETAILS
    )
    got = capture.join_details(hits, articles).collect()
    assert sorted((r.page_no, r.pos, r.texto_completo) for r in got) == [
        (1, 0, "velho"), (1, 1, "velho"), (2, 0, "velho"),
    ]


def test_hot_links_are_split_without_changing_the_result(spark):
    rows = [(p, i, f"t{p}-{i}", None, "hot" if i % 3 else f"l{p}") for p in range(60) for i in range(8)]
    hits = hits_table(spark, rows)
    articles = spark.createDataFrame(
        [detail(1, "hot", text="quente")] + [detail(p + 2, f"l{p}", text=f"x{p}") for p in range(0, 60, 2)], DETAILS
    )
    plain = capture.join_details(hits, articles).collect()
    split = capture.join_details(hits, articles, hot_link_hits=50)
    assert sorted(map(str, split.collect())) == sorted(map(str, plain))
    assert len(plain) == len(rows)


@pytest.mark.parametrize("hot_link_hits", [50, 10**6])
def test_every_page_is_parsed_once(spark, hot_link_hits):
    """The usual and the hot links share one scan and one shuffle of the articles."""
    parsed = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    rows = [(i, 0, f"t{i}", None, "hot" if i % 3 else f"l{i}") for i in range(600)]
    articles = spark.createDataFrame([detail(i, f"l{i}" if i else "hot") for i in range(100)], DETAILS)
    articles = articles.repartition(4).mapInArrow(counting, DETAILS)
    assert len(capture.join_details(hits_table(spark, rows), articles, hot_link_hits).collect()) == 600
    assert parsed.value == 100


def test_usable_hits(spark):
    hits = hits_table(
        spark, [(1, 0, "A", None, "a"), (1, 1, "", None, "b"), (1, 2, None, None, "c"), (1, 3, "D", None, None)]
    )
    assert [r.titulo for r in selection.usable_hits(hits).collect()] == ["A"]


@pytest.fixture(scope="module")
def many_hits(spark):
    # About 20,000 pages with up to five hits, every seventh of them without a title.
    rows = spark.range(100_000).select(
        (F.col("id") / 5 + 1).cast("int").alias("page_no"),
        (F.col("id") % 5).cast("int").alias("pos"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), "id")).alias("titulo"),
        F.lit(None).cast("string").alias("subtitulo"),
        F.concat(F.lit("l"), "id").alias("link_noticia"),
    )
    return rows.repartition(7)


@pytest.mark.parametrize("n", [1, 9, 17_554, 85_714, 90_000])
def test_first_articles_count_usable_rows_in_order(many_hits, n):
    lost = many_hits.limit(1).select(F.lit(None).cast("int").alias("page_no"), F.lit(0).alias("pos"),
                                     F.lit("t").alias("titulo"), "subtitulo", F.lit("l").alias("link_noticia"))
    got = selection.first_articles(many_hits.unionByName(lost), n).collect()
    assert [(r.page_no, r.pos) for r in got] == [(i // 5 + 1, i % 5) for i in range(100_000) if i % 7][:n]


def test_no_task_ranks_all_hits(many_hits):
    plan = selection.first_articles(many_hits, 200_000)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


@pytest.mark.parametrize("kept", [0, 1000])
@pytest.mark.parametrize("n", [1, 399, 400, 401, 650, 1000, 1001, 1500])
def test_first_articles_of_a_page_with_most_hits_and_of_equal_places(spark, n, kept, monkeypatch):
    """A page of 600 hits, all of one place, between usual pages; with and without tasks that keep the first."""
    monkeypatch.setattr(selection, "_KEPT_BY_TASKS", kept)
    rows = [(p, i, f"t{p}-{i}", None, f"l{p}-{i}") for p in (*range(1, 41), *range(42, 82)) for i in range(10)]
    same = [(41, 3, f"same{k % 200}", None, "l") for k in range(600)]
    hits = hits_table(spark, rows + same).repartition(5)
    got = selection.first_articles(hits, n).collect()
    assert [(r.page_no, r.pos) for r in got] == sorted((r[0], r[1]) for r in rows + same)[:n]
    assert [tuple(r) for r in selection.first_articles(hits, n).collect()] == [tuple(r) for r in got]


def test_results_end_at_the_first_page_without_hits(spark):
    pages = spark.createDataFrame(
        [(p, "") for p in (1, 2, 3, 5, 6, 7, 8)] + [(None, ""), (5, "")], "page_no int, html string"
    )
    hits = hits_table(spark, [(1, 0, "a", None, "a"), (2, 0, None, None, None), (3, 0, "c", None, "c"), (5, 0, "d", None, "d"),
                              (7, 0, "e", None, "e"), (8, 0, "f", None, "f"), (None, 0, "g", None, "g")])
    # Page 2 has a hit, if no usable one; 4 was not captured; 6 is without hits.
    assert {r.page_no for r in selection.until_empty_page(hits, pages).collect()} == {1, 2, 3, 5, None}
    assert selection.until_empty_page(hits, pages.where("page_no <> 6")).count() == 7
    assert selection.until_empty_page(hits.limit(0), pages).count() == 0
    assert selection.until_empty_page(hits.limit(0), pages.limit(0)).count() == 0


def test_page_loop_end_is_an_option_of_the_job(spark):
    hit = '<li class="ais-Hits-item"><a class="search-results" href="/{0}"><h2 class="search-results__texto--title">t{0}</h2></a></li>'
    pages = spark.createDataFrame([(p, "" if p == 3 else hit.format(p)) for p in range(1, 6)], "page_no int, html string")
    titles = lambda **o: sorted(r.titulo for r in capture_hits(pages, SITE, **o).collect())
    assert titles() == ["t1", "t2"]
    assert titles(max_articles=4) == ["t1", "t2"]
    assert titles(until_empty=False) == ["t1", "t2", "t4", "t5"]
    assert titles(until_empty=False, max_articles=3) == ["t1", "t2", "t4"]
    assert titles(max_pages=4) == ["t1", "t2"]


def test_chunks_bound_what_a_key_brings_to_a_task(spark):
    """One key with 30 % of 100,000 rows and a thousand with 0.05 % each, chunks of 1000."""
    rows = spark.range(100_000).select(
        "id", F.when(F.col("id") % 10 < 3, "hot").when(F.col("id") % 10 < 8, F.concat(F.lit("k"), (F.col("id") * 7919 / 10).cast("long") % 1000))
        .when(F.col("id") % 10 == 8, F.concat(F.lit("own"), "id")).alias("key")
    )
    rows = rows.repartition(6)
    right = rows.where("key <> 'k5'").groupBy("key").agg(F.min("id").alias("first"))
    got = chunks.chunked_left_join(rows, right, "key", ["id"], chunk_rows=1000)
    plain = rows.join(right, "key", "left")
    same = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("id", "key", "first").cast("decimal(38)"))).first()
    assert same(got) == same(plain) and got.columns == plain.columns
    # A key takes chunks by its own rows: the hot one 30, keys with fifty rows none.
    spread = rows.withColumn("__bucket", F.pmod(F.xxhash64("id"), F.lit(100)).cast("long"))
    cut = chunks.key_chunks(spread, "key", 100, 1000)
    assert {(r.key, r["__chunks"]) for r in cut.collect()} == {("hot", 30)} and cut.count() == 100
    own = spread.join(cut, ["key", "__bucket"]).groupBy((F.col("__bucket") % F.col("__chunks")).alias("c")).count()
    assert max(r["count"] for r in own.collect()) < 2000
    assert chunks.chunked_left_join(rows.limit(0), right, "key", ["id"]).count() == 0


def test_limits_are_checked(many_hits):
    for bad in (0, -1):
        with pytest.raises(ValueError):
            selection.first_pages(many_hits, bad)
        with pytest.raises(ValueError):
            selection.first_articles(many_hits, bad)
    with pytest.raises(ValueError, match="37"):
        selection.first_pages(many_hits, 38, total_pages=37)
    with pytest.raises(ValueError, match="296"):
        selection.first_articles(many_hits, 297, total_pages=37)
    assert selection.first_pages(many_hits, 2, total_pages=37).count() == 10


def test_search_ignores_case_and_takes_the_term_literally(spark):
    df = spark.createDataFrame(
        [(1, "Pão de Queijo", None, None), (2, "x", "o PÃO DE QUEIJO", None), (3, "x", None, "a.b"), (4, None, None, "aXb")],
        "i int, titulo string, subtitulo string, texto_completo string",
    )
    assert [r.i for r in selection.search_articles(df, "pão de queijo").collect()] == [1, 2]
    assert [r.i for r in selection.search_articles(df, "A.B").collect()] == [3]
    assert selection.search_articles(df.select("i", "titulo"), "queijo").count() == 1
    with pytest.raises(ValueError):
        selection.search_articles(df.select("i"), "x")


def pages(spark):
    def hit(link, title):
        return f'<li class="ais-Hits-item"><a class="search-results" href="{link}"><h2 class="search-results__texto--title">{title}</h2></a></li>'

    lists = [(1, hit("/a", "A") + hit("/x", "") + hit("/b", "B")), (2, hit("/c", "C")), (3, hit("/a", "A"))]
    article = (
        '<div class="cp023-assinatura-do-artigo"></div><div class="read-controller materia__tts article-whole '
        'article-body"><p>Um "texto", com\nquebra</p><p>dois</p></div>'
    )
    return (
        spark.createDataFrame(lists, "page_no int, html string"),
        spark.createDataFrame([(1, f"{BASE}/a", article), (2, f"{BASE}/b", "<p>x</p>")], "page_id bigint, url string, html string"),
    )


@pytest.mark.parametrize(
    "limits, expected",
    [
        ({}, [(1, 0), (1, 2), (2, 0), (3, 0)]),
        ({"max_pages": 1}, [(1, 0), (1, 2)]),
        ({"max_articles": 2}, [(1, 0), (1, 2)]),
        ({"max_articles": 3}, [(1, 0), (1, 2), (2, 0)]),
    ],
)
def test_capture_with_limits(spark, limits, expected):
    got = capture_articles(*pages(spark), SITE, **limits).collect()
    assert sorted((r.page_no, r.pos) for r in got) == expected


def test_capture_writes_a_csv_that_reads_back(spark, tmp_path):
    lists, details = pages(spark)
    assert run_capture(lists, details, SITE, str(tmp_path / "noticias"))
    got = {r.titulo: r for r in read_news_csv(spark, str(tmp_path / "noticias")).collect()}
    assert got["A"].texto_completo == 'Um "texto", com\nquebra\ndois'
    assert got["A"].tags_noticia is None and got["A"].horario is None
    assert got["B"].texto_completo == S.SENTINEL_TEXT
    none = lists.where("page_no > 9")
    assert not run_capture(none, details, SITE, str(tmp_path / "nada"))
    assert not (tmp_path / "nada").exists()
    with pytest.raises(ValueError):
        capture_articles(lists, details, SITE, max_pages=1, max_articles=1)


def test_captured_count(spark):
    assert capture.captured_count(pages(spark)[0]).first().total_noticias == 3
