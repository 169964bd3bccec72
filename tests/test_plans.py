import csv

import pytest

from manchete import schema as S
from manchete.plans.cleaning import run_cleaning
from manchete.plans.text_statistics import run_text_statistics
from manchete.sources.news_csv import read_news_csv

ROWS = [
    ("Casa nova", "sub", "1 de julho de 2023", "10:00", "l1", "corpo casa casa", "img", "True", "Ana", "Galo, Minas"),
    ("Casa velha", "", "31 de fevereiro de 2024", "N/A", "l2", "Erro ao coletar texto", "img", "False", "Ana", "N/A"),
    ("Erro", "", "30 de junho de 2025", "Erro", "l3", 'com "aspas"\ne linha', "img", "False", "Erro ao coletar repórter", "Galo"),
    ("", "x", "1 de maio de 2024", "", "l4", "fora", "img", "False", "", ""),
    ("Fora", "x", "1 de maio de 2024", "", "", "fora", "img", "False", "", ""),
    ("Tarde", "", "1 de julho de 2025", "", "l6", "", "", "False", "", ""),
]


@pytest.fixture()
def news_csv(tmp_path):
    path = tmp_path / "noticias.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(S.ARTICLE_COLUMNS)
        w.writerows(ROWS)
    return str(path)


def lines(spark, path):
    (part,) = path.glob("part-*.csv")
    with open(part, newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


def test_cleaning_job(spark, news_csv, tmp_path):
    articles = run_cleaning(
        spark, news_csv, str(tmp_path / "clean"), str(tmp_path / "month"), str(tmp_path / "year")
    )
    assert lines(spark, tmp_path / "month") == [
        ["ano_publicacao", "mes_publicacao", "total_noticias"], ["2023", "julho", "1"], ["2025", "junho", "1"],
    ]
    assert lines(spark, tmp_path / "year") == [["ano_publicacao", "total_noticias"], ["2023", "1"], ["2025", "2"]]
    back = {r.link_noticia: r for r in read_news_csv(spark, str(tmp_path / "clean")).collect()}
    assert set(back) == {"l1", "l2", "l3", "l6"}
    assert back["l3"].titulo is None and back["l3"].nome_reporter is None and back["l3"].horario is None
    assert back["l3"].texto_completo == 'com "aspas"\ne linha'
    assert back["l2"].data_dt is None and back["l1"].mes_publicacao == "julho"
    assert articles.columns == [*S.ARTICLE_COLUMNS, *S.DATE_COLUMNS]


def test_text_statistics_job(spark, news_csv, tmp_path):
    tables = run_text_statistics(spark, news_csv, str(tmp_path / "stats"))
    got = lines(spark, tmp_path / "stats")
    assert got[0] == ["Tipo de Análise", "Termo", "Frequência"]
    sections = list(dict.fromkeys(r[0] for r in got[1:]))
    assert sections[0] == "Palavras - Títulos" and sections[-1] == "Tags Mais Frequentes"
    assert ["Palavras - Títulos", "casa", "2"] == got[1]
    # Without cleaning first, the words of the error texts count, too.
    assert ["Palavras - Texto Completo", "coletar", "1"] in got
    assert got[-2:] == [["Tags Mais Frequentes", "Galo", "2"], ["Tags Mais Frequentes", "Minas", "1"]]
    assert [r.termo for r in tables["tag_chart"].orderBy("posicao").collect()] == ["Galo", "Minas"]
    assert tables["clouds"].where("nuvem = 1 and posicao = 1").first().termo == "Casa"


def test_nothing_to_count_writes_nothing(spark, tmp_path):
    path = tmp_path / "vazio.csv"
    path.write_text("titulo\n1\n", encoding="utf-8")
    run_text_statistics(spark, str(path), str(tmp_path / "stats"))
    assert not (tmp_path / "stats").exists()


def test_jobs_from_the_command_line(spark, news_csv, tmp_path):
    from manchete.__main__ import arguments, run

    run(spark, arguments(["clean", news_csv, str(tmp_path / "c"), "--start", "2025-01-01", "--end", "2025-12-31"]))
    assert lines(spark, tmp_path / "c" / "monthly")[1:] == [["2025", "junho", "1"], ["2025", "julho", "1"]]
    run(spark, arguments(["stats", news_csv, str(tmp_path / "s")]))
    assert lines(spark, tmp_path / "s" / "tag_chart")[1][3:] == ["Galo", "2"]
    assert {r[2] for r in lines(spark, tmp_path / "s" / "clouds")[1:]} == {
        "Tags das Notícias", "Títulos das Notícias", "Subtítulos das Notícias", "Texto Completo das Notícias",
    }
    item = '<li class="ais-Hits-item"><a class="search-results" href="/a"><h2 class="search-results__texto--title">A</h2></a></li>'
    spark.createDataFrame([(1, item)], "page_no int, html string").write.parquet(str(tmp_path / "l"))
    spark.createDataFrame([(1, "u", "x")], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "a"))
    run(spark, arguments(["capture", str(tmp_path / "l"), str(tmp_path / "a"), str(tmp_path / "o"), "--base-url", "https://x.example", "--articles", "3"]))
    assert read_news_csv(spark, str(tmp_path / "o")).first().link_noticia == "https://x.example/a"


def test_further_options_of_the_command_line(spark, news_csv, tmp_path):
    from manchete.__main__ import arguments, run

    extra = ["--also", "monthly_all", "by_date_text", "newest", "report", "profile"]
    run(spark, arguments(["clean", news_csv, str(tmp_path / "c"), *extra]))
    assert lines(spark, tmp_path / "c" / "monthly_all")[1] == ["2023", "julho", "7", "1"]
    assert lines(spark, tmp_path / "c" / "newest")[1][2] == "l6"
    assert lines(spark, tmp_path / "c" / "report")[1][:3] == ["6", "4", "2"]
    assert lines(spark, tmp_path / "c" / "profile")[1][1] == "titulo"
    assert ["1 de julho de 2025", "1"] in lines(spark, tmp_path / "c" / "by_date_text")

    item = '<li class="ais-Hits-item"><a class="search-results" href="/{0}"><h2 class="search-results__texto--title">T{0}</h2></a></li>'
    info = '<div class="pagination__info">Página 1 de 2</div>'
    pages = [(k, (info if k == 1 else "") + "".join(item.format(f"{k}{n}") for n in range(3))) for k in (2, 1)]
    spark.createDataFrame(pages, "page_no int, html string").write.parquet(str(tmp_path / "l"))
    article = '<div class="cp023-assinatura-do-artigo"></div><div class="c-news-body"><iframe src="https://v.example/x/1"></iframe></div>'
    rows = [(1, "https://x.example/11", article)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "a"))

    def capture(name, *options):
        job = ["capture", str(tmp_path / "l"), str(tmp_path / "a"), str(tmp_path / name), "--base-url", "https://x.example"]
        run(spark, arguments([*job, *options]))
        return read_news_csv(spark, str(tmp_path / name), row_id="row_id").orderBy("row_id").collect()

    every = capture("o1", "--pages", "2", "--video-address", "v.example/x")
    assert [r.titulo for r in every] == ["T10", "T11", "T12", "T20", "T21", "T22"]
    assert [r.tem_video for r in every] == [False, True] + [False] * 4
    assert [r.titulo for r in capture("o2", "--term", "t2")] == ["T20", "T21", "T22"]
    for options in (["--pages", "3"], ["--articles", "17"]):
        with pytest.raises(ValueError, match="must be between"):
            capture("o3", *options)


def test_a_table_without_dates_has_empty_counts(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("titulo,link_noticia,data_pura\na,l,Erro\n", encoding="utf-8")
    run_cleaning(spark, str(path), str(tmp_path / "c"), str(tmp_path / "m"), str(tmp_path / "y"))
    assert lines(spark, tmp_path / "y") in ([], [["ano_publicacao", "total_noticias"]])


def test_extraction_runs_unchanged_on_a_stream(spark, tmp_path):
    """Pages that keep arriving go through the same stateless functions."""
    from manchete.sources.captured_pages import extract_articles
    from manchete.sources.site_profile import generic_profile

    schema = "page_id bigint, url string, html string"
    profile = generic_profile("https://x.example")
    out = str(tmp_path / "out")

    def drain():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = (
            extract_articles(stream, profile)
            .writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start(out)
        )
        assert query.awaitTermination(120)

    for batch in (1, 2):
        rows = [(batch, "u", f"<article><p>texto {batch}</article>")]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        drain()
    assert sorted(r.texto_completo for r in spark.read.parquet(out).collect()) == ["texto 1", "texto 2"]


def test_index_and_search_from_the_command_line(spark, news_csv, tmp_path):
    from manchete.__main__ import arguments, run
    from manchete.operators.selection import search_articles

    run(spark, arguments(["index", news_csv, str(tmp_path / "i")]))
    news = read_news_csv(spark, news_csv)
    for n, term in enumerate(["galo", "A", "não está em nenhuma"]):
        run(spark, arguments(["search", str(tmp_path / "i"), term, str(tmp_path / f"o{n}")]))
        wanted = sorted(r.link_noticia or "" for r in search_articles(news, term).collect())
        found = [] if not wanted else read_news_csv(spark, str(tmp_path / f"o{n}")).collect()
        assert sorted(r.link_noticia or "" for r in found) == wanted


def test_results_go_on_past_an_empty_page_if_asked(spark, tmp_path):
    from manchete.__main__ import arguments, run

    item = '<li class="ais-Hits-item"><a class="search-results" href="/{0}"><h2 class="search-results__texto--title">T{0}</h2></a></li>'
    spark.createDataFrame([(p, "" if p == 2 else item.format(p)) for p in (1, 2, 3)], "page_no int, html string").write.parquet(str(tmp_path / "l"))
    spark.createDataFrame([(1, "u", "x")], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "a"))
    for name, extra, titles in (("o", [], ["T1"]), ("p", ["--past-empty-pages"], ["T1", "T3"])):
        job = ["capture", str(tmp_path / "l"), str(tmp_path / "a"), str(tmp_path / name), "--base-url", "https://x.example"]
        run(spark, arguments(job + extra))
        assert sorted(r.titulo for r in read_news_csv(spark, str(tmp_path / name)).collect()) == titles
