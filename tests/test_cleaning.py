from pyspark.sql import functions as F

from manchete import schema as S
from manchete.functions.dates import with_dates
from manchete.operators import cleaning

COLUMNS = "titulo string, link_noticia string, data_pura string, tags_noticia string, nome_reporter string, tem_video boolean"
ROWS = [
    ("Erro", "l1", "Erro ao coletar data", "a, b", None, True),
    ("T2", "l2", "1 de maio de 2024", "Erro ao coletar tags", "Erro ao coletar repórter", False),
    (None, "l3", "x", "só aqui", "Ana", False),
    ("T4", None, "x", "só aqui", "Ana", None),
    ("T5", "l5", "Erro ao coletar data ", "erro", None, None),
]


def table(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_rows_without_title_or_link_go(spark):
    got = cleaning.drop_incomplete(table(spark)).select("link_noticia").collect()
    assert [r[0] for r in got] == ["l1", "l2", "l5"]


def test_sentinels_are_whole_cells_and_leave_the_row(spark):
    got = cleaning.null_sentinels(cleaning.drop_incomplete(table(spark))).collect()
    assert [tuple(r) for r in got] == [
        (None, "l1", None, "a, b", None, True),
        ("T2", "l2", "1 de maio de 2024", None, None, False),
        ("T5", "l5", "Erro ao coletar data ", "erro", None, None),
    ]


def test_empty_columns_go_after_sentinels(spark):
    assert cleaning.clean(table(spark)).columns == [
        "titulo", "link_noticia", "data_pura", "tags_noticia", "tem_video",
    ]


def test_a_late_value_keeps_its_column(spark):
    rows = [(i, None, None) for i in range(5000)] + [(5000, "x", None)]
    df = spark.createDataFrame(rows, "i int, tarde string, nunca string").coalesce(1)
    assert cleaning.empty_columns(df) == ["nunca"]


def test_no_rows_no_columns(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert cleaning.empty_columns(df) == df.columns


def test_report(spark):
    got = cleaning.clean_report(table(spark)).first().asDict()
    assert got == {
        "linhas_antes": 5, "linhas_depois": 3, "linhas_removidas": 2,
        "colunas_antes": 6, "colunas_depois": 5, "colunas_removidas": 1,
    }
    cleaned = cleaning.clean(table(spark))
    assert (got["linhas_depois"], got["colunas_depois"]) == (cleaned.count(), len(cleaned.columns))


def test_profile(spark):
    got = [tuple(r) for r in cleaning.profile(table(spark)).orderBy("ordem").collect()]
    assert got[0] == (0, "titulo", "string", 4, 5)
    assert got[5] == (5, "tem_video", "boolean", 3, 5)
    assert len(got) == 6


def _by_stage(df):
    cleaned = cleaning.clean(df)
    stages = {"original": df, "limpo": cleaned, "final": with_dates(cleaned)}
    return sorted((s, *r) for s, part in stages.items() for r in cleaning.profile(part).collect())


def test_profile_of_all_stages_in_one_pass(spark):
    df = table(spark)
    assert sorted(map(tuple, cleaning.profile_stages(df).collect())) == _by_stage(df)
    for odd in (df.limit(0), df.drop("data_pura"), df.withColumn("n", F.lit(3)).withColumn("a` AS b", F.lit("N/A")),
                df.withColumn("data_pura", F.lit("11 de junho de 2025"))):
        assert sorted(map(tuple, cleaning.profile_stages(odd).collect())) == _by_stage(odd)


def test_profile_scans_the_table_once(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "t"))
    plan = cleaning.profile_stages(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_all_six_sentinels(column):
    from pyspark.sql import functions as F

    assert len(S.SENTINELS) == 6
    assert column(lambda c: F.coalesce(c.isin(*S.SENTINELS), F.lit(False)), list(S.SENTINELS)) == [True] * 6
