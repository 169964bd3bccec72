"""Cleaning a captured news table and reporting on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manchete import schema as S
from manchete.functions.dates import parse_date, with_dates
from manchete.functions.literals import name, null_if_listed, quoted

REQUIRED = ("titulo", "link_noticia")
DATE_TEXT = "data_pura"


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows without a title or without a link."""
    return df.na.drop(how="any", subset=list(REQUIRED))


def null_sentinels(df: DataFrame) -> DataFrame:
    """Cells that are exactly an error text become null, in every text column."""
    return df.selectExpr(*_without_sentinels(df))


def _without_sentinels(df: DataFrame) -> list[str]:
    return [
        null_if_listed(f.name, S.SENTINELS) if isinstance(f.dataType, T.StringType) else name(f.name)
        for f in df.schema.fields
    ]


def empty_columns(df: DataFrame) -> list[str]:
    """Names of the columns that are null in every row; one aggregate over the table."""
    seen = df.selectExpr(*(f"max({name(c)} IS NOT NULL) AS {name(c)}" for c in df.columns)).first()
    return [c for c in df.columns if not seen[c]]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def clean(df: DataFrame) -> DataFrame:
    """Incomplete rows out, error texts to null, columns without any value out."""
    return drop_empty_columns(null_sentinels(drop_incomplete(df)))


def clean_report(df: DataFrame) -> DataFrame:
    """Rows and columns before and after :func:`clean`, as one row, in one pass."""
    complete = " AND ".join(f"{name(c)} IS NOT NULL" for c in REQUIRED)
    marked = df.selectExpr(f"{complete} AS _complete", *_without_sentinels(df))
    # A column survives if some complete row still has a value in it.
    survives = " + ".join(
        f"CAST(coalesce(max(_complete AND {name(c)} IS NOT NULL), false) AS INT)" for c in df.columns
    )
    return marked.selectExpr(
        "count(*) AS linhas_antes",
        "count_if(_complete) AS linhas_depois",
        f"{len(df.columns)} AS colunas_antes",
        f"{survives} AS colunas_depois",
    ).selectExpr(
        "linhas_antes",
        "linhas_depois",
        "linhas_antes - linhas_depois AS linhas_removidas",
        "colunas_antes",
        "colunas_depois",
        "colunas_antes - colunas_depois AS colunas_removidas",
    )


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, non-null cells, rows of the table."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "ordem int, coluna string, tipo string, nao_nulos long, linhas long")
    counts = df.selectExpr("count(*) AS _rows", *(f"count({name(c)}) AS {name(c)}" for c in df.columns))
    lines = ", ".join(
        f"{i}, {quoted(f.name)}, {quoted(f.dataType.simpleString())}, {name(f.name)}, _rows"
        for i, f in enumerate(df.schema.fields)
    )
    return counts.selectExpr(
        f"stack({len(df.columns)}, {lines}) AS (ordem, coluna, tipo, nao_nulos, linhas)"
    )


#: Stages of a table's way through cleaning: as read, cleaned, and with its dates.
STAGES = ("original", "limpo", "final")


def profile_stages(df: DataFrame) -> DataFrame:
    """:func:`profile` of the table as read, of :func:`clean` and of its dates, in one pass.

    One aggregate counts every cell under the conditions of each stage, which leaves a
    single row; columns without a value are taken out of that row, not of the table.
    ``etapa`` names the stage.
    """
    places = range(len(df.columns))
    complete = " AND ".join(f"o{df.columns.index(c)} IS NOT NULL" for c in REQUIRED)
    # Plain names for all columns: o for a cell as read, c for what cleaning leaves of it.
    twice = df.toDF(*(f"o{k}" for k in places)).selectExpr(
        f"{complete} AS _complete", *(f"o{k}" for k in places), *(f"CASE WHEN {complete} THEN o{k} END AS c{k}" for k in places)
    )
    texts = {f"c{k}" for k in places if isinstance(df.schema.fields[k].dataType, T.StringType)}
    marked = twice.selectExpr(*(null_if_listed(c, S.SENTINELS) if c in texts else c for c in twice.columns))
    if DATE_TEXT in df.columns:
        marked = marked.withColumn("d", parse_date(F.col(f"c{df.columns.index(DATE_TEXT)}")))
    else:
        marked = marked.withColumn("d", F.lit(None).cast("date"))
    counts = marked.selectExpr(
        "count(*) AS read", "count_if(_complete) AS kept", "count(d) AS dated",
        *(f"count(o{k}) AS o{k}" for k in places), *(f"count(c{k}) AS c{k}" for k in places),
    )
    left = [f"CAST(c{k} > 0 AS INT)" for k in places]
    types = [f.dataType.simpleString() for f in df.schema.fields]
    dates = with_dates(df.select(F.lit(None).cast("string").alias(DATE_TEXT))).drop(DATE_TEXT).schema.fields
    lines = []
    for stage in STAGES:
        first, rows = ("o", "read") if stage == STAGES[0] else ("c", "kept")
        for k, c in enumerate(df.columns):
            at = str(k) if first == "o" else " + ".join(["0", *left[:k]])
            shown = "true" if first == "o" else f"c{k} > 0"
            lines.append(f"{quoted(stage)}, {at}, {quoted(c)}, {quoted(types[k])}, {first}{k}, {rows}, {shown}")
        for k, f in enumerate(dates if stage == STAGES[2] else ()):
            at = " + ".join([str(k), *left])
            lines.append(f"{quoted(stage)}, {at}, {quoted(f.name)}, {quoted(f.dataType.simpleString())}, dated, kept, true")
    stacked = counts.selectExpr(
        f"stack({len(lines)}, {', '.join(lines)}) AS (etapa, ordem, coluna, tipo, nao_nulos, linhas, _fica)"
    )
    return stacked.where("_fica").drop("_fica")

