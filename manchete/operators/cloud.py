"""Word-cloud term weights of tags, titles, subtitles and bodies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manchete import schema as S
from manchete.functions.literals import listed, text_array
from manchete.functions.text import cloud_tokens, cut_possessive, is_number, portuguese_stop_words
from manchete.operators.ranking import arrival, row_key, top_by_frequency

# Clouds in the order in which they are made. Commas between tags and the blanks that
# join texts both separate tokens, so every column is tokenised row by row.
CLOUDS = (
    ("tags_noticia", "Tags das Notícias"),
    ("titulo", "Títulos das Notícias"),
    ("subtitulo", "Subtítulos das Notícias"),
    ("texto_completo", "Texto Completo das Notícias"),
)


def _vocabulary(df: DataFrame, fields: list[tuple[int, str]], row_id: str) -> DataFrame:
    """Distinct raw tokens with count and first appearance: ``(nuvem, palavra, n, chegada)``."""
    cells = [cell for number, name in fields for cell in (F.lit(number), F.col(name))]
    tokens = (
        df.select(row_key(df, row_id).alias("chave"), *(c for _, c in fields))
        .select("chave", F.stack(F.lit(len(fields)), *cells).alias("nuvem", "texto"))
        .where(F.col("texto").isNotNull())
        .select("chave", "nuvem", F.posexplode(cloud_tokens(F.col("texto"))).alias("posicao", "palavra"))
    )
    return (
        tokens.select("nuvem", "palavra", arrival(tokens, "chave", "posicao").alias("chegada"))
        .groupBy("nuvem", "palavra")
        .agg(F.count("*").alias("n"), F.min("chegada").alias("chegada"))
    )


def cloud_terms(
    df: DataFrame,
    limit: int = S.TOP_CLOUD_TERMS,
    row_id: str = "row_id",
    stop_words: Iterable[str] | None = None,
) -> DataFrame:
    """``(nuvem, posicao, tipo, termo, frequencia, peso)`` of the terms a cloud shows.

    Counts ignore case and the term is shown in its most frequent spelling. A plural in
    ``s`` counts for its singular if the singular occurs. The weight is relative to the
    most frequent term. Token rules are applied to the vocabulary, not to every token.
    """
    fields = [(i, c) for i, (c, _) in enumerate(CLOUDS) if c in df.columns]
    stop = portuguese_stop_words() if stop_words is None else stop_words
    stop = sorted({w.lower() for w in stop})

    # The test of the count is always true. Without it the optimiser moves the filters
    # below the aggregate, where they would run once per token.
    word = F.when(F.col("n") > 0, cut_possessive(F.col("palavra")))
    spellings = (
        _vocabulary(df, fields, row_id)
        .withColumn("palavra", word)
        .where(~is_number(F.col("palavra")))
        .withColumn("termo", F.lower("palavra"))
        .where(f"termo NOT IN ({listed(stop)})" if stop else "true")
        .withColumn("plural", F.col("termo").endswith("s") & ~F.col("termo").endswith("ss"))
        .withColumn("raiz", F.expr("if(plural, left(termo, length(termo) - 1), termo)"))
    )
    # A term and its plural share the root, and nothing else does: a root that itself
    # ends in a single s would make its plural end in ss. So one hash partitioning by
    # root serves the singular test and both aggregations below.
    same_root = Window.partitionBy("nuvem", "raiz")
    folded = (
        spellings.withColumn("tem_singular", F.max(~F.col("plural")).over(same_root))
        .withColumn("unido", F.col("plural") & F.col("tem_singular"))
        .withColumn("termo", F.when(F.col("unido"), F.col("raiz")).otherwise(F.col("termo")))
        .withColumn(
            "forma",
            F.when(F.col("unido"), F.expr("left(palavra, length(palavra) - 1)")).otherwise(
                F.col("palavra")
            ),
        )
    )
    own = F.when(~F.col("unido"), F.col("chegada"))
    forms = folded.groupBy("nuvem", "raiz", "termo", "forma").agg(
        F.sum("n").alias("n"), F.min(own).alias("propria"), F.min("chegada").alias("chegada")
    )
    # Most frequent spelling; of equals the one that came first, the term's own
    # spellings before those that only its plural has.
    preference = F.struct(-F.col("n"), F.col("propria").isNull(), F.coalesce("propria", "chegada"))
    counted = forms.groupBy("nuvem", "raiz", "termo").agg(
        F.min_by("forma", preference).alias("forma"),
        F.sum("n").alias("frequencia"),
        F.min("propria").alias("primeira"),
    )
    labels = text_array(label for _, label in CLOUDS)
    heaviest = F.max("frequencia").over(Window.partitionBy("nuvem"))
    return (
        top_by_frequency(counted, "nuvem", limit)
        .withColumn("peso", F.col("frequencia") / heaviest)
        .select(
            "nuvem",
            "posicao",
            F.get(labels, F.col("nuvem")).alias("tipo"),
            F.col("forma").alias("termo"),
            "frequencia",
            "peso",
        )
    )
