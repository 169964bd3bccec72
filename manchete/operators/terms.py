"""Most frequent words, bigrams, trigrams and tags."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manchete import schema as S
from manchete.functions.literals import text_array
from manchete.functions.text import long_words, portuguese_stop_words, split_tags, without_stop_words
from manchete.operators.ngram_counts import (
    SIZES as _SIZES,
    Ngrams,
    buckets_of_numbers,
    buckets_of_sections,
    count_by_buckets,
    last_ranked,
)
from manchete.operators.ranking import top_by_frequency, with_ties
from manchete.workspace import materialise

_TAG_SECTION = len(S.TEXT_FIELDS) * len(_SIZES) + 1

# Counters of a task's summary of a section, and how many terms are then counted exactly.
_TRACKED = 1 << 16
_CANDIDATES = 4096
# The most counters that Spark's summary can have.
_MOST_TRACKED = 1_000_000


def section_labels() -> dict[int, str]:
    labels = {
        field * len(_SIZES) + n: f"{S.NGRAM_LABELS[n - 1]} - {name}"
        for field, (_, name) in enumerate(S.TEXT_FIELDS)
        for n in _SIZES
    }
    return labels | {_TAG_SECTION: S.TAGS_LABEL}


def _present(df: DataFrame, fields: Iterable[str]) -> list[tuple[int, str]]:
    """Position and name of the wanted text fields that the table has."""
    wanted = set(fields)
    return [(i, c) for i, (c, _) in enumerate(S.TEXT_FIELDS) if c in wanted and c in df.columns]


def stack_texts(df: DataFrame, fields: Sequence[tuple[int, str]], row_id: str) -> DataFrame:
    """One row per text: ``(chave, campo, texto)``; missing texts are left out."""
    keyed = df.select(F.col(row_id).alias("chave"), *(c for _, c in fields))
    if len(fields) == 1:
        (number, name), = fields
        texts = keyed.select("chave", F.lit(number).alias("campo"), F.col(name).alias("texto"))
    else:
        cells = [cell for number, name in fields for cell in (F.lit(number), F.col(name))]
        texts = keyed.select("chave", F.stack(F.lit(len(fields)), *cells).alias("campo", "texto"))
    return texts.where(F.col("texto").isNotNull())


def _ngrams(texts: DataFrame, stop_words: Iterable[str], sizes: Sequence[int]) -> DataFrame:
    """Every n-gram of every text: ``(secao, termo, chave, posicao)``.

    The filtered word list is zipped with itself shifted by one and two and exploded
    once; a row then holds all n-grams that start at its position. Grams past the end
    of a text come out null.
    """
    words = [f"p{k}" for k in range(max(sizes))]
    shifted = [
        F.slice("palavras", k + 1, F.greatest(F.size("palavras") - k, F.lit(0))).alias(w)
        for k, w in enumerate(words)
    ]
    starts = (
        texts.select("chave", "campo", long_words(F.col("texto")).alias("palavras"))
        .withColumn("palavras", without_stop_words("palavras", stop_words))
        .select("chave", "campo", F.posexplode(F.arrays_zip(*shifted)).alias("posicao", "inicio"))
        .select("chave", "campo", "posicao", "inicio.*")
    )
    gram: list[Column] = [
        F.col("p0") if n == 1 else F.concat(*_spaced(words[:n])) for n in sizes
    ]
    section = F.col("campo") * len(_SIZES)
    if len(sizes) == 1:
        grams = starts.select((section + sizes[0]).alias("secao"), gram[0].alias("termo"), "chave", "posicao")
    else:
        cells = [cell for n, g in zip(sizes, gram) for cell in (section + n, g)]
        grams = starts.select("chave", "posicao", F.stack(F.lit(len(sizes)), *cells).alias("secao", "termo"))
    return grams.where(F.col("termo").isNotNull()).select("secao", "termo", "chave", "posicao")


def _spaced(words: Sequence[str]) -> list[Column]:
    out: list[Column] = []
    for w in words:
        out += [F.lit(" "), F.col(w)] if out else [F.col(w)]
    return out


def _tags(df: DataFrame, row_id: str) -> DataFrame:
    """Every tag of every article, in the same shape as the n-grams."""
    tags = df.where(F.col("tags_noticia").isNotNull()).select(
        F.col(row_id).alias("chave"),
        F.posexplode(split_tags(F.col("tags_noticia"))).alias("posicao", "termo"),
    )
    return tags.select(F.lit(_TAG_SECTION).alias("secao"), "termo", "chave", "posicao")


def _counted(terms: DataFrame) -> DataFrame:
    return terms.groupBy("secao", "termo").agg(
        F.count("*").alias("frequencia"), F.min("chave").alias("primeira")
    )


#: Terms of the whole table, or of the rows that a function leaves of it.
Terms = Callable[[Callable[[DataFrame], DataFrame]], DataFrame]


def _rank(counted: DataFrame, terms_of: Terms, row_id: str, limit: int) -> DataFrame:
    """``(secao, posicao, tipo, termo, frequencia)`` of the most frequent of the counted terms.

    Counts come with the first row of a term only. Where terms that can make the ranking are
    equal in both, their places in that row decide, and only those rows are cut into terms
    again.
    """
    candidates = materialise(with_ties(counted, "secao", limit))
    same = Window.partitionBy("secao", "frequencia", "primeira")
    tied = candidates.withColumn("iguais", F.count("*").over(same)).where("iguais > 1")
    tied = tied.select("secao", "termo", F.col("primeira").alias("chave"))
    # Ties at the end of a section all lie in one row, so these are few rows.
    rows = tied.select("chave").distinct()
    again = terms_of(lambda df: df.join(rows, F.col(row_id) == F.col("chave"), "left_semi"))
    places = again.join(tied, ["secao", "termo", "chave"]).groupBy("secao", "termo").agg(F.min("posicao").alias("lugar"))
    settled = candidates.join(places, ["secao", "termo"], "left")
    labels = section_labels()
    names = text_array(labels[i] for i in sorted(labels))
    return top_by_frequency(settled, "secao", limit, then=[F.col("lugar").asc()]).select(
        "secao", "posicao", F.get(names, F.col("secao") - 1).alias("tipo"), "termo", "frequencia"
    )


def frequent_items(terms: DataFrame, tracked: int, candidates: int) -> tuple[DataFrame, dict[int, int]]:
    """``(secao, melhores, perda)``, the largest counters of every section, and what any other term can be at most."""
    summed = terms.groupBy("secao").agg(F.expr(f"approx_top_k_accumulate(termo, {tracked})").alias("resumo"))
    best = materialise(
        summed.select(
            "secao",
            F.expr(f"approx_top_k_estimate(resumo, {candidates})").alias("melhores"),
            # What the counters have lost is the fourth number of the summary, if it has any.
            F.substring(F.col("resumo.sketch"), 25, 8).alias("perda"),
        )
    )
    # A row for each of the ten sections, and at most `candidates` terms of each.
    others: dict[int, int] = {}
    for r in best.select("secao", "perda", F.size("melhores").alias("n"), F.get("melhores", F.size("melhores") - 1)["count"].alias("ultima")).collect():
        # Counters up to twice the loss are not told, nor are more than were asked for.
        told = r["ultima"] if r["n"] == candidates else 0
        others[r["secao"]] = max(2 * int.from_bytes(r["perda"], "little"), told)
    return best, others


class Counting(NamedTuple):
    """Exact counts of the terms of ``(secao, termo)``, and of all terms of some sections."""

    chosen: Callable[[DataFrame], DataFrame]
    sections: Callable[[list[int]], DataFrame]


def _counting(terms: DataFrame) -> Counting:
    return Counting(
        lambda chosen: _counted(terms.join(F.broadcast(chosen), ["secao", "termo"], "left_semi")),
        lambda sections: _counted(terms.where(F.col("secao").isin(sections))),
    )


def count_frequent(
    terms: DataFrame,
    limit: int,
    tracked: int = _TRACKED,
    candidates: int = _CANDIDATES,
    counting: Counting | None = None,
) -> DataFrame:
    """Exact counts of enough terms to contain the ``limit`` most frequent of each section.

    For corpora whose distinct n-grams are too many to shuffle. In a first pass every task
    keeps a summary of frequent items for each section, of a fixed size: ``tracked``
    counters, which lose a known amount when they run out, so that a term's count is at most
    its counter, or at most what was lost if it has none. Summaries are merged, and a second
    pass counts only the ``candidates`` largest exactly. A section is settled if its last
    ranked term beats what any other term can be; sections that are not settled are counted
    in full. Runs these passes as jobs; their results go to the shared working folder.

    ``terms`` may hold numbers that several terms share, if ``counting`` counts the terms
    themselves: all those that have a given number.
    """
    counting = counting or _counting(terms)
    candidates = max(candidates, 4 * limit)
    tracked = max(tracked, candidates)
    if tracked > _MOST_TRACKED:
        return counting.sections(list(section_labels()))
    best, others = frequent_items(terms, tracked, candidates)
    counted = materialise(counting.chosen(best.select("secao", F.explode("melhores.item").alias("termo"))))
    ranked = last_ranked(counted, limit)
    again = [section for section, bound in others.items() if bound and ranked.get(section, 0) <= bound]
    if not again:
        return counted
    return counted.where(~F.col("secao").isin(again)).unionByName(counting.sections(again))


def count_ngrams(ngrams: Ngrams, limit: int, two_pass: bool = False) -> DataFrame:
    """Exact counts that contain the ``limit`` most frequent n-grams of each section.

    What is worth counting term by term is told by sums over buckets, or in ``two_pass``
    mode by summaries of frequent items.
    """
    if not two_pass:
        return count_by_buckets(ngrams, limit)
    by_words = Counting(
        lambda chosen: ngrams.counted(buckets_of_numbers(chosen)),
        lambda sections: ngrams.counted(buckets_of_sections(sections)),
    )
    return count_frequent(ngrams.numbers(), limit, counting=by_words)


def top_ngrams(
    df: DataFrame,
    fields: Iterable[str] = tuple(c for c, _ in S.TEXT_FIELDS),
    sizes: Sequence[int] = _SIZES,
    limit: int = S.TOP_TERMS,
    row_id: str = "row_id",
    stop_words: Iterable[str] | None = None,
    two_pass: bool = False,
) -> DataFrame:
    """Most frequent n-grams per field and size, all of them in one pass over the texts.

    Ties keep the order of first appearance, for which ``row_id`` must grow with the
    order of the articles. ``two_pass`` gives the same result by another first pass
    (see :func:`count_ngrams`).
    """
    stop = portuguese_stop_words() if stop_words is None else list(stop_words)
    present = _present(df, fields)

    def terms_of(rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return _ngrams(stack_texts(rows(df), present, row_id), stop, tuple(sizes))

    ngrams = Ngrams(stack_texts(df, present, row_id), stop, tuple(sizes))
    return _rank(count_ngrams(ngrams, limit, two_pass), terms_of, row_id, limit)


def top_tags(df: DataFrame, limit: int = S.TOP_TERMS, row_id: str = "row_id") -> DataFrame:
    """Most frequent tags; twenty of them are what the tag chart shows."""
    return _rank(_counted(_tags(df, row_id)), lambda rows: _tags(rows(df), row_id), row_id, limit)


def term_stats(
    df: DataFrame,
    limit: int = S.TOP_TERMS,
    row_id: str = "row_id",
    stop_words: Iterable[str] | None = None,
    two_pass: bool = False,
) -> DataFrame:
    """All n-gram sections and the tag section as one long, ordered table.

    A text column other than the title may be missing or empty; its sections are then
    empty as well.
    """
    if "titulo" not in df.columns:
        raise ValueError("text statistics need the column 'titulo'")
    stop = portuguese_stop_words() if stop_words is None else list(stop_words)
    fields = _present(df, (c for c, _ in S.TEXT_FIELDS))

    def terms_of(rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
        read = rows(df)
        terms = _ngrams(stack_texts(read, fields, row_id), stop, _SIZES)
        return terms.unionByName(_tags(read, row_id)) if "tags_noticia" in df.columns else terms

    counted = count_ngrams(Ngrams(stack_texts(df, fields, row_id), stop, _SIZES), limit, two_pass)
    if "tags_noticia" in df.columns:
        tags = _tags(df, row_id)
        counted = counted.unionByName(count_frequent(tags, limit) if two_pass else _counted(tags))
    return (
        _rank(counted, terms_of, row_id, limit)
        .orderBy("secao", "posicao")
        .select(
            F.col("tipo").alias("Tipo de Análise"),
            F.col("termo").alias("Termo"),
            F.col("frequencia").alias("Frequência"),
        )
    )
