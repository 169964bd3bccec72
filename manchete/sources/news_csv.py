"""News tables in CSV files."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manchete import schema as S
from manchete.functions.literals import name, null_if_listed
from manchete.sources.csv_splits import SPLIT_BYTES, Head, file_heads, split_records

# Doubled quotes inside quoted cells, line breaks inside cells, blanks kept.
CSV_OPTIONS = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def decode_missing(df: DataFrame) -> DataFrame:
    """Turn cells that are exactly a missing-value token into nulls, in every text column."""
    return df.selectExpr(
        *(
            null_if_listed(f.name, S.NA_TOKENS) if isinstance(f.dataType, T.StringType) else name(f.name)
            for f in df.schema.fields
        )
    )


def _typed(column: str) -> Column:
    wanted = S.COLUMN_TYPES.get(column, T.StringType())
    cell = F.col(name(column))
    if isinstance(wanted, T.StringType):
        return cell
    if isinstance(wanted, T.BooleanType):
        return F.when(F.lower(cell).isin("true", "false"), F.lower(cell) == "true").alias(column)
    if isinstance(wanted, T.IntegerType):  # an integer column with gaps may be saved as 6.0
        return cell.try_cast("double").cast("int").alias(column)
    return cell.try_cast(wanted).alias(column)


# A cell beyond the header goes here, and is refused.
_BEYOND = "_alem_do_cabecalho"
# Row numbers of one file; the number of the file stands above them.
_ROWS_PER_FILE = 1 << 33


def read_news_csv(
    spark: SparkSession, path: str | list[str], row_id: str | None = None, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Read raw or cleaned news CSVs: columns by header name, fixed types, tokens as nulls.

    Files may differ in their columns and in their order: each is read by its own header,
    and a column that a file lacks is null there. The header is the first record after any
    blank lines. A row with more cells than its header is an error. ``row_id`` names an extra
    BIGINT column that grows with the path of the file and the row in it; the term
    statistics use it to break ties by first appearance. Cells may hold line breaks. Files
    up to ``split_bytes`` are one task each; larger ones are cut into records by many tasks
    when this is called, which writes the records to the working folder.
    """
    heads = file_heads(spark, path)
    if not heads:
        raise ValueError(f"no CSV with a header in {path}")
    groups: dict[tuple[str, ...], dict[int, Head]] = {}
    for number, head in enumerate(heads):
        groups.setdefault(head.header, {})[number] = head
    tables = []
    for header, own in groups.items():
        cut = {n: h for n, h in own.items() if not h.one_line and (h.size > split_bytes or h.blanks)}
        small = {n: h for n, h in own.items() if n not in cut}
        tables += [_read_small(spark, header, small, row_id)] if small else []
        tables += [_read_large(spark, header, cut, row_id, split_bytes)] if cut else []
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    cells = decode_missing(raw)
    return cells.select(*(F.col(name(c)) if c == row_id else _typed(c) for c in cells.columns))


def _cells(header: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in (*header, _BEYOND)])


def _checked(rows: DataFrame) -> DataFrame:
    beyond = F.col(_BEYOND).isNull()
    return rows.where(beyond | F.assert_true(beyond, "a CSV row has more cells than its header").isNull())


def _read_small(spark: SparkSession, header: tuple[str, ...], heads: dict[int, Head], row_id: str | None) -> DataFrame:
    """Files that share a header, as texts, each read by one task."""
    files = {h.file: n for n, h in heads.items()}
    reader = spark.read.options(**CSV_OPTIONS, multiLine="true").schema(_cells(header))
    checked = _checked(reader.csv([unquote(f) for f in files]))
    if not row_id:
        return checked.drop(_BEYOND)
    own = spark.createDataFrame(list(files.items()), "_arquivo string, _numero long")
    # Rows are numbered in the task that reads them; a file is read by one task, in order.
    numbered = checked.select(
        "*", F.col("_metadata.file_path").alias("_arquivo"), F.monotonically_increasing_id().alias("_lido")
    )
    number = F.col("_numero") * _ROWS_PER_FILE + F.col("_lido").bitwiseAND(F.lit(_ROWS_PER_FILE - 1))
    return numbered.join(F.broadcast(own), "_arquivo").select(*(F.col(name(c)) for c in header), number.alias(row_id))


def _read_large(
    spark: SparkSession, header: tuple[str, ...], heads: dict[int, Head], row_id: str | None, split_bytes: int
) -> DataFrame:
    """Files that share a header, as texts, each read by many tasks."""
    records = split_records(spark, heads, split_bytes)
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
    columns = ", ".join(f"{name(c)} STRING" for c in (*header, _BEYOND))
    # Records of blanks may stand before the header, hardly ever more than a few.
    before = spark.createDataFrame([(n, h.blanks) for n, h in heads.items()], "number long, blanks long")
    rows = records.join(F.broadcast(before), "number").where(F.col("record") > F.col("blanks"))
    cells = rows.select(
        F.from_csv("text", columns, options).alias("_celulas"),
        (F.col("number") * _ROWS_PER_FILE + F.col("record") - F.col("blanks") - 1).alias("_linha"),
    )
    checked = _checked(cells.select("_celulas.*", "_linha"))
    texts = [F.col(name(c)) for c in header]
    return checked.select(*texts, F.col("_linha").alias(row_id)) if row_id else checked.select(*texts)
