"""SQL spellings of constant lists.

A list spelled in one SQL expression reaches the JVM in one call; built from Columns it
takes one call per element, which for a stop-word list is most of the planning time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def listed(values: Iterable[str]) -> str:
    """Inside of an ``IN (…)`` list; of no values, a list that nothing is in."""
    return ", ".join(quoted(v) for v in values) or "NULL"


def text_array(values: Iterable[str]) -> Column:
    return F.expr(f"array({', '.join(quoted(v) for v in values)})")


def null_if_listed(column: str, values: Iterable[str]) -> str:
    """SQL of a column with the listed values turned into nulls."""
    c = name(column)
    return f"CASE WHEN {c} NOT IN ({listed(values)}) THEN {c} END AS {c}"
