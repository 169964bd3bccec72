"""Every registered query against its DuckDB counterpart on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as E
from check import expected, sorted_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

# The queries of the news jobs; those of the training-data operators have their own tests.
NAMES = sorted(n for n in E.queries() if not re.match(r"op\d+_|pipeline$", n))


def test_every_query_has_a_counterpart():
    assert set(NAMES) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["secao", "posicao", "tipo", "termo", "frequencia"]
    assert df.count() == 150


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = E.queries()[name](spark, SF)
    columns, _, rows = expected(SF, E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, rows)


def test_stop_words_of_the_counterparts_are_those_of_spark(spark):
    import oracles
    from manchete.functions.text import portuguese_stop_words

    assert oracles.stop_words() == portuguese_stop_words()


def test_no_query_has_a_cross_join(spark):
    for name in NAMES:
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
