import os

import pytest

from manchete import workspace
from manchete.operators.numbering import cut_at, number_rows, ordered_ranges
from manchete.operators.ranking import top_by_frequency
from pyspark.sql import functions as F


class Session:
    """A session of another master, without the folders a cluster has to name."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master, self._jsc = master, self

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return False


def test_a_cluster_must_name_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="shared folder"):
            workspace.working_folder(Session(master))
    assert workspace.working_folder(Session("yarn", "hdfs://x/y/")).startswith("hdfs://x/y/manchete-")
    assert os.path.isdir(os.path.dirname(workspace.working_folder(Session("local[2]"))))


def test_folders_of_a_job_go_with_it(spark):
    with workspace.job_folders(spark):
        workspace.materialise(spark.range(3))
        (path,) = workspace._opened[-1]
        assert os.path.isdir(path)
    assert not os.path.exists(path) and not workspace._opened


def test_row_numbers(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("secao"), F.hash("id").alias("h")).repartition(9)
    got = number_rows(rows, [F.col("h").asc()]).orderBy("numero").collect()
    assert [r.numero for r in got] == list(range(1, 5001)) and [r.h for r in got] == sorted(r.h for r in got)
    for r in number_rows(rows, [F.desc("h")], within="secao").where("numero <= 2").collect():
        own = sorted((x.h for x in got if x.secao == r.secao), reverse=True)
        assert own[r.numero - 1] == r.h
    assert number_rows(rows.limit(0), [F.col("h").asc()]).collect() == []


@pytest.mark.parametrize("copies", [False, True])
def test_equal_keys_are_shared_by_several_ranges(spark, copies):
    """One key, or one row, has half of all rows: no range gets more than twice its share."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 1000).alias("chave"),
        (F.lit(0) if copies else F.col("id")).alias("outra"),
    )
    rows = rows.repartition(8)
    ranges = ordered_ranges(rows, [F.col("chave").asc()])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in ranges.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * 40_000 / 8
    got = number_rows(rows, [F.col("chave").asc()]).orderBy("numero").collect()
    assert [r.numero for r in got] == list(range(1, 40_001))
    assert [r.chave for r in got] == sorted(r.chave for r in got)


@pytest.mark.parametrize("n", [1, 2, 999, 1000, 1001, 5000, 9999])
def test_cut_at(spark, n):
    values = [(7 * k) ** 3 % 100_003 - 50_000 for k in range(9000)] + [3] * 1000
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(4)
    value, below = cut_at(df, "v", n)
    ordered = sorted(values)
    assert value == ordered[n - 1] and below == sum(v < value for v in values)
    assert cut_at(df, "v", 10_000) is None and cut_at(df.limit(0), "v", 1) is None



@pytest.mark.parametrize("limit", [5, 1000, 1001, 5000])
def test_ranking_is_the_same_beyond_the_limit_that_spark_cuts_to(spark, limit):
    terms = spark.range(6000).select(
        (F.col("id") % 2).cast("int").alias("secao"), (F.col("id") % 7).alias("frequencia"), (-F.col("id")).alias("primeira")
    )
    ranked = top_by_frequency(terms.repartition(5), "secao", limit)
    got = [(r.secao, r.posicao, r.primeira) for r in ranked.orderBy("secao", "posicao").collect()]
    wanted = []
    for s in (0, 1):
        own = sorted((-(i % 7), -i) for i in range(6000) if i % 2 == s)[:limit]
        wanted += [(s, k + 1, first) for k, (_, first) in enumerate(own)]
    assert got == wanted
    assert dict(ranked.dtypes)["posicao"] == "int"
    if limit > 1000:
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan
