"""Supports of large tables: tasks of bounded size, sorted rows and no map of pairs or components."""

import os
import random

import pytest
from pyspark.sql import functions as F

from curriq import session
from curriq.operators import statistics
from curriq.plans import queries as plans
from curriq.plans import views as V

SMALL = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@tables
def test_tasks_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    lines = session.table(spark, SMALL, "lineitem").count()
    tasks = V.supports(spark, SMALL).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert len(tasks) > lines // 500 * 0.9 and max(r.n for r in tasks) < 800


@tables
def test_components_are_not_gathered_in_maps(spark):
    plan = plans.QUERIES["stat_components"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    aggregates = [x for x in plan.splitlines() if "Aggregate(keys=[" in x and "keys=[]" not in x]
    assert len(aggregates) == 2 and all("keys=[l_partkey" in x for x in aggregates)  # different parts, in part and whole
    assert plan.count("Sort [") == 1 and plan.count("REPARTITION_BY_NUM") == 1  # one shuffle of lines, sorted once


def test_random_supports_brute_force(spark):
    """Repeated pairs, standards, components and confidences that are null, an only component, no support."""
    r = random.Random(19)
    pick = lambda n: r.choice([*range(n), None])
    cases = [[(pick(9), pick(4), r.choice([0.1, 0.5, 0.9, None])) for _ in range(r.choice([1, 6, 40]))] for _ in range(6)]
    for rows in [*cases, [], [(1, None, 0.3)] * 2, [(1, i, 0.3) for i in range(50)]]:
        spans = {c: {s for k, s, _ in rows if k == c and s is not None} for c, _, _ in rows}
        known = [x for _, _, x in rows if x is not None]
        want = (len({s for _, s, _ in rows if s is not None}), len(spans), sum(len(s) > 1 for s in spans.values()), max(map(len, spans.values()), default=None), min(known, default=None), max(known, default=None))
        told = statistics.support_statistics(spark.createDataFrame(rows, "component long, standard long, confidence double"))
        assert told.columns == ["standards", "components", "bridges", "largest_span", "least_confidence", "most_confidence"] and [tuple(x) for x in told.collect()] == [want]


def test_a_pair_has_its_least_discount(spark, tmp_path):
    lines = [(1, 1, 0.5), (1, 1, 0.25), (1, 2, None), (1, 2, 0.75), (2, 1, None), (None, 1, 0.125), (None, 1, 0.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.component, r.standard, r.confidence) for r in V.supports(spark, str(tmp_path)).collect()}
    assert got == {("O:1", "P:1", 0.75), ("O:1", "P:2", 0.25), ("O:2", "P:1", None), (None, "P:1", 1.0)}
