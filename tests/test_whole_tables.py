"""Queries over whole tables against brute force, on rows that id bounds would leave out."""

from collections import Counter

import pytest

from curriq.plans import queries as plans

#: l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus
LINES = [(1, 1, 1, 1, "A", "F"), (199, 1, 2, 7, "A", "O"), (200, 1, 3, 2, "A", "F"), (499, 2, 10, 7, "N", "O"), (500, 1, 4, 7, "A", "F"), (500, 1, 4, 7, "A", "F"), (10**9, 3, 7, 7, "R", "F"), (10**9, 2, 11, 1, "A", "O")]
PARTS = [(1, "STANDARD"), (2, "PROMO"), (3, "OTHER"), (4, "STANDARD"), (5, "OTHER")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    tables = {
        "lineitem": (LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"),
        "part": ([(k, f"part {k}", "Brand#1", t, 1, 1.0) for k, t in PARTS], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(k, 0) for k in range(1, 12)], "s_suppkey long, s_nationkey long"), "nation": ([(0, 0, "n")], "n_nationkey long, n_regionkey long, n_name string"), "region": ([(0, "r")], "r_regionkey long, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def test_compact_rehydrate(spark, folder):
    got = Counter((r.stage, r.l_orderkey, r.l_partkey, r.flag, r.status) for r in plans.QUERIES["compact_rehydrate"](spark, folder).collect())
    assert got == Counter((stage, o, p, flag, status) for o, p, _, _, f, status in LINES if f == "A" for stage, flag in (("lifted", None), ("lowered", "A")))


def test_set_reconcile(spark, folder):
    got = Counter((r.l_orderkey, r.l_partkey, r.side) for r in plans.QUERIES["set_reconcile"](spark, folder).collect())
    assert got == Counter([(o, p, "left") for o, p, _, n, _, _ in LINES if n == 7] + [(1, -1, "right")])


def test_findings_parents(spark, folder):
    got = sorted((r.code, r.record_id) for r in plans.QUERIES["findings_parents"](spark, folder).collect())
    assert got == [("parent-too-few", "P:4"), ("parent-too-many", "P:1"), ("parent-type", "P:3")]
