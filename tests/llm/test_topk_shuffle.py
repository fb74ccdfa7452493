"""Top-k moves each block of candidates once, and what a block gives is what brute force gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curriq.llm import op2_topk as op2


def written(spark) -> int:
    """Bytes that all stages so far have shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    lists = spark._jvm.java.util.ArrayList()
    double = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(lists, False, False, double, lists)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_candidates_are_shuffled_once(spark, monkeypatch):
    v = spark.range(6000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda j: F.rand(5).cast("float") + (F.xxhash64("id", j) % 1000) / 1000).cast("array<float>").alias("embedding"))
    took = []
    for size in (2048, 4):
        monkeypatch.setattr(op2, "QUERIES", size)
        before = written(spark)
        assert op2.top_k(v, v.where("vec_id % 100 = 0")).count() == 600
        took.append(written(spark) - before)
    assert took[1] < 2 * took[0]  # 15 groups of queries instead of one


@pytest.mark.parametrize("scale", [1, 10, 3_000, 10_000_000])
def test_a_chain_of_blocks_gives_the_best(scale):
    rng = np.random.default_rng(scale)
    shared = rng.integers(-1000, 1000, (8, 24))
    v = (shared[rng.integers(0, 8, 3000)] * scale + rng.integers(-3, 4, (3000, 24)) * (rng.random(3000) < 0.7)[:, None]).astype(np.int64)
    v[:1500] //= 9  # bounds drop these
    ids, q_ids = rng.permutation(3000).astype(np.int64), np.arange(0, 3000, 10)
    at = np.argsort(ids)
    best = op2.Best(q_ids, 10)
    for first in range(0, 3000, 500):
        part = slice(2500 - first, 3000 - first)
        best.take(*op2.search_block(q_ids, v[at[q_ids]], ids[part], v[part], 10, best.floors))
    scores = v[at[q_ids]] @ v.T
    for i, q in enumerate(q_ids):
        want = sorted((-int(s), int(c)) for s, c in zip(scores[i], ids, strict=True) if c != q)[:10]
        own = best.rows == i
        assert [(-int(s), int(c)) for s, c in zip(best.scores[own], best.ids[own], strict=True)] == want
