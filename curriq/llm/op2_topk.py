"""Exact top-k search by inner product: columnar branch and bound over blocks of queries and candidates.

Each component x becomes floor(1024 * x), x taken as a double. Candidates are packed into blocks of 4,096 vectors and
queries, by a hash of their ids, into blocks of about 2,048, in the narrowest integers that hold them. Each block of candidates
moves once, to one of as many salts as there are shuffle partitions; the queries, a small stated set, go to every salt. So what
is shuffled grows with the table and not with its square, a task holds one block of each at a time, and nothing is broadcast or
collected.

In a block, candidates lie in vertical layout, one array for each dimension, dimensions in order of the query block's
mass. Products are added a quarter of the dimensions at a time, for 128 queries together. A task keeps the k best of each query
over all its blocks, and the k-th of them is the query's floor in the next block: a candidate's score can still grow by at most
the product of the two vectors' remaining norms, candidates that can reach no floor of the 128 are dropped, and the survivors
are compacted before the next step. Where a look at the bounds drops few, the next ones are left out. Bounds are compared with
>=, so ties survive, and the last step makes each survivor's score exact. Scores are exact integers: floats and doubles are used
where the vectors' norms keep all sums below 2**24 and 2**53, else 64-bit integers (scores beyond 64 bits are out of range). The k
best of each query in each task are then cut to the k best of all, ties to the smaller vec_id.

Null vectors, vectors with null or non-finite components, empty vectors and null vec_ids take no part. A query and a candidate of different length
have no score. Rows that repeat a vec_id are candidates of their own, but not for a query of that id; such queries are one
query if their vectors are equal, else the smallest is taken. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curriq.llm.common import spread, table

K = 10
CANDIDATES, QUERIES, TOGETHER, STEPS = 4096, 2048, 128, 4
#: A block of long vectors has fewer of them.
CELLS = 1 << 20
#: Chunks of queries without a look at the bounds after one that dropped less than a quarter.
PAUSE = 15
LEAST = np.iinfo(np.int64).min + 1

FOUND = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of long) of the vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(fine).select("vec_id", F.transform(x, lambda e: F.floor(e * 1024).cast("long")).alias("v"))


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(rows.astype(np.float64)).sum(axis=1)) * (1 + 1e-9)


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = K, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's number, vec id, score) of what may be among each query's k best: those of the block that reach the query's floor
    (the k-th best score of other blocks; none at LEAST), the k best of them where they are many, ties to smaller ids. Integer matrices."""
    n, dims = queries.shape
    floors = np.full(n, LEAST) if floors is None else floors
    if not n or not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = float(_norms(queries).max()) * float(_norms(vectors).max())
    kind, slack = (np.float32, 4.0) if top < 2.0**24 else (np.float64, 4.0) if top < 2.0**52 else (np.int64, 8192.0)
    low = -np.inf if kind is not np.int64 else np.iinfo(np.int64).min
    order = np.argsort(-np.square(queries.astype(np.float64)).sum(axis=0), kind="stable")
    by_id = np.argsort(ids, kind="stable")
    ids = ids[by_id]
    columns = np.ascontiguousarray(vectors[by_id][:, order].T.astype(kind))  # vertical: dimension x candidate
    queries = np.ascontiguousarray(queries[:, order].astype(kind))
    width = max(8, -(-dims // STEPS))
    ends = [*range(width, dims, width), dims]
    # norms of what remains after each step
    left = [_norms(columns[e:].T).astype(np.float32 if kind is np.float32 else np.float64) for e in ends[:-1]]
    found_q, found_v, found_s = [], [], []
    pause = 0
    for first in range(0, n, TOGETHER):
        q, own = queries[first : first + TOGETHER], query_ids[first : first + TOGETHER]
        raised = floors[first : first + TOGETHER]
        floor = np.where(raised == LEAST, -np.finfo(kind).max, raised).astype(kind) if kind is not np.int64 else raised
        alive = None
        if pause or (raised == LEAST).any() or not left:
            score, pause = q @ columns, max(0, pause - 1)
        else:
            score, held = q[:, : ends[0]] @ columns[: ends[0]], columns
            for at, end in enumerate(ends[:-1]):
                room = left[at] if alive is None else left[at][alive]
                keep = (score + (_norms(q[:, end:]).astype(room.dtype)[:, None] * room + room.dtype.type(slack)) >= floor[:, None]).any(axis=0)
                if 4 * np.count_nonzero(keep) > 3 * len(keep):
                    pause = PAUSE
                    score = score + q[:, end:] @ held[end:]
                    break
                alive = np.flatnonzero(keep) if alive is None else alive[keep]
                score, held = score[:, keep], columns[:, alive]
                score = score + q[:, end : ends[at + 1]] @ held[end : ends[at + 1]]
        names = ids if alive is None else ids[alive]
        starts, stops = np.searchsorted(names, own, "left"), np.searchsorted(names, own, "right")
        for r in np.flatnonzero(starts < stops):
            score[r, starts[r] : stops[r]] = low  # not a query's own id
        hits = score >= floor[:, None]
        many = np.flatnonzero(np.count_nonzero(hits, axis=1) > 4 * k)
        for r in many:
            line = np.flatnonzero(hits[r])
            some = score[r, line]
            bar = np.partition(some, len(some) - k)[len(some) - k]
            above, level = np.flatnonzero(some > bar), np.flatnonzero(some == bar)  # in order of id
            hits[r] = False
            hits[r, line[np.concatenate([above, level[: k - len(above)]])]] = True
        rows, cols = np.nonzero(hits)
        found_q.append(rows + first)
        found_v.append(names[cols])
        found_s.append(score[rows, cols].astype(np.int64))
    return np.concatenate(found_q), np.concatenate(found_v), np.concatenate(found_s)


class Best:
    """The k best of each query of a block so far: rows in order of (query's number, score from the highest, vec id)."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.rows, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.floors = np.full(len(query_ids), LEAST)

    def take(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        rows, ids, scores = np.concatenate([self.rows, rows]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, rows))
        rows = rows[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        kept = rank < self.k
        self.rows, self.ids, self.scores = rows[kept], ids[order][kept], scores[order][kept]
        last = rank[kept] == self.k - 1
        self.floors[self.rows[last]] = self.scores[last]


def _narrow(flat: np.ndarray) -> bytes:
    """Integers in 2, 4 or 8 bytes each, as the farthest from zero needs."""
    low, high = int(flat.min(initial=0)), int(flat.max(initial=0))
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return flat.astype(kind).tobytes()


def _matrix(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{len(data) // (rows * dims)}").reshape(rows, dims)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """block, dims, ids, data: blocks of at most `size` vectors of one length, as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray], int]] = {}

        def close(dims: int) -> pa.RecordBatch:
            ids, data, _ = held.pop(dims)
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) | block], pa.int64()), "dims": pa.array([dims], pa.int32()), "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()), "data": pa.array([_narrow(np.concatenate(data))], pa.binary())})

        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy()
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths):
                some, most = np.flatnonzero(lengths == dims), max(1, min(size, CELLS // int(dims)))
                for k in range(0, len(some), most):
                    rows_ = some[k : k + most]
                    own = held.setdefault(int(dims), ([], [], 0))
                    own[0].append(ids[rows_])
                    own[1].append(flat[(starts[rows_][:, None] + np.arange(dims)).ravel()])
                    held[int(dims)] = (own[0], own[1], own[2] + len(rows_))
                    if held[int(dims)][2] >= most:
                        yield close(int(dims))
                        block += 1
        for dims in list(held):
            yield close(dims)
            block += 1

    return spread(rows).mapInArrow(pack, "block long, dims int, ids binary, data binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors (vec_id, embedding) for each of queries, without its own id."""
    spark = vectors.sparkSession
    ready, asked = quantized(vectors), quantized(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    salts, groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), max(1, -(-asked.count() // QUERIES))

    def pack_queries(key: tuple, group: pa.Table) -> pa.Table:
        flat = pa.chunked_array([c.flatten() for c in group.column("v").chunks], pa.int64()).to_numpy()
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "dims": pa.array([key[1].as_py()], pa.int32()), "q_ids": pa.array([group.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()), "q_data": pa.array([_narrow(flat)], pa.binary())})

    dealt = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), F.size("v").alias("dims"), "vec_id", "v")
    query_blocks = dealt.groupBy("g", "dims").applyInArrow(pack_queries, "g int, dims int, q_ids binary, q_data binary").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    candidate_blocks = _packed(ready, CANDIDATES).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_ids, ids = np.frombuffer(row["q_ids"], dtype=np.int64), np.frombuffer(row["ids"], dtype=np.int64)
                own = best.setdefault((row["g"], row["dims"]), Best(q_ids, k))
                own.take(*search_block(q_ids, _matrix(row["q_data"], len(q_ids), row["dims"]), ids, _matrix(row["data"], len(ids), row["dims"]), k, own.floors))
        for own in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own.query_ids[own.rows], own.ids, own.scores)], names=["query_id", "vec_id", "score"])

    # of a number that is asked for: few bytes are much work here, so partitions must not be coalesced by their bytes
    dealt_out = lambda blocks: blocks.repartition(salts, "dims", "salt")
    pairs = dealt_out(candidate_blocks).join(dealt_out(query_blocks).hint("merge"), ["dims", "salt"]).select("g", "dims", "q_ids", "q_data", "ids", "data")
    found = spread(pairs).mapInArrow(search, FOUND)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op2_branch_and_bound_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
