"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios, trained on labelled text.

Features are the 4- to 7-grams of characters (code points) of the lower-cased text, hashed into 2**18 buckets, each present or absent. A
bucket's ratio r is the log of its smoothed share among toxic documents over its share among the others. The 4,096
buckets whose shares differ most, in standard errors, are kept; a logistic regression with an L2 penalty is fitted to
presence times r. The score of a text is the regression's probability over all of its n-grams; texts aren't cut.

The classifier is fitted on a bounded sample: at most SAMPLE_DOCS labelled documents (the lowest hashes of their ids, so
the same ones every time), of those whose crc32(doc_id as text) mod 5 is not 0. Labels, lang, source and doc_id are no
inputs of a score. Several labels of a document: the highest; null labels and null doc_ids aren't learnt from.

Null and empty texts get the score of a text without n-grams. Without labels of both kinds every score is the share of
toxic ones (0 without labels). Null doc_ids count as not held out. Of labelled rows that repeat a doc_id, the one with the
smallest text is learnt from, once; so repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curriq.llm.common import bucket_of, chunks, cut, mix, released, shared_dir, spread, table

SIZES = (4, 5, 6, 7)
BUCKET_BITS = 18
KEPT = 4096
SAMPLE_DOCS = 16_000
SMOOTHING, PENALTY, STEPS = 1.0, 1e-4, 250


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (bucket, text index) of all n-grams of the texts."""
    lowered = [t.lower() for t in texts]
    data = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(lowered), dtype=np.int32), [len(t) for t in lowered])
    value = np.zeros(len(data), dtype=np.uint64)
    for j in range(max(SIZES)):
        n = len(data) - j
        if n <= 0:
            return
        value = value[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + data[j:] + np.uint64(1)
        if j + 1 in SIZES:
            inside = owner[:n] == owner[j:]
            yield (mix(value[inside]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), owner[:n][inside]


@dataclass
class Classifier:
    places: np.ndarray  # bucket -> place among the kept ones, or -1
    weights: np.ndarray
    bias: float

    def presence(self, texts: list[str]) -> np.ndarray:
        """texts x kept: does the text hold the bucket?"""
        found = np.zeros((len(texts), max(1, len(self.weights))), dtype=bool)
        for bucket, owner in grams(texts):
            place = self.places[bucket]
            here = place >= 0
            found[owner[here], place[here]] = True
        return found

    def scores(self, texts: list[str]) -> np.ndarray:
        raw = self.presence(texts)[:, : len(self.weights)] @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic regression on sparse rows, by Adam over the whole sample."""
    w, b, m, v = np.zeros(width + 1), 0.0, np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    for step in range(1, STEPS + 1):
        raw = np.bincount(rows, weights=w[columns] * values, minlength=len(y)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y
        g = np.append(np.bincount(columns, weights=error[rows] * values, minlength=width) / len(y) + PENALTY * w[:-1], error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    b = float(w[-1])
    return w[:-1], b


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    spark = docs.sparkSession
    told = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    told = told.where(bucket_of("doc_id", 5) != 0)
    # the sample's ids first, SAMPLE_DOCS rows at most: small enough to broadcast whatever the tables' sizes
    rows = told.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()
    nothing = Classifier(np.full(1 << BUCKET_BITS, -1, np.int16), np.zeros(0), -40.0)
    if not rows:
        return nothing
    chosen = spark.createDataFrame(rows, "doc_id long, toxic int")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = cut(sample.repartition(12), shared_dir(spark), "sample")

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for start, some in chunks(batch.column(0).to_pylist()):
                # a bucket counts once for a text, whichever sizes hit it
                pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *((owner.astype(np.int64) << BUCKET_BITS) | bucket for bucket, owner in grams(some))]))
                kind = toxic[start + (pairs >> BUCKET_BITS)] > 0
                for k in (0, 1):
                    seen[k] += np.bincount(pairs[kind == k] & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
        some = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0][some]), pa.array(seen[1][some])], names=["bucket", "clean", "toxic"])

    counts = spread(sample.select("text", "toxic")).mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # 2**18 rows at most
    sizes = {r[0]: r[1] for r in sample.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Classifier(nothing.places, np.zeros(0), 40.0 if toxic else -40.0)
    counts = counts.sort_values("bucket")
    p, q = (counts.toxic.to_numpy() + SMOOTHING) / (toxic + 2 * SMOOTHING), (counts.clean.to_numpy() + SMOOTHING) / (clean + 2 * SMOOTHING)
    both = (counts.toxic.to_numpy() + counts.clean.to_numpy() + SMOOTHING) / (toxic + clean + 2 * SMOOTHING)
    errors = np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / toxic + 1 / clean) + 1e-12)
    kept = np.sort(np.argsort(-errors, kind="stable")[:KEPT])
    ratio = np.log(p / q)[kept]
    places = np.full(1 << BUCKET_BITS, -1, dtype=np.int16)
    places[counts.bucket.to_numpy()[kept]] = np.arange(len(kept))
    draft = Classifier(places, np.zeros(len(kept)), 0.0)

    @released
    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in chunks(batch.column(0).to_pylist()):
                found = [np.flatnonzero(row).astype(np.int32).tobytes() for row in draft.presence(some)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(start, len(some)), pa.array(found, pa.binary())], names=["toxic", "found"])

    rows = spread(sample.select("text", "toxic")).mapInArrow(present, "toxic int, found binary").collect()  # SAMPLE_DOCS x KEPT at most
    rows.sort()
    y = np.array([r[0] > 0 for r in rows], dtype=float)
    columns = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.int32)
    owners = np.repeat(np.arange(len(rows)), [len(r[1]) // 4 for r in rows])
    w, bias = logistic(owners, columns, ratio[columns], y, len(kept))
    return Classifier(places, w * ratio, bias)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # half a megabyte
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    @released
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start, some in chunks(batch.column(2).to_pylist()):
                s = own.scores(some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(some)), batch.column(1).slice(start, len(some)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return spread(rows).mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")


def op1_nb_char_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
