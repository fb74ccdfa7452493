"""Near-duplicate classes of documents: BagMinHash signatures of shingle multisets, bands, exact verification.

Two texts are linked if the multisets of their five-word shingles have a weighted Jaccard similarity (sum of minima over
sum of maxima) of 0.8 or more. A class is a connected component of links; each document gets the smallest doc_id of its
class. Texts with equal multisets share a class, exact copies whatever they hold.

BagMinHash: a shingle's weight axis is cut into intervals (0,1], (1,2], (2,4], (4,8] ...; each interval of each shingle
carries a Poisson process with a rate of its length, seeded by shingle and interval, so that any two documents see the
same points. A point within the document's own weight goes to a random place of the signature, which keeps the earliest
time. Points come in order of time, so a process stops once it is later than every place. Places of two signatures agree
with a probability of exactly the weighted Jaccard similarity.

Signatures are cut into 25 bands of 5 places (a pair at 0.8 is missed with a probability of 5e-5). Of texts with equal
multisets one takes part. A multiset is held as a set: the j-th occurrence of a shingle is an item of its own, so that the
sum of minima is the size of an intersection, which Spark computes on arrays of items.

1. Each member of a bucket (texts that share a band's value) is compared with the bucket's smallest id: one pair a member.
2. Buckets whose members are then of one class are settled. The texts of the others are joined by prefixes: items are
   ordered by the number of these texts that have them, rarest first. A pair at 0.8 shares an item among the first
   size - ceil(0.8 size) + 1 of each, and the items from the first shared one on must suffice. A large group of variants
   shares only frequent items, which come last, so what is left are small groups, of which only pairs across classes
   are compared: with 8 leaders of a group, then 512 and so on until none is left. No link is lost, nothing is capped.

Null doc_ids: class_id null. Null texts: a class of their own. Texts without words: linked by exact copies only. Rows that
repeat a doc_id must repeat its text; each row gets the class. Columns other than doc_id and text are not read. An empty
table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curriq.llm.common import SHINGLE, chunks, cut, forget, mix, released, shared_dir, spread, table, text_shingles

BANDS, ROWS = 25, 5
SIMILARITY = 0.8
ELEMENT_BITS = 44
#: Leaders of a group of texts that share a rare item, and so many times more in each further round.
FIRST_LEADERS, LEADER_GROWTH = 8, 64

# ---- BagMinHash ------------------------------------------------------------------------------------------------


def bags(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, multiplicity) of each text's distinct shingles, in order of text and shingle."""
    shingles, owners = text_shingles(texts, k)
    keys = (owners.astype(np.uint64) << np.uint64(ELEMENT_BITS)) | (shingles >> np.uint64(64 - ELEMENT_BITS))
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(keys)]]))
    return (keys[first] >> np.uint64(ELEMENT_BITS)).astype(np.int64), keys[first] & np.uint64((1 << ELEMENT_BITS) - 1), counts


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, places: int) -> np.ndarray:
    """BagMinHash signatures (n x places) of integer weights; infinite where an owner has no element."""
    owners, seeds, rates, lows, tops = [owner], [mix(element * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))], [np.ones(len(owner))], [np.zeros(len(owner), np.int64)], [weight]
    level, low = 1, 1
    here = np.flatnonzero(weight > low)
    while len(here):  # the interval (low, 2 low]
        owners.append(owner[here])
        seeds.append(mix(element[here] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1)))
        rates.append(np.full(len(here), float(low)))
        lows.append(np.full(len(here), low, np.int64))
        tops.append(weight[here])
        level, low = level + 1, 2 * low
        here = np.flatnonzero(weight > low)
    d, seed, rate, low, top = (np.concatenate(x) for x in (owners, seeds, rates, lows, tops))
    out = np.full((n, places), np.inf)
    flat, time, step, block = out.ravel(), np.zeros(len(d)), 0, 1
    while len(d):
        late = np.zeros(len(d), dtype=bool)
        for j in range(block):
            h = mix(seed + np.uint64((step + j) * 0xC2B2AE3D27D4EB4F % 2**64))
            time = time - np.log(((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate
            place = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)
            partial = np.flatnonzero(low > 0)
            at = d * places + place
            if len(partial):  # keep points whose place on the weight axis is within the weight
                spot = low[partial] + 1 + ((mix(h[partial] + np.uint64(7)) >> np.uint64(33)).astype(np.int64) % low[partial])
                outside = partial[spot > top[partial]]
                kept = np.ones(len(d), dtype=bool)
                kept[outside] = False
                np.minimum.at(flat, at[kept], time[kept])
            else:
                np.minimum.at(flat, at, time)
        step += block
        late = time >= out.max(axis=1)[d]
        go = ~late
        d, seed, rate, low, top, time = (x[go] for x in (d, seed, rate, low, top, time))
        block = min(32, block * 2 if step > 2 else 1)
    return out


def band_values(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    out = np.zeros((len(signature), bands), dtype=np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return mix(out + np.arange(bands, dtype=np.uint64)).view(np.int64)  # equal only within a band


def items_of(element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """An item for each occurrence: the j-th of a shingle has the same item in every text."""
    ends = np.cumsum(weight)
    nth = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - weight, weight)
    return mix(np.repeat(element, weight) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64)).view(np.int64)


def digests(owner: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The owners that have elements, and 128 bits for each one's multiset."""
    there, first = np.unique(owner, return_index=True)
    if not len(there):
        return there, []
    own = mix(element * np.uint64(0xC2B2AE3D27D4EB4F) + weight.astype(np.uint64))
    sums = np.stack([np.add.reduceat(own, first), np.add.reduceat(mix(own + np.uint64(1)), first)], axis=1)
    return there, [row.tobytes() for row in np.ascontiguousarray(sums)]


# ---- Classes ---------------------------------------------------------------------------------------------------


def _sketch(docs: DataFrame) -> DataFrame:
    """doc_id, copy (128 bits of the multiset, or of the text where it has no word; null for null), size and buckets."""

    @released
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, some in chunks(texts):
                owner, element, weight = bags(some)
                values = band_values(signatures(owner, element, weight, len(some), BANDS * ROWS))
                sizes = np.bincount(owner, weights=weight, minlength=len(some)).astype(np.int64)
                copies: list[bytes | None] = [None if texts[start + i] is None else hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() if not sizes[i] else None for i, t in enumerate(some)]
                for i, digest in zip(*digests(owner, element, weight), strict=True):
                    copies[i] = digest
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * BANDS + 1, BANDS), pa.int32()), pa.array(values.ravel()), mask=pa.array(sizes == 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(some)), pa.array(copies, pa.binary()), pa.array(sizes), lists], names=["doc_id", "copy", "size", "buckets"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(sketch, "doc_id long, copy binary, size long, buckets array<long>")


def _bagged(texts: DataFrame) -> DataFrame:
    """id, items of each of the texts (id, text)."""

    @released
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in chunks(batch.column(1).to_pylist()):
                owner, element, weight = bags(some)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=weight, minlength=len(some)).astype(np.int64))])
                items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(items_of(element, weight)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(some)), items], names=["id", "items"])

    return spread(texts).mapInArrow(listed, "id long, items array<long>")


def _linked(pairs: DataFrame, bagged: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets are similar. b may stand in very many pairs: its rows can be split."""
    left = pairs.join(bagged.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")
    both = left.join(bagged.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
    low, total = F.size(F.array_intersect("items_a", "items_b")), F.size("items_a") + F.size("items_b")
    # low / (total - low) >= 0.8 in whole numbers
    return both.where(9 * low >= 4 * total).select("a", "b")


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, class_id): the smallest id of each connected component of edges (a, b).

    Each round takes the smallest label among neighbours and then the label's own label, so labels travel twice as far in
    each round; every round's labels are a table in the shared folder.
    """
    spark = edges.sparkSession
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), folder, f"{name}-edges")
    labels, step = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("class_id")), folder, f"{name}-0"), 0
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "class_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("near"))
        told = labels.join(near, "id").select("id", F.col("class_id").alias("old"), F.least("class_id", "near").alias("mid"))
        jump = told.join(labels.select(F.col("id").alias("mid"), F.col("class_id").alias("far")), "mid", "left")
        new = cut(jump.select("id", F.least("mid", F.coalesce("far", "mid")).alias("class_id"), "old"), folder, f"{name}-{step + 1}")
        changed = not new.where("class_id <> old").isEmpty()
        forget(spark, folder, f"{name}-{step}")
        labels, step = new.select("id", "class_id"), step + 1
        if not changed:
            forget(spark, folder, f"{name}-edges")
            return labels


def joined(labels: DataFrame | None, links: DataFrame, folder: str, name: str) -> DataFrame | None:
    """labels (id, class_id) after further links (a, b): components of the classes that links join, not of all texts."""
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links, folder, name)
    of = lambda end: labels.select(F.col("id").alias(end), F.col("class_id").alias(f"class_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b"))
    over = components(ends, folder, name)
    moved = labels.join(over.select(F.col("id").alias("class_id"), F.col("class_id").alias("into")), "class_id", "left").select("id", F.coalesce("into", "class_id").alias("class_id"))
    return cut(moved.unionByName(over.join(labels, "id", "left_anti").select("id", "class_id")), folder, f"{name}-all")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, class_id, kept (is it the one that stands for its class)."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    sketched = cut(_sketch(docs), folder, "sketches")
    firsts = cut(sketched.where("copy IS NOT NULL").groupBy("copy").agg(F.min("doc_id").alias("id")), folder, "firsts")
    heads = sketched.where("buckets IS NOT NULL").join(firsts.withColumnRenamed("id", "doc_id"), ["copy", "doc_id"], "left_semi")
    buckets = heads.select(F.col("doc_id").alias("id"), "size", F.explode("buckets").alias("bucket"))
    crowded = buckets.groupBy("bucket").agg(F.min(F.struct("id", "size")).alias("l"), F.max("id").alias("last")).where("l.id < last")
    live = cut(buckets.join(crowded.select("bucket", F.col("l.id").alias("leader"), F.col("l.size").alias("leader_size")), "bucket"), folder, "live")
    labels = None
    if not live.isEmpty():
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        bagged = cut(_bagged(texts.join(live.select("id").distinct(), "id").dropDuplicates(["id"])), folder, "bags")
        stars = live.where((F.col("id") > F.col("leader")) & _near("size", "leader_size")).select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
        labels = joined(None, cut(_linked(stars, bagged), folder, "links-0"), folder, "labels-0")
        labels = _settled(live.select("bucket", "id", "size"), labels, bagged, folder)
        forget(spark, folder, "live", "bags")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    known = sketched.select("doc_id", "copy").join(firsts, "copy", "left").select("doc_id", F.coalesce("id", "doc_id").alias("id"))
    if labels is not None:
        known = known.join(labels, "id", "left").select("doc_id", F.coalesce("class_id", "id").alias("class_id"))
    else:
        known = known.withColumnRenamed("id", "class_id")
    return known.unionByName(rows).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _near(a: str, b: str) -> Column:
    """Can texts of these sizes be linked?"""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _named(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows (id, ...) with their present class_id."""
    if labels is None:
        return rows.withColumn("class_id", F.col("id"))
    return rows.drop("class_id").join(labels, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))


def _settled(live: DataFrame, labels: DataFrame | None, bagged: DataFrame, folder: str) -> DataFrame | None:
    """labels once every pair across classes in the buckets of live (bucket, id, size) is settled."""
    named = _named(live, labels)
    split = named.groupBy("bucket").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high").select("bucket")
    unsettled = cut(named.join(split, "bucket", "left_semi").select("id", "size", "class_id").distinct(), folder, "unsettled")
    groups, step = cut(_prefixes(unsettled, bagged), folder, "groups-1"), 1
    leaders = FIRST_LEADERS
    while True:
        split = groups.groupBy("item").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high").select("item")
        groups = cut(groups.join(split, "item", "left_semi"), folder, f"open-{step}")
        if groups.isEmpty():
            return labels
        # leaders of equal hashes in every group, so that texts which share many items meet in the same pairs
        chosen = groups.groupBy("item", F.pmod(F.xxhash64("id"), F.lit(leaders)).alias("slice")).agg(F.min(F.struct("id", "class_id", "size", "left")).alias("l")).select("item", "l")
        met = groups.join(chosen, "item").where((F.col("class_id") != F.col("l.class_id")) & (9 * F.least("left", "l.left") >= 4 * (F.col("size") + F.col("l.size"))))
        pairs = met.select(F.greatest("id", "l.id").alias("a"), F.least("id", "l.id").alias("b")).distinct()
        labels = joined(labels, cut(_linked(pairs, bagged), folder, f"links-{step}"), folder, f"labels-{step}")
        rest = groups.join(chosen.select("item", F.col("l.id").alias("id")), ["item", "id"], "left_anti")
        groups, step, leaders = _named(rest, labels), step + 1, leaders * LEADER_GROWTH


def _prefixes(texts: DataFrame, bagged: DataFrame) -> DataFrame:
    """item, id, size, class_id, left (items from this one on) for the items of each text's prefix that other classes have too."""
    rows = texts.join(bagged, "id").select("id", "size", "class_id", F.explode("items").alias("item"))
    held = rows.groupBy("item").agg(F.count("*").alias("n"), F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("n > 1").select("item", "n", (F.col("low") < F.col("high")).alias("crossed"))
    # items that no other text has come first in the order; a text with too many of them has no partner
    own = Window.partitionBy("id")
    ranked = rows.join(held, "item").withColumn("shared", F.count("*").over(own)).where(5 * F.col("shared") >= 4 * F.col("size"))
    ranked = ranked.withColumn("left", F.col("shared") - F.row_number().over(own.orderBy("n", "item")) + 1)
    return ranked.where(F.col("crossed") & (5 * F.col("left") >= 4 * F.col("size"))).select("item", "id", "size", "class_id", "left")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row for each class, the one of its smallest doc_id; rows with a null doc_id stay.

    Of rows that repeat the doc_id, the one with the smallest hash of all its columns stays.
    """
    kept = near_duplicate_classes(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept")).distinct()
    first = Window.partitionBy("__row.doc_id").orderBy(F.xxhash64("__row"))
    one = docs.join(kept, docs["doc_id"] == kept["__kept"], "left_semi").select(F.struct("*").alias("__row")).withColumn("__place", F.row_number().over(first)).where("__place = 1").select("__row.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def op8_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
