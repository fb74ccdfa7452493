"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Sources, in order of code points with null last, have weights 3, 1, 2, repeating, and share 150 % of all words. A
source's target stops at twice its size; what it can't take is shared among the others by weight until no target is
above. A document is taken once for each complete epoch of its source's target; the rest of the target is filled without
replacement: each document gets the key E / w, with E exponential (a hash of its id and the seed, so reruns agree) and w
its quality weight, and documents are taken in order of key while the running sum of sizes, to the middle of the
document, is within the rest.

The running sum has two levels, so that no source is gathered in one task: keys are put into 4,096 bins of equal
probability, bins are summed before the shuffle, and only the bin in which a source's rest ends is sorted.

A document's size is its number of words, runs of other characters than space and tab to carriage return. Null and empty
texts: size 0, taken 0; the mix has them once for each complete epoch of their source. A source without words: target 0. Quality weights: the label `quality` (1: 1.0, 0: 0.25, none or
null: 0.5; several labels of a document: the highest). Rows that repeat a doc_id are taken as rows; those equal in id, size
and text hash as well are interchangeable. Null doc_ids take part with a hash of their text. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curriq.llm.common import cut, shared_dir, table

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2.0
BINS = 4096
SEED = 20240607


def words_in(text: str) -> Column:
    """Number of runs of characters other than space and tab to carriage return."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size -> with weight and target; one row for each source.

    Filling by weight until limits hold leaves each source the smaller of its limit and level * weight. Sources reach
    their limits in order of limit / weight, so the level follows from running sums over that order.
    """
    # a row for each source, already summed; the order of sources is global
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", limit * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    filled = ranked.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).withColumn("all", share * F.sum("source_size").over(everything))
    filled = filled.withColumn("own_level", (F.col("all") - F.col("full")) / F.col("open"))
    level = F.min(F.when(F.col("own_level") <= F.col("ratio"), F.struct("ratio", "source", "own_level"))).over(everything)["own_level"]
    return filled.withColumn("level", level).select("source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))).alias("target"))


def taken_times(docs: DataFrame, labels: DataFrame | None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): rows with doc_id, source, size, copy and times (0 to 2); sources with target."""
    folder = shared_dir(docs.sparkSession)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in("text").alias("size"), F.xxhash64("text").alias("copy"))
    if labels is not None:
        quality = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
        sized = sized.join(quality, "doc_id", "left").withColumn("weight", F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.25).otherwise(0.5)).drop("quality")
    else:
        sized = sized.withColumn("weight", F.lit(0.5))
    # u is in (0, 1); the key's own distribution function spreads keys evenly over the bins at weight 1
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("copy "), F.col("copy").cast("string"))))
    u = (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = sized.withColumn("key", -F.log(u) / F.col("weight")).withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key") / 2)) * BINS), F.lit(BINS - 1)).cast("int"))
    keyed = cut(keyed.select("doc_id", "source", "size", "copy", "key", "bin"), folder, "sized")
    bins = keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    sources = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # at most BINS rows for each source
    summed = bins.withColumn("above", F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size"))
    plan = cut(summed.join(sources, summed["source"].eqNullSafe(sources["source"])).select(summed["source"], "bin", "bin_size", "above", "source_size", "target", "epochs", "rest"), folder, "plan")
    plan = plan.withColumn("part", F.when(F.col("above") + F.col("bin_size") <= F.col("rest"), 1).when(F.col("above") < F.col("rest"), 0).otherwise(-1))
    # bins times sources is a table of counts, far smaller than the documents; its size is not bounded, so no broadcast is forced
    placed = keyed.join(plan.withColumnsRenamed({"source": "s", "bin": "b"}), (F.col("bin") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")))
    placed = placed.select("doc_id", "source", "size", "copy", "key", "bin", "above", "source_size", "target", "epochs", "rest", "part")
    edge = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "copy", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = placed.where("part = 0").withColumn("start", F.col("above") + F.coalesce(F.sum("size").over(edge), F.lit(0))).withColumn("times", F.col("epochs") + ((F.col("size") > 0) & (F.col("start") + F.col("size") / 2 <= F.col("rest"))).cast("int")).drop("start")
    clear = placed.where("part <> 0").withColumn("times", F.col("epochs") + ((F.col("part") == 1) & (F.col("size") > 0)).cast("int"))
    return clear.unionByName(last).select("doc_id", "source", "size", "copy", "source_size", "target", "times"), sources


def mix_sources(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of this document, repeats counted)."""
    rows, _ = taken_times(docs, labels)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """docs, each row as often as the mix takes it."""
    rows, _ = taken_times(docs, labels)
    # rows that repeat id, text and source are taken alike, as often as the one of them that is taken most
    times = rows.where("times > 0").groupBy("doc_id", "copy", "source").agg(F.max("times").alias("times"))
    whole = docs.select(F.struct("*").alias("row"))  # the documents' own columns can't clash with these
    hit = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("copy")) & F.col("row.source").eqNullSafe(F.col("source"))
    return whole.join(times, hit).select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op10_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('20240607:' || d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN q.quality = 1 THEN 1.0 WHEN q.quality = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS key
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q ON q.doc_id = d.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s),
f AS (
  SELECT *, most / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS whole,
    coalesce(sum(most) OVER w, 0.0)::DOUBLE AS full_, (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0))::DOUBLE AS open_
  FROM r WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (whole - full_) / open_ AS level FROM f WHERE (whole - full_) / open_ <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(most, (SELECT level FROM l) * weight), most) AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start
  FROM sized d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN start + size / 2.0 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p
"""
