"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation, rendered once as
prompt, and what follows in each as a pair of completions with a loss mask.

`format_preferences` gives a row for each rendered turn: pair_id, block, part (prompt, chosen or rejected), turn, place
(among turns of the same number), role, rendered text, in_loss (assistant turns of the completions). `pairs` makes of
them one row a pair: prompt, chosen, rejected, and the completions' loss spans (start:end in code points of that row's
completion, comma-joined, end exclusive). A pair of more than 1,024 turn numbers or PIECE_BYTES has further rows: in order of
(block, piece) their columns are its texts, so a conversation may be as long as it likes. All work on turns stays within
(pair, block of 1,024 turn numbers); only one short row for each block meets the others of its pair.

Turns are in order of `turn` (null first), those with the same number by role and text; rows that repeat another wholly
count once. Null roles are rendered as `unknown`, null texts as empty. Null pair ids take no part. If one conversation is
the other's beginning, its completion is empty; equal ones are all prompt. Extra columns are not read.

The query makes its pairs from the table: chosen is a conversation up to its last assistant turn, rejected the same with
the last assistant reply of the next such conversation of the whole table (by conv_id, the last followed by the first) in that
turn's place. Conversations without assistant turns give no pair, nor does one that is alone in the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curriq.llm.common import cut, shared_dir, table

NO_TURN = -(1 << 63)
PIECE_BYTES = 1 << 20


def _turns(rows: DataFrame) -> DataFrame:
    """pair_id, block, turn, role, text without nulls."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN))
    return rows.where("pair_id IS NOT NULL").select(
        F.col("pair_id").cast("long").alias("pair_id"), F.shiftright(turn, 10).alias("block"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rendered turns of pairs; chosen and rejected have pair_id, turn, role, text."""
    # dealt once by (pair, block): the distinct, the numbering, the comparison and the join below need no other exchange
    rows = _turns(chosen).withColumn("side", F.lit(0)).unionByName(_turns(rejected).withColumn("side", F.lit(1))).repartition("pair_id", "block").distinct()
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("pair_id", "block", "turn", "side").orderBy("role", "text")))
    said = F.struct("role", "text")
    cells = placed.groupBy("pair_id", "block", "turn", "place").agg(F.max(F.when(F.col("side") == 0, said)).alias("c"), F.max(F.when(F.col("side") == 1, said)).alias("r"))
    cells = cells.withColumn("same", F.col("c").eqNullSafe(F.col("r")))
    spot = F.struct("turn", "place")
    # the first difference of each block, then of the pair
    firsts = cells.groupBy("pair_id", "block").agg(F.min(F.when(~F.col("same"), spot)).alias("own"))
    firsts = firsts.withColumn("first", F.min("own").over(Window.partitionBy("pair_id"))).drop("own")
    prompts = cells.join(firsts, ["pair_id", "block"]).withColumn("shared", F.col("first").isNull() | (spot < F.col("first")))
    part = lambda name, value: F.struct(F.lit(name).alias("part"), F.col(value).alias("said"))
    parts = F.when(F.col("shared"), F.array(part("prompt", "c"))).otherwise(F.array(part("chosen", "c"), part("rejected", "r")))
    out = prompts.select("pair_id", "block", "turn", "place", F.explode(parts).alias("p")).where("p.said IS NOT NULL")
    return out.select(
        "pair_id", "block", "p.part", F.when(F.col("turn") != NO_TURN, F.col("turn")).alias("turn"), "place", F.col("p.said.role").alias("role"),
        F.concat(F.lit("<|"), F.col("p.said.role"), F.lit("|>\n"), F.col("p.said.text"), F.lit("<|end|>\n")).alias("rendered"),
        ((F.col("p.part") != "prompt") & (F.col("p.said.role") == "assistant")).alias("in_loss"),
    )


def pairs(segments: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """pair_id, block, piece, prompt, chosen, rejected, chosen_loss, rejected_loss: one row a pair, or one for each piece.

    A piece starts with the turn that starts beyond a multiple of piece_bytes in its block's rendered bytes, so it
    holds that many and one turn at most.
    """
    upto = Window.partitionBy("pair_id", "block").orderBy("turn", "place", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("rendered")).over(upto), F.lit(0))
    rows = segments.withColumn("piece", F.floor(before / piece_bytes))
    ends = F.sum(F.char_length("rendered")).over(Window.partitionBy("pair_id", "block", "piece", "part").orderBy("turn", "place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", ends).withColumn("span", F.concat_ws(":", F.col("end") - F.char_length("rendered"), "end"))

    def joined(part: str, value: str, sep: str, keep):
        items = F.sort_array(F.collect_list(F.when(keep & (F.col("part") == part), F.struct("turn", "place", value))))
        return F.array_join(F.transform(items, lambda x: x[value]), sep)

    texts = [joined(p, "rendered", "", F.lit(True)).alias(p) for p in ("prompt", "chosen", "rejected")]
    spans = [joined(p, "span", ",", F.col("in_loss")).alias(f"{p}_loss") for p in ("chosen", "rejected")]
    return rows.groupBy("pair_id", "block", "piece").agg(*texts, *spans)


def next_ids(ids: DataFrame) -> DataFrame:
    """(pair_id, next_id) of distinct ids, the greatest followed by the smallest.

    Ids are dealt by ranges; only the first id of each range, as many as there are partitions, meets the others.
    """
    dealt = cut(ids.repartitionByRange("pair_id").withColumn("range", F.spark_partition_id()), shared_dir(ids.sparkSession), "ranges")
    heads = dealt.groupBy("range").agg(F.min("pair_id").alias("head"))
    every = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("head").over(every), F.min("head").over(Window.partitionBy())).alias("head"))
    own = F.lead("pair_id").over(Window.partitionBy("range").orderBy("pair_id"))
    return dealt.withColumn("own", own).join(F.broadcast(heads), "range").select("pair_id", F.coalesce("own", "head").alias("next_id"))


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) of the query: see the module's text."""
    rows = _turns(conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text"))
    finals = rows.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last")).select("pair_id", F.col("last.turn").alias("last"), F.col("last.text").alias("reply"))
    follows = next_ids(finals.select("pair_id")).where("next_id <> pair_id")
    others = finals.select("pair_id", "last").join(follows, "pair_id").join(finals.select(F.col("pair_id").alias("next_id"), F.col("reply").alias("other")), "next_id").drop("next_id")
    # rows meet the reply by (pair, block), as a pair may hold a third of them
    blocks = rows.select("pair_id", "block").distinct().join(others, "pair_id").withColumn("other", F.when(F.col("block") == F.shiftright("last", 10), F.col("other")))
    both = rows.join(blocks, ["pair_id", "block"]).where(F.col("turn") <= F.col("last"))
    swapped = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.col("other")).otherwise(F.col("text"))
    tidy = F.when(F.col("turn") != NO_TURN, F.col("turn")).alias("turn")
    return both.select("pair_id", tidy, "role", "text"), both.select("pair_id", tidy, "role", swapped.alias("text"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(format_preferences(*swapped_replies(table(spark, sf_dir, "conversations"))))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT pair_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY pair_id),
f AS (SELECT l.pair_id, l.last, max(t.text) AS reply FROM l JOIN t ON t.pair_id = l.pair_id AND t.turn = l.last AND t.role = 'assistant' GROUP BY l.pair_id, l.last),
o AS (SELECT pair_id, last, coalesce(lead(reply) OVER w, first_value(reply) OVER w) AS other FROM f WHERE (SELECT count(*) FROM f) > 1 WINDOW w AS (ORDER BY pair_id)),
b AS (SELECT t.*, CASE WHEN t.turn = o.last AND role = 'assistant' THEN other ELSE text END AS swapped FROM t JOIN o ON o.pair_id = t.pair_id WHERE t.turn <= o.last),
s AS (SELECT DISTINCT 0 AS side, pair_id, turn, role, text FROM b UNION ALL SELECT DISTINCT 1, pair_id, turn, role, swapped FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY pair_id, turn, side ORDER BY role, text) AS place FROM s),
c AS (SELECT pair_id, turn, place, count(*) AS n, min(role) = max(role) AND min(text) = max(text) AS same FROM p GROUP BY pair_id, turn, place),
d AS (SELECT pair_id, min(turn * 1000000 + place) FILTER (WHERE NOT same OR n < 2) AS first_ FROM c GROUP BY pair_id),
x AS (SELECT p.*, CASE WHEN first_ IS NULL OR p.turn * 1000000 + p.place < first_ THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part,
  '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered FROM p JOIN d ON d.pair_id = p.pair_id),
y AS (SELECT *, floor(turn / 1024.0)::BIGINT AS block, part <> 'prompt' AND role = 'assistant' AS in_loss FROM x WHERE NOT (part = 'prompt' AND side = 1)),
z AS (SELECT *, (coalesce(sum(strlen(rendered)) OVER (PARTITION BY pair_id, block ORDER BY turn, place, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1048576)::BIGINT AS piece FROM y),
e AS (SELECT *, (sum(length(rendered)) OVER (PARTITION BY pair_id, block, piece, part ORDER BY turn, place ROWS UNBOUNDED PRECEDING))::BIGINT AS end_ FROM z),
g AS (SELECT *, (end_ - length(rendered)) || ':' || end_ AS span FROM e)
SELECT pair_id, block, piece,
  coalesce(string_agg(rendered, '' ORDER BY turn, place) FILTER (WHERE part = 'prompt'), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY turn, place) FILTER (WHERE part = 'chosen'), '') AS chosen,
  coalesce(string_agg(rendered, '' ORDER BY turn, place) FILTER (WHERE part = 'rejected'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn, place) FILTER (WHERE part = 'chosen' AND in_loss), '') AS chosen_loss,
  coalesce(string_agg(span, ',' ORDER BY turn, place) FILTER (WHERE part = 'rejected' AND in_loss), '') AS rejected_loss
FROM g GROUP BY pair_id, block, piece
"""
