"""Conversation prefix trie: rebuilt conversations merged into one trie, families first.

Conversation c belongs to the family of its base, c - c % 5. It is rebuilt from the first h turns of its base (all if there are
fewer, none if the table hasn't the base) and its own turns after its first h, h = crc32(decimal c) % 9. Each distinct
sequence of first turns is a node; a node's members are the rebuilt conversations that start with it.

1. Turns are numbered. They are dealt by ranges of (conv_id, turn, hash), so a conversation of any length is spread over
   as many tasks as it needs; a task tells in one row where its last conversation stands, and the next task's rows go on
   from there. A number comes with the hash of the conversation's turns so far (two 64-bit lanes of a polynomial over
   md5s), from which that of any rebuilt prefix follows: no text moves after its md5 is taken.
2. The first turns of base and members are cogrouped by base, and each family's small trie is built: a row for each of
   its nodes, dealt by (base, block of 1,024 depths), as a family may hold a third of all turns.
3. Only these combined nodes are shuffled and merged, by (hash, depth).
4. A node with one member stands on a path without branches, so its counts are known at once. The subtrees of nodes with
   several members are summed up by doubling: each round adds the sums of descendants 2^k levels below, for the logarithm
   of the depth in rounds.
5. `ends_sha256` reads a node's conversations in ascending order, in pieces of 65,536 ids.

Rows are in order of `turn` (null first), those with the same turn by the md5 of role and text; rows that repeat another are
turns of their own. Null role and text become empty; rows without conv_id take no part. Remainders are SQL's (a negative
conv_id's is negative or 0). Columns other than these four are not read. An empty table gives no rows, not even the root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curriq.llm.common import cut, forget, released, shared_dir, spread, table
from curriq.llm.op4_elias_fano import gathered

FAMILY, MOST_SHARED = 5, 8
#: Odd bases of the two lanes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
MASK = (1 << 64) - 1
#: Bytes of turns that a task numbers at once; depths of a block of a family; conversation ids of a piece, as a power of 2.
BLOCK_BYTES, DEPTH_BITS, PIECE_BITS = 2 << 20, 10, 16

NUMBERED = "kind int, part int, conv_id long, pos long, k1 long, k2 long, t1 long, t2 long, bytes long"
NODES = "base long, conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, bytes long, ends boolean"


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2**64, by squaring."""
    out, left, square = np.ones(len(exponents), dtype=np.uint64), exponents.astype(np.int64).copy(), base
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] *= np.uint64(square)
        left >>= 1
        square = square * square & MASK
    return out


def numbered_turns(conversations: DataFrame, folder: str) -> DataFrame:
    """conv_id, pos (from 1), k1, k2 (hash of turns up to this one), t1, t2 (the turn's md5), bytes (of its text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.md5(said.cast("binary"))).alias("said"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", F.asc_nulls_first("turn"), "said"]

    @released
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, count, sums = None, 0, [0, 0]  # of the conversation that a batch ended with

        def out(kind: int, *columns) -> pa.RecordBatch:
            n = len(columns[0])
            names = ("conv_id", "pos", "k1", "k2", "t1", "t2", "bytes")
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(n, kind, np.int32)), "part": pa.array(np.full(n, part, np.int32)), **{c: pa.array(v, pa.int64()) for c, v in zip(names, columns, strict=True)}})

        for batch in gathered(batches, BLOCK_BYTES):
            if not batch.num_rows:
                continue
            conv, size = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            turns = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u8").reshape(-1, 2)
            n = len(conv)
            begins = np.ones(n, dtype=bool)
            begins[1:] = conv[1:] != conv[:-1]
            starts = np.flatnonzero(begins)
            own = np.cumsum(begins) - 1
            at = np.arange(n)
            pos = at - starts[own] + 1
            goes_on = last is not None and conv[0] == last
            hashes = []
            for lane in (0, 1):
                up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASES[lane], INVERSES[lane]))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(turns[:, lane] * down[1 : n + 1])])
                value = up[1 : n + 1] * (total[1:] - total[starts[own]])
                if goes_on:
                    head = own == 0
                    value[head] += np.uint64(sums[lane]) * up[pos[head]]
                hashes.append(value)
            if goes_on:
                pos = pos + np.where(own == 0, count, 0)
            last, count, sums = int(conv[-1]), int(pos[-1]), [int(h[-1]) for h in hashes]
            yield out(0, conv, pos, *(h.view(np.int64) for h in hashes), turns[:, 0].astype(np.uint64).view(np.int64), turns[:, 1].astype(np.uint64).view(np.int64), size)
        if last is not None:
            yield out(1, [last], [count], *(np.array([s], np.uint64).view(np.int64) for s in sums), [0], [0], [0])

    dealt = spread(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "said", "bytes"))
    numbered = cut(dealt.mapInArrow(number, NUMBERED), folder, "numbered")
    # one row for each task: where each task's first conversation stands before it
    before: dict[int, tuple[int, int, list[int]]] = {}
    state: tuple[int, int, list[int]] | None = None
    for row in sorted(numbered.where("kind = 1").select("part", "conv_id", "pos", "k1", "k2").collect()):
        own = [row.k1 & MASK, row.k2 & MASK]
        if state is not None:
            before[row.part] = state
        if state is not None and state[0] == row.conv_id:
            own = [(s * pow(b, row.pos, 1 << 64) + o) & MASK for s, b, o in zip(state[2], BASES, own, strict=True)]
            state = (row.conv_id, state[1] + row.pos, own)
        else:
            state = (row.conv_id, row.pos, own)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, pos, k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            pos, lanes = pos.copy(), [k1.view(np.uint64).copy(), k2.view(np.uint64).copy()]
            for p in np.unique(part).tolist():
                if p in before:
                    held, count, sums = before[p]
                    mine = np.flatnonzero((part == p) & (conv == held))
                    for lane in (0, 1):
                        lanes[lane][mine] += np.uint64(sums[lane]) * powers(BASES[lane], pos[mine])
                    pos[mine] += count
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(pos), pa.array(lanes[0].view(np.int64)), pa.array(lanes[1].view(np.int64)), *(batch.column(i) for i in (5, 6, 7))], ["conv_id", "pos", "k1", "k2", "t1", "t2", "bytes"])

    whole = numbered.where("kind = 0").select("part", "conv_id", "pos", "k1", "k2", "t1", "t2", "bytes")
    return whole.mapInArrow(go_on, "conv_id long, pos long, k1 long, k2 long, t1 long, t2 long, bytes long")


def rebuilt_heads(turns: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, base, h, taken (turns from its base), heads (those), n_turns (rebuilt),
    and the hashes a1, a2 of the turns taken and b1, b2 of the turns left out."""
    head = F.struct("pos", "k1", "k2", "t1", "t2", "bytes")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n_own"), F.sort_array(F.collect_list(F.when(F.col("pos") <= MOST_SHARED, head))).alias("own"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1))
    bases = convs.where("conv_id = base").select("base", F.col("own").alias("from_base"))
    both = convs.join(bases, "base", "left")
    taken = F.slice(F.coalesce("from_base", F.slice("own", 1, 0)), F.lit(1), F.col("h").cast("int"))
    both = both.withColumn("heads", taken).withColumn("taken", F.size("heads").cast("long"))
    lane = lambda rows, n, k: F.coalesce(F.try_element_at(F.col(rows), n.cast("int"))[k], F.lit(0).cast("long"))
    at_h, at_taken = F.when(F.col("h") > 0, F.col("h")), F.when(F.col("taken") > 0, F.col("taken"))
    return both.select(
        "conv_id", "base", "h", "heads", "taken", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"),
        *(lane("heads", at_taken, f"k{i}").alias(f"a{i}") for i in (1, 2)), *(lane("own", at_h, f"k{i}").alias(f"b{i}") for i in (1, 2)),
    )


def conversation_nodes(turns: DataFrame) -> DataFrame:
    """A row for each rebuilt conversation and node that it is a member of (NODES)."""
    heads = rebuilt_heads(turns)
    zero = F.lit(0).cast("long")
    root = heads.select("base", "conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("bytes"), (F.col("n_turns") == 0).alias("ends"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the rebuilt prefixes: the turns taken stand where those left out stood."""
        for batch in batches:
            number = {f: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema.names)}
            depth = number["taken"] + number["pos"] - number["h"]
            lanes, parents = [], []
            for i in (1, 2):
                k, a, b, t = (number[f"{c}{i}"].view(np.uint64) for c in "kabt")
                lanes.append(k + (a - b) * powers(BASES[i - 1], number["pos"] - number["h"]))
                parents.append((lanes[-1] - t) * np.uint64(INVERSES[i - 1]))
            columns = [number["base"], number["conv_id"], depth, *(x.view(np.int64) for x in (*lanes, *parents)), number["bytes"], depth == number["n_turns"]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NODE_NAMES)

    moved = turns.join(heads.drop("heads"), "conv_id").where("pos > h").select("base", "conv_id", "pos", "h", "taken", "n_turns", "bytes", *(f"{c}{i}" for i in (1, 2) for c in "kabt"))
    own = spread(moved).mapInArrow(place, NODES)
    numbered = heads.select("base", "conv_id", "n_turns", "heads", F.posexplode("heads").alias("i", "at"))
    above = lambda k: F.when(F.col("i") > 0, F.try_element_at("heads", F.col("i"))[k]).otherwise(zero)
    taken = numbered.select("base", "conv_id", (F.col("i") + 1).cast("long").alias("depth"), "at.k1", "at.k2", above("k1").alias("p1"), above("k2").alias("p2"), "at.bytes", (F.col("i") + 1 == F.col("n_turns")).alias("ends"))
    return root.unionByName(taken).unionByName(own)


NODE_NAMES = ["base", "conv_id", "depth", "k1", "k2", "p1", "p2", "bytes", "ends"]
KEY = ["k1", "k2", "depth"]


def family_tries(rows: DataFrame) -> DataFrame:
    """Nodes of each family's trie: how many of its conversations are members, the smallest, and those that end there."""
    dealt = rows.withColumn("block", F.shiftright("depth", DEPTH_BITS)).repartition("base", "block")
    return dealt.groupBy("base", "block", *KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("bytes").alias("bytes"), F.collect_list(F.when(F.col("ends"), F.col("conv_id"))).alias("ending"),
    )


def subtree_sums(shared: DataFrame, folder: str) -> DataFrame:
    """shared: k1, k2, depth, p1, p2, leaves, saved of nodes whose ancestors are all there; adds up both over subtrees.

    After round k a node's sums cover its descendants less than 2^k levels below, and (p1, p2) is its ancestor 2^k above.
    """
    spark = shared.sparkSession
    rows, step = cut(shared, folder, "subtrees-0"), 1
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    while step <= deepest:
        up = rows.where(F.col("depth") >= step)
        below = up.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - step).alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = up.where(F.col("depth") >= 2 * step).select(*KEY, F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        above = rows.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), (F.col("depth") + step).alias("depth"), F.col("p1").alias("r1"), F.col("p2").alias("r2"))
        hops = further.join(above, ["q1", "q2", "depth"]).select(*KEY, "r1", "r2")
        grown = rows.join(below, KEY, "left").join(hops, KEY, "left").select(
            *KEY, F.col("r1").alias("p1"), F.col("r2").alias("p2"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        rows = cut(grown, folder, f"subtrees-{2 * step}")
        forget(spark, folder, f"subtrees-{step if step > 1 else 0}")
        step *= 2
    return rows.select(*KEY, "leaves", "saved")


def end_digests(family: DataFrame) -> DataFrame:
    """k1, k2, depth, ends_sha256 of nodes at which conversations end."""
    ends = family.select(*KEY, F.explode("ending").alias("conv_id")).withColumn("piece", F.shiftright("conv_id", PIECE_BITS))
    pieces = ends.groupBy(*KEY, "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")

    @released
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        key, running = None, None

        def rows(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([d[0][i] for d in done], pa.int64()) for i in range(3)), pa.array([d[1] for d in done], pa.string())], [*KEY, "ends_sha256"])

        for batch in batches:
            done = []
            for *own, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own == key:
                    running.update(b",")
                else:
                    if key is not None:
                        done.append((key, running.hexdigest()))
                    key, running = own, hashlib.sha256()
                running.update(ids.encode())
            yield rows(done)
        if key is not None:
            yield rows([(key, running.hexdigest())])

    return spread(ordered).mapInArrow(digest, "k1 long, k2 long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    folder = shared_dir(conversations.sparkSession)
    family = cut(family_tries(conversation_nodes(numbered_turns(conversations, folder))), folder, "families")
    merged = family.groupBy(*KEY).agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("bytes").alias("bytes"), F.sum(F.size("ending")).alias("n_ending"),
    )
    nodes = cut(merged, folder, "nodes")
    shared = nodes.where("n_convs > 1")
    # children of shared nodes; one with a single member is a path to one leaf
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    counted = shared.join(children, KEY, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "single": F.coalesce("single", F.lit(0))})
    counted = cut(counted, folder, "shared")
    weights = counted.select(*KEY, "p1", "p2", (F.col("single") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    sums, digests = subtree_sums(weights, folder), end_digests(family)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    tops = counted.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    several = counted.join(sums, KEY).join(digests, KEY, "left").join(tops, ["p1", "p2", "depth"], "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    one = nodes.where("n_convs = 1").join(tops, ["p1", "p2", "depth"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", (1 - F.col("n_ending")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("n_ending") > 0, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    return several.unionByName(one)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 of an id's decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, step: xor(x >> 1, 3988292384 * (x & 1)))))"""

ORACLE_SQL = rf"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c.c, t.pos, t.role, t.text FROM c JOIN t ON t.c = c.base AND t.pos <= c.h UNION ALL SELECT c.c, t.pos + 100, t.role, t.text FROM c JOIN t ON t.c = c.c AND t.pos > c.h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS depth, strlen(text) AS bytes, md5(strlen(role) || ':' || role || text) AS said FROM r),
p AS (SELECT c, depth, bytes, string_agg(said, '') OVER (PARTITION BY c ORDER BY depth) AS node FROM o UNION ALL SELECT c, 0, 0, '' FROM c),
e AS (SELECT c, max(depth) AS depth FROM p GROUP BY c),
n AS (SELECT p.node, p.depth, min(p.c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (WHERE e.depth = p.depth), '')) AS ends_sha256
  FROM p JOIN e ON e.c = p.c GROUP BY p.node, p.depth),
k AS (SELECT n.node, n.depth, count(x.node) AS n_children FROM n LEFT JOIN n x ON x.depth = n.depth + 1 AND left(x.node, (32 * n.depth)::BIGINT) = n.node GROUP BY n.node, n.depth),
s AS (SELECT a.node, a.depth, count(*) FILTER (WHERE kb.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved
  FROM (SELECT DISTINCT x.node, x.depth, y.node AS lower, y.depth AS lower_depth FROM p x JOIN p y ON y.c = x.c AND y.depth >= x.depth) a
  JOIN n b ON b.node = a.lower AND b.depth = a.lower_depth JOIN k kb ON kb.node = b.node AND kb.depth = b.depth GROUP BY a.node, a.depth)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN k ON k.node = n.node AND k.depth = n.depth JOIN s ON s.node = n.node AND s.depth = n.depth
LEFT JOIN n u ON u.depth = n.depth - 1 AND u.node = left(n.node, (32 * (n.depth - 1))::BIGINT)
"""
