"""Line dedup: lines that many documents share go from all of them but one, told by keep bitmaps instead of text.

A line's key is the line without white space `[\\x20\\x09-\\x0D]` at its ends and with A-Z lower-cased. Keys of MIN_CHARS code
points or more that MIN_DOCS documents or more hold lose all their lines, except those in the largest doc_id that holds them.

Each such line is a row (128-bit hash of its key, doc_id, line number). Rows are dealt by ranges of hash and then doc_id,
largest first, so the rows of a very frequent line are spread over as many tasks as they need. A task reads its rows in
that order: the first document of a hash is the one that keeps it, and no more than MIN_DOCS - 1 documents' rows are held
until it is known whether the others lose theirs. A hash at a task's border is left open; the task tells in one row how many
documents of it were seen, and these rows, two a task at most, settle the open ones.

`keep_bitmaps` gives a row for each document that loses lines: doc_id, text_key (64-bit hash of its text, which tells apart
texts of one doc_id), n_dropped and keep, a bitmap with a bit for each line up to the last dropped one (`pack_keep`; lines
beyond it stay). `kept_lines` applies bitmaps to documents.

A null text is empty, and an empty text is one empty line. Rows of the same doc_id are one document where documents are
counted; a row without doc_id keeps all its lines and isn't counted. Rows that repeat another lose the same lines.
Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curriq.llm.common import cut, released, shared_dir, spread, table
from curriq.llm.op4_elias_fano import gathered

MIN_CHARS, MIN_DOCS = 40, 5
#: White space at a line's ends.
BLANK = " \t\n\x0b\x0c\r"
#: Bytes of sorted rows that a task settles at once.
BLOCK_BYTES = 4 << 20

LINES = "hi long, lo long, doc_id long, text_key long, line int"
#: kind 0: this line goes; 1: open, as its hash lies at the task's border; 2: what a task saw of such a hash.
SETTLED = "kind int, part int, hi long, lo long, doc_id long, text_key long, line int, docs long, last_doc long"


# ---- Bitmaps ---------------------------------------------------------------------------------------------------


def _varints(numbers: np.ndarray) -> bytes:
    out = bytearray()
    for n in numbers.tolist():
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out)


def pack_keep(dropped: np.ndarray) -> bytes:
    """Bitmap of lines up to the last of `dropped` (distinct, ascending), 1 for kept ones, in the shorter of two forms: a
    byte 0 and the bits, or a byte 1 and the lengths of kept and dropped runs in turn, seven bits a byte, lowest first."""
    n = int(dropped[-1]) + 1 if len(dropped) else 0
    bits = np.ones((n + 7) // 8 * 8, dtype=np.uint8)  # padding counts as kept
    bits[dropped] = 0
    edges = np.flatnonzero(np.diff(np.concatenate([[1], bits[:n], [1]]).astype(np.int8)))
    runs = _varints(np.diff(np.concatenate([[0], edges])))
    plain = np.packbits(bits, bitorder="little").tobytes()
    return b"\1" + runs if len(runs) < len(plain) else b"\0" + plain


def unpack_keep(keep: bytes, n_lines: int) -> np.ndarray:
    """True for each of n_lines lines that stays."""
    out = np.ones(n_lines, dtype=bool)
    if keep[:1] == b"\0":
        bits = np.unpackbits(np.frombuffer(keep, np.uint8, offset=1), bitorder="little")[:n_lines].astype(bool)
    else:
        runs, n, shift = [], 0, 0
        for byte in keep[1:]:
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                runs.append(n)
                n, shift = 0, 0
        bits = np.repeat(np.arange(len(runs)) % 2 == 0, runs)[:n_lines]
    out[: len(bits)] = bits
    return out


# ---- Lines and their hashes ------------------------------------------------------------------------------------


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line whose key has min_chars code points or more."""

    @released
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.split_pattern(pc.fill_null(batch.column(2).cast(pa.large_string()), ""), "\n")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            keys = pc.ascii_trim(lists.flatten(), characters=BLANK)
            long = pc.greater_equal(pc.utf8_length(keys), min_chars)
            at = np.flatnonzero(long.to_numpy(zero_copy_only=False))
            owner = np.searchsorted(offsets, at, side="right") - 1
            words = pc.ascii_lower(keys.filter(long)).cast(pa.large_binary()).to_pylist()
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=">i8").astype(np.int64).reshape(-1, 2)
            rows = pa.array(owner)
            yield pa.RecordBatch.from_pydict({
                "hi": pa.array(digests[:, 0]), "lo": pa.array(digests[:, 1]), "doc_id": batch.column(0).take(rows), "text_key": batch.column(1).take(rows), "line": pa.array((at - offsets[owner]).astype(np.int32)),
            })

    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return spread(known).mapInArrow(lines, LINES)


def text_key():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def settle(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Lines that go, open lines and what is known of their hashes (SETTLED)."""
    order = ["hi", "lo", F.desc("doc_id"), "text_key", "line"]
    names = ("hi", "lo", "doc_id", "text_key", "line")

    @released
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[np.ndarray] | None = None  # rows of the last hash while fewer than min_docs documents of it were seen
        run: dict | None = None  # of the last hash: key, docs, first and last doc, whether the task began with it
        first: dict | None = None

        def rows_of(kind: int, columns: list[np.ndarray], docs=None, last=None) -> pa.RecordBatch:
            n = len(columns[0])
            blank = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_pydict({
                "kind": pa.array(np.full(n, kind, np.int32)), "part": pa.array(np.full(n, part, np.int32)), **{c: pa.array(v) for c, v in zip(names, columns, strict=True)},
                "docs": blank if docs is None else pa.array([docs], pa.int64()), "last_doc": blank if last is None else pa.array([last], pa.int64()),
            })

        def seen(of: dict) -> pa.RecordBatch:
            key = [np.array([of["key"][0]]), np.array([of["key"][1]]), np.array([of["first"]]), np.zeros(1, np.int64), np.zeros(1, np.int32)]
            return rows_of(2, key, of["docs"], of["last"])

        for batch in gathered(batches, BLOCK_BYTES):
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            again = 0
            if held is not None:
                again = len(held[0])
                columns = [np.concatenate([a, b]) for a, b in zip(held, columns, strict=True)]
                held = None
            hi, lo, doc = columns[:3]
            begins = np.ones(len(hi), dtype=bool)
            begins[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            new_doc = begins.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            starts = np.flatnonzero(begins)
            number = np.cumsum(begins) - 1
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            keeper = doc[starts].copy()
            goes_on = run is not None and not again and run["key"] == (hi[0], lo[0])
            if goes_on:
                docs[0] += run["docs"] - (doc[0] == run["last"])
                keeper[0] = run["first"]
            at_border = run is None or (run["border"] and goes_on)
            if run is not None and run["border"] and not goes_on:
                first = run
            goes = (docs >= min_docs)[number] & (doc != keeper[number])
            if at_border:  # the task's first hash stays open
                head = number == 0
                yield rows_of(1, [c[head] for c in columns])
                goes &= ~head
            last = len(starts) - 1
            border = bool(at_border and last == 0)
            if at_border and last > 0:
                first = {"key": (hi[0], lo[0]), "docs": int(docs[0]), "first": int(keeper[0]), "last": int(doc[starts[1] - 1])}
            run = {"key": (hi[-1], lo[-1]), "docs": int(docs[last]), "first": int(keeper[last]), "last": int(doc[-1]), "border": border}
            if not border and docs[last] < min_docs:
                held = [c[starts[last] :] for c in columns]
            if goes.any():
                yield rows_of(0, [c[goes] for c in columns])
        if held is not None:
            yield rows_of(1, held)
        if first is not None:
            yield seen(first)
        if run is not None:
            yield seen(run)

    return spread(lines.repartitionByRange(*order).sortWithinPartitions(*order)).mapInArrow(stream, SETTLED)


def dropped_lines(docs: DataFrame, folder: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, line) of all lines that go."""
    # written first: dealing by ranges reads its input twice
    settled = cut(settle(cut(hashed_lines(docs, min_chars), folder, "lines"), min_docs), folder, "settled")
    pieces = Window.partitionBy("hi", "lo").orderBy("part", F.desc("doc_id"))
    seen = settled.where("kind = 2").select("hi", "lo", "docs", F.col("doc_id").alias("first_doc"), (F.coalesce(F.lag("last_doc").over(pieces) == F.col("doc_id"), F.lit(False))).alias("again"))
    known = seen.groupBy("hi", "lo").agg(F.sum(F.col("docs") - F.col("again").cast("long")).alias("all_docs"), F.max("first_doc").alias("keeper")).where(F.col("all_docs") >= min_docs)
    # two rows for each task of `settle` at most
    opened = settled.where("kind = 1").join(F.broadcast(known), ["hi", "lo"]).where("doc_id <> keeper")
    chosen = ["doc_id", "text_key", "line"]
    return settled.where("kind = 0").select(chosen).unionByName(opened.select(chosen))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_key, n_dropped, keep: a row for each document that loses lines."""
    dropped = dropped_lines(docs, shared_dir(docs.sparkSession), min_chars, min_docs)
    lists = dropped.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line")).alias("lines"))

    @released
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(2)
            flat, offsets = lines.flatten().to_numpy(), lines.offsets.to_numpy() - lines.offsets[0].as_py()
            keep = [pack_keep(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(keep, pa.binary())], ["doc_id", "text_key", "n_dropped", "keep"])

    return spread(lists).mapInArrow(packed, "doc_id long, text_key long, n_dropped long, keep binary")


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, text of the lines that stay."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = own.join(bitmaps.select("doc_id", "text_key", "n_dropped", "keep"), ["doc_id", "text_key"], "left")

    @released
    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            n_lines = pc.add(pc.count_substring(texts, "\n"), 1).cast(pa.int64())
            some = np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False)).tolist()
            if some:
                out = texts.to_pylist()
                for i in some:
                    lines = out[i].split("\n")
                    out[i] = "\n".join([lines[k] for k in np.flatnonzero(unpack_keep(batch.column(3)[i].as_py(), len(lines))).tolist()])
                texts = pa.array(out, pa.large_string() if pa.types.is_large_string(texts.type) else pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_lines, pc.fill_null(batch.column(2), 0), texts], ["doc_id", "n_lines", "n_dropped", "text"])

    return spread(joined.select("doc_id", "text", "n_dropped", "keep")).mapInArrow(applied, "doc_id long, n_lines long, n_dropped long, text string")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kept_lines(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.line, k.place, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS goes FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
