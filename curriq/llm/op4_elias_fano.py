"""Token-id output: one array of ids per shard, with document boundaries and doc_ids as Elias-Fano sequences.

A shard is one binary value in a Parquet table in the shared folder (any store that Spark writes will do, and a lost
executor's shard is written again by Spark's commit protocol). Its layout, little-endian:

    magic 'EFTK' | id width in bytes u8 | 3 unused | documents n u64 | null doc_ids u64 | first doc_id i64 | ids m u64
    | boundaries, a sequence | doc_ids less the first, a sequence | ids, m x id width

    sequence: values n u64 | last value u64 | low bits u8 | 7 unused | low parts, n x low bits, packed | upper parts, unary, packed

Boundary i is the number of ids up to and with document i. Its lowest bits are stored as they are, its upper part as a
one bit at place upper + i of a bit string with n ones and at most m >> low zeros: about 2 + log2(m/n) bits for each
document. `select(i)` finds that one bit by a rank over 512-bit blocks, and `block(i, count)` reads on from there; readers
go through a shard in blocks of READ_DOCS documents, and no table of 64-bit offsets is stored or built.

Null texts count as empty, and so hold the end id alone; rows are in order of doc_id, nulls first, ties by text.
Columns other than doc_id and text are not read. An empty table gives no shard and no row.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curriq.llm.common import cut, keep_one, released, shared_dir, spread, table

END_ID = 2
#: Ids of a shard: it is closed with the document that reaches this number.
SHARD_IDS = 4 << 20
#: Distinct pieces of text whose ids a Python worker keeps at once, about 40 bytes each; beyond, it starts anew.
STORE_PIECES = 250_000
#: Bytes of text that are encoded at once; a longer document makes a batch of its own.
ENCODE_BYTES = 2 << 20
#: Documents of a shard that a reader decodes at once, and values that a writer packs at once.
READ_DOCS, PACK_VALUES = 4096, 1 << 16

#: White space as the tokenizer's pattern sees it.
WHITE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HEADER = struct.Struct("<4sB3xQQqQ")
SEQUENCE = struct.Struct("<QQB7x")


# ---- Elias-Fano ------------------------------------------------------------------------------------------------


def pack_sequence(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of unsigned 64-bit numbers."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    lows = []
    for k in range(0, n if low else 0, PACK_VALUES):  # whole bytes, as PACK_VALUES is a multiple of 8
        bits = np.unpackbits(values[k : k + PACK_VALUES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lows.append(np.packbits(bits[:, :low].ravel(), bitorder="little").tobytes())
    upper = np.zeros((top >> low) + n + 1 if n else 0, dtype=np.uint8)
    upper[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    return b"".join([SEQUENCE.pack(n, top, low), *lows, np.packbits(upper, bitorder="little").tobytes()])


class Sequence:
    """A packed sequence read in place: select(i) is its i-th value, block(i, count) that one and those after it."""

    def __init__(self, raw: np.ndarray):
        self.n, top, self.low = SEQUENCE.unpack_from(raw[: SEQUENCE.size])
        a = SEQUENCE.size + (self.n * self.low + 7) // 8
        self.end = a + ((top >> self.low) + self.n + 1 + 7) // 8 if self.n else a
        self._lows, self._upper = raw[SEQUENCE.size : a], raw[a : self.end]
        ones = np.add.reduceat(np.bitwise_count(self._upper).astype(np.int64), np.arange(0, len(self._upper), 64)) if self.n else np.zeros(0, np.int64)
        self._ranks = np.concatenate([[0], np.cumsum(ones)])  # one number for each 512 bits

    def select(self, i: int) -> int:
        return int(self.block(i, 1)[0])

    def block(self, i: int, count: int) -> np.ndarray:
        """Values i to i + count - 1, fewer at the end."""
        count = min(count, self.n - i)
        if count <= 0:
            return np.zeros(0, dtype=np.uint64)
        first, last = np.searchsorted(self._ranks, [i, i + count - 1], side="right") - 1
        bits = np.unpackbits(self._upper[first * 64 : (last + 1) * 64], bitorder="little")
        places = np.flatnonzero(bits)[i - self._ranks[first] :][:count] + first * 512
        value = (places - np.arange(i, i + count)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            start, stop = i * self.low, (i + count) * self.low
            span = np.unpackbits(self._lows[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :][: stop - start]
            wide = np.zeros((count, 64), dtype=np.uint8)
            wide[:, : self.low] = span.reshape(count, self.low)
            value |= np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()
        return value


def pack_shard(documents: list[np.ndarray], doc_ids: list[int | None], width: int) -> bytes:
    """documents in order of doc_ids, nulls first."""
    ends = np.cumsum([len(d) for d in documents], dtype=np.uint64)
    known = np.array([i for i in doc_ids if i is not None], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    numbers = known.view(np.uint64) - np.array(base, dtype=np.int64).view(np.uint64)
    ids = np.concatenate(documents).astype(f"<u{width}").tobytes() if documents else b""
    head = HEADER.pack(b"EFTK", width, len(ends), len(doc_ids) - len(known), base, int(ends[-1]) if len(ends) else 0)
    return b"".join([head, pack_sequence(ends), pack_sequence(numbers), ids])


class Shard:
    """A shard's bytes, read in place: document(i) gives its ids."""

    def __init__(self, data: bytes):
        magic, width, self.n, self.nulls, self.base, m = HEADER.unpack_from(data)
        if magic != b"EFTK":
            raise ValueError("not a shard of token ids")
        raw = np.frombuffer(data, dtype=np.uint8, offset=HEADER.size)
        self.boundaries = Sequence(raw)
        self.numbers = Sequence(raw[self.boundaries.end :])
        self.ids = np.frombuffer(data, dtype=f"<u{width}", offset=HEADER.size + self.boundaries.end + self.numbers.end, count=m)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.boundaries.select(i - 1) if i else 0 : self.boundaries.select(i)]

    def doc_ids(self, i: int, count: int) -> list[int | None]:
        """doc_ids of documents i to i + count - 1."""
        count = min(count, self.n - i)
        nulls = min(max(self.nulls - i, 0), count)
        known = self.numbers.block(i + nulls - self.nulls, count - nulls) + np.array(self.base, dtype=np.int64).view(np.uint64)
        return [None] * nulls + known.view(np.int64).tolist()


# ---- Tokenizing ------------------------------------------------------------------------------------------------


class Store:
    """Ids by piece of text, in flat arrays; a lookup of many pieces is one hash probe in Arrow."""

    def __init__(self, dtype: np.dtype):
        self.keys = pa.array([], pa.large_string())
        self.ids, self.sizes = np.zeros(0, dtype=dtype), np.zeros(0, dtype=np.int32)

    def find(self, pieces: pa.Array, learn) -> np.ndarray:
        """Places of pieces; those that aren't here yet are learnt: learn(pieces) gives (flat ids, sizes)."""
        if len(self.keys) + len(pieces) > STORE_PIECES:
            self.__init__(self.ids.dtype)
        at = pc.index_in(pieces, self.keys)
        if at.null_count:
            new = pieces.filter(at.is_null())
            ids, sizes = learn(new)
            first = len(self.keys)
            self.keys = pa.concat_arrays([self.keys, new])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes.astype(np.int32)])
            out = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            out[out < 0] = first + np.arange(len(new))
            return out
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at these places one after another, and their sizes."""
        starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        return spans(self.ids, starts[at], self.sizes[at])


def spans(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start : start + size] of all spans one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    kind = np.int32 if max(len(values), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
    place = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    place += np.arange(len(place), dtype=kind)
    return values[place], sizes


class PieceTokenizer:
    """Ids of whole texts from the tokenizers library, each distinct space-separated piece encoded once.

    A byte-level pattern always breaks before a space unless that space stands inside or at the end of a longer run of
    white space, so a text's ids are its pieces' ids in order. Texts with such runs, or with an added token's text, are
    encoded whole. Pieces of letters with a closing mark, or several such across line ends, are put together from words.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)  # the same vocabulary, held once
        # words of letters only are one unit of the pattern already: joined by NUL they need no pattern
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\0", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = "|".join([f"{WHITE} {WHITE}", f"{WHITE} $", *added])
        self.pieces, self.words = Store(self.dtype), Store(self.dtype)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=self.dtype, count=int(sizes.sum())), sizes

    def _learn_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """words: letters with at most a space before them, or one mark."""
        words, ids, sizes = words.to_pylist(), [], []
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            encoding = self.bare.encode("\0".join(some), add_special_tokens=False)
            ids.append(np.array(encoding.ids, dtype=self.dtype))
            sizes.append(np.bincount(np.array(encoding.word_ids, dtype=np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each piece as a row of up to four words, or whole."""
        n = len(pieces)
        parts, owners = [], []

        def simple(some: pa.Array, at: np.ndarray, order: int) -> np.ndarray:
            """Take these as letters with at most one closing mark; true where that holds."""
            core = pc.utf8_rtrim(some, ",.")
            length, inner = pc.binary_length(some).to_numpy(), pc.binary_length(core).to_numpy()
            fits = pc.utf8_is_alpha(pc.utf8_ltrim(pc.utf8_slice_codeunits(core, 0, 1), " ")).to_numpy(zero_copy_only=False) | pc.equal(pc.utf8_slice_codeunits(core, 0, 1), " ").to_numpy(zero_copy_only=False)
            fits &= pc.utf8_is_alpha(pc.if_else(pc.starts_with(core, " "), pc.utf8_slice_codeunits(core, 1), core)).to_numpy(zero_copy_only=False) & (length - inner <= 1)
            marked = fits & (length > inner)
            parts.extend([core.filter(pa.array(fits)), pc.utf8_slice_codeunits(some.filter(pa.array(marked)), -1)])
            owners.extend([at[fits] * 8 + order, at[marked] * 8 + order + 1])
            return fits

        at = np.arange(n)
        done = simple(pieces, at, 0)
        left = at[~done]
        if len(left):  # two pieces across one line end
            halves = pc.split_pattern(pieces.take(pa.array(left)), "\n")
            two = pc.equal(pc.list_value_length(halves), 2).to_numpy(zero_copy_only=False)
            both, lines = halves.filter(pa.array(two)), left[two]
            first, second = pc.list_element(both, 0), pc.list_element(both, 1)
            fits = simple(first, lines, 0) & simple(second, lines, 3)
            good = lines[fits]
            done[good] = True
            parts.append(pa.array(["\n"] * len(good), pa.large_string()))
            owners.append(good * 8 + 2)
        rest = at[~done]
        words = pa.concat_arrays([p.cast(pa.large_string()) for p in parts])
        owner = np.concatenate(owners)
        keep = done[owner // 8]  # not the one half of a piece whose other half doesn't fit
        words, owner = words.filter(pa.array(keep)), owner[keep]
        coded = words.dictionary_encode()
        found = self.words.find(coded.dictionary, self._learn_words)[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        ids, sizes = self.words.gather(found[order])
        total = np.bincount(owner[order] // 8, weights=sizes, minlength=n).astype(np.int64)
        if len(rest):
            own, own_sizes = self._whole(pieces.take(pa.array(rest)).to_pylist())
            starts = np.zeros(n, dtype=np.int64)
            starts[done] = np.cumsum(total[done]) - total[done]
            starts[rest] = len(ids) + np.cumsum(own_sizes) - own_sizes
            total[rest] = own_sizes
            return spans(np.concatenate([ids, own]), starts, total)
        return ids, total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, without end ids, and each text's number of ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~whole))
        lengths = np.zeros(len(texts), dtype=np.int64)
        ids = np.zeros(0, dtype=self.dtype)
        if len(plain):
            lists = pc.split_pattern(plain, " ")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            coded = lists.flatten().dictionary_encode()
            codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            heads, back = np.unique(codes[offsets[:-1]], return_inverse=True)  # pieces that begin a text have no space
            codes[offsets[:-1]] = len(distinct) + back
            both = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar("", pa.large_string()), distinct, pa.scalar(" ", pa.large_string())), distinct.take(pa.array(heads))]).dictionary_encode()
            at = self.pieces.find(both.dictionary, self._learn_pieces)[both.indices.to_numpy(zero_copy_only=False)]
            ids, sizes = self.pieces.gather(at[codes])
            lengths[~whole] = np.diff(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[offsets])
        if whole.any():
            own, own_sizes = self._whole(texts.filter(pa.array(whole)).to_pylist())
            starts = np.zeros(len(texts), dtype=np.int64)
            starts[~whole] = np.cumsum(lengths[~whole]) - lengths[~whole]
            starts[whole] = len(ids) + np.cumsum(own_sizes) - own_sizes
            lengths[whole] = own_sizes
            ids, _ = spans(np.concatenate([ids, own]), starts, lengths)
        return ids, lengths


def tokenizer(path: str) -> PieceTokenizer:
    return keep_one("op4", path, lambda: PieceTokenizer(path))


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have limit bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
            held = []
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# ---- The operator ----------------------------------------------------------------------------------------------

SHARDS = "part int, shard int, n_docs long, n_ids long, data binary"


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode docs (doc_id, text) and write shards in order of doc_id; returns the table of shards as written.

    Ranges of doc_id are dealt to tasks by Spark's range partitioning; a task's rows are sorted by Spark, so it holds one
    batch of texts and one open shard at a time.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    @released
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        t = tokenizer(path)
        if not 0 <= end_id < 1 << 8 * t.dtype.itemsize:
            raise ValueError(f"the end id {end_id} doesn't fit {t.dtype.itemsize} bytes")
        end = np.array([end_id], dtype=t.dtype)
        open_docs: list[np.ndarray] = []
        open_ids: list[int | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(open_docs)], pa.int64()),
                "n_ids": pa.array([held], pa.int64()), "data": pa.array([pack_shard(open_docs, open_ids, t.dtype.itemsize)], pa.binary()),
            })

        for batch in gathered(batches, ENCODE_BYTES):
            ids, lengths = t.encode(batch.column(1))
            ends = np.cumsum(lengths)
            for doc_id, a, b in zip(batch.column(0).to_pylist(), ends - lengths, ends, strict=True):
                open_docs.append(np.concatenate([ids[a:b], end]))
                open_ids.append(doc_id)
                held += int(b - a) + 1
                if held >= shard_ids:
                    yield close()
                    shard, held = shard + 1, 0
                    open_docs.clear()
                    open_ids.clear()
            pa.default_memory_pool().release_unused()
        if open_docs:
            yield close()

    return cut(ordered.mapInArrow(encode, SHARDS), folder, "shards")


DIGEST = "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long"


def read_shards(shards: DataFrame) -> DataFrame:
    """One row for each document of the shards: doc_id, start, n_tokens, ids_crc32 (of its ids as unsigned 32-bit)."""
    # running sums in two levels: over the tasks that wrote, and over each one's shards
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier(Window.orderBy("part")).alias("part_start"))
    starts = shards.select("part", "shard", earlier(Window.partitionBy("part").orderBy("shard")).alias("shard_start")).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("before"))

    @released
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, number, shard = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), Shard(batch.column(2)[k].as_py())
                before = 0
                for i in range(0, shard.n, READ_DOCS):
                    ends = shard.boundaries.block(i, READ_DOCS).astype(np.int64)
                    starts = np.concatenate([[before], ends[:-1]])
                    wide = memoryview(shard.ids[before : ends[-1]].astype("<u4")).cast("B")
                    crcs = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip((starts - before).tolist(), (ends - before).tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array(np.full(len(ends), part, np.int32)), "shard": pa.array(np.full(len(ends), number, np.int32)), "doc_id": pa.array(shard.doc_ids(i, READ_DOCS), pa.int64()),
                        "start": pa.array(starts), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crcs, pa.int64()),
                    })
                    before = int(ends[-1])

    rows = spread(shards.select("part", "shard", "data")).mapInArrow(digest, DIGEST)
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write docs as shards in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    return read_shards(write_shards(docs, shared_dir(docs.sparkSession), path, end_id, shard_ids))


def op4_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
