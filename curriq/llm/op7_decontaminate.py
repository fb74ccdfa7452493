"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Every window of a document that has as many words as a benchmark item gets a 64-bit SimHash of its shingles, weighted by
multiplicity, unless fewer than 8/9 of its shingles occur in the benchmark at all (such a window can't reach the
similarity below, so none is lost, and no fingerprint is computed for the bulk of the text). The
fingerprint is cut into 4 blocks of 16 bits. Two fingerprints within a distance of 18 agree to within 4 bits in at least
one block, so a table from block values to the items within 4 bits of them finds all items within 18. Each candidate is
then verified by the exact weighted Jaccard similarity (sum of minima over sum of maxima) of the shingle multisets: a
document is contaminated by an item if one of its windows has 0.8 or more.

A document of fewer words than an item is one window as a whole. Such windows are few and short, so the overlaps of those
that have enough known shingles are counted exactly by way of an inverted table of the items' shingles, without fingerprints.

At a similarity of 0.8 fingerprints of equal windows differ by 9.7 bits on average with a deviation of 2.9, so the radius
loses about 0.2 % of windows at the threshold itself and none of exact copies.

Items are taken to the workers in blocks of 8,192 items or 8 MB of text (ITEM_BLOCK, ITEM_BYTES); a larger benchmark makes as
many narrow passes.
Items of 1 to 4 words have one shingle of all their words; items and documents without words match nothing, null texts
too. Documents of 1 to 4 words match no longer item. Rows that repeat a doc_id count as one document; null doc_ids
take part as one document of that id. Columns other than doc_id, text and item_id, text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curriq.llm.common import SHINGLE, chunks, keep_one, mix, released, shingle_hashes, spread, table, word_hashes

SIMILARITY = 0.8
RADIUS, BLOCKS, BLOCK_BITS = 18, 4, 16
ITEM_BLOCK, ITEM_BYTES = 8192, 8 << 20
#: Words whose windows are looked at together, so that memory doesn't grow with a text.
SEGMENT = 1 << 17
#: Characters of text that one search takes.
CHUNK = 1 << 20
#: Fingerprints that are looked up together.
LOOKUPS = 4096


def near_masks(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits with at most radius ones."""
    values = np.arange(1 << bits, dtype=np.uint32)
    return values[np.bitwise_count(values) <= radius].astype(np.int64)


def bit_sums(shingles: np.ndarray) -> np.ndarray:
    """Running counts of one bits of the shingles, (n + 1) x 64."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(shingles) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=out[1:])
    return out


def simhash(starts: np.ndarray, size: int, sums: np.ndarray) -> np.ndarray:
    """SimHash of the shingles from each start on, each occurrence with weight 1; sums: their bit_sums."""
    ones = 2 * (sums[starts + size] - sums[starts]) > size
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()


def run_places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def multiset_similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, wx = np.unique(a, return_counts=True)
    y, wy = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(wx[i], wy[j]).sum())
    return low / (len(a) + len(b) - low)


class ItemIndex:
    """The items of one block: shingles by item, and tables from fingerprint blocks to items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.shingles = [], [], []
        for item_id, text in items:
            words, _ = word_hashes([text or ""])
            if len(words):
                self.ids.append(item_id)
                self.words.append(len(words))
                self.shingles.append(shingle_hashes(words, min(SHINGLE, len(words))))
        self.words = np.array(self.words, dtype=np.int64)
        self.prints = np.array([simhash(np.array([0]), len(s), bit_sums(s))[0] for s in self.shingles], dtype=np.uint64)
        # (shingle length, words of a window) of the items; items of fewer than SHINGLE words have shingles of their own
        self.shapes = sorted({(min(SHINGLE, int(n)), int(n)) for n in self.words})
        self.known = {k: np.unique(np.concatenate([s for s, n in zip(self.shingles, self.words, strict=True) if min(SHINGLE, n) == k])) for k in {k for k, _ in self.shapes}}
        self.flags = {k: np.bincount((v >> np.uint64(44)).astype(np.int64), minlength=1 << 20) > 0 for k, v in self.known.items()}
        # (item, count) of each known shingle of SHINGLE words, in the order of known[SHINGLE]
        own = [(i, *np.unique(s, return_counts=True)) for i, (s, n) in enumerate(zip(self.shingles, self.words, strict=True)) if n >= SHINGLE]
        values = np.concatenate([np.zeros(0, np.uint64), *(v for _, v, _ in own)])
        order = np.argsort(values, kind="stable")
        self.holders = np.repeat([i for i, _, _ in own], [len(v) for _, v, _ in own]).astype(np.int64)[order]
        self.held = np.concatenate([np.zeros(0, np.int64), *(c for _, _, c in own)])[order]
        self.holder_starts = np.searchsorted(values[order], self.known.get(SHINGLE, values[:0]), side="left")
        self.holder_ends = np.searchsorted(values[order], self.known.get(SHINGLE, values[:0]), side="right")
        self.masks = masks = near_masks(BLOCK_BITS, RADIUS // BLOCKS // 2)
        self.tables = []
        for block in range(BLOCKS):
            own = (self.prints >> np.uint64(block * BLOCK_BITS)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)
            values = (own[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            counts = np.bincount(values, minlength=1 << BLOCK_BITS)
            self.tables.append((np.cumsum(counts) - counts, counts, np.repeat(np.arange(len(own)), len(masks))[order].astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, item) of all pairs within RADIUS."""
        found = [np.zeros(0, np.int64)]
        for low in range(0, len(prints), LOOKUPS):
            some = prints[low : low + LOOKUPS]
            for block, (starts, counts, items) in enumerate(self.tables):
                own = (some >> np.uint64(block * BLOCK_BITS)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)
                value = (own[:, None] ^ self.masks[None, :]).ravel()
                n = counts[value]
                place = run_places(starts[value], n)
                found.append(np.unique((low + np.repeat(np.arange(len(value)) // len(self.masks), n)) * len(self.ids) + items[place]))
        pairs = np.unique(np.concatenate(found))
        at, item = pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))
        close = np.bitwise_count(prints[at] ^ self.prints[item]) <= RADIUS
        return at[close], item[close]

    def search(self, texts: list[str]) -> list[tuple[int, int, float, int, int]]:
        """(text index, item id, similarity, first word, words) of the best window of each text and item that match."""
        all_words, offsets = word_hashes(texts)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for low in range(0, len(all_words), SEGMENT) if self.shapes else ():  # windows that begin in one segment
            self._search(all_words[low : low + SEGMENT + self.shapes[-1][1] - 1], low, offsets, best)
        self._search_short(all_words, offsets, best)
        return [(d, self.ids[i], *v) for (d, i), v in sorted(best.items())]

    def _search(self, words: np.ndarray, low: int, offsets: np.ndarray, best: dict) -> None:
        """Note in `best` the matches of windows in words, which begin at place `low` of all words."""
        for k, known in self.known.items():
            shingles = shingle_hashes(words, k)
            maybe = np.flatnonzero(self.flags[k][(shingles >> np.uint64(44)).astype(np.int64)]) if len(shingles) else np.zeros(0, np.int64)
            spot = np.minimum(np.searchsorted(known, shingles[maybe]), len(known) - 1)
            hits = maybe[known[spot] == shingles[maybe]]
            if not len(hits):
                continue
            touched = np.zeros(len(shingles) + 1, dtype=np.int64)
            touched[hits + 1] = 1
            touched = np.cumsum(touched)
            # the shingles that windows with hits may hold, as a union of intervals; windows lie in one run of them
            reach = max(n for own_k, n in self.shapes if own_k == k) - k + 1
            cover = np.zeros(len(shingles) + 1, dtype=np.int32)
            np.add.at(cover, np.maximum(hits - reach, 0), 1)
            np.add.at(cover, np.minimum(hits + reach + 1, len(shingles)), -1)
            region = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            content = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles), dtype=np.uint64)])
            sums = bit_sums(shingles[region])
            for n_words in (n for own_k, n in self.shapes if own_k == k):
                size = n_words - k + 1
                around = region[region + n_words <= len(words)]
                # equal sizes: 0.8 needs an overlap of 2 * 0.8 / 1.8 of the size, and so as many hits at least
                around = around[touched[around + size] - touched[around] >= 2 * SIMILARITY / (1 + SIMILARITY) * size - 1e-9]
                around = around[around < SEGMENT]
                owner = np.searchsorted(offsets, around + low, side="right") - 1
                inside = around + low + n_words <= offsets[owner + 1]
                around, owner = around[inside], owner[inside]
                # equal sums of scrambled shingles: equal multisets; the first such window of a text stands for all
                _, first = np.unique(mix(content[around + size] - content[around]) + owner.astype(np.uint64), return_index=True)
                around, owner = around[np.sort(first)], owner[np.sort(first)]
                if not len(around):
                    continue
                at, item = self.near(simhash(np.searchsorted(region, around), size, sums))
                fits = self.words[item] == n_words
                for p, i in zip(at[fits], item[fits], strict=True):
                    s = multiset_similarity(shingles[around[p] : around[p] + size], self.shingles[i])
                    key = (int(owner[p]), int(i))
                    if s >= SIMILARITY and s > best.get(key, (0.0,))[0]:
                        best[key] = (s, int(around[p] + low - offsets[owner[p]]), n_words)

    def _search_short(self, words: np.ndarray, offsets: np.ndarray, best: dict) -> None:
        """Note in `best` the items that match a whole text of fewer words."""
        if SHINGLE not in self.known:
            return
        known, counts = self.known[SHINGLE], np.diff(offsets)
        short = np.flatnonzero((counts >= SHINGLE) & (counts < self.words.max()))
        if not len(short):
            return
        sizes = counts[short] - SHINGLE + 1
        ends = np.cumsum(counts[short])
        at = np.arange(int(ends[-1])) + np.repeat(offsets[short] - (ends - counts[short]), counts[short])
        shingles = shingle_hashes(words[at], SHINGLE)
        spot = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        hits = np.concatenate([[0], np.cumsum(known[spot] == shingles)])
        first = ends - counts[short]
        # longer items: 0.8 needs an overlap of more than 2 * 0.8 / 1.8 of the text's size
        for j in np.flatnonzero(hits[first + sizes] - hits[first] >= 2 * SIMILARITY / (1 + SIMILARITY) * sizes - 1e-9):
            own = slice(first[j], first[j] + sizes[j])
            places, times = np.unique(spot[own][known[spot[own]] == shingles[own]], return_counts=True)
            n = self.holder_ends[places] - self.holder_starts[places]
            some = run_places(self.holder_starts[places], n)
            low = np.bincount(self.holders[some], weights=np.minimum(self.held[some], np.repeat(times, n)), minlength=len(self.words))
            similarity = low / (sizes[j] + self.words - SHINGLE + 1 - low)
            for i in np.flatnonzero((self.words > counts[short[j]]) & (similarity >= SIMILARITY)):
                best[int(short[j]), int(i)] = (float(similarity[i]), 0, int(counts[short[j]]))


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded number and bytes; only one block is on the driver at a time."""
    block: list[tuple[int, str]] = []
    held = 0
    for row in items.where("text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1])
        if len(block) == ITEM_BLOCK or held >= ITEM_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _index(shared) -> ItemIndex:
    return keep_one("op7", shared.id, lambda: ItemIndex(shared.value))


class _Shared:
    """A broadcast of one block of items, with an id that workers know it by."""

    def __init__(self, spark: SparkSession, items: list[tuple[int, str]]):
        self._broadcast = spark.sparkContext.broadcast(items)
        self.id = self._broadcast._jbroadcast.id() if self._broadcast._jbroadcast is not None else 0

    @property
    def value(self):
        return self._broadcast.value


HITS = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item that match: the best window, the first of equals."""
    spark = docs.sparkSession
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    out = None
    for block in item_blocks(items):
        shared = _Shared(spark, block)

        @released
        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found = [(ids[start + d], *rest) for start, some in chunks(batch.column(1).to_pylist(), CHUNK) for d, *rest in index.search(some)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = rows.mapInArrow(search, HITS)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], HITS)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "first_word", "n_words")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.s")).alias("similarity"), "b.first_word", "b.n_words")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones: a narrow pass for each block of items, no shuffle."""
    out, spark, names = docs, docs.sparkSession, docs.columns
    at = names.index("text")
    for block in item_blocks(items):
        shared = _Shared(spark, block)

        @released
        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for start, some in chunks(batch.column(at).to_pylist(), CHUNK):
                    keep[[start + d for d, *_ in index.search(some)]] = False
                yield batch.filter(pa.array(keep))

        out = spread(out).mapInArrow(clean, docs.schema)
    return out


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
