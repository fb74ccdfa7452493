"""Language identification by a byte convolutional network, trained in numpy and applied to whole texts.

A text's UTF-8 bytes are cut into windows of 256 bytes (the last one padded with spaces). The network embeds bytes (8
numbers each), applies filters of widths 2, 4 and 6 (12 of each), takes each filter's maximum over the window, and maps
the rectified maxima to language logits. A document's logits are the mean over its windows, weighted by their bytes; its
score is the softmax probability of the chosen language.

Every language with a labelled text that isn't empty is learnt. Training is plain stochastic gradient descent with momentum over windows of a sample: for
each of L languages SAMPLE_DOCS // L labelled documents at most, or one where L is larger (lowest hashes of their ids, so the
same ones every time, and texts of under LEAST_BYTES only where a language has no others left), at most SAMPLE_WINDOWS
windows of each, spread evenly. Every language weighs the same in the loss. For use, each filter of width w is w/2 tables over byte pairs, added up: the
same sums as the convolution's, found by lookup.

Only rows with text and lang whose crc32(doc_id as text) mod 4 is not 2 are learnt from. Texts that are null or have no
letter: `und` with score 0. Without any labelled row every text is `und` with score 0. Null doc_ids are held out (false) and not learnt
from. Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curriq.llm.common import bucket_of, keep_one, released, spread, table

WINDOW = 256
WIDTHS = (2, 4, 6)
FILTERS, EMBED = 12, 8
SAMPLE_DOCS, SAMPLE_WINDOWS = 3000, 3
EPOCHS, BATCH = 5, 64
LEAST_BYTES = 16
#: A text whose best language has a lower probability is rejected by the pipeline.
LEAST_SCORE = 0.5


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # for each width: width x EMBED x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray  # (widths x FILTERS) x langs
    shift: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, width/2 tables of byte pairs (first byte low) to sums of filter responses."""
        made = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            single = np.einsum("be,wef->wbf", self.embed, f)
            made.append([(single[j][None, :, :] + single[j + 1][:, None, :]).reshape(65536, FILTERS).astype(np.float32) for j in range(0, w, 2)])
        return made


def windows_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes, owner, bytes in each) of texts; an empty text has no window."""
    counts = np.array([-(-len(r) // WINDOW) for r in raw], dtype=np.int64)
    padded = b"".join(r + b" " * (-len(r) % WINDOW) for r in raw)
    owner = np.repeat(np.arange(len(raw)), counts)
    sizes = np.full(len(owner), WINDOW, dtype=np.int64)
    ends = np.cumsum(counts)
    partial = np.array([len(r) % WINDOW for r in raw], dtype=np.int64)
    some = np.flatnonzero(partial)
    sizes[ends[some] - 1] = partial[some]
    return np.frombuffer(padded, dtype=np.uint8).reshape(-1, WINDOW), owner, sizes


def window_logits(tables: list[list[np.ndarray]], net_biases, out, shift, windows: np.ndarray) -> np.ndarray:
    pairs = windows[:, :-1].astype(np.int32) | (windows[:, 1:].astype(np.int32) << 8)
    pooled = []
    for w, parts, b in zip(WIDTHS, tables, net_biases, strict=True):
        n = WINDOW - w + 1
        total = np.take(parts[0], pairs[:, :n], axis=0)
        for j, part in enumerate(parts[1:], 1):
            total += np.take(part, pairs[:, 2 * j : 2 * j + n], axis=0)
        pooled.append(np.maximum(total.max(axis=1) + b, 0))
    return np.concatenate(pooled, axis=1) @ out + shift


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 7) -> Network:
    """Fit the network to windows (n x WINDOW bytes) with labels (places in langs)."""
    r = np.random.default_rng(seed)
    net = Network(
        langs, r.normal(0, 0.5, (256, EMBED)).astype(np.float32), [r.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32),
    )
    counts = np.bincount(labels, minlength=len(langs))
    weight = (len(labels) / (len(langs) * np.maximum(counts, 1)))[labels].astype(np.float32)
    params = [net.embed, *net.filters, *net.biases, net.out, net.shift]
    speed = [np.zeros_like(p) for p in params]
    steps, step = EPOCHS * -(-len(labels) // BATCH), 0
    for _ in range(EPOCHS):
        order = r.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            x, y, m = windows[pick], labels[pick], len(pick)
            e = net.embed[x]  # m x WINDOW x EMBED
            best, pooled = [], []
            for w, f, b in zip(WIDTHS, net.filters, net.biases, strict=True):
                n = WINDOW - w + 1
                s = sum(e[:, j : j + n] @ f[j] for j in range(w))
                best.append(s.argmax(axis=1))  # m x FILTERS
                pooled.append(s.max(axis=1) + b)
            z = np.concatenate(pooled, axis=1)
            h = np.maximum(z, 0)
            logits = h @ net.out + net.shift
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(m), y] -= 1
            p *= (weight[pick] / m)[:, None]
            back = (p @ net.out.T) * (z > 0)
            grads = [np.zeros_like(net.embed), *(np.zeros_like(f) for f in net.filters), *(np.zeros_like(b) for b in net.biases), h.T @ p, p.sum(axis=0)]
            for i, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[1 + len(WIDTHS) + i] += g.sum(axis=0)
                for j in range(w):  # only the places of the maxima have gradients
                    spot = x[np.arange(m)[:, None], best[i] + j]  # m x FILTERS bytes
                    grads[1 + i][j] += np.einsum("mfe,mf->ef", net.embed[spot], g)
                    np.add.at(grads[0], spot.ravel(), (g[:, :, None] * f[j].T[None, :, :]).reshape(-1, EMBED))
            rate = 0.2 * (1 - step / steps)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for q, v, g in zip(params, speed, grads, strict=True):
                v *= 0.9
                v -= rate * g * min(1.0, 2.0 / (norm + 1e-9))
                q += v
            step += 1
    return net


def fit(docs: DataFrame) -> Network | None:
    """A network trained on a bounded sample of docs (doc_id, text, lang); None without labelled rows."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of("doc_id", 4) != 2))
    # ids first: texts are then read for the sample's rows alone
    ids = rows.where("text <> ''").groupBy("lang", "doc_id").agg(F.min(F.octet_length("text") < LEAST_BYTES).alias("brief")).withColumn("o", F.xxhash64(F.lit(3), "doc_id"))
    counted = [tuple(r) for r in ids.groupBy("lang", "brief").count().collect()]  # two rows for each language at most
    if not counted:
        return None
    sizes = docs.sparkSession.createDataFrame(counted, "lang string, brief boolean, count long")
    each = max(1, SAMPLE_DOCS // len({lang for lang, _, _ in counted}))
    # hashes are uniform: the lowest `each` of a language lie below this bound, and no task gets all rows of a language
    share = F.lit(2.0 * each + 50) / F.col("count")
    low = ids.join(F.broadcast(sizes), ["lang", "brief"]).where(F.col("o") / 2.0**63 <= 2 * share - 1)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("brief", "o", "doc_id"))
    chosen = [tuple(r) for r in low.withColumn("place", place).where(F.col("place") <= each).select("doc_id", "lang").collect()]
    sample = docs.sparkSession.createDataFrame(chosen, "doc_id long, lang string")

    @released
    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, langs, ids, lengths = [], [], [], []
            for doc_id, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, _, sizes = windows_of([text.encode("utf-8", "surrogatepass")])
                for i in sorted({int(i) for i in np.linspace(0, len(found) - 1, SAMPLE_WINDOWS)}) if len(found) else ():
                    parts.append(found[i].tobytes())
                    langs.append(lang)
                    ids.append(doc_id)
                    lengths.append(int(sizes[i]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(parts, pa.binary()), pa.array(lengths, pa.int64())], names=["doc_id", "lang", "bytes", "size"])

    got = spread(rows.join(F.broadcast(sample), ["doc_id", "lang"]).select("doc_id", "text", "lang")).mapInArrow(cut_windows, "doc_id long, lang string, bytes binary, size long").collect()
    full = {r[1] for r in got if r[3] >= LEAST_BYTES}
    got = sorted({(r[0], r[1], r[2]) for r in got if r[3] >= LEAST_BYTES or r[1] not in full})
    if not got:
        return None
    names = sorted({r[1] for r in got})
    place = {n: i for i, n in enumerate(names)}
    windows = np.frombuffer(b"".join(r[2] for r in got), dtype=np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([place[r[1]] for r in got]), names)


def _scores(net: Network, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the best language, its probability) of each text."""
    tables = keep_one("op3", id(net), lambda: (net, net.tables()))[1]  # holds the network too, so that its id stays its own
    sums, total = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts))
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    windows, owner, sizes = windows_of(raw)
    for k in range(0, len(windows), 512):
        part = slice(k, k + 512)
        logits = window_logits(tables, net.biases, net.out, net.shift, windows[part])
        np.add.at(sums, owner[part], logits * sizes[part, None])
        np.add.at(total, owner[part], sizes[part])
    mean = sums / np.maximum(total, 1)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return best, p[np.arange(len(texts)), best]


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("string")).alias("text"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some tens of kilobytes

    @released
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            best, score = _scores(own, texts)
            langs = [own.langs[b] if t is not None else "und" for b, t in zip(best, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(np.where([t is not None for t in texts], score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return spread(rows).mapInArrow(apply, PREDICTED)


def keep_known_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs without those whose language is undetermined or has a lower probability: one narrow pass, no shuffle."""
    net = fit(docs)
    at = docs.columns.index("text")
    if net is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @released
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            score = _scores(own, texts)[1]
            yield batch.filter(pa.array(score >= least))

    return spread(docs.where(F.col("text").rlike(r"\p{L}"))).mapInArrow(keep, docs.schema)


def op3_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
