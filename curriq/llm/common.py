"""What the operators of this subpackage share: table reads, durable cuts of lineage, and word hashing in numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one numpy pass takes; longer documents make a pass of their own.
CHUNK_CHARS = 1 << 18
SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Keep Arrow batches small, so that a worker's memory depends on a batch's bytes and not on its rows."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset on one machine (tests), under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="curriq-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/curriq-{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: later jobs restart from files that outlive executors."""
    path = f"{folder}/{name}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def forget(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete cuts that no later plan reads."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucket_of(column: str, modulus: int):
    """crc32 of an integer id's text, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) with at most limit characters together, or one longer text alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > limit:
            yield start, [t or "" for t in texts[start:i]]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, [t or "" for t in texts[start:]]


def give_back() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


_held: dict[tuple, object] = {}


def keep_one(operator: str, key, make: Callable):
    """What a Python worker keeps between tasks, made once. Spark hands workers from stage to stage, so a worker holds one
    such thing at a time: another operator's tables, index or tokenizer goes when the next one is made."""
    if (operator, key) not in _held:
        _held.clear()
        give_back()
        _held[operator, key] = make()
        give_back()  # what making it took
    return _held[operator, key]


def released(task: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back at its end."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            _powers.clear()
            give_back()

    return run


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


@lru_cache(maxsize=1)
def _word_bytes() -> np.ndarray:
    """Which bytes belong to words: ASCII letters and digits, and all bytes of non-ASCII characters."""
    keep = np.zeros(256, dtype=bool)
    for low, high in ((48, 58), (97, 123), (128, 256)):
        keep[low:high] = True
    return keep


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, n at least."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and offsets: words of text i are [offsets[i], offsets[i+1]).

    Words are maximal runs of ASCII letters, digits and non-ASCII characters of the lower-cased text.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = _word_bytes()[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    borders = np.cumsum([0] + [len(r) + 1 for r in raw])
    return hashes, np.searchsorted(starts, borders)


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of the k words from each position on; positions near the end are cut off."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += words[j : j + n]
    return mix(out)


def text_shingles(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts, and each one's text index; a text of 1 to k-1 words has one shingle of all its words."""
    words, offsets = word_hashes(texts)
    count = np.diff(offsets)
    owner = np.repeat(np.arange(len(texts)), count)
    all_shingles = shingle_hashes(words, k)
    inside = owner[: len(all_shingles)] == owner[k - 1 :] if len(all_shingles) else np.zeros(0, dtype=bool)
    shingles, owners = all_shingles[inside], owner[: len(all_shingles)][inside]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([shingle_hashes(words[offsets[i] : offsets[i + 1]], int(count[i]))[0] for i in short], dtype=np.uint64)
        shingles, owners = np.concatenate([shingles, extra]), np.concatenate([owners, short])
    return shingles, owners
