"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; bytes.split() without arguments splits at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table may be broadcast. Callers check the count first.
BROADCAST_ROWS = 200_000
#: Words whose hashes a Python worker remembers at a time.
MEMO_WORDS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where the session names none (local tests only)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back. This cuts the lineage; lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows that it has few enough rows. Call it on stored tables."""
    return F.broadcast(df) if df.count() <= limit else df


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Actions within it send Python workers Arrow batches of about this size at most, of one row at least."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def same_row(left: Column, right: Column) -> Column:
    """Equality for join keys under which nulls are equal too."""
    return left.eqNullSafe(right)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """Signed 64-bit hash of each word (bytes); remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        value -= (value >> 63) << 64
        self[word] = value
        return value


def word_hashes(text: str | None, memo: WordHashes, lower: bool) -> np.ndarray:
    """Hashes of the words of a text, in order."""
    if not text:
        return np.empty(0, np.int64)
    raw = text.encode("utf-8", "surrogatepass")
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def mixed(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (uint64 in and out)."""
    x = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash (uint64) of each run of k words; with fewer words, one hash of the whole sequence, or none of nothing."""
    k = min(k, len(words)) if len(words) else k
    if len(words) < k:
        return np.empty(0, np.uint64)
    words = words.view(np.uint64)
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(_MULTIPLIERS[0]) + words[i : len(words) - k + 1 + i])
    return out


def slices(frames: Iterator, rows: int) -> Iterator:
    """Smaller pandas frames, so that long texts don't add up."""
    for frame in frames:
        for start in range(0, len(frame), rows):
            yield frame.iloc[start : start + rows]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as bytes; the first is ascending and kept as differences. Bytes of equal weight lie together."""
    first = np.diff(arrays[0].astype(np.int64), prepend=0)
    planes = [x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (first, *arrays[1:]) if len(x)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(data: bytes, types: list[str]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = len(raw) // sum(np.dtype(t).itemsize for t in types), 0, []
    for t in types:
        wide = np.dtype(t).itemsize
        planes = np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t) if n else np.empty(0, t))
        at += n * wide
    out[0] = np.cumsum(out[0])
    return out
