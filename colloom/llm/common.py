"""What the operators share: tables kept in the shared folder, words, rolling hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.array(
    [(0x9E3779B97F4A7C15 * (2 * i + 1) ^ (0xD1B54A32D192ED03 * i)) & (2**64 - 1) | 1 for i in range(64)],
    dtype=np.uint64,
)


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="colloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one, if there is one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or _own_dir()).rstrip("/")


#: Rows and bytes that go to a Python worker at once; Spark's own defaults let a batch of texts take 64 MB on both sides.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES; lower settings stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.match(r"-?\d+", spark.conf.get(key))
        if not 0 < int(now[0] if now else 0) <= most:
            spark.conf.set(key, str(most))


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/colloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, lost executors don't matter."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z lower-cased; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def split_words(text: str | None) -> list[bytes]:
    r"""Lower-cased words [^\x20\x09-\x0D]+ (bytes.split() cuts at these six characters)."""
    return ascii_lower(text).split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound; any word's hash is always the same."""

    def __init__(self, bound: int = 1 << 17):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hash_words(lists: list[list[bytes]], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one list after the other, and where each list starts (one entry more)."""
    ends = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), dtype=np.uint64, count=int(ends[-1]))
    return flat, ends


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(flat: np.ndarray, k: int) -> np.ndarray:
    """Hash of flat[i:i+k] for each i, ends of lists ignored: callers cut those windows out."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += flat[j : j + n] * _ODD[j]
    return mix(out)


def shingle_hashes(flat: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    """For each list its k-word shingles in order of place; a shorter list is one shingle, an empty one none."""
    windows, out = rolling(flat, k), []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= k:
            out.append(windows[a : b - k + 1])
        elif b > a:
            short = (flat[a:b] * _ODD[32 : 32 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value; small integers are split in byte planes, hashes are not."""
    head, body = struct.pack("<B", len(arrays)), []
    for a in arrays:
        planes = a.dtype.itemsize if a.dtype.kind in "iu" and a.dtype.itemsize < 8 else 1
        head += struct.pack("<2sBQ", a.dtype.str[1:].encode(), planes, len(a))
        raw = np.ascontiguousarray(a)
        body.append(raw.view(np.uint8).reshape(-1, planes).T.tobytes() if planes > 1 else raw.tobytes())
    return head + zstandard.ZstdCompressor(level=3).compress(b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    (n,), at = struct.unpack_from("<B", data), 1
    heads = []
    for _ in range(n):
        heads.append(struct.unpack_from("<2sBQ", data, at))
        at += struct.calcsize("<2sBQ")
    body = zstandard.ZstdDecompressor().decompress(data[at:])
    out, at = [], 0
    for kind, planes, length in heads:
        t = np.dtype("<" + kind.decode())
        raw = np.frombuffer(body, np.uint8, length * t.itemsize, at)
        out.append(np.ascontiguousarray(raw.reshape(planes, -1).T).view(t).ravel() if planes > 1 else raw.view(t) if at % 8 == 0 else np.frombuffer(raw.tobytes(), t))
        at += length * t.itemsize
    return out


def starts(*sorted_arrays: np.ndarray) -> np.ndarray:
    """Where a new combination of the (together sorted) arrays starts."""
    n = len(sorted_arrays[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = False
        for a in sorted_arrays:
            new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


#: Bytes that may be broadcast; anything larger is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """df, to be broadcast if its rows have at most BROADCAST_BYTES together; df should be stored or cheap.

    row_bytes: of each row, an expression where rows hold arrays or texts.
    """
    total = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0]
    return F.broadcast(df) if (total or 0) <= BROADCAST_BYTES else df


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps now, and not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def even_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """Integers of which repartition(parts, key) deals each to a partition of its own."""
    ids = spark.range(0, 40 * parts + 200, 1, 1).select(F.col("id").cast("int").alias("key"))
    rows = ids.groupBy(F.pmod(F.hash("key"), F.lit(parts)).alias("at")).agg(F.min("key").alias("key")).collect()
    found = {r["at"]: r["key"] for r in rows}
    return np.array([found.get(i, i) for i in range(parts)], dtype=np.int32)


def release_memory() -> None:
    """Gives freed memory back to the system: workers live on between tasks, and so would their largest need."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, releasing memory when its task ends."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release_memory()

    return run
