"""Token-id files with Elias-Fano coded document boundaries.

A shard is one binary value: a header, the ids of its documents one after the other (2 or 4 bytes
each, by the vocabulary), the Elias-Fano coded ends of the documents, and the Elias-Fano coded
doc_ids. Shards are rows of a Parquet table, so that Spark's commit protocol covers lost executors
and any store that Spark can write serves.

Elias-Fano keeps of n ascending values below u the low log2(u/n) bits as they are and the rest in
unary, 2 + log2(u/n) bits a value. The place of every 256th one-bit is kept too, so that select
reads a short stretch and no table of 64-bit offsets is needed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, new_table_path, small_batches
from .token_ids import encoder

MAGIC = b"CLMEF001"
SAMPLE = 256
SHARD_IDS = 1 << 20
SHARD_SCHEMA = "part int, seq int, ids_before long, n_docs long, n_ids long, payload binary"
_POP = np.array([bin(x).count("1") for x in range(256)], dtype=np.int64)


class EliasFano:
    """Ascending non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
        bits[places] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def _lows(self, a: int, b: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(b - a, dtype=np.uint64)
        first, last = a * self.low_bits, b * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : -(-last // 8)], bitorder="little")[first % 8 : first % 8 + last - first]
        return (bits.reshape(b - a, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value: from the sampled one-bit before it on, bytes are counted until its own."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := int(_POP[word])) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i << self.low_bits) | int(self._lows(i, i + 1)[0])

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(0, self.n)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data, "<u4", c, at + a + b)
        return cls(n, low_bits, low, high, samples), at + a + b + 4 * c


def write_shard(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """keys ascend, nulls first; ids: each document's packed little-endian unsigned 32-bit ids."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)
    nulls = sum(x is None for x in keys)
    known = keys[nulls:]
    base = known[0] if known else 0
    steps = np.array([x - base for x in known], dtype=np.uint64)
    body = flat.astype(f"<u{width}").tobytes()
    head = MAGIC + struct.pack("<BQQQq", width, len(keys), len(flat), nulls, base)
    return head + body + EliasFano.encode(ends).to_bytes() + EliasFano.encode(steps).to_bytes()


class Shard:
    """Reads one shard; document(i) needs no other document's ids."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        width, self.n_docs, self.n_ids, self.nulls, self.base = struct.unpack_from("<BQQQq", data, 8)
        at = 8 + struct.calcsize("<BQQQq")
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)
        self.ends, at = EliasFano.from_bytes(data, at + width * self.n_ids)
        self.steps, at = EliasFano.from_bytes(data, at)
        if at != len(data) or self.ends.n != self.n_docs or self.steps.n + self.nulls != self.n_docs:
            raise ValueError("broken shard of token ids")

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.steps.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Every text's ids and the end id, in ascending doc_id order (nulls first, equal ids by text), as shards at path."""

    @frugal
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end, part = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        keys: list[int | None] = []
        ids: list[bytes] = []
        size = seq = before = width = 0

        def out() -> pa.RecordBatch:
            row = [[part], [seq], [before], [len(keys)], [size], [write_shard(keys, ids, width)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=["part", "seq", "ids_before", "n_docs", "n_ids", "payload"])

        with encoder(tokenizer_path) as enc:
            width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 65536 else 4
            for batch in batches:
                texts = [x or "" for x in batch.column(1).to_pylist()]
                for key, x in zip(batch.column(0).to_pylist(), enc.encode(texts)):
                    keys.append(key)
                    ids.append(x + end)
                    size += len(ids[-1]) // 4
                    if size >= shard_ids:
                        yield out()
                        seq, before, size = seq + 1, before + size, 0
                        keys, ids = [], []
            if keys:
                yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(shards, SHARD_SCHEMA).write.parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards at path.

    Only one total for each partition of the writer comes to the driver.
    """
    table = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part], at = at, at + n
    starts = spark.sparkContext.broadcast(base)

    @frugal
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(*(batch.column(x).to_pylist() for x in ("part", "ids_before", "payload"))):
                shard = Shard(data)
                steps, ends = shard.steps.all().tolist(), shard.ends.all().astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                keys = [None] * shard.nulls + [shard.base + x for x in steps]
                ids = shard.ids.astype("<u4").tobytes()
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                cols = [pa.array(keys, pa.int64()), pa.array(begins + (starts.value[part] + before)), pa.array(ends - begins), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("part", "ids_before", "payload").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """What read_ids finds in the files of write_ids. Null texts are empty; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    path = new_table_path(docs.sparkSession, "ids")
    write_ids(docs, tokenizer_path, path, end_id)
    return read_ids(docs.sparkSession, path)
