"""Best-fit packing by minimum bin slack.

Only piece lengths matter for a packing, and there are at most as many lengths as a sequence has
places. So the lengths' counts are planned on the driver (a table bounded by the capacity, whatever
the corpus), and every piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, small_batches, stored
from .token_ids import encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length that are ranked together at least; of a length with n rows, about the root of n.
ROWS_PER_SALT = 500


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, uses) of the fullest combination that fits; longer pieces are preferred among equals."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left:
            k = min(block, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, block = left - k, block * 2
        if reach >> room & 1:
            break
    target, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> target & 1:
            used[length] = used.get(length, 0) + k
            target -= length * k
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, uses)] and how many sequences have each.

    Each bin gets the longest piece left and the fullest combination for the rest of its room. The
    same bin is repeated as long as its pieces last, which is what packing bin by bin would do.
    """
    left, out = {x: n for x, n in counts.items() if n}, []
    while left:
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        pattern = dict(fullest(rest, capacity - top))
        pattern[top] = pattern.get(top, 0) + 1
        times = min(left[x] // n for x, n in pattern.items())
        out.append((sorted(pattern.items(), reverse=True), times))
        for x, n in pattern.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


class Places:
    """Sequence and offset of the r-th piece of a length."""

    def __init__(self, patterns: list[tuple[list[tuple[int, int]], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        seen: dict[int, int] = {}
        sequence = 0
        for pattern, times in patterns:
            offset = 0
            for length, uses in pattern:
                first = seen.get(length, 0)
                rows.setdefault(length, []).append((first, uses, sequence, offset))
                seen[length] = first + uses * times
                offset += length * uses
            sequence += times
        self.sequences = sequence
        self.rows = {x: np.array(v, dtype=np.int64).T for x, v in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        for x in np.unique(length):
            first, uses, base, offset = self.rows[int(x)]
            at = length == x
            k = np.searchsorted(first, rank[at], side="right") - 1
            j = rank[at] - first[k]
            seq[at] = base[k] + j // uses[k]
            off[at] = offset[k] + (j % uses[k]) * x
        return seq, off


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut from the back so that only the first piece is shorter.

    Null texts are empty (one piece, the end id). Repeated rows are documents of their own; a null doc_id stays null.
    """

    @frugal
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        with encoder(tokenizer_path) as enc:
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
                out: list[tuple] = []
                for key, ids in zip(keys, enc.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    a, b, piece = 0, (n - 1) % capacity + 1, 0
                    while a < n:
                        out.append((key, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                        a, b, piece = b, b + capacity, piece + 1
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(pieces, PIECE_SCHEMA)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset: gapless from 0 in each sequence, no sequence over the capacity.

    An empty table gives an empty result. pieces is stored once, so that ranks stay what they are if
    an executor is lost.
    """
    pieces = stored(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = pieces.sparkSession
    salts = [(x, -(-n // max(ROWS_PER_SALT, isqrt(n)))) for x, n in counts.items()]  # at most a row for each length
    dealt = F.broadcast(spark.createDataFrame(salts, "__length long, __salts long"))
    places = spark.sparkContext.broadcast(Places(plan(counts, capacity)))
    salted = pieces.join(dealt, F.col("length") == F.col("__length"))
    salted = salted.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("__salts"))).drop("__length", "__salts")
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("__in", F.row_number().over(order)).join(sizes, ["length", "__salt"])
    ranked = ranked.select(*pieces.columns, (F.col("__before") + F.col("__in") - 1).alias("__rank"))

    @frugal
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "__rank"))
            seq, off = places.value.find(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(off)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(placed, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of cut_pieces with the places of pack: see there for nulls, repeated rows and empty tables."""
    small_batches(docs.sparkSession)
    return pack(cut_pieces(docs, tokenizer_path, capacity, end_id), capacity)
