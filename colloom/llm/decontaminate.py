r"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of test words. For all patterns of one length m, a table gives each block of
two words the distance that the search may move on without passing an occurrence; a block that is in
no pattern moves it by m - 1 words. Where a block may end a pattern, its bucket lists the test
strings with that end, and word by word comparison confirms an occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches, stored

WINDOW = 13
#: Windows of test words that are broadcast at once (some 60 MB of tables); a larger benchmark is searched in blocks.
BLOCK_WINDOWS = 1 << 17
# Bytes that part words, \x00-\x2F \x3A-\x60 \x7B-\x7F after A-Z were lower-cased.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class WuManber:
    """All patterns have m words; find() gives the places where one starts and its number."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.m = m = len(patterns[0])
        self.block = b = min(2, m)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], int]]] = {}
        for k, p in enumerate(patterns):
            for end in range(b, m + 1):
                key = p[end - b : end]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.buckets.setdefault(p[m - b :], []).append((list(p), k))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        m, shift, buckets, n = self.m, self.shift.get, self.buckets, len(text)
        at, far = m - 1, m - self.block + 1
        while at < n:
            key = (text[at - 1], text[at]) if m > 1 else (text[at],)
            move = shift(key, far)
            if not move:
                start = at - m + 1
                for p, k in buckets[key]:
                    if p[0] == text[start] and text[start : at + 1] == p:
                        yield start, k
                move = 1
            at += move


class Matcher:
    """Windows of (item, words), by length, each with the items that hold it."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        holders: dict[tuple[bytes, ...], list[str]] = {}
        known: dict[bytes, bytes] = {}
        for item, w in items:
            w = [known.setdefault(x, x) for x in w]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                held = holders.setdefault(tuple(w[i : i + window]), [])
                if item is not None and (not held or held[-1] != item):
                    held.append(item)
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for p in holders:
            by_length.setdefault(len(p), []).append(p)
        self.searches = [(WuManber(ps), [holders[p] for p in ps]) for ps in by_length.values()]

    def hits(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Joined stretches [start, end) of hit words, and the ids of items with occurring windows."""
        spans, items = [], set()
        for search, held in self.searches:
            for start, k in search.find(text):
                spans.append((start, start + search.m))
                items.update(held[k])
        return merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """(item, words) of all items, in blocks of at most `most` windows; a longer item is cut, so that no window is lost."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        w, a = words(r["t"]), 0
        while a == 0 or a + window <= len(w):
            n = max(1, min(most - size, len(w) - window + 1 - a))
            block.append((r["i"], w[a : a + n + window - 1]))
            a, size = a + n, size + n
            if size >= most:
                yield block
                block, size = [], 0
    if block:
        yield block


SPANS = "__op4_spans"
ITEMS = "__op4_items"
COUNT = "__op4_words"


def find_test_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with __op4_words (long), __op4_spans (array of [start, end) word places), __op4_items (array of item ids).

    Null and empty texts have no words. A null item_id marks words but names no item; repeated items
    count once. An empty benchmark hits nothing. All other columns of docs, whatever their names,
    stay as they are.
    """
    kept = list(docs.columns)
    small_batches(docs.sparkSession)
    out = docs.withColumns({COUNT: F.lit(0).cast("long"), SPANS: F.lit(None).cast("array<int>"), ITEMS: F.lit(None).cast("array<string>")})
    at = kept.index("text")
    blocks = _blocks(benchmark, window, block_windows)
    rows = next(blocks, [])
    while rows is not None:
        matcher = docs.sparkSession.sparkContext.broadcast(Matcher(rows, window))

        @frugal
        def search(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, all_spans, all_items = [], [], []
                # Texts become Python strings one by one: those of non-Latin characters take several times their bytes.
                for text, spans, items in zip(batch.column(at), *(batch.column(batch.num_columns - i).to_pylist() for i in (2, 1))):
                    w = words(text.as_py())
                    found, names = matcher.value.hits(w)
                    if spans:
                        found = merged([*zip(spans[::2], spans[1::2]), *found])
                    n.append(len(w))
                    all_spans.append([x for s in found for x in s])
                    all_items.append(sorted(names | set(items or ())))
                new = [pa.array(n, pa.int64()), pa.array(all_spans, pa.list_(pa.int32())), pa.array(all_items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *new], names=batch.schema.names)

        out, rows = out.mapInArrow(search, out.schema), next(blocks, None)
        if rows is not None:
            out = stored(out, "op4")
    return out


def _contaminated(n_hit, n_words):
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def _n_hit():
    pairs = F.transform(F.sequence(F.lit(0), F.size(SPANS) - 2, F.lit(2)), lambda i: F.get(SPANS, i + 1) - F.get(SPANS, i))
    return F.when(F.size(SPANS) > 0, F.aggregate(pairs, F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0)).cast("long")


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The counts and digests of every row of docs; nulls, repeated rows and empty tables as in find_test_words."""
    found = find_test_words(docs.select("doc_id", "text"), benchmark)
    hits = found.select("doc_id", F.col(COUNT).alias("n_words"), _n_hit().alias("n_hit"), F.size(ITEMS).cast("long").alias("n_items"), F.sha2(F.array_join(ITEMS, ",").cast("binary"), 256).alias("items_sha256"))
    return hits.withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their own columns; test words in the others are left.

    Null and empty texts stay; repeated rows stay or go together; an empty table gives an empty result.
    """
    found = find_test_words(docs, benchmark)
    return found.filter(~_contaminated(_n_hit(), F.col(COUNT))).select(*(f"`{c}`" for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM items),
places AS (SELECT row_no, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, sizes WHERE len(w) >= m),
found AS (SELECT p.row_no, p.k, p.m, x.item_id FROM places p JOIN items x ON x.m = p.m AND x.win = array_to_string(p.w[p.k:p.k + p.m - 1], ' ')),
hits AS (SELECT row_no, count(DISTINCT j) AS n_hit FROM (SELECT row_no, unnest(range(k, k + m)) AS j FROM (SELECT DISTINCT row_no, k, m FROM found)) GROUP BY row_no),
named AS (SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_no, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (row_no) LEFT JOIN named USING (row_no)
"""
