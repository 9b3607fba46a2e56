"""Substring dedup: shared k-mer seeds, collinear chains with gap costs, aligned to fuzzy passages.

1. Of every WINDOW neighbouring k-mers of words the smallest hash is a seed, so that any equal run of
   K + WINDOW - 1 words shares one.
2. Each seed is joined with its first place in the corpus (smallest doc_id), never with all others: a
   seed in a million documents makes a million matches. The first places come from an aggregate with
   map-side combine, and the join may be split by Spark where one seed is very common.
3. The matches of a document with one source are chained: a tree over source places holds the best
   chain so far of each place, of matches within MAX_GAP words only; the words passed over on either
   side cost GAP_COST each.
4. The words of both sides are fetched for chains that are long enough, gaps between seeds and both
   ends are aligned, and passages of MIN_WORDS with enough equal words are returned. A chain with too
   few is cut at the gap with the most unequal words, and both parts are judged in its place.
5. Seeds that occur earlier but are in no passage are looked up once more, in runs of up to 16 of them,
   each joined with its own first place: what single seeds of a passage share with several earlier
   documents, a longer run shares with fewer. Steps 3 and 4 follow for these matches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, ascii_lower, free_shuffles, frugal, hash_words, mix, rolling, small_batches, small_side, split_words, starts, stored

K = 6
WINDOW = 10
GAP_COST = 0.05
MAX_GAP = 64
#: Words between the first and last seed of a chain. The seeds of 51 equal words span 33 at least; the rest is for seeds
#: whose first place is elsewhere.
MIN_SPAN = 16
MIN_WORDS = 50
IDENTITY = 0.8
#: Words fetched on either side of a chain, for its ends.
MARGIN = 48
SALTS = 256
#: Numbers of neighbouring seeds that are looked up together where single ones led to no passage. 16 span about 88 words.
RUNS = (2, 3, 4, 6, 8, 12, 16)
#: Occurrences of a run in text that goes on repeating it are told apart up to this number.
REPEATS = 64
_BATCH_WORDS = 1 << 19


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash of each window of k-mers (the last of equals); of fewer k-mers, one."""
    n = len(h)
    if not n:
        return np.zeros(0, dtype=np.int64)
    if n <= window:
        return np.array([n - 1 - int(h[::-1].argmin())])
    views = np.lib.stride_tricks.sliding_window_view(h[::-1], window)
    return np.unique(n - 1 - (views.argmin(axis=1) + np.arange(len(views))))


def seeds(docs: DataFrame) -> DataFrame:
    """(h, doc, pos) of every document's seeds; pos counts words."""

    @frugal
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            docs_, texts, a = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while a < len(texts):
                lists, size, b = [], 0, a
                while b < len(texts) and size < _BATCH_WORDS:
                    lists.append(split_words(texts[b]))
                    size += len(lists[-1])
                    b += 1
                flat, ends = hash_words(lists, known)
                del lists
                grams = rolling(flat, K)
                out_h, out_d, out_p = [], [], []
                for d, x, y in zip(docs_[a:b], ends[:-1].tolist(), ends[1:].tolist()):
                    if y - x >= K:
                        own = grams[x : y - K + 1]
                        at = winnow(own)
                        out_h.append(own[at])
                        out_p.append(at)
                        out_d.append(np.full(len(at), d, dtype=np.int64))
                if out_h:
                    cols = [pa.array(np.concatenate(out_h).view(np.int64)), pa.array(np.concatenate(out_d)), pa.array(np.concatenate(out_p).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["h", "doc", "pos"])
                a = b

    return docs.select("doc", "text").mapInArrow(find, "h long, doc long, pos int")


def matches(found: DataFrame) -> DataFrame:
    """(h, doc, src, pos, spos): each seed that two documents have and its first place; doc is src in the first document itself."""
    first = found.groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("last"))
    first = first.filter("last != first.doc").select("h", F.col("first.doc").alias("src"), F.col("first.pos").alias("spos"))
    # Stored, so that the join has exchanges of its own, of which Spark can split a very common seed's.
    first = stored(first, "first-places")
    return found.join(first, "h").select("h", "doc", "src", "pos", "spos")


def uncovered(matched: DataFrame, passages: DataFrame) -> DataFrame:
    """(h, doc, pos): matched seeds that no passage of their document holds."""
    spans = stored(passages.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    held = F.exists("spans", lambda s: (s["start"] <= F.col("pos")) & (F.col("pos") + K <= s["end"]))
    return matched.join(small_side(spans, 96 + 24 * F.size("spans")), "doc", "left").filter(~F.coalesce(held, F.lit(False))).select("h", "doc", "pos")


def numbered(doc: np.ndarray, pos: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keys of runs, with their number where a document repeats one within MIN_WORDS, so that repetitions match in order."""
    order = np.lexsort((key, doc))
    d, p, k, i = doc[order], pos[order], key[order], np.arange(len(order))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (p[1:] - p[:-1] >= MIN_WORDS)
    number = (i - np.maximum.accumulate(np.where(new, i, 0))) % REPEATS
    out = key.copy()
    out[order] = np.where(number > 0, mix(k + number.astype(np.uint64)), k)
    return out


def seed_runs(shared: DataFrame, left: DataFrame) -> DataFrame:
    """(h, doc, pos, last, asked) of runs of RUNS neighbouring seeds, of all documents that have seeds of left.

    shared holds all places of seeds that two documents have. Only hashes that left has count, so an
    edit's own seeds do not part a run. h is the run's hash, pos
    and last are its outer seeds' places; asked: one of its seeds is in left.
    """
    known = left.select("h").distinct()
    places = shared.select("doc", "pos", "h").join(small_side(stored(known, "open-seeds"), 16), "h", "left_semi").withColumn("asked", F.lit(0))
    rows = places.unionByName(left.withColumn("asked", F.lit(1))).select("doc", "pos", "h", "asked")
    dealt = rows.repartition("doc").sortWithinPartitions("doc", "pos")

    def runs_of(doc: np.ndarray, pos: np.ndarray, h: np.ndarray, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = starts(doc, pos)
        asked = np.maximum.reduceat(asked, at)
        doc, pos, h = doc[at], pos[at].astype(np.int64), h[at].view(np.uint64)
        apart = np.ones(len(doc), dtype=bool)
        apart[1:] = (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > MAX_GAP + K)
        part, total = np.cumsum(apart), np.append(0, np.cumsum(asked))
        for n in RUNS:
            if n > len(doc):
                break
            m = len(doc) - n + 1
            whole = np.flatnonzero(part[:m] == part[n - 1 :])
            key = numbered(doc[whole], pos[whole], rolling(h, n)[whole])
            cols = [key.view(np.int64), doc[whole], pos[whole].astype(np.int32), pos[whole + n - 1].astype(np.int32), total[whole + n] > total[whole]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "doc", "pos", "last", "asked"])

    @frugal
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            new = np.flatnonzero(cols[0] != cols[0][-1])
            cut = int(new[-1]) + 1 if len(new) else 0  # the last document may go on in the next batch
            if kept and (cut or kept[-1][0][-1] != cols[0][0]):
                yield from runs_of(*(np.concatenate(x) for x in zip(*kept, [c[:cut] for c in cols])))
                kept = []
            elif cut:
                yield from runs_of(*(c[:cut] for c in cols))
            kept.append([c[cut:] for c in cols])
        if kept:
            yield from runs_of(*(np.concatenate(x) for x in zip(*kept)))

    return dealt.mapInArrow(find, "h long, doc long, pos int, last int, asked boolean")


def run_matches(shared: DataFrame, left: DataFrame) -> DataFrame:
    """(doc, src, pos, spos): outer seeds of runs that have a seed of left, and of the run's first place in an earlier document."""
    runs = stored(seed_runs(shared, left), "runs")
    first = runs.groupBy("h").agg(F.min(F.struct("doc", "pos", "last")).alias("first"), F.max("doc").alias("end")).filter("end != first.doc").select("h", "first")
    pairs = runs.filter("asked").join(stored(first, "first-runs"), "h").filter("doc != first.doc")
    ends = F.array(F.struct(F.col("pos").alias("pos"), F.col("first.pos").alias("spos")), F.struct(F.col("last").alias("pos"), F.col("first.last").alias("spos")))
    return pairs.select("doc", F.col("first.doc").alias("src"), F.inline(ends)).distinct()


_NONE = (float("-inf"), -1)


class MaxTree:
    """Best live (value, index) over a range of ranks; the oldest match of a rank can be taken out."""

    def __init__(self, n: int):
        self.n, self.live = n, [deque() for _ in range(n)]
        self.best_of = [_NONE] * (2 * n)

    def _set(self, rank: int) -> None:
        t, i = self.best_of, rank + self.n
        t[i] = self.live[rank][0] if self.live[rank] else _NONE
        while i > 1:
            i >>= 1
            t[i] = max(t[2 * i], t[2 * i + 1])

    def put(self, rank: int, value: float, index: int) -> None:
        live = self.live[rank]
        while live and live[-1][0] <= value:
            live.pop()
        live.append((value, index))
        if len(live) == 1:
            self._set(rank)

    def drop(self, rank: int, index: int) -> None:
        """Takes a match out; matches of a rank must go in the order in which they came."""
        live = self.live[rank]
        if live and live[0][1] == index:
            live.popleft()
            self._set(rank)

    def best(self, low: int, high: int) -> tuple[float, int]:
        """Over ranks from low to below high."""
        t, found, low, high = self.best_of, _NONE, low + self.n, high + self.n
        while low < high:
            if low & 1:
                found = max(found, t[low])
                low += 1
            if high & 1:
                high -= 1
                found = max(found, t[high])
            low, high = low >> 1, high >> 1
        return found


def chains(pos: list[int], spos: list[int], k: int = K, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[tuple[float, list[int]]]:
    """(score, match numbers) of collinear chains, best first; no match is in two.

    pos ascends. A chain's score is k for each match less the gap costs; a match goes on from the best
    of the earlier ones within max_gap words on both sides, or starts a chain where that gains nothing.
    """
    ys = sorted(set(spos))
    rank = {y: i for i, y in enumerate(ys)}
    tree = MaxTree(len(ys))
    score, back = [float(k)] * len(pos), [-1] * len(pos)
    near, ready = 0, 0  # matches from near to below ready are in the tree
    for i, (x, y) in enumerate(zip(pos, spos)):
        while pos[ready] < x:
            tree.put(rank[spos[ready]], score[ready] + gap_cost * (pos[ready] + spos[ready]), ready)
            ready += 1
        while near < ready and x - pos[near] > max_gap + k:
            tree.drop(rank[spos[near]], near)
            near += 1
        value, j = tree.best(bisect_left(ys, y - max_gap - k), rank[y])
        gain = value - gap_cost * (x + y)
        if gain > 0:
            score[i], back[i] = k + gain, j
    used, out = [False] * len(pos), []
    for i in sorted(range(len(pos)), key=lambda i: (-score[i], i)):
        path, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = back[j]
        if path:
            out.append((score[i] - (score[j] if j >= 0 else 0.0), path[::-1]))
    return out


CHAIN_SCHEMA = "doc long, src long, start int, end int, s_start int, s_end int, score double, pos array<int>, spos array<int>"


def chained(found: DataFrame) -> DataFrame:
    """Chains of each (doc, src) that span MIN_SPAN words on both sides."""
    dealt = found.select("doc", "src", "pos", "spos").repartition("doc", "src").sortWithinPartitions("doc", "src", "pos", "spos")
    names = ["doc", "src", "start", "end", "s_start", "s_end", "score", "pos", "spos"]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    @frugal
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, xs, ys = None, [], []

        def close() -> None:
            if len(xs) < 2 or xs[-1] + K - xs[0] < MIN_SPAN:
                return
            for score, path in chains(xs, ys):
                a, b = path[0], path[-1]
                if xs[b] + K - xs[a] >= MIN_SPAN and ys[b] + K - ys[a] >= MIN_SPAN:
                    rows.append((*key, xs[a], xs[b] + K, ys[a], ys[b] + K, score, [xs[i] for i in path], [ys[i] for i in path]))

        for batch in batches:
            for doc, src, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, src) != key:
                    close()
                    key, xs, ys = (doc, src), [], []
                xs.append(x)
                ys.append(y)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return dealt.mapInArrow(chain, CHAIN_SCHEMA)


def _edit(a: list[bytes], b: list[bytes]) -> int:
    """Most words that an alignment of a and b in order can match."""
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j = 0
    while j < len(a) and j < len(b) and a[-1 - j] == b[-1 - j]:
        j += 1
    if j:
        a, b = a[:-j], b[:-j]
    if not a or not b:
        return i + j
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for c, y in enumerate(b, 1):
            last, row[c] = row[c], last + 1 if x == y else max(row[c], row[c - 1])
    return i + j + row[-1]


def _extend(a: list[bytes], b: list[bytes]) -> tuple[int, int, int]:
    """Words taken of a and b from their starts on, and equal ones: small edits are passed if three equal words follow."""
    i = j = equal = best_i = best_j = best = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, equal = i + 1, j + 1, equal + 1
            best_i, best_j, best = i, j, equal
            continue
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (3, 3), (2, 0), (0, 2)):
            x, y = a[i + di : i + di + 3], b[j + dj : j + dj + 3]
            if len(x) == 3 and x == y:
                i, j = i + di, j + dj
                break
        else:
            break
    return best_i, best_j, best


def align(a: list[bytes], b: list[bytes], xs: list[int], ys: list[int], k: int = K) -> tuple[int, int, int, int, int]:
    """(start, end) in a, (start, end) in b and equal words of the passage through the seeds at (xs, ys)."""
    equal, x, y = k, xs[0] + k, ys[0] + k
    for nx, ny in zip(xs[1:], ys[1:]):
        over = max(0, x - nx, y - ny)  # seeds that overlap count their new words only
        equal += _edit(a[x : nx + over], b[y : ny + over]) + k - over
        x, y = nx + k, ny + k
    di, dj, n = _extend(a[x:], b[y:])
    left_a, left_b = a[: xs[0]][::-1], b[: ys[0]][::-1]
    ei, ej, m = _extend(left_a, left_b)
    return xs[0] - ei, x + di, ys[0] - ej, y + dj, equal + n + m


def judged(a: list[bytes], b: list[bytes], xs: list[int], ys: list[int], min_words: int, identity: float) -> Iterator[tuple[int, int, int, int, int, float]]:
    """align() of the chain (xs, ys) with its identity if that is enough, else of what is left after cutting it at its worst gap."""
    left = [(xs, ys)]
    while left:
        xs, ys = left.pop()
        x0, x1, y0, y1, equal = align(a, b, xs, ys)
        same = 2 * equal / (x1 - x0 + y1 - y0)
        if same >= identity:
            if max(x1 - x0, y1 - y0) >= min_words:
                yield x0, x1, y0, y1, equal, same
        elif len(xs) > 1:
            odd = [max(p - x, q - y) - _edit(a[x + K : p], b[y + K : q]) for x, y, p, q in zip(xs, ys, xs[1:], ys[1:])]
            cut = max(range(len(odd)), key=lambda i: (odd[i], -i)) + 1
            left += [(xs[cut:], ys[cut:]), (xs[:cut], ys[:cut])]


PASSAGE_SCHEMA = "doc_id long, source_doc_id long, start int, end int, source_start int, source_end int, n_equal int, identity double"


def _slices(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(id, side, first, words) for both sides of each chain: its words with a margin, and where they start."""
    side0 = table.select(F.col("doc").alias("d"), "id", F.lit(0).alias("side"), "start", "end")
    side1 = table.select(F.col("src").alias("d"), "id", F.lit(1).alias("side"), F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    asked = side0.union(side1).groupBy("d", F.pmod("id", F.lit(SALTS)).alias("salt")).agg(F.collect_list(F.struct("id", "side", "start", "end")).alias("asked")).drop("salt")
    joined = docs.select("doc", "text").join(small_side(stored(asked, "asked"), 96 + 24 * F.size("asked")), F.col("doc") == F.col("d")).select("text", "asked")

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for text, asked_ in zip(batch.column(0), batch.column(1)):
                words = ascii_lower(text.as_py()).split()
                for r in asked_.as_py():
                    first = max(0, r["start"] - MARGIN)
                    out.append((r["id"], r["side"], first, b" ".join(words[first : r["end"] + MARGIN])))
                    size += len(out[-1][3])
                if size > 16 << 20:
                    yield _slice_batch(out)
                    out, size = [], 0
            if out:
                yield _slice_batch(out)

    return joined.mapInArrow(cut, "id long, side int, first int, words binary")


def _slice_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["id", "side", "first", "words"])


def _one_row_each(docs: DataFrame) -> DataFrame:
    """(doc, text): rows that repeat a doc_id are one document, their texts one after the other."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").filter("doc_id is not null and text is not null")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc")).groupBy("doc").count().filter("count > 1 and doc is not null").select("doc")
    if ids.isEmpty():
        return rows
    ids = stored(ids, "repeated")
    joined = rows.join(ids, "doc", "left_semi").groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))
    return rows.join(ids, "doc", "left_anti").union(joined)


def fuzzy_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """Passages of docs(doc_id, text) that repeat words of an earlier document (smaller doc_id).

    One row for each: doc_id, source_doc_id, word places [start, end) on both sides, equal words and
    identity (twice those over both lengths). Null and short texts have none. Rows with a null doc_id
    have no name and take no part; rows that repeat a doc_id are one document, so repeated rows
    within it are not matched with each other. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = _one_row_each(docs)
    shared = stored(matches(stored(seeds(rows), "seeds")), "matches")
    free_shuffles(docs.sparkSession)
    matched = shared.filter("doc != src")
    passages = stored(_aligned(rows, matched, min_words, identity), "passages")
    left = stored(uncovered(matched, passages), "uncovered")
    if left.isEmpty():
        return passages
    free_shuffles(docs.sparkSession)
    return passages.union(_aligned(rows, run_matches(shared, left), min_words, identity)).distinct()


def _aligned(rows: DataFrame, matched: DataFrame, min_words: int, identity: float) -> DataFrame:
    """The passages that matches (doc, src, pos, spos) lead to."""
    table = chained(matched)
    table = stored(table.withColumn("id", F.xxhash64("doc", "src", "start", "s_start")), "chains")
    sides = _slices(rows, table.select("id", "doc", "src", "start", "end", "s_start", "s_end"))
    pairs = table.select("id", F.lit(-1).alias("side"), "doc", "src", "pos", "spos", F.lit(0).alias("first"), F.lit(None).cast("binary").alias("words"))
    parts = pairs.unionByName(sides, allowMissingColumns=True).repartition("id").sortWithinPartitions("id", "doc", "src", "side")
    names = ["doc_id", "source_doc_id", "start", "end", "source_start", "source_end", "n_equal", "identity"]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.float64()]

    @frugal
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, {}

        def passage() -> Iterator[tuple]:
            if len(got) != 3:
                return
            doc, src, pos, spos = got[-1]
            (fa, a), (fb, b) = got[0], got[1]
            for x0, x1, y0, y1, equal, same in judged(a.split(), b.split(), [x - fa for x in pos], [y - fb for y in spos], min_words, identity):
                yield doc, src, x0 + fa, x1 + fa, y0 + fb, y1 + fb, equal, round(same, 6)

        rows: list[tuple] = []
        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in ("id", "side", "doc", "src", "pos", "spos", "first", "words")]
            for i, side, doc, src, pos, spos, first, words in zip(*cols):
                if i != now:
                    rows += passage()
                    now, got = i, {}
                got[side] = (doc, src, pos, spos) if side < 0 else (first, words)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []
        rows += passage()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return parts.mapInArrow(aligned, PASSAGE_SCHEMA)
