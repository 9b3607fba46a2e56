"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Shingles that recur within a block of documents are counted over the corpus; the most frequent of
   them get a place in the common order, all others come before them by hash. Any common order gives
   right results, a rare-first one gives few candidates.
2. Each distinct set keeps its prefix: sets of similarity t share e shingles of their first
   n - ceil(t n) + e. Equal sets are one node from here on, whatever their number.
3. Prefix postings of one shingle, packed by block and part of the hash space, are joined in order
   of set size; sizes too far apart part the group (length filter). In groups of up to SMALL sets
   pairs are counted; larger groups are hot, and each set counts its hot shingles. A set with fewer
   than `tolerated` of them shares the rest of the e others with any set that it is linked with, so
   pairs stay that share `enough` without hot ones. Only sets with more hot shingles join the stars of
   their hot groups: in a large corpus many shingles are hot by chance, and all sets in stars would be
   one component. A group that is large within its block becomes a star there, and only the few sets
   that keep its range of sizes go on, so that what one shingle sends to a task grows with the blocks
   and not with its sets. The components of these edges hold every possible link.
4. A component's sets are dealt in blocks by size; each pair of blocks whose sizes can match is one
   task of bounded memory. It walks the sets by size with an inverted index of prefixes, applies the
   positional and suffix filters, verifies a pair once, and skips pairs that are already connected
   through verified links. So it returns at most one edge for each set, and loses no link between
   components.
5. Components of those edges are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, even_keys, frugal, hash_words, lengths, mix, pack, shingle_hashes, small_batches, small_side, split_words, starts, stored, unpack
from .components import connected_components

SHINGLE = 5
PERCENT = 80
#: Shingles with a place in the common order; the others are ordered by hash.
FREQUENT = 1 << 19
#: Occurrences within a block of documents from which a shingle is reported.
REPORTED = 3
#: Sets and bytes of shingles that a block holds at most (one larger set is a block of its own).
BLOCK_SETS = 1000
BLOCK_BYTES = 16 << 20
#: Sets that share a prefix shingle up to which all their pairs are counted; more are a star.
SMALL = 64
#: Prefix postings that a task packs at once, and whose pairs it counts at once.
BLOCK_POSTINGS = 1 << 20
PAIRED_POSTINGS = 1 << 15
_BATCH_WORDS = 1 << 19


def _sets(batches: Iterator[pa.RecordBatch], known: WordHashes, k: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows of a few documents at a time, and their shingle sets (ascending hashes)."""
    for batch in batches:
        texts, rows = batch.column(0).to_pylist(), list(zip(*(c.to_pylist() for c in batch.columns[1:]))) or [()] * batch.num_rows
        a = 0
        while a < len(texts):
            lists, size, b = [], 0, a
            while b < len(texts) and size < _BATCH_WORDS:
                lists.append(split_words(texts[b]))
                size += len(lists[-1])
                b += 1
            flat, ends = hash_words(lists, known)
            yield rows[a:b], [np.unique(x) for x in shingle_hashes(flat, ends, k)]
            a = b


def signature(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], dtype="<u8").tobytes()


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set that it is linked with."""
    return -(-n * percent // 100)


def extra(n):
    """Shingles that a linked pair shares at least in their prefixes, by the smaller set's size."""
    return 1 + n // 20


def tolerated(n):
    """Hot shingles in a set's prefix from which on it joins the stars of its hot groups."""
    return 1 + n // 30


def enough(small, large):
    """Shingles that are not hot and that a linked pair shares in its prefixes, if not both sets join
    stars or none of the shared ones is hot: the other set has at most tolerated - 1 hot ones."""
    return np.maximum(1, extra(small) - (tolerated(large) - 1))


def prefix_length(n: int, percent: int) -> int:
    """Of sets that share `needed`, the first n - needed + extra shingles share `extra`."""
    return min(n, n - needed(n, percent) + extra(n))


def frequent_shingles(docs: DataFrame, k: int = SHINGLE, limit: int = FREQUENT) -> list[int]:
    """Hashes of the most frequent shingles, most frequent first; at most limit come to the driver."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pile, size = WordHashes(), [], 0

        def report() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(pile), return_counts=True)
            at = n >= REPORTED
            return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(n[at].astype(np.int64))], names=["h", "n"])

        for _, sets in _sets(batches, known, k):
            pile += sets
            size += sum(map(len, sets))
            if size >= 2 << 20:
                yield report()
                pile, size = [], 0
        if pile:
            yield report()

    seen = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return [r["h"] for r in seen.orderBy(F.desc("n"), "h").limit(limit).collect()]


class Order:
    """The common order: shingles without a place by hash, then the placed ones, most frequent last."""

    def __init__(self, frequent: list[int]):
        h = np.array(frequent, dtype=np.int64).view(np.uint64)
        self.sorted = np.sort(h)
        self.place = (len(h) - np.argsort(h, kind="stable")).astype(np.int64)

    def arrange(self, s: np.ndarray) -> np.ndarray:
        """The ascending set s in the common order."""
        if not len(self.sorted) or not len(s):
            return s
        at = np.minimum(np.searchsorted(self.sorted, s), len(self.sorted) - 1)
        placed = self.sorted[at] == s
        if not placed.any():
            return s
        late = s[placed]
        return np.concatenate([s[~placed], late[np.argsort(self.place[at[placed]], kind="stable")]])


def _suffix_possible(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> bool:
    """Suffix filter: whether ascending x and y can differ in at most `most` places, probing middles."""
    if abs(len(x) - len(y)) > most:
        return False
    if not depth or len(x) < 8 or len(y) < 8:
        return True
    mid = y[len(y) // 2]
    i, j = int(np.searchsorted(x, mid)), len(y) // 2
    hit = i < len(x) and x[i] == mid
    low = abs(i - j)
    high = abs((len(x) - i - hit) - (len(y) - j - 1))
    if low + high + (not hit) > most:
        return False
    return _suffix_possible(x[:i], y[:j], most - high - (not hit), depth - 1) and _suffix_possible(x[i + hit :], y[j + 1 :], most - low - (not hit), depth - 1)


def linked_pairs(sets: list[np.ndarray], order: Order, percent: int, left: int | None = None) -> list[tuple[int, int]]:
    """A forest of links that connects all that links connect.

    sets: in the order of size; left: only pairs of one set before it and one from it on count.
    """
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index: dict[int, list[tuple[int, int]]] = {}
    out = []
    for j in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        x = sets[j]
        n = len(x)
        prefix = order.arrange(x)[: n - needed(n, percent) + 1].tolist()  # one shared shingle is enough here
        side = left is not None and j < left
        shared: dict[int, int] = {}
        for p, h in enumerate(prefix):
            for i, q in index.get(h, ()):
                if left is not None and (i < left) == side:
                    continue
                seen = shared.get(i, 0)
                if seen < 0:
                    continue
                m = len(sets[i])
                if m * 100 < n * percent:
                    continue
                least = -(-(n + m) * percent // (100 + percent))
                # Positional filter: what can still be shared from these places on.
                shared[i] = seen + 1 if seen + 1 + min(n - p - 1, m - q - 1) >= least else -1
        for i, seen in shared.items():
            if seen <= 0 or root(i) == root(j):
                continue
            y = sets[i]
            least = -(-(n + len(y)) * percent // (100 + percent))
            if not _suffix_possible(x, y, n + len(y) - 2 * least):
                continue
            inter = len(np.intersect1d(x, y, assume_unique=True))
            if inter * 100 >= percent * (n + len(y) - inter):
                out.append((i, j))
                parent[root(j)] = root(i)
        for q, h in enumerate(prefix):
            index.setdefault(h, []).append((j, q))
    return out


def set_table(docs: DataFrame, frequent: list[int], k: int = SHINGLE, percent: int = PERCENT, parts: int = 8) -> DataFrame:
    """A row for each document: doc_id, text_hash, n, node, sig; for each block and part its prefix
    postings, packed; and a row for each star edge (node, hub) of a block's large groups, with the
    node's size and the number of groups.

    node is 64 bits of sig. A block's equal sets have their postings once.
    """
    order, keys = docs.sparkSession.sparkContext.broadcast(Order(frequent)), even_keys(docs.sparkSession, parts)
    few = SMALL
    names = ["doc_id", "text_hash", "n", "node", "sig", "part", "postings", "hub", "shared"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    @frugal
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, heads, nodes, sizes, seen, held = WordHashes(), [], [], [], set(), 0

        def postings() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(heads)
            node, n = np.array(nodes, dtype=np.uint64), np.array(sizes, dtype=np.uint32)
            at = np.repeat(np.arange(len(heads), dtype=np.uint32), [len(x) for x in heads])
            by_size = np.lexsort((node, n))
            rank = np.empty(len(n), dtype=np.uint32)
            rank[by_size] = np.arange(len(n), dtype=np.uint32)
            part = keys[(h % np.uint64(parts)).astype(np.int64)]
            order = np.lexsort((rank[at], h, part))
            h, at, part = h[order], at[order], part[order]
            kept, hot, stars = _combined(h, n[at].astype(np.int64), at, percent, few)
            stars, shared = np.unique(stars, return_counts=True)
            h, at, part, hot = h[kept], at[kept], part[kept], hot[kept]
            cuts = np.append(starts(part), len(part))
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own, place = np.unique(at[a:b], return_inverse=True)
                packed = pack(node[own], n[own], h[a:b], place.astype(np.uint32), np.flatnonzero(hot[a:b]).astype(np.uint32))
                rows.append((None, None, None, None, None, int(part[a]), packed, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            if len(stars):
                own = stars >> np.uint64(32)
                cells = {"node": node[own].view(np.int64), "hub": node[stars & np.uint64(2**32 - 1)].view(np.int64), "n": n[own].astype(np.int64), "shared": shared}
                cols = [pa.array(cells[c], t) if c in cells else pa.nulls(len(stars), t) for c, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

        for rows, sets in _sets(batches, known, k):
            sigs = [signature(s) for s in sets]
            ids = [int.from_bytes(x[:8], "little", signed=True) for x in sigs]
            cols = [[r[0] for r in rows], [r[1] for r in rows], [len(s) for s in sets], ids, sigs, *[[None] * len(sets)] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
            for s, sig, node in zip(sets, sigs, ids):
                if len(s) and sig not in seen:
                    seen.add(sig)
                    heads.append(order.value.arrange(s)[: prefix_length(len(s), percent)])
                    nodes.append(node & (2**64 - 1))
                    sizes.append(len(s))
                    held += len(heads[-1])
            if held >= BLOCK_POSTINGS:
                yield from postings()
                heads, nodes, sizes, seen, held = [], [], [], set(), 0
        if heads:
            yield from postings()

    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(prefixes, "doc_id long, text_hash long, n long, node long, sig binary, part int, postings binary, hub long, shared long")


def _groups(h: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Where groups start in rows sorted by shingle, then size: at a new shingle, and (length filter)
    where the next set is too large for the last one."""
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (n[:-1] * 100 < n[1:] * percent)
    return np.flatnonzero(new)


def _combined(h: np.ndarray, n: np.ndarray, at: np.ndarray, percent: int, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, hot, stars) of a block's postings [shingle, size, set number], sorted by shingle, then size.

    Groups of more than `few` sets are stars here: edges, set << 32 | hub, once a group. Of them only the
    sets that `kept` marks go on: the first, the last, and between them the fewest that no length
    filter parts, so that another block's set joins the group if and only if it would join all of it.
    They are `hot`: wherever one is in a group, the group is large.
    """
    first = _groups(h, n, percent)
    size = lengths(first, len(h))
    kept, hot, stars = np.ones(len(h), dtype=bool), np.zeros(len(h), dtype=bool), []
    for a, m in zip(first[size > few].tolist(), size[size > few].tolist()):
        own, i, stay = n[a : a + m], 0, [0]
        reach = np.searchsorted(own * percent, own * 100, side="right") - 1
        while i < m - 1:
            i = max(i + 1, int(reach[i]))
            stay.append(i)
        kept[a : a + m] = False
        kept[a + np.array(stay)] = hot[a + np.array(stay)] = True
        stars.append(at[a + 1 : a + m].astype(np.uint64) << np.uint64(32) | np.uint64(at[a]))
    return kept, hot, np.concatenate(stars) if stars else np.zeros(0, np.uint64)


def _large(h: np.ndarray, n: np.ndarray, hot: np.ndarray, percent: int, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, size, in_large) of rows sorted by shingle, then size: the place in the group, the group's size, whether it is large."""
    at = _groups(h, n, percent)
    size = lengths(at, len(h))
    return np.arange(len(h)) - np.repeat(at, size), np.repeat(size, size), np.repeat((size > few) | np.logical_or.reduceat(hot, at), size)


def _near(h: np.ndarray, n: np.ndarray, node: np.ndarray, hot: np.ndarray, percent: int, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs [a, b, shared, need] within groups of up to `few` sets of one shingle, and star edges [a, hub]
    of larger ones, once for each set of a group, the hub too.

    The rows are sorted by shingle, then size. A pair is left out where the larger set is too large for
    the smaller one. A group with a hot set is large.
    """
    place, size, is_large = _large(h, n, hot, percent, few)
    large = np.flatnonzero(is_large)
    stars = np.stack([node[large], node[large - place[large]]], axis=1)
    pairs, small = [np.zeros((0, 3), np.uint64)], np.flatnonzero(~is_large & (size > 1))
    for d in range(1, few):
        small = small[place[small] + d < size[small]]
        if not len(small):
            break
        fits = small[n[small] * 100 >= n[small + d] * percent]
        x, y = node[fits], node[fits + d]
        pairs.append(np.column_stack([np.minimum(x, y), np.maximum(x, y), enough(n[fits], n[fits + d]).astype(np.uint64)]))
    both = np.concatenate(pairs)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    at = starts(both[:, 0], both[:, 1])
    return np.column_stack([both[at, :2], lengths(at, len(both)).astype(np.uint64), both[at, 2]]), stars


def _hot_edges(stars: np.ndarray, n: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Distinct [a, hub, shared, need] of star edges: how many hot shingles of a they stand for, and -tolerated(a).

    n, hot: of each a. A set that was hot within its block stands for others there, so it always joins.
    """
    least = tolerated(n).astype(np.int64)
    order = np.lexsort((stars[:, 1], stars[:, 0]))
    stars, least, weight = stars[order], least[order], np.where(hot, least, 1)[order]
    at = starts(stars[:, 0], stars[:, 1])
    shared = np.add.reduceat(weight, at) if len(at) else weight
    return np.column_stack([stars[at].view(np.int64), shared, -least[at]])


def candidate_components(table: DataFrame, percent: int = PERCENT, parts: int = 8) -> DataFrame:
    """(node, component) of sets that may be linked.

    Pairs within groups of up to SMALL sets are counted over all shingles, and only pairs that share
    `enough` of their prefixes stay. Of larger groups' stars the edges of sets with `tolerated` hot
    shingles or more stay, which join a superset of the other links. The stars of large groups within
    a block are in the table; a shingle counted in several blocks only makes a set join sooner.
    """
    few = SMALL

    @frugal
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not got:
                return
            node = np.concatenate([x[0][x[3]] for x in got])
            n = np.concatenate([x[1][x[3]] for x in got]).astype(np.int64)
            h = np.concatenate([x[2] for x in got])
            cold = np.ones(len(h), dtype=bool)
            cold[np.concatenate([x[4] + b for x, b in zip(got, np.cumsum([0, *(len(x[2]) for x in got)]))])] = False
            got.clear()
            order = np.lexsort((cold, node, n, h))
            node, n, h, hot = node[order], n[order], h[order], ~cold[order]
            kept = np.ones(len(h), dtype=bool)
            kept[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])  # equal sets of several blocks, a hot one first
            node, n, h, hot = node[kept], n[kept], h[kept], hot[kept]
            a = 0
            while a < len(h):
                b = min(len(h), a + PAIRED_POSTINGS)
                while b < len(h) and h[b] == h[b - 1]:
                    b += 1
                pairs, stars = _near(h[a:b], n[a:b], node[a:b], hot[a:b], percent, few)
                large = a + np.flatnonzero(_large(h[a:b], n[a:b], hot[a:b], percent, few)[2])
                e = np.concatenate([pairs.view(np.int64), _hot_edges(stars, n[large], hot[large])])
                if len(e):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, i])) for i in range(4)], names=["a", "b", "shared", "need"])
                a = b

        for batch in batches:
            for part, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    yield from close()
                    now = part
                got.append(unpack(payload))
        yield from close()

    blocks = table.filter("part is not null").select("part", "postings")
    found = blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(near, "a long, b long, shared long, need long")
    counted = stored(found.groupBy("a", "b", "need").agg(F.sum("shared").alias("shared")).filter("need < 0 or shared >= need"), "pairs")
    in_blocks = table.filter("hub is not null").select(F.col("node").alias("a"), F.col("hub").alias("b"), (-(F.floor(F.col("n") / 30) + 1)).alias("need"), "shared")
    stars = counted.filter("need < 0").select("a", "b", "need", "shared").union(in_blocks)
    joining = stars.groupBy("a").agg(F.sum("shared").alias("hot"), F.min("need").alias("need")).filter("hot >= -need").select("a")
    edges = counted.filter("need > 0").select("a", "b").union(stars.filter("a != b").join(joining, "a", "left_semi").select("a", "b"))
    return connected_components(edges)


def _tasks(wanted: DataFrame, percent: int) -> DataFrame:
    """(doc, sig, tasks) of wanted(doc, sig, component, n): the pairs of blocks that a set takes part in.

    Blocks are cut by running sums over (component, size) counts, not over rows. Sets of one size are
    dealt to sub-blocks by hash where they alone exceed a block.
    """
    from pyspark.sql import Window

    sized = wanted.groupBy("component", "n").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("component").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sets_before, bytes_before = F.coalesce(F.sum("c").over(before), F.lit(0)), F.coalesce(F.sum(F.col("c") * F.col("n") * 8).over(before), F.lit(0))
    per = F.least(F.lit(BLOCK_SETS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (F.col("n") * 8))))
    major = F.greatest(F.floor(sets_before / BLOCK_SETS), F.floor(bytes_before / BLOCK_BYTES))
    blocks = sized.select("component", "n", F.ceil(F.col("c") / per).alias("subs"), major.cast("long").alias("major"))
    minor = F.when(F.col("subs") > 1, F.pmod(F.xxhash64("sig"), F.col("subs")) + 1).otherwise(F.lit(0))
    placed = stored(wanted.join(blocks, ["component", "n"]).select("doc", "sig", "component", "n", F.xxhash64("major", minor).alias("block")), "blocks")
    listed = placed.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = listed.alias("x"), listed.alias("y")
    pairs = x.join(y, F.expr(f"x.component = y.component and (x.low < y.low or (x.low = y.low and x.block <= y.block)) and x.high * 100 >= y.low * {percent}"))
    pairs = pairs.select(F.col("x.component").alias("component"), F.col("x.block").alias("one"), F.col("y.block").alias("two"))
    ends = pairs.select("component", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"), "one", "two")
    task = F.struct("component", "one", "two", (F.col("block") == F.col("one")).alias("first"))
    by_block = ends.groupBy("component", "block").agg(F.collect_list(task).alias("tasks"))
    return placed.join(by_block, ["component", "block"]).select("doc", "sig", "tasks")


def _verified_edges(docs: DataFrame, wanted: DataFrame, frequent: list[int], k: int, percent: int) -> DataFrame:
    """(a, b): sigs of verified links, enough of them to connect what links connect.

    The texts of wanted sets are read again, and each set is sent once to each of its tasks.
    """
    order = docs.sparkSession.sparkContext.broadcast(Order(frequent))
    names = ["component", "one", "two", "first", "sig", "s"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]

    @frugal
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for rows, sets in _sets(batches, known, k):
            out = []
            for (sig, tasks), s in zip(rows, sets):
                if signature(s) == sig:
                    packed = s.astype("<u8").tobytes()
                    out += [(t["component"], t["one"], t["two"], t["first"], sig, packed) for t in tasks]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    tasks = stored(_tasks(wanted, percent), "tasks")
    texts = docs.select("text", F.col("doc_id").cast("long").alias("__id"))
    asked = texts.join(small_side(tasks, 96 + 64 * F.size("tasks")), F.expr("__id <=> doc"), "inner").select("text", "sig", "tasks")
    dealt = asked.mapInArrow(shingles, "component long, one long, two long, first boolean, sig binary, s binary")
    dealt = dealt.repartition("component", "one", "two").sortWithinPartitions("component", "one", "two", F.desc("first"), F.octet_length("s"), "sig")

    @frugal
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sigs, sets, left = None, [], [], 0

        def links() -> Iterator[pa.RecordBatch]:
            if len(sigs) < 2:
                return
            found = linked_pairs(sets, order.value, percent, None if task[1] == task[2] else left)
            if found:
                cols = [pa.array([sigs[p[i]] for p in found], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b"])

        for batch in batches:
            for component, one, two, first, sig, s in zip(*(c.to_pylist() for c in batch.columns)):
                if (component, one, two) != task:
                    yield from links()
                    task, sigs, sets, left = (component, one, two), [], [], 0
                left += first
                sigs.append(sig)
                sets.append(np.frombuffer(s, dtype="<u8"))
        yield from links()

    return dealt.mapInArrow(verify, "a binary, b binary")


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n, sig, component, component_id) of each row; component: the sig that names the group, null for empty sets."""
    small_batches(docs.sparkSession)
    parts = max(4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    frequent = frequent_shingles(docs, k)
    table = stored(set_table(docs, frequent, k, percent, parts), "sets")
    rows = table.filter("part is null and hub is null").select("doc_id", "text_hash", "n", "node", "sig")
    reps = stored(rows.filter("n > 0").groupBy("sig", "node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n")), "nodes")
    # Candidates go by 64 bits of sig: a clash may join two components of candidates, never two sets.
    wanted = reps.join(candidate_components(table, percent, parts), "node").select("doc", "sig", "component", "n")
    linked = connected_components(_verified_edges(docs, wanted, frequent, k, percent))
    named = reps.select("sig", "doc").join(linked.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    lowest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_sig = named.join(lowest, "component").select("sig", "component", "component_id")
    return rows.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(by_sig, "sig", "left")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for each row of docs.

    Rows with equal sets are linked, but empty sets (null, empty or blank texts) with nothing, not
    with each other: such a row's component is its own doc_id. Null doc_ids take part; the smallest
    known doc_id names the component, which is null if there is none. An empty table gives none.
    """
    named = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return _grouped(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), named.alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with its own columns: that of the smallest doc_id, a null one last.

    Of several rows with that doc_id, one text's stays, and of rows that repeat both, any one. Rows go
    by doc_id and text, so rows with one doc_id and unlinked texts all stay. Rows with empty sets stay.
    An empty table gives an empty result.
    """
    found = stored(_grouped(docs, k, percent).filter("n > 0").select("doc_id", "text_hash", "component"), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    best = found.groupBy("component").agg(F.min(rank).alias("best"))
    best = stored(best.select("component", F.col("best.doc_id").alias("d"), F.col("best.text_hash").alias("h")), "kept-rows")
    gone = found.join(best, "component").filter("not (doc_id <=> d and text_hash = h)").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).distinct()
    rows = docs.withColumn("__key", F.xxhash64("text"))
    rows = rows.join(small_side(stored(gone, "gone"), 24), F.expr("cast(doc_id as long) <=> __id and __key = __h"), "left_anti")
    repeated = found.groupBy("component", "doc_id", "text_hash").count().filter("count > 1")
    repeated = repeated.join(best, F.expr("doc_id <=> d and text_hash = h")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).distinct()
    repeated = stored(repeated, "repeated")
    if repeated.isEmpty():
        return rows.drop("__key")
    same = F.expr("cast(doc_id as long) <=> __id and __key = __h")
    copies = rows.join(small_side(repeated, 24), same, "left_semi")
    one = copies.groupBy(F.col("doc_id").alias("__id"), "__key").agg(F.first(F.struct(*(f"`{c}`" for c in docs.columns))).alias("__row")).select("__row.*")
    return rows.join(small_side(repeated, 24), same, "left_anti").drop("__key").union(one)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT row_no, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS sh FROM (SELECT row_no, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT row_no, count(*) AS n FROM s GROUP BY row_no),
shared AS (SELECT x.row_no AS a, y.row_no AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.row_no < y.row_no GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n na ON na.row_no = a JOIN n nb ON nb.row_no = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
lowest AS (SELECT r.a AS row_no, min(d.doc_id) AS component_id FROM reach r JOIN d ON d.row_no = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN l.row_no IS NULL THEN doc_id ELSE component_id END AS component_id
FROM d LEFT JOIN n USING (row_no) LEFT JOIN lowest l USING (row_no)
"""
