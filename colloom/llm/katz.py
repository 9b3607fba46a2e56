r"""Katz backoff scoring: Good-Turing discounted bigrams, exactly normalised backoff to unigrams.

A document is its words between two boundary marks; the end counts as a token. So each token stands
once as the context of the next one, and the count of a word is the count of its context.

    P(w | v) = d(r) r / c(v)       for a pair counted r >= MIN_COUNT times after v, else
    P(w | v) = a(v) P(w),          a(v) = (1 - sum P(seen w | v)) / (1 - sum P(seen w))
    P(w)     = d(c) c / N          for a word counted c times, else what the discounts leave
                                   (all unknown words are one)

Tables are partitioned by context: `part` holds all pairs of its contexts, so counts and backoff
weights are local to it. Contexts with a large share of all words are spread over the parts by the
next word, and the few sums that they need are put together. Only P(w) of a seen pair lies in another
part; it is asked for once per part and word. Pairs travel in packed blocks: a block of documents
sends each part one value with its contexts, a list of next words, and pairs and documents as places
in those. A block's documents get one partial sum from each part. What comes to the driver has a fixed size: counts of counts, and the
figures of at most SPREAD spread contexts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import even_keys, frugal, lengths, mix, pack, small_batches, split_words, starts, stored, unpack

#: Hash of the boundary mark; no word has it but for a clash of 64 bits.
MARK = np.uint64(0x2545F4914F6CDD1D)
MIN_COUNT = 1
CUTOFF = 5
SPREAD = 512
BLOCK_TOKENS = 5 << 19
#: Different words from which on a block ends; one run of words more fits WORD_BITS, so that a pair and its part are one 64-bit number.
BLOCK_WORDS = 1 << 20
WORD_BITS = 21
_BATCH_WORDS = 1 << 19
ROW = "part int, kind int, block long, payload binary"
_NAMES = ["part", "kind", "block", "payload"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
# Kinds of rows, in the order in which a part reads them.
CONTEXTS, PAIRS, ANSWERS, ASKED, TOKENS, DOCUMENTS, SUMS, COUNTS, SHARED = range(9)


def row_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def held_out(doc_id: int | None) -> bool:
    """crc32 of doc_id as text, mod 5, is 1; a null doc_id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


class LocalIds(dict):
    """Words numbered from 1 as they come; 0 is the mark."""

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self) + 1
        return i


class Routes:
    """The part of a pair: by its context, or by both words where the context is spread."""

    def __init__(self, keys: np.ndarray, spread: np.ndarray):
        self.keys, self.spread = keys, np.sort(spread)

    def is_spread(self, v: np.ndarray) -> np.ndarray:
        if not len(self.spread):
            return np.zeros(len(v), dtype=bool)
        return self.spread[np.minimum(np.searchsorted(self.spread, v), len(self.spread) - 1)] == v

    def of_word(self, v: np.ndarray) -> np.ndarray:
        return self.keys[(mix(v) % np.uint64(len(self.keys))).astype(np.int64)]

    def numbers(self, block: Block) -> np.ndarray:
        """For each token one number of its part's place, its context's and its own, which sorts in that order."""
        v, w = block.v, block.w
        part = (mix(block.words) % np.uint64(len(self.keys)))[v]
        at = np.flatnonzero(self.is_spread(block.words)[v])
        part[at] = mix(block.words[v[at]] * np.uint64(3) + block.words[w[at]]) % np.uint64(len(self.keys))
        return part << np.uint64(2 * WORD_BITS) | v.astype(np.uint64) << np.uint64(WORD_BITS) | w.astype(np.uint64)

    def asked(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of pairs whose counts other parts know, and these parts, in whose order answers come."""
        words = np.unique(w[~self.is_spread(w)])
        owner = self.of_word(words)
        order = np.argsort(owner, kind="stable")
        return words[order], owner[order]


@dataclass
class Block:
    """Tokens of some documents: doc_ids, hashes of the different words in ascending order, and of each
    token its context and itself (as places in words) and its document's number."""

    keys: list
    words: np.ndarray
    v: np.ndarray
    w: np.ndarray
    d: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], train_only: bool) -> Iterator[Block]:
    known, keys, vs, ws, ds, size = LocalIds(), [], [], [], [], 0

    def block() -> Block:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
        words, place = np.unique(np.insert(h, 0, MARK), return_inverse=True)
        place = place.astype(np.uint32)
        return Block(keys, words, place[np.concatenate(vs)], place[np.concatenate(ws)], np.concatenate(ds))

    for batch in batches:
        ids, texts, a = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
        while a < len(texts):
            lists, own, n = [], [], 0
            while a < len(texts) and n < _BATCH_WORDS:
                if not (train_only and held_out(ids[a])):
                    lists.append(split_words(texts[a]))
                    own.append(ids[a])
                    n += len(lists[-1])
                a += 1
            ends = np.zeros(len(lists) + 1, dtype=np.int64)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.uint32, int(ends[-1]))
            del lists
            ws.append(np.insert(flat, ends[1:], 0))
            vs.append(np.insert(flat, ends[:-1], 0))
            ds.append(np.repeat(np.arange(len(keys), len(keys) + len(own), dtype=np.uint32), np.diff(ends) + 1))
            keys += own
            size += len(vs[-1])
            if size >= BLOCK_TOKENS or len(known) >= BLOCK_WORDS:
                yield block()
                known, keys, vs, ws, ds, size = LocalIds(), [], [], [], [], 0
    if keys:
        yield block()


def _messages(number: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, int, tuple[np.ndarray, ...]]]:
    """For each part in sorted numbers its place, first and last token, and what it is sent.

    That is: contexts, how many pairs each has, next words, the pairs' places in those, how many tokens each pair has.
    """
    part, low = number >> np.uint64(2 * WORD_BITS), np.uint64((1 << WORD_BITS) - 1)
    cuts = np.append(starts(part), len(part))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        s = starts(number[a:b])
        pair = number[a:b][s]
        v, w = pair >> np.uint64(WORD_BITS) & low, pair & low
        at = starts(v)
        own, place = np.unique(w, return_inverse=True)
        yield int(part[a]), a, b, (words[v[at]], lengths(at, len(v)).astype(np.uint32), words[own], place.astype(np.uint32), lengths(s, b - a).astype(np.uint32))


def common_words(docs: DataFrame, parts: int) -> np.ndarray:
    """Hashes of words (and the mark) with a share of the corpus that one part should not hold alone.

    Decides only where pairs are counted, no result. All documents are counted; a run of words reports
    those with a share of its own.
    """

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, False):
            n, total = np.bincount(block.v, minlength=len(block.words)), len(block.v)
            at = n * 16 * parts >= total
            cols = [np.append(block.words[at], np.uint64(0)).view(np.int64), np.append(n[at], 0), np.append(np.zeros(at.sum(), np.int64), total)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "n", "all"])

    seen = docs.select("doc_id", "text").mapInArrow(count, "h long, n long, all long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    rows = seen.orderBy(F.desc("all"), F.desc("n"), "h").limit(SPREAD + 1).collect()
    total = sum(r["all"] for r in rows)
    return np.array([r["h"] for r in rows if r["n"] * 8 * parts >= total > 0 and not r["all"]], dtype=np.int64).view(np.uint64)


def _by_part(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "part").sortWithinPartitions("part", "kind", "block")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def discounts(n_r: np.ndarray, k: int = CUTOFF) -> np.ndarray:
    """d(0..k) from the counts of counts n_r[0..k+1]; where Good-Turing's are no discounts, (r - 0.5) / r."""
    d = np.ones(k + 1)
    last = (k + 1) * n_r[k + 1] / n_r[1] if n_r[1] else 1.0
    for r in range(1, k + 1):
        value = ((r + 1) * n_r[r + 1] / (r * n_r[r]) - last) / (1 - last) if n_r[r] and last != 1 else -1.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


@dataclass
class Figures:
    """All of the model that is not in the tables; its size does not grow with the corpus."""

    keys: np.ndarray
    spread: np.ndarray
    spread_counts: np.ndarray
    spread_log_a: np.ndarray
    tokens: int
    types: int
    d_words: np.ndarray
    d_pairs: np.ndarray
    unknown: float

    def routes(self) -> Routes:
        return Routes(self.keys, self.spread)

    def p_word(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words counted c times."""
        c = c.astype(np.float64)
        d = np.where(c <= CUTOFF, self.d_words[np.minimum(c, CUTOFF).astype(np.int64)], 1.0)
        return np.where(c > 0, d * c / max(self.tokens, 1), self.unknown)

    def p_pair(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        r = r.astype(np.float64)
        return np.where(r <= CUTOFF, self.d_pairs[np.minimum(r, CUTOFF).astype(np.int64)], 1.0) * r / c


def log_backoff(seen: np.ndarray, seen_words: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 a(v), and what to scale P(seen w | v) by: where the discounts leave nothing, c / (c + 1)."""
    scale = np.where(seen > 1 - 1e-9, c / (c + 1.0), 1.0)
    return np.log10((1 - np.minimum(seen, 1.0) * scale) / np.maximum(1 - seen_words, 1e-12)), scale


class Katz:
    """A trained model: figures and tables of contexts, pairs and their words' counts."""

    def __init__(self, figures: Figures, tables: DataFrame, answers: DataFrame):
        self.figures, self.tables, self.answers = figures, tables, answers


def train(docs: DataFrame, parts: int | None = None) -> Katz:
    """The model of the documents that are not held out. docs: doc_id, text."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    routes = Routes(even_keys(spark, parts), common_words(docs, parts))

    @frugal
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, True):
            number = routes.numbers(block)
            number.sort()
            for part, _, _, payload in _messages(number, block.words):
                yield row_batch([(int(routes.keys[part]), COUNTS, 0, pack(*payload))])

    @frugal
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not got:
                return
            ctx, words = (np.unique(np.concatenate([x[i] for x in got])) for i in (0, 2))
            v = np.concatenate([np.repeat(np.searchsorted(ctx, x[0]), x[1]) for x in got]).astype(np.uint64)
            number = v << np.uint64(32) | np.concatenate([np.searchsorted(words, x[2])[x[3]] for x in got]).astype(np.uint64)
            n = np.concatenate([x[4] for x in got])
            got.clear()
            order = np.argsort(number)
            number, n = number[order], n[order].astype(np.int64)
            at = starts(number)
            r, number = np.add.reduceat(n, at), number[at]
            w = (number & np.uint64(2**32 - 1)).astype(np.uint32)
            s = starts(number >> np.uint64(32))
            c = np.add.reduceat(r, s)
            shared = routes.is_spread(ctx)
            counts = np.bincount(np.minimum(r, CUTOFF + 2), minlength=CUTOFF + 3)
            singles = np.bincount(np.minimum(c[~shared], CUTOFF + 2), minlength=CUTOFF + 3)
            rows = [(now, SUMS, 0, pack(counts, singles, np.array([c[~shared].sum(), (~shared).sum()]), ctx[shared], c[shared]))]
            keep = r >= MIN_COUNT
            kept = np.add.reduceat(keep, s).astype(np.uint32)
            rows.append((now, CONTEXTS, 0, pack(ctx, c.astype(np.uint32) if c.max() < 2**32 else c, kept)))
            used, place = np.unique(w[keep], return_inverse=True)
            rows.append((now, PAIRS, 0, pack(words[used], place.astype(np.uint32), r[keep].astype(np.uint32) if r.max() < 2**32 else r[keep])))
            asked, owner = routes.asked(words[used])
            cuts = np.append(starts(owner), len(owner))
            rows += [(int(owner[a]), ASKED, now, pack(asked[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield row_batch(rows)

        for part, _, _, payload in _parts(batches):
            if part != now:
                yield from close()
                now = part
            got.append(unpack(payload))
        yield from close()

    tables = stored(_by_part(docs.mapInArrow(pairs, ROW), parts).mapInArrow(merge, ROW), "katz")
    n_pairs, n_words, tokens, types, spread = np.zeros(CUTOFF + 3), np.zeros(CUTOFF + 3), 0, 0, {}
    for r in tables.filter(F.col("kind") == SUMS).select("payload").toLocalIterator():
        a, b, both, h, c = unpack(r["payload"])
        n_pairs, n_words, tokens, types = n_pairs + a, n_words + b, tokens + int(both[0]), types + int(both[1])
        for x, y in zip(h.tolist(), c.tolist()):
            spread[x] = spread.get(x, 0) + y
    for c in spread.values():
        n_words[min(c, CUTOFF + 2)] += 1
    hot = np.array(sorted(spread), dtype=np.uint64)
    hot_counts = np.array([spread[x] for x in hot.tolist()], dtype=np.int64)
    d_words, d_pairs = discounts(n_words), discounts(n_pairs)
    tokens, types = tokens + int(hot_counts.sum()), types + len(hot)
    unknown = float(sum((1 - d_words[r]) * r * n_words[r] for r in range(1, CUTOFF + 1)) / tokens) if tokens else 1.0
    scale = 1.0
    if tokens and unknown <= 0:
        unknown, scale = 1 / (tokens + 1), tokens / (tokens + 1)
    figures = Figures(routes.keys, routes.spread, np.zeros(len(routes.spread), np.int64), np.zeros(len(routes.spread)), tokens, types, d_words * scale, d_pairs, unknown)
    figures.spread_counts = np.array([spread.get(x, 0) for x in routes.spread.tolist()], dtype=np.int64)

    @frugal
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part, kind, block, payload in _parts(batches):
            if part != now:
                now, words, counts = part, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if kind == CONTEXTS:
                words, counts, _ = unpack(payload)
                continue
            (asked,) = unpack(payload)
            yield row_batch([(block, ANSWERS, part, pack(_find(words, counts, asked).astype(np.uint32)))])

    wanted = tables.filter(F.col("kind").isin(CONTEXTS, ASKED))
    answers = stored(_by_part(wanted, parts).mapInArrow(answer, ROW), "katz-words")
    model = Katz(figures, tables.filter(F.col("kind").isin(CONTEXTS, PAIRS)), answers)
    if len(routes.spread):
        _spread_backoff(model)
    return model


def _find(words: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """values of the asked words in the ascending words, 0 for others."""
    if not len(words):
        return np.zeros(len(asked), dtype=np.int64)
    at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
    return np.where(words[at] == asked, values[at], 0).astype(np.int64)


class Part:
    """One part's contexts and pairs, ready to score."""

    def __init__(self, f: Figures, rows: dict[int, list[list[np.ndarray]]]):
        ctx, c, kept = rows[CONTEXTS][0] if rows.get(CONTEXTS) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        words, place, r = rows[PAIRS][0] if rows.get(PAIRS) else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        asked, _ = f.routes().asked(words)
        counts = np.concatenate([x[0] for x in rows.get(ANSWERS, [])] or [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(asked)
        c_w = _find(asked[order], counts[order], words)
        spread = f.routes().is_spread(words)
        c_w[spread] = _find(f.spread, f.spread_counts, words[spread])
        self.shared = f.routes().is_spread(ctx)
        c = c.astype(np.int64)
        c[self.shared] = _find(f.spread, f.spread_counts, ctx[self.shared])
        owner = np.repeat(np.arange(len(ctx)), kept.astype(np.int64))
        p, p_w = f.p_pair(r, c[owner]), f.p_word(c_w)[place]
        self.seen = np.bincount(owner, p, len(ctx))
        self.seen_words = np.bincount(owner, p_w, len(ctx))
        self.log_a, scale = log_backoff(self.seen, self.seen_words, c)
        if self.shared.any():
            at = np.searchsorted(f.spread, ctx[self.shared])
            self.log_a[self.shared] = f.spread_log_a[at, 0] if f.spread_log_a.ndim == 2 else 0.0
            scale[self.shared] = f.spread_log_a[at, 1] if f.spread_log_a.ndim == 2 else 1.0
        self.ctx, self.c, self.words = ctx, c, words
        # Pairs are in the order of context and word, so their numbers ascend.
        self.pair = owner * max(len(words), 1) + place
        self.gain = np.log10(p * scale[owner]) - np.log10(p_w)

    def gains(self, ctx: np.ndarray, owner: np.ndarray, words: np.ndarray, place: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        """log10 P(w | v) - log10 P(w) of pairs (ctx[owner], words[place]) that the model holds, `otherwise` for others."""
        if not len(self.pair):
            return otherwise
        v, w = np.searchsorted(self.ctx, ctx), np.searchsorted(self.words, words)
        v_known = self.ctx[np.minimum(v, len(self.ctx) - 1)] == ctx
        w_known = self.words[np.minimum(w, len(self.words) - 1)] == words
        wanted = v[owner] * len(self.words) + w[place]
        at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        return np.where((self.pair[at] == wanted) & v_known[owner] & w_known[place], self.gain[at], otherwise)


def _spread_backoff(model: Katz) -> None:
    """Backoff weights of spread contexts, from sums of all parts."""
    f = model.figures

    @frugal
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _loaded(batches, f):
            at = part.shared
            if at.any():
                yield pa.RecordBatch.from_arrays([pa.array(part.ctx[at].view(np.int64)), pa.array(part.seen[at]), pa.array(part.seen_words[at])], names=["h", "p", "q"])

    rows = _by_part(model.tables.union(model.answers), len(f.keys)).mapInArrow(sums, "h long, p double, q double")
    found = {r["h"] & (2**64 - 1): (r["p"], r["q"]) for r in rows.groupBy("h").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).collect()}
    seen = np.array([found.get(x, (0.0, 0.0)) for x in f.spread.tolist()]).reshape(-1, 2)
    f.spread_log_a = np.stack(log_backoff(seen[:, 0], seen[:, 1], np.maximum(f.spread_counts, 1)), axis=1)


def _loaded(batches: Iterator[pa.RecordBatch], f: Figures) -> Iterator[tuple[tuple, Part]]:
    """Each part once its table is read; with rows that follow the table, once for each of them."""
    now, rows, part = None, {}, None
    for row in _parts(batches):
        if row[0] != now:
            if rows and part is None:
                yield (now, None, None, None), Part(f, rows)
            now, rows, part = row[0], {}, None
        if row[1] <= ANSWERS:
            rows.setdefault(row[1], []).append(unpack(row[3]))
        else:
            if part is None:
                part, rows = Part(f, rows), {}
            yield row, part
    if rows and part is None:
        yield (now, None, None, None), Part(f, rows)


def score(docs: DataFrame, model: Katz) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Null and empty texts are their end alone. Repeated rows are scored (and trained on) one by one. An
    empty table gives an empty result; without training documents all words are unknown.
    """
    f = model.figures
    figures = docs.sparkSession.sparkContext.broadcast(f)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    @frugal
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        routes, block = figures.value.routes(), TaskContext.get().partitionId() << 24
        for some in _blocks(batches, False):
            number, keys = routes.numbers(some), some.keys
            order = np.argsort(number)
            number, d = number[order], some.d[order]
            for part, a, b, payload in _messages(number, some.words):
                yield row_batch([(int(routes.keys[part]), TOKENS, block, pack(*payload, d[a:b]))])
            ids = np.array([0 if k is None else k for k in keys], dtype=np.int64)
            null = np.array([k is None for k in keys], dtype=np.uint8)
            yield row_batch([(int(f.keys[block % len(f.keys)]), DOCUMENTS, block, pack(ids, null))])
            block += 1

    @frugal
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = figures.value
        total = np.log10(f.tokens + 0.5 * (f.types + 1))
        for (_, kind, block, payload), part in _loaded(batches, f):
            if kind is None:
                continue
            if kind == DOCUMENTS:
                yield row_batch([(0, DOCUMENTS, block, payload)])
                continue
            ctx, n_pairs, words, place, n, d = unpack(payload)
            c = _find(part.ctx, part.c, ctx)
            spread = f.routes().is_spread(ctx)
            c[spread] = _find(f.spread, f.spread_counts, ctx[spread])
            known = np.minimum(np.searchsorted(part.ctx, ctx), max(len(part.ctx) - 1, 0))
            log_a = np.where(part.ctx[known] == ctx, part.log_a[known], 0.0) if len(part.ctx) else np.zeros(len(ctx))
            if spread.any():
                log_a[spread] = np.where(c[spread] > 0, f.spread_log_a[np.searchsorted(f.spread, ctx[spread]), 0], 0.0)
            owner = np.repeat(np.arange(len(ctx)), n_pairs.astype(np.int64))
            gain = part.gains(ctx, owner, words, place, log_a[owner])
            gain = gain + np.log10(f.p_word(c))[owner]
            base = (np.log10(c + 0.5) - total)[owner]
            n = n.astype(np.int64)
            docs_, where = np.unique(d, return_inverse=True)
            out = [np.bincount(where, np.repeat(x, n), len(docs_)) for x in (base, gain, (c > 0)[owner])]
            yield row_batch([(0, SUMS, block, pack(docs_, np.bincount(where).astype(np.uint32), out[2].astype(np.uint32), out[0], out[1]))])

    @frugal
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, null, out = None, None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            if ids is None:
                return
            keys = [None if x else i for i, x in zip(ids.tolist(), null.tolist())]
            cols = [pa.array(keys, pa.int64()), pa.array([held_out(k) for k in keys]), pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(np.full(len(keys), f.tokens, np.int64)), pa.array(out[2]), pa.array(out[3])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for _, kind, block, payload in _parts(batches):
            if block != now:
                yield from close()
                now, ids, null, out = block, None, None, None
            got = unpack(payload)
            if kind == DOCUMENTS:
                ids, null = got
                out = [np.zeros(len(ids)) for _ in range(4)]
            else:
                for total, part in zip(out, got[1:]):
                    total[got[0]] += part
        yield from close()

    read = _by_part(model.tables.union(model.answers).union(docs.mapInArrow(tokens, ROW)), len(f.keys))
    partial = read.mapInArrow(sums, ROW)
    dealt = partial.repartition("block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train_and_score(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs))
