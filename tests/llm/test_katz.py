import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from colloom.llm import katz as Kz

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return WORD.findall((text or "").translate(LOW))


def is_held(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 1


class Brute:
    """The same model in dictionaries of whole words."""

    def __init__(self, rows):
        self.one, self.two = Counter(), Counter()
        for doc, text in rows:
            if not is_held(doc):
                t = [None, *tokens(text), None]
                self.one.update(t[1:])
                self.two.update(zip(t, t[1:]))
        self.n = sum(self.one.values())
        hist = lambda c: np.bincount([min(x, 7) for x in c.values()] or [0], minlength=8).astype(float)
        self.d1, self.d2 = Kz.discounts(hist(self.one)), Kz.discounts(hist(self.two))
        self.unknown = sum((1 - self.d1[min(c, 5)]) * c for c in self.one.values() if c <= 5) / self.n
        scale = 1.0
        if self.unknown <= 0:
            self.unknown, scale = 1 / (self.n + 1), self.n / (self.n + 1)
        self.p1 = {w: (self.d1[c] if c <= 5 else 1.0) * scale * c / self.n for w, c in self.one.items()}
        if scale == 1.0:
            pass
        self.seen = {}
        for (v, w), r in self.two.items():
            if r >= Kz.MIN_COUNT:
                self.seen.setdefault(v, {})[w] = (self.d2[r] if r <= 5 else 1.0) * r / self.one[v]
        self.a = {}
        for v, s in self.seen.items():
            total = sum(s.values())
            if total > 1 - 1e-9:
                k = self.one[v] / (self.one[v] + 1)
                s = self.seen[v] = {w: p * k for w, p in s.items()}
                total = min(total, 1.0) * k
            self.a[v] = (1 - total) / (1 - sum(self.p1[w] for w in s))

    def p(self, w, v):
        if w in self.seen.get(v, {}):
            return self.seen[v][w]
        return self.a.get(v, 1.0) * self.p1.get(w, self.unknown)

    def row(self, doc, text):
        t = [None, *tokens(text), None]
        v = len(self.one)
        base = sum(math.log10((self.one[w] + 0.5) / (self.n + 0.5 * (v + 1))) for w in t[1:])
        score = sum(math.log10(self.p(w, u)) for u, w in zip(t, t[1:]))
        return doc, is_held(doc), len(t) - 1, sum(self.one[w] > 0 for w in t[1:]), self.n, base, score


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(40)]
    out = [(d, " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(40)], k=r.randint(0, 60)))) for d in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, " \n "), (None, "w1 w2 new"), (3, "w1 w1 w1 w2"), (n + 3, "only-here words-here")]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    return [tuple(x) for x in Kz.score(df, Kz.train(df, **kw)).collect()]


def same(got, rows):
    want = Brute(rows)
    want = [want.row(d, t) for d, t in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[2], round(x[6], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    np.testing.assert_allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9)


@pytest.mark.parametrize("parts", [4, 9])
def test_equals_plain_model(spark, parts):
    rows = corpus(1)
    same(run(spark, rows, parts=parts), rows)


def test_without_spread_contexts(spark, monkeypatch):
    monkeypatch.setattr(Kz, "common_words", lambda docs, parts: np.zeros(0, np.uint64))
    rows = corpus(2)
    same(run(spark, rows), rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(Kz, "BLOCK_TOKENS", 50)
    rows = corpus(3)
    same(run(spark, rows), rows)


def test_pairs_seen_once_are_in_the_model(spark, monkeypatch):
    rows = corpus(6)
    got = run(spark, rows)
    monkeypatch.setattr(Kz, "MIN_COUNT", 1)
    same(got, rows)


def test_probabilities_add_up():
    rows = corpus(4, 200)
    m = Brute(rows)
    words = [*m.one, "never seen"]
    assert abs(sum(m.p1.values()) + m.unknown - 1) < 1e-9
    for v in [None, *list(m.one)[:20]]:
        assert abs(sum(m.p(w, v) for w in words) - 1) < 1e-9


def test_empty_table_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Kz.score(empty, Kz.train(empty)).collect() == []
    held = next(d for d in range(100) if is_held(d))
    got = run(spark, [(held, "a b")])
    assert got[0][:5] == (held, True, 3, 0, 0)


def test_round_trip():
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.uint32), np.array([1.5, 2.5]), np.array([7], dtype=np.int64), np.arange(300, dtype=np.uint32)]
    for a, b in zip(arrays, Kz.unpack(Kz.pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()


def test_beats_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [x for x in Kz.train_and_score(docs).collect() if x["held_out"]]
    assert sum(x["score"] for x in got) > sum(x["base_score"] for x in got)
