import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloom.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return set(zip(w, w[1:], w[2:], w[3:], w[4:]))


def brute(rows):
    """(doc_id, size, component) of every row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[root(i)] = min(d, lowest.get(root(i), d))
    return sorted(((d, len(s), lowest.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in J.jaccard_components(df).collect()), key=str)


def corpus(seed, n, copies):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    while len(texts) < n:
        base = r.choices(vocabulary, k=r.choice([3, 8, 40, 90]))
        for _ in range(r.randint(1, copies)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append(" ".join(t))
    r.shuffle(texts)
    return list(enumerate(texts))


def test_equals_all_pairs(spark):
    rows = corpus(1, 150, 12) + [(900, None), (901, ""), (902, " \n"), (None, "a b c"), (903, "A b C"), (903, "A b C"), (904, "x"), (None, "lonely words of no one here")]
    assert run(spark, rows) == brute(rows)


def test_blocks_smaller_than_groups(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SETS", 4)
    rows = corpus(2, 120, 30)
    assert run(spark, rows) == brute(rows)


def test_one_size_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SETS", 3)
    r = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for d in range(40):
        t = list(base)
        t[r.randrange(60)] = f"x{d}"
        rows.append((d, " ".join(t)))
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(x) for x in J.jaccard_components(docs).collect()), key=str)
    assert got == brute(rows)


def test_keep_one_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, None, 9), (4, "q r s", 1)], "doc_id long, text string, component long")
    assert sorted(tuple(x) for x in J.keep_one(df).collect()) == [(1, "a b c d e f", 7), (3, None, 9), (4, "q r s", 1)]
    assert sorted(x["doc_id"] for x in J.keep_one(df).collect()) == [1, 3, 4]
    assert J.keep_one(df).columns == df.columns


def test_keep_one_with_repeated_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(12))
    rows = [(2, text("a")), (5, text("a")), (5, text("b")), (7, text("c")), (7, text("d")), (7, text("d")), (8, text("d").upper()), (None, text("d")), (None, text("e")), (9, ""), (9, "")]
    df = spark.createDataFrame([(d, t, {"k": 1}) for d, t in rows], "doc_id long, text string, component map<string,int>")
    got = sorted(((x["doc_id"], x["text"]) for x in J.keep_one(df).collect()), key=str)
    assert got == sorted([(2, text("a")), (5, text("b")), (7, text("c")), (7, text("d")), (None, text("e")), (9, ""), (9, "")], key=str)
    assert J.keep_one(df.limit(0)).collect() == []


@pytest.mark.parametrize("small", [2, 5])
def test_stars_of_large_groups(spark, monkeypatch, small):
    monkeypatch.setattr(J, "SMALL", small)
    rows = corpus(7, 120, 20)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("blocks", [2, 6])
def test_stars_within_blocks(spark, monkeypatch, blocks):
    # One group of distinct near copies in many blocks, of many sizes, some blocks with few of them.
    monkeypatch.setattr(J, "SMALL", 3)
    monkeypatch.setattr(J, "BLOCK_POSTINGS", 40)
    r = random.Random(3)
    base = [f"c{i}" for i in range(90)]
    texts = [" ".join(base[: r.randint(30, 90)] + [f"y{d}"]) for d in range(60)]
    rows = [(d, t) for d, t in enumerate(texts + [t for _, t in corpus(8, 60, 6)] + texts[:5])]
    df = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], SCHEMA).repartition(blocks)
    got = sorted((tuple(x) for x in J.jaccard_components(df).collect()), key=str)
    assert got == brute(rows)
    table = J.set_table(df, [], parts=4).cache()
    assert table.filter("hub is not null").count() > 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 60), st.integers(0, 3)), min_size=1, max_size=60, unique_by=lambda x: (x[0], x[1], x[2])))
def test_combined_blocks_join_the_same(cells):
    """Postings (shingle, size, block) of distinct sets: the same components, with and without stars in the blocks."""
    rows = sorted((h, n, i, block) for i, (h, n, block) in enumerate(cells))

    def components(pairs, stars):
        p = list(range(len(cells)))
        for _ in p:
            for a, b in [*pairs, *stars]:
                p[a] = p[b] = min(p[a], p[b])
        return p

    def near(part, hot):
        h, n, at = (np.array([x[i] for x in part], dtype=np.uint64) for i in range(3))
        pairs, stars = J._near(h, n.astype(np.int64), at, np.array(hot, dtype=bool), 80, 3)
        return [tuple(map(int, x[:2])) for x in pairs], [tuple(map(int, x)) for x in stars]

    pairs, stars = near(rows, [False] * len(rows))
    left, own = [], []
    for block in range(4):
        part = [x for x in rows if x[3] == block]
        if part:
            h, n, at = (np.array([x[i] for x in part]) for i in range(3))
            kept, hot, edges = J._combined(h.astype(np.uint64), n, at.astype(np.uint32), 80, 3)
            own += [(int(e) >> 32, int(e) & (2**32 - 1)) for e in edges]
            left += [(x, y) for x, y, z in zip(part, hot, kept) if z]
    left.sort()
    pairs2, stars2 = near([x for x, _ in left], [y for _, y in left])
    assert sorted(map(sorted, pairs)) == sorted(map(sorted, pairs2))
    assert components([], stars) == components([], stars2 + own)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=14), st.booleans())
def test_forest_connects_what_links_connect(sets, placed):
    arrays = sorted((np.array(sorted(s), dtype=np.uint64) for s in sets), key=len)
    order = J.Order(list(range(0, 40, 3)) if placed else [])
    found = J.linked_pairs(arrays, order, 80)
    n = len(arrays)

    def closure(pairs):
        p = list(range(n))
        for _ in range(n):
            for a, b in pairs:
                p[a] = p[b] = min(p[a], p[b])
        return p

    links = [(i, j) for i in range(n) for j in range(i) if 100 * len(set(arrays[i].tolist()) & set(arrays[j].tolist())) >= 80 * len(set(arrays[i].tolist()) | set(arrays[j].tolist()))]
    assert set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, links)))
    assert closure(found) == closure(links)
    assert len(found) < n


@pytest.mark.parametrize("n,percent,share", [(5, 80, 4), (10, 80, 8), (1, 80, 1), (7, 80, 6)])
def test_needed(n, percent, share):
    assert J.needed(n, percent) == share


def test_hot_shingles_alone_join_nothing(spark, monkeypatch):
    """Texts without near copies that share shingles by chance, all of them hot: no giant component of candidates."""
    monkeypatch.setattr(J, "SMALL", 3)
    r = random.Random(11)
    phrases = [" ".join(f"p{i}.{j}" for j in range(5)) for i in range(12)]
    texts = []
    for d in range(120):
        words = [f"d{d}.{i}" for i in range(200)]
        for i, p in enumerate(r.sample(phrases, 3)):
            words.insert(60 * i, p)
        texts.append(" ".join(words))
    texts += [texts[7] + " more", "few " + texts[7]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], SCHEMA).repartition(48)
    table = J.set_table(df, [], parts=4).cache()
    found = J.candidate_components(table, parts=4).collect()
    largest = max(sum(x["component"] == c for x in found) for c in {x["component"] for x in found})
    assert largest <= 3
    assert run(spark, rows) == brute(rows)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.data())
def test_enough_without_hot_shingles(n, data):
    """A linked pair of which one set is under its bound of hot shingles shares `enough` others."""
    m = data.draw(st.integers(n, n * 100 // 80))
    for k in (J.tolerated(n) - 1, J.tolerated(m) - 1):
        assert J.enough(n, m) <= max(1, J.extra(n) - k)
    assert J.extra(n) - (J.tolerated(m) - 1) >= 1
