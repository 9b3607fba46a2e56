import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from colloom.llm import importance as Im
from colloom.llm import substring_dedup as D
from colloom.llm import decontaminate, pii
from test_filters import base_spans, brute_decontamination, brute_quality
from test_jaccard_join import brute as brute_jaccard
from test_tokens import BYTE, check_packing, plain

SAMPLE = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- substring dedup --------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=80), st.integers(1, 9))
def test_every_window_has_a_seed(values, window):
    h = np.array(values, dtype=np.uint64)
    at = D.winnow(h, window).tolist()
    for i in range(max(1, len(h) - window + 1) if len(h) else 0):
        own = range(i, min(i + window, len(h)))
        assert any(p in at for p in own)
        assert min(h[list(own)]) in h[at]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=10, unique_by=lambda m: m[0]))
def test_best_chain_is_best(pairs):
    pairs.sort()
    xs, ys = [x for x, _ in pairs], [y for _, y in pairs]
    found = D.chains(xs, ys, k=4, gap_cost=0.05, max_gap=1000)
    best = 0.0
    for mask in range(1, 1 << len(pairs)):
        own = [pairs[i] for i in range(len(pairs)) if mask >> i & 1]
        if all(a[1] < b[1] for a, b in zip(own, own[1:])):
            best = max(best, 4 * len(own) - 0.05 * (own[-1][0] - own[0][0] + own[-1][1] - own[0][1]))
    assert (max((s for s, _ in found), default=0.0)) == pytest.approx(best)
    assert sorted(i for _, path in found for i in path) == list(range(len(pairs)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=40, unique=True), st.integers(0, 30))
def test_chains_go_on_within_the_gap(pairs, max_gap):
    pairs.sort()
    found = D.chains([x for x, _ in pairs], [y for _, y in pairs], k=4, gap_cost=0.05, max_gap=max_gap)
    best = []
    for i, (x, y) in enumerate(pairs):
        near = [best[j] - 0.05 * (x - a + y - b) for j, (a, b) in enumerate(pairs[:i]) if 0 < x - a <= max_gap + 4 and 0 < y - b <= max_gap + 4]
        best.append(4 + max(near + [0.0]))
    assert max((s for s, _ in found), default=0.0) == pytest.approx(max(best, default=0.0))
    assert sorted(i for _, path in found for i in path) == list(range(len(pairs)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12))
def test_gap_alignment_is_longest_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert D._edit(a, b) == t[-1][-1]


def passages(spark, rows, extra="score int"):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], f"doc_id long, text string, {extra}")
    return {(r["doc_id"], r["source_doc_id"]): r for r in D.fuzzy_passages(df).collect()}


def prose(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def test_passages(spark):
    r = random.Random(3)
    shared, fuzzy, short = prose(r, 51), prose(r, 120), prose(r, 30)
    edited = list(fuzzy)
    edited[30], edited[70:72] = "new", ["other"]
    docs = {
        1: prose(r, 40) + shared + prose(r, 20), 2: prose(r, 7) + shared, 3: shared + prose(r, 500), 4: prose(r, 90) + fuzzy, 5: edited + prose(r, 9), 6: short + prose(r, 90), 7: prose(r, 60) + short,
        8: prose(r, 200), 9: ["Common"] * 400, 10: ["common"] * 300,
    }
    rows = [(d, " ".join(t)) for d, t in docs.items()] + [(11, None), (12, ""), (None, " ".join(docs[8])), (13, "few words")]
    rows += [(20 + i, " ".join(docs[8])) for i in range(30)] + [(8, " ".join(docs[8]))]
    got = passages(spark, rows)
    plain = {k for k in got if not {9, 10} & set(k)}
    assert plain == {(2, 1), (3, 1), (5, 4)} | {(20 + i, 8) for i in range(30)}
    p = got[2, 1]
    assert (p["start"], p["end"], p["source_start"], p["source_end"], p["n_equal"], p["identity"]) == (7, 58, 40, 91, 51, 1.0)
    p = got[5, 4]
    assert (p["start"], p["end"]) == (0, 119) and (p["source_start"], p["source_end"]) == (90, 210) and p["n_equal"] == 117
    assert all(got[20 + i, 8]["n_equal"] == 200 for i in range(30))


def test_second_passage_of_a_pair(spark):
    r = random.Random(8)
    long, second = prose(r, 400), prose(r, 80)
    docs = {1: long + prose(r, 100) + second, 2: long + prose(r, 150) + second, 3: long[:200] + prose(r, 90) + long[200:]}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string")
    got = sorted((x["doc_id"], x["source_doc_id"], x["start"], x["end"]) for x in D.fuzzy_passages(df).collect())
    assert got == [(2, 1, 0, 400), (2, 1, 550, 630), (3, 1, 0, 200), (3, 1, 290, 490)]


def test_seeds_that_occur_first_elsewhere(spark):
    r = random.Random(9)
    t, u = prose(r, 60), prose(r, 60)
    edited = list(u)
    edited[29] = "new"
    docs = {
        1: prose(r, 9) + t[:26] + prose(r, 30), 2: prose(r, 20) + t[14:44], 3: t[30:] + prose(r, 9), 4: u[:25], 5: prose(r, 70) + u[12:40] + prose(r, 70), 6: u[33:] + prose(r, 50) + u[5:30],
        100: prose(r, 70) + t + prose(r, 30) + u, 200: prose(r, 11) + t, 300: edited + prose(r, 30),
    }
    got = passages(spark, [(d, " ".join(x)) for d, x in docs.items()])
    assert set(got) == {(200, 100), (300, 100)}
    assert [got[200, 100][x] for x in ("start", "end", "source_start", "n_equal")] == [11, 71, 70, 60]
    assert got[300, 100]["n_equal"] == 59


@pytest.mark.parametrize("gap", [0, 3, 40, 50, 64, 65, 90, 200, 650, 900, 1200, 1500])
def test_passages_of_one_pair_at_any_gap(spark, gap):
    """Two shared passages of a pair are found whatever stands between them: as one where the whole is equal enough."""
    r = random.Random(gap)
    one, two = prose(r, 60), prose(r, 60)
    docs = {1: prose(r, 9) + one + prose(r, gap) + two, 2: one + prose(r, gap) + two + prose(r, 5)}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string")
    found = D.fuzzy_passages(df).collect()
    covered = {i for x in found for i in range(x["start"], x["end"])}
    wanted = {*range(60), *range(60 + gap, 120 + gap)}
    assert wanted <= covered and all(x["identity"] >= 0.8 for x in found)


def test_recall_against_all_pairs(spark):
    """Every run of 51 equal words in an earlier document, by brute force over all pairs, lies in a passage."""
    r = random.Random(11)
    pool = [prose(r, 160) for _ in range(12)]
    rows = []
    for d in range(70):
        words = prose(r, r.randrange(30))
        for _ in range(r.randrange(4)):
            p = r.choice(pool)
            a = r.randrange(100)
            words += p[a : a + r.randrange(20, 130)] + prose(r, r.choice([0, 2, 30, 70, 400]))
        rows.append((d, words))
    first = {}
    wanted, by_doc = 0, {}
    for d, words in rows:
        hits = {i for i in range(len(words) - 50) if first.get(tuple(words[i : i + 51]), d) != d}
        by_doc[d] = {j for i in hits for j in range(i, i + 51)}
        wanted += len(by_doc[d])
        for i in range(len(words) - 50):
            first.setdefault(tuple(words[i : i + 51]), d)
    got = {}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    texts = dict(rows)
    for x in D.fuzzy_passages(df).collect():
        got.setdefault(x["doc_id"], set()).update(range(x["start"], x["end"]))
        assert x["source_doc_id"] < x["doc_id"] and x["n_equal"] <= min(x["end"] - x["start"], x["source_end"] - x["source_start"])
        assert len(set(texts[x["doc_id"]][x["start"] : x["end"]]) & set(texts[x["source_doc_id"]][x["source_start"] : x["source_end"]])) >= 0.6 * (x["end"] - x["start"])
    found = sum(len(by_doc[d] & got.get(d, set())) for d in by_doc)
    assert wanted > 3000 and found >= 0.97 * wanted, (found, wanted)


def test_shuffled_requests(spark, monkeypatch):
    import colloom.llm.common as common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    r = random.Random(5)
    t = " ".join(prose(r, 80))
    assert set(passages(spark, [(1, t), (2, t), (3, "x " + t)])) == {(2, 1), (3, 1)}


def test_no_passages(spark):
    assert passages(spark, [(1, "a b c"), (2, None)]) == {}
    assert D.fuzzy_passages(spark.createDataFrame([], DOCS)).collect() == []


# --- importance -------------------------------------------------------------------------------


def test_weights_equal_a_plain_sum(spark):
    r = random.Random(1)
    texts = [" ".join(r.choices("abcdefgh", k=r.randint(0, 30))) for _ in range(40)] + [None, ""]
    rows = [(i, t, 0.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, log_weight double")
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 7 == 0)) for i in range(30)] + [(None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    ratio = Im.fit(df, labels)
    from colloom.llm.common import WordHashes, hash_words, rolling

    def buckets(t):
        flat, _ = hash_words([(t or "").encode().split()], WordHashes())
        return [int(x % Im.BUCKETS) for x in flat] + [int(x % Im.BUCKETS) for x in (rolling(flat, 2) if len(flat) > 1 else [])]

    raw, good = np.zeros(Im.BUCKETS), np.zeros(Im.BUCKETS)
    for i, t, _ in rows:
        for b in buckets(t):
            raw[b] += 1
            good[b] += i < 30 and i % 2 == 1 and i % 7 != 0 and i != 3
    want = np.log((good + Im.SMOOTHING) / (good.sum() * raw / raw.sum() + Im.SMOOTHING))
    np.testing.assert_allclose(ratio, want)
    for x in Im.weigh(df, ratio).collect():
        assert x["log_weight"] == pytest.approx(sum(want[y] for y in buckets(texts[x["doc_id"]])), abs=1e-6)
    # The whole query: k is the labels' share of good ones, the largest keys are kept, ties with the k-th too.
    out = Im.resample(df, labels).collect()
    k = round(np.mean([i % 2 == 1 and i % 7 != 0 and i != 3 for i in range(30)]) * len(rows))
    keys = sorted((x["sort_key"] for x in out), reverse=True)
    assert all(x["kept"] == (x["sort_key"] >= keys[k - 1]) for x in out) and sum(x["kept"] for x in out) == k


def test_ties_at_the_last_place_are_kept(spark):
    df = spark.createDataFrame([(1, "a b c")] * 5 + [(2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = [r["doc_id"] for r in Im.resample(df, labels, k=1).collect() if r["kept"]]
    assert kept in ([1] * 5, [2])


@pytest.mark.parametrize("k", [0, 1, 7, 199, 200, 500])
def test_top_k_is_exact(spark, k):
    r = random.Random(2)
    rows = spark.createDataFrame([(i, r.gauss(0, 1) * 10 ** r.randint(-9, 9)) for i in range(200)], "doc_id long, sort_key double")
    limit = Im._threshold(rows, k)
    keys = sorted((x["sort_key"] for x in rows.collect()), reverse=True)
    assert (limit is None) if not k else limit == keys[min(k, 200) - 1]


def test_held_out_accuracy_and_sampling(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, rest = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    w = {r["doc_id"]: r["log_weight"] for r in Im.weigh(docs, Im.fit(docs, train)).collect()}
    good = [w[r["doc_id"]] for r in rest.collect() if r["quality"] == 1]
    bad = [w[r["doc_id"]] for r in rest.collect() if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    toxic = [w[r["doc_id"]] for r in rest.collect() if r["toxic"] == 1 and r["quality"] == 1]
    clean = [w[r["doc_id"]] for r in rest.collect() if r["toxic"] == 0 and r["quality"] == 1]
    assert np.mean([g > b for g in clean for b in toxic]) > 0.8
    out = Im.resample(docs, labels, k=300).collect()
    assert sum(r["kept"] for r in out) == 300 == len({r["doc_id"] for r in out if r["kept"]})
    assert sorted(out) == sorted(Im.resample(docs.repartition(3), labels, k=300).collect())


def test_importance_edges(spark):
    empty_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert [r["kept"] for r in Im.resample(df, empty_labels).collect()] == [True] * 3
    assert Im.resample(df.limit(0), empty_labels).collect() == []


# --- pipeline ---------------------------------------------------------------------------------


def test_stage_names_and_columns(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "best_fit_packing"]
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "en", "s", 1, "x"), (2, good + " end", "en", None, 2, "y"), (3, "tiny", "en", "s", 3, "z"), (4, None, None, None, None, None), (None, " ".join(f"other{i}" for i in range(40)) + " mail a@b.co", "en", "s", 5, "n"), (1, good, "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS + ", n_words string")
    spark.createDataFrame([(1, "q " * 20)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words"]
    left = docs.collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 1]
    assert [r["text"][-7:] for r in left if r["doc_id"] is None] == ["<EMAIL>"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").collect() == []


def test_pipeline_equals_plain_steps(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SAMPLE}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(d, t) for d, t in docs if not brute_quality(t)[-1]]  # no line is frequent enough here to be removed
    kept = {d for d, n, c in brute_jaccard(docs) if not n or d == c}
    docs = [(d, t) for d, t in docs if d in kept]
    clean = {r[0] for r in brute_decontamination(docs, items) if not r[-1]}
    docs = [(d, t) for d, t in docs if d in clean]
    out = []
    for d, t in docs:
        spans = sorted(((a, -b, k) for k, a, b in base_spans(t)))
        text, at = "", 0
        for a, b, k in spans:
            if -b > at:
                text, at = text + (t[at:a] + f"<{k.upper()}>" if a >= at else ""), -b
        out.append((d, text + t[at:]))
    texts = [(d, ids) for (d, _), ids in zip(out, plain(BYTE, [t for _, t in out]))]
    check_packing(corpus_pipeline.run(spark, SAMPLE).collect(), texts)
