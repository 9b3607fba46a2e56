import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colloom.llm import id_files as I
from colloom.llm import packing as P
from colloom.llm.token_ids import Encoder

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SAMPLE = "/root/testdata/sf0.001"


def plain(path, texts):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def ids(packed):
    return [np.frombuffer(x, "<u4").tolist() for x in packed]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_equal_to_whole_texts(spark, path):
    texts = [r["text"] for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").select("text").collect()]
    texts += ["", " ", "a  b\n\n c\t'll X's", "<|endoftext|> hi<|startoftext|>", "\x1c x\x85y\xa0z", "½ ² 東京 é́", "İstanbul Σίσυφος ſ K", "x" * 5000, "don't WE'LL", "a\r\nb \n", "×÷ªº", "a <|endoftext|> b", "<|ENDOFTEXT|><|endoftext|>é"]
    e = Encoder(path, bound=500)
    assert ids(e.encode(texts)) == plain(path, texts)
    assert ids(e.encode(texts)) == plain(path, texts)


def test_added_tokens_are_one_id():
    assert ids(Encoder(BYTE).encode(["a <|endoftext|> b"])) == [[64, 220, 50256, 275]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB z'\n\t.,19éÉßÿ×–’"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_any_text(texts):
    for path in (BYTE, WORD):
        assert ids(encoders[path].encode(texts)) == plain_by[path](texts)


encoders = {p: Encoder(p) for p in (BYTE, WORD)}
_whole = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
plain_by = {p: lambda xs, t=t: [t.encode(x, add_special_tokens=False).ids for x in xs] for p, t in _whole.items()}


# --- packing ----------------------------------------------------------------------------------


def brute_fullest(items, room):
    best = 0
    for mask in range(1 << len(items)):
        s = sum(x for i, x in enumerate(items) if mask >> i & 1)
        if s <= room:
            best = max(best, s)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=10), st.integers(0, 60))
def test_fullest_is_fullest(items, room):
    counts = defaultdict(int)
    for x in items:
        counts[x] += 1
    got = P.fullest(counts, room)
    assert sum(x * n for x, n in got) == brute_fullest(items, room)
    assert all(n <= counts[x] for x, n in got)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 40), max_size=12))
def test_plan_places_every_piece_once(counts):
    patterns = P.plan(counts, 32)
    placed = defaultdict(int)
    for pattern, times in patterns:
        assert sum(x * n for x, n in pattern) <= 32 and times > 0
        for x, n in pattern:
            placed[x] += n * times
    assert dict(placed) == {x: n for x, n in counts.items() if n}
    bins, total = sum(t for _, t in patterns), sum(x * n for x, n in counts.items())
    assert bins <= 2 * -(-total // 32) + 1


def test_plan_is_near_the_bound():
    r = random.Random(1)
    counts = defaultdict(int)
    for _ in range(20000):
        counts[min(1024, int(r.lognormvariate(5.5, 1)) + 1)] += 1
    patterns = P.plan(counts, 1024)
    assert len(patterns) < 8000
    assert sum(t for _, t in patterns) <= 1.002 * sum(x * n for x, n in counts.items()) / 1024 + 1


def check_packing(rows, texts, capacity=1024):
    want = {}
    for key, text_ids in texts:
        want.setdefault(key, []).append(text_ids + [2])
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(want)
    for key, docs in want.items():
        expected = []
        for d in docs:
            first = (len(d) - 1) % capacity + 1
            cuts = [0, *range(first, len(d) + 1, capacity)]
            expected += [(i, a, b - a, zlib.crc32(np.array(d[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[key]) == sorted(expected)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("per_salt", [20_000, 7])
def test_pack_documents(spark, monkeypatch, per_salt):
    monkeypatch.setattr(P, "ROWS_PER_SALT", per_salt)
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    extra = spark.createDataFrame([(900, None, "l"), (901, "", "l"), (None, "a b", "l"), (901, "", "l"), (902, "word " * 5000, "l")], "doc_id long, text string, length string")
    docs = docs.select("doc_id", "text", docs.lang.alias("length")).union(extra)
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = P.pack_documents(docs, BYTE).collect()
    coded = list(zip([k for k, _ in texts], plain(BYTE, [t for _, t in texts])))
    bins = check_packing(rows, coded)
    assert bins <= 1.01 * sum(len(x) + 1 for _, x in coded) / 1024 + 2


def test_pack_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), BYTE).collect() == []


# --- files ------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700).map(sorted))
def test_elias_fano(values):
    ef, at = I.EliasFano.from_bytes(b"xx" + I.EliasFano.encode(np.array(values, dtype=np.uint64)).to_bytes(), 2)
    assert ef.all().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1} if values else ():
        assert ef.select(i) == values[i]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_is_small_and_selects():
    r = np.random.default_rng(0)
    v = np.cumsum(r.integers(1, 2000, 20000)).astype(np.uint64)
    ef = I.EliasFano.encode(v)
    assert len(ef.to_bytes()) * 8 / len(v) < 2.5 + np.log2(1000) + 0.2
    assert [ef.select(i) for i in range(0, 20000, 37)] == v[::37].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=9), max_size=20), st.integers(0, 3))
def test_shard(docs, nulls):
    keys = [None] * min(nulls, len(docs)) + [3 * i - 5 for i in range(len(docs) - min(nulls, len(docs)))]
    s = I.Shard(I.write_shard(keys, [np.array(d, "<u4").tobytes() for d in docs], 2))
    assert [s.key(i) for i in range(s.n_docs)] == keys
    assert [s.document(i).tolist() for i in range(s.n_docs)] == docs
    with pytest.raises(ValueError):
        I.Shard(b"no shard at all")


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_write_and_read(spark, tmp_path, shard):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "text", "n_chars")
    docs = docs.union(spark.createDataFrame([(-7, None, 0), (None, "x y", 1), (5000, "", 1), (5000, "zz top", 1)], docs.schema)).withColumnRenamed("n_chars", "start")
    path = f"file://{tmp_path}/ids"
    I.write_ids(docs.repartition(5), WORD, path, shard_ids=shard)
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in I.read_ids(spark, path).collect()), key=lambda r: r[2])
    rows = sorted(((r["doc_id"] is not None, r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0], r[1] or 0, r[2]))
    at, want = 0, []
    for (known, key, _), x in zip(rows, plain(WORD, [t for _, _, t in rows])):
        want.append((known, key, at, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())))
        at += len(x) + 1
    assert got == want


def test_ids_of_empty_table(spark):
    assert I.write_and_read(spark.createDataFrame([], "doc_id long, text string"), WORD).collect() == []
