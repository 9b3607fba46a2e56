import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloom.functions import scalars as S
from colloom.operators import archive as A
from colloom.operators import blocks as K
from colloom.operators import encodings as E
from colloom.operators import profile as P
from colloom.operators import relate as R
from colloom.operators import sequences as Q
from colloom.plans import measure as M
from colloom.plans import planner
from colloom.sources import files as L
from colloom.streaming import ingest


def files(spark, contents):
    rows = [(i, f"f{i:03d}", bytearray(c)) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "file_ordinal int, name string, content binary")


# --- sequences across block borders -----------------------------------------------------------


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_previous(spark, block, n):
    keys = random.Random(1).sample(range(60), 25)
    rows = sorted((k, None if k % 5 == 0 else k * k) for k in keys)
    df = spark.createDataFrame(rows, "k long, v long")
    got = sorted((r["k"], r["p"]) for r in Q.previous(df, "k", "v", "p", n, block=block).collect())
    assert got == [(k, rows[i - n][1] if i >= n else None) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_folds_by_group(spark, block):
    r = random.Random(2)
    rows = [(g, k, r.choice([None, r.randint(-9, 9)])) for g in ("a", None) for k in r.sample(range(40), 17)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    total = {(x["g"], x["k"]): x["s"] for x in Q.running_sum(df, "k", "v", "s", ["g"], block).collect()}
    last = {(x["g"], x["k"]): x["l"] for x in Q.carry_forward(df, "k", "v", "l", ["g"], block).collect()}
    place = {(x["g"], x["k"]): x["i"] for x in Q.row_numbers(df, "k", "i", ["g"], block).collect()}
    for g in ("a", None):
        s, keep = 0, None
        for i, (_, k, v) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1])):
            s, keep = s + (v or 0), keep if v is None else v
            assert (total[g, k], last[g, k], place[g, k]) == (s, keep, i)


def test_delta_keeps_the_base(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10000, 10300, 10100, -5])], "k long, v long")
    for n in (1, 2, 3):
        back = E.undelta(E.delta(df, "k", "v", n).drop("v"), "k", n).orderBy("k").collect()
        assert [r["value"] for r in back] == [10000, 10300, 10100, -5]


def test_blank_repeats_with_nulls_and_empty(spark):
    values = [None, None, "", "", "\x00", "\x01", "\x01", None, "a"]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v string")
    b = E.blank_repeats(df, "k", "v")
    assert [r["repeated"] for r in b.orderBy("k").collect()] == [False, True, False, True, False, False, True, False, False]
    assert [r["value"] for r in E.fill_repeats(b.drop("v"), "k").orderBy("k").collect()] == values
    runs = E.run_lengths(df, "k", "v")
    assert [(r["length"], r["value"]) for r in runs.orderBy("run").collect()] == [(2, None), (2, ""), (1, "\x00"), (2, "\x01"), (1, None), (1, "a")]


def test_sub_split(spark):
    df = spark.createDataFrame([('"330,1,N"',), ("x",), ('""',)], "v string")
    got = E.sub_join(E.sub_split(df, "v"), "back").collect()
    assert [(r["v"], r["back"]) for r in got] == [('"330,1,N"', '"330,1,N"'), ("x", None), ('""', '""')]


# --- scalars ----------------------------------------------------------------------------------


def test_zigzag_and_varints(spark):
    values = [0, -1, 1, 63, 64, -64, 127, 128, 2**40, -(2**62), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    rows = df.select("x", S.zigzag(F.col("x")).alias("z")).withColumn("b", S.unzigzag(F.col("z"))).withColumn("n", S.varint_length(F.col("z"))).collect()
    for r in rows:
        z = r["x"] * 2 if r["x"] >= 0 else -2 * r["x"] - 1
        assert r["z"] & (2**64 - 1) == z and r["b"] == r["x"]
        assert r["n"] == max(1, -(-z.bit_length() // 7))


def test_exact_decimals(spark):
    texts = ["6.70", "6.7", "6", "-0.05", "0.00", "-0.00", "01.2", "1.", ".5", "1e3", "", "12345.678901234"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", S.decimals(F.col("t")).alias("d")).collect()}
    assert got == {"6.70": 2, "6.7": 1, "6": 0, "-0.05": 2, "0.00": 2, "-0.00": None, "01.2": None, "1.": None, ".5": None, "1e3": None, "": None, "12345.678901234": 9}
    two = spark.createDataFrame([("6.70",), ("-0.05",), ("0.00",), ("-12.30",)], "t string")
    for r in two.select("t", S.unscaled(S.scaled(F.col("t"), 2), 2).alias("b")).collect():
        assert r["t"] == r["b"]


def plain_split(line, sep):
    out, now, odd = [], "", False
    for i, piece in enumerate(line.split(sep)):
        now = now + sep + piece if odd else piece
        odd = now.count('"') % 2 == 1
        if not odd:
            out.append(now)
    return out + [now] if odd else out


def test_quote_fold(spark):
    r = random.Random(4)
    texts = ["".join(r.choice('a,"b |') for _ in range(r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for sep in (",", "|"):
        for row in df.select("t", S.split_quoted(F.col("t"), sep).alias("f")).collect():
            assert row["f"] == plain_split(row["t"], sep), row["t"]
            assert [x.decode() for x in K.split_line(row["t"].encode(), sep.encode())] == row["f"]


def test_byte_entropy(spark):
    df = spark.createDataFrame([(bytearray(b""),), (bytearray(b"aabb"),), (bytearray(bytes(range(256))),)], "c binary")
    assert [round(r[0], 6) for r in df.select(P.byte_entropy(F.col("c"))).collect()] == [8.0, 1.0, 8.0]


# --- files ------------------------------------------------------------------------------------

NEWLINES = [b"a,b\n1,2\n", b"a,b\n1,2", b"a,b\r\n1,2\r\n", b"a,b\n\n1,2\n", b"", b"\n", b"\n\n", b"http://x\na,b\n1,2\n3,4\n", b"\na,b\n1,2\n3,4\n", bytes(range(256)) * 2, b'"a,b",c\n"d,e",f\n', b'a,"b\nc,d\n']


def test_tables_come_back_byte_for_byte(spark):
    for sep in (",", ";"):
        rows, heads = L.table(files(spark, NEWLINES), sep)
        back = {r["file_ordinal"]: bytes(r["content"]) for r in L.rebuild(rows, heads, sep).collect()}
        for i, c in enumerate(NEWLINES):
            assert back.get(i, b"") == c, (sep, c)


def test_prelude_is_kept_apart(spark):
    rows, heads = L.table(files(spark, [b"url\na,b\n1,2\n3,4\n", b"\na,b\n1,2\n", b"a,b\n1,2\n"]))
    assert [r["prelude"] for r in heads.orderBy("file_ordinal").collect()] == [["url"], [""], []]
    assert rows.filter("file_ordinal = 0").count() == 3


@pytest.mark.parametrize("sep", [",", "\t", ";", "|", None])
def test_sniff(spark, sep):
    text = "\n".join((sep or " ").join([f"n{i}", str(i), "x"]) for i in range(20)).encode()
    r = L.sniff(files(spark, [text, text])).first()
    assert (r["sep"], r["width"]) == (sep, 3)


def test_log_fixed_and_fasta(spark):
    log = "".join(f"Jan {i:02d} 10:00:00 host proc: message number {i} with more words\n" for i in range(60)).encode()
    fixed = b"".join(b"%08d|%10s|%5s|%040d\n" % (i, b"abc", b"xy", i) for i in range(250))
    fasta = b">seq\n" + b"ACGTACGTAC\n" * 50
    f = files(spark, [log, fixed, fasta, b"x\n"])
    assert [r["is_log"] for r in L.looks_like_log(f).orderBy("file_ordinal").collect()] == [True, True, False, False]  # padded columns are fields as well
    assert {r["file_ordinal"]: r["is_fixed"] for r in L.fixed_width(f).collect()} == {0: False, 1: True, 2: False, 3: False}
    assert [r["is_fasta"] for r in L.looks_like_fasta(f).orderBy("file_ordinal").collect()] == [False, False, True, False]
    k = L.log_fields(L.lines(f).filter("file_ordinal = 0"), 3).first()["fields"]
    assert k[:3] == ["Jan", "00", "10:00:00"] and len(k) == 4


def test_batches(spark):
    sizes = [5, 5, 100, 1, 1, 1, 1, 7]
    df = spark.createDataFrame(list(enumerate(sizes)), "file_ordinal long, n_bytes long").repartition(3)
    got = [r["batch_id"] for r in L.batches(df, 3, 10).orderBy("file_ordinal").collect()]
    assert got == [0, 0, 1, 2, 2, 2, 3, 3]


def test_batches_of_pieces(spark):
    """A file that fits a batch is in one; a larger one starts its own and goes on in others."""
    cut = [(0, 4), (0, 2), (1, 3), (1, 3), (2, 6), (2, 6), (2, 6), (3, 1), (4, 1), (5, 1)]
    rows = [(f, i, sum(n for g, n in cut[:i] if g == f), n, sum(m for g, m in cut if g == f)) for i, (f, n) in enumerate(cut)]
    df = spark.createDataFrame(rows, "file_ordinal long, piece long, start long, n_bytes long, file_bytes long").repartition(3)
    got = [r["batch_id"] for r in L.batches(df, 3, 10).orderBy("file_ordinal", "piece").collect()]
    assert got == [0, 0, 1, 1, 2, 3, 4, 4, 4, 5]


# --- archives ---------------------------------------------------------------------------------


def station(i, n=200):
    r = random.Random(i)
    rows = ["station,ts,value,flag"] + [f"S{i:02d},2024-01-{1 + k // 24:02d} {k % 24:02d}:00,{100 + r.randint(0, 400) / 100:.2f},{r.choice(['ok', 'ok', 'bad'])}" for k in range(n)]
    return "\n".join(rows).encode() + b"\n"


CORPORA = {
    "aligned": [station(i) for i in range(12)],
    "numbers": [b"".join(b"%d.%02d,%d\n" % (100 + k, k % 100, k * 3) for k in range(300))] * 3,
    "mixed decimals": [b"".join((b"6.7,x\n", b"6,x\n")[k % 2] for k in range(300))] * 2,
    "far groups": [b"".join(b"w%d,q%d,q%d,w%d\n" % (k % 7, k % 5, k % 5, k % 7) for k in range(300))] * 2,
    "ragged": [b"a,b,c\n1,2\n1,2,3,4,5\n" * 50] * 2,
    "tabs": [b"".join(b"%d\tx%d\t%d\n" % (k, k % 3, k * k) for k in range(200))] * 2,
    "preludes": [b"http://x\n" + station(1), b"\n" + station(2), station(3)[:-1]],
    "marks": [b"\x00,\x01\n,\n\x01,\x00\n" * 100] * 2,
    "others": NEWLINES,
    "binary": [random.Random(9).randbytes(5000), b"", bytes(3000)],
}


@pytest.mark.parametrize("name", CORPORA)
def test_archive_round_trip(spark, tmp_path, name):
    contents = CORPORA[name]
    f = files(spark, contents)
    path = f"file://{tmp_path}/a"
    A.pack_files(f, path, max_files=5)
    back = {r["name"]: bytes(r["content"]) for r in A.unpack(spark, path).collect()}
    assert back == {f"f{i:03d}": c for i, c in enumerate(contents)}
    last = f"f{len(contents) - 1:03d}"
    assert A.get(spark, path, last) == contents[-1]
    assert [r["name"] for r in A.list_files(spark, path).orderBy("name").collect()] == sorted(back)
    routes = {r["route"] for r in A.manifest(spark, path).collect()}
    if name in ("aligned", "numbers", "far groups", "tabs", "preludes"):
        assert routes == {"columns"}
    if name in ("ragged", "binary"):
        assert routes == {"raw"}


@pytest.mark.parametrize("name", ["aligned", "ragged", "tabs", "preludes", "others", "binary"])
def test_archive_cuts_large_files(spark, tmp_path, name):
    import hashlib
    import zlib

    contents = [*CORPORA[name], b"no newline " * 500, b""]
    path = f"file://{tmp_path}/a"
    A.pack_files(files(spark, contents), path, max_files=3, max_bytes=5000, block_bytes=1500)
    stored = spark.read.parquet(f"{path}/manifest")
    assert stored.agg(F.max("n_bytes")).first()[0] <= 1500
    assert stored.groupBy("batch_id", "block").agg(F.sum("n_bytes").alias("n")).agg(F.max("n")).first()[0] <= 1500
    assert stored.groupBy("batch_id").agg(F.sum("n_bytes").alias("n")).agg(F.max("n")).first()[0] <= 5000
    names = [f"f{i:03d}" for i in range(len(contents))]
    want = {n: (len(c), hashlib.sha256(c).hexdigest(), zlib.crc32(c)) for n, c in zip(names, contents)}
    for found in (A.manifest(spark, path), A.piece_digests(A.unpack_pieces(spark, path))):
        assert sorted((r["name"], (r["n_bytes"], r["sha256"], r["crc32"])) for r in found.collect()) == sorted(want.items())
    assert {r["name"]: bytes(r["content"]) for r in A.unpack(spark, path).collect()} == dict(zip(names, contents))
    for i in (0, len(contents) - 2):
        assert A.get(spark, path, names[i]) == contents[i]
    if name in ("aligned", "tabs"):
        shape = {r["name"]: (r["route"], r["width"], r["n_rows"]) for r in A.manifest(spark, path).collect()}
        assert shape["f001"][1:] == (4 if name == "aligned" else 3, contents[1].count(b"\n"))


def test_missing_piece_is_an_error(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    A.pack_files(files(spark, [station(1), station(2)]), path, max_bytes=3000, block_bytes=1500)
    cut = A.unpack_pieces(spark, path)
    for lost in ("start > 0 and start < 1500", "start + octet_length(content) = file_bytes"):
        with pytest.raises(Exception, match="piece"):
            A.piece_digests(cut.filter(f"not (name = 'f001' and {lost})")).collect()


def test_lines_are_sorted_in_pieces(spark):
    r = random.Random(6)
    rows = [(f, "".join(r.choice("a,\t\xe9") for _ in range(r.randint(0, 9)))) for f in (0, 1, 3) for _ in range(500)]
    rows += [(3, "x" * 250), (3, None)]
    got = L.sorted_pieces(spark.createDataFrame(rows, "file_ordinal int, line string").repartition(5), 100).orderBy("file_ordinal", "piece").collect()
    assert max(len(x["content"]) for x in got) <= 100 and len(got) > 60
    for f in (0, 1, 3):
        text = "".join(x + "\n" for x in sorted(x for g, x in rows if g == f and x is not None))
        assert b"".join(bytes(x["content"]) for x in got if x["file_ordinal"] == f) == text.encode("latin-1")


def test_wide_archive_holds_no_file(spark, tmp_path, monkeypatch):
    """q120: files of several pieces, equal to SQL; no list or text of a whole file is made."""
    import duckdb

    from colloom.plans import catalogue, table_queries

    monkeypatch.setattr(A, "BLOCK_BYTES", 4000)
    rows = [(k // 3, k * 7 % 101, k * 5 % 13, 1 + k % 3, float(k % 50)) for k in range(3000)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = table_queries.q120_wide_archive(spark, f"file://{tmp_path}")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "FlatMapGroups" not in plan
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = db.execute(f"SELECT name, sha256, width FROM ({catalogue.SQL['q120_wide_archive']})").fetchall()
    assert sorted((r["name"], r["sha256"], r["width"]) for r in df.collect()) == sorted(want)


def test_archive_beats_best_general_coder(spark, tmp_path):
    import lzma

    contents = CORPORA["aligned"]
    A.pack_files(files(spark, contents), f"file://{tmp_path}/a")
    size = A.column_report(spark, f"file://{tmp_path}/a").agg(F.sum("coded_bytes")).first()[0]
    assert size < 0.9 * len(lzma.compress(b"".join(contents), preset=9 | lzma.PRESET_EXTREME))


def test_folder_pack_verify_and_damage(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(3):
        (src / f"s{i}.csv").write_bytes(station(i, 50))
    A.pack(spark, str(src), f"file://{tmp_path}/a")
    assert {r["state"] for r in A.verify(spark, f"file://{tmp_path}/a", str(src)).collect()} == {"same"}
    (src / "s1.csv").write_bytes(b"changed")
    (src / "new.csv").write_bytes(b"new")
    (src / "s0.csv").unlink()
    got = {r["name"]: r["state"] for r in A.verify(spark, f"file://{tmp_path}/a", str(src)).collect()}
    assert got == {"s0.csv": "missing", "s1.csv": "differs", "s2.csv": "same", "new.csv": "new"}
    assert A.write_files(A.unpack(spark, f"file://{tmp_path}/a"), str(tmp_path / "out")) == 3
    assert (tmp_path / "out" / "s2.csv").read_bytes() == station(2, 50)
    with pytest.raises(KeyError):
        A.get(spark, f"file://{tmp_path}/a", "none")
    evil = spark.createDataFrame([("../evil", bytearray(b"x"))], "name string, content binary")
    with pytest.raises(Exception, match="unsafe name"):
        A.write_files(evil, str(tmp_path / "out"))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=6), st.sampled_from([b"", b"1.50", b"2.25", b"-3.00", b"a\nb", b"7"])), max_size=40))
def test_column_codings_invert(values):
    for method, data in K.encodings(values):
        assert K.decode_column(method, data, len(values)) == values, method


@pytest.mark.parametrize("text", ["100.00 100.50 99.75", "7 8 9 -10", "0.1 0.2 -0.3"])
def test_delta_is_used_and_keeps_base(text):
    values = text.encode().split()
    coded = dict(K.encodings(values))
    assert K.decode_column("delta", coded["delta"], len(values)) == values


def test_delta_declines():
    for text in ("6.7 6", "6.70 6.7", "01 02", "+1 2", "1e3 2", "-0 1", ".5 .6", "5. 6."):
        assert "delta" not in dict(K.encodings(text.encode().split())), text


# --- planning, relations, measurement -----------------------------------------------------------


def test_planner(spark):
    c = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 1, 10), (2, "a", 0, 30), (2, "b", 1, 20), (3, "a", 0, 9)], "k int, coder string, ordinal int, bytes long")
    assert {r["k"]: r["coder"] for r in planner.choose(c, ["k"]).collect()} == {1: "a", 2: "b", 3: "a"}
    raw = spark.createDataFrame([(1, 10), (2, 25), (3, 8)], "k int, bytes long")
    assert {r["k"]: (r["coder"], r["bytes"]) for r in planner.never_worse(c, raw, ["k"]).collect()} == {1: ("raw", 10), 2: ("b", 20), 3: ("raw", 8)}
    assert sorted((r["k"], r["coder"]) for r in planner.narrow(c, ["k"], 1).collect()) == [(1, "a"), (2, "b"), (3, "a")]


def test_greedy_groups_are_not_transitive():
    assert R.greedy_groups([(0, 1), (1, 2), (3, 4)], [0, 1, 2, 3, 4]) == [[0, 1], [2], [3, 4]]


def test_lines_and_cross_fields(spark):
    df = spark.createDataFrame([(i, 3 * i + 5, (i * 37) % 11) for i in range(100)], "x long, y long, z long")
    rows = {(r["y"], r["x"]): (r["a"], r["b"]) for r in R.best_line(df, ["x", "y", "z"]).collect()}
    assert rows["y", "x"] == (3, 5)
    assert R.best_differences(df.withColumn("t", F.expr("x + y + z")), ["x", "y", "z", "t"]).filter("target = 't'").first()["minus"] == "x,y"  # what is left fits one byte either way


def test_sizes_and_split(spark, tmp_path):
    f = files(spark, [station(1), station(2)])
    rows, _ = L.table(f)
    sizes = {(r["arrangement"], r["coder"]): r["bytes"] for r in M.size_matrix(M.arrangements(rows), ["raw", "bz2"]).collect()}
    assert sizes["columns", "bz2"] < sizes["rows by file", "bz2"] < sizes["rows by file", "raw"]
    out = M.storage_sizes(spark.range(100).toDF("x"), f"file://{tmp_path}/s", (("parquet", "zstd"), ("orc", "zstd")))
    assert all(r[2] > 0 and r[4] for r in out)
    cut = M.split_rows(L.lines(files(spark, [station(3)])).select("line_no", "line"), 4).orderBy("file_ordinal").collect()
    assert len(cut) == 4 and b"".join(bytes(c["content"]).split(b"\n", 1)[1] for c in cut) == station(3).split(b"\n", 1)[1]
    assert M.human(999) == "999 B" and M.human(21_291_144) == "21.3 MB"


def test_log_extracts(spark):
    texts = ["id 0123456789abcdef0123 at 2024-01-02 03:04:05.123 ok", "2024-01-02T03:04:05.1 ff00ff00ff00ff00ff", "plain", "has \x01 mark 0123456789abcdef", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, line string")
    taken = M.log_extracts(df)
    assert [r["line"] for r in M.log_restore(taken.drop("line")).orderBy("i").collect()] == texts


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(4):
        (src / f"s{i}.csv").write_bytes(station(i, 40))
    ingest.archive_stream(spark, str(src), f"file://{tmp_path}/arc", f"file://{tmp_path}/cp", max_files=2).awaitTermination()
    parts = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "arc").iterdir() if p.name.startswith("part="))
    assert len(parts) == 2
    back = {r["name"]: bytes(r["content"]) for r in ingest.unpack_parts(spark, f"file://{tmp_path}/arc", parts).collect()}
    assert back == {f"s{i}.csv": station(i, 40) for i in range(4)}


def test_read_files_in_name_order(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / name).write_bytes(name.encode())
    got = [(r["file_ordinal"], r["name"], bytes(r["content"])) for r in L.read_files(spark, str(tmp_path)).orderBy("file_ordinal").collect()]
    assert got == [(0, "a", b"a"), (1, "b", b"b"), (2, "c", b"c")]


def test_difference_columns():
    r = random.Random(8)
    fares = [(r.randint(300, 9000), r.randint(0, 900), r.randint(0, 700)) for _ in range(400)]
    text = "".join(f"{a / 100:.2f},{b / 100:.2f},{c / 100:.2f},{(a + b + c) / 100:.2f}\n" for a, b, c in fares).encode()
    parsed = K.parse([text, text[: text.index(b"\n") + 1]])
    groups = K.encode_columns(parsed)
    methods = {c["col_no"]: c["method"] for notes, _ in groups for c in notes}
    assert methods[3] == "difference"
    assert K.render(parsed, K.decode_columns(groups, parsed)) == [text, text[: text.index(b"\n") + 1]]


def test_sparse_keys_make_few_blocks(spark):
    """Keys far apart (hashes, timestamps) are cut by their span, so summaries stay a fraction of the rows."""
    r = random.Random(5)
    keys = [r.randint(-(2**62), 2**62) for _ in range(500)]
    df = spark.createDataFrame([(k, 1) for k in keys], "k long, v long")
    low, width = Q.key_span(df, "k", 50)
    assert len({(k - low) // width for k in keys}) <= 10
    got = {r["k"]: r["s"] for r in Q.running_sum(df, "k", "v", "s", block=50).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_dictionary_of_many_values(spark):
    df = spark.createDataFrame([(f"v{i * 7919 % 3000}",) for i in range(6000)] + [(None,)], "value string")
    got = {r["value"]: r["code"] for r in E.dictionary(df, "value").collect()}
    assert got == {v: i for i, v in enumerate(sorted({f"v{i}" for i in range(3000)}))}


def test_ragged_rows_and_timestamps():
    rows = [b"%d,2024-01-01 00:%02d:%02d,2024-01-01 01:%02d:%02d" % (i, i // 60, i % 60, i // 60, i % 60) + (b",extra" if i % 9 == 4 else b"") for i in range(600)]
    data = b"\n".join(rows) + b"\n"
    parsed = K.parse([data])
    assert parsed.width == 3
    groups = K.encode_columns(parsed)
    assert K.render(parsed, K.decode_columns(groups, parsed)) == [data]
    assert K.parse([b"a,b\n" * 20 + b"a,b,c,d\n"]) is None
    for stamp in (b"2024-02-29 23:59:59", b"2024-02-29T23:59:59", b"1969/12/31 00:00:01"):
        kind, ints = K.timestamps([stamp])
        assert K._number_text(ints[0], kind) == stamp
    assert K.timestamps([b"2024-02-30 00:00:00"]) is None and K.timestamps([b"2024-02-29 24:00:00"]) is None


def test_split_groups_keep_related_columns():
    assert K.split_groups(8, []) == [[0, 4], [1, 5], [2, 6], [3, 7]]
    out = K.split_groups(9, [(0, 8), (8, 3)])
    assert sorted(c for g in out for c in g) == list(range(9)) and any({0, 3, 8} <= set(g) for g in out)


def test_best_line_rounds_halves_away_from_zero(spark):
    """A slope of exactly minus one half is minus one, as in SQL, in any order of rows; nulls take no part."""
    rows = [(x, 1_000_000 - x // 2) for x in range(-100, 101, 2)] + [(None, 7)]
    df = spark.createDataFrame(rows, "x long, y long").repartition(7)
    got = {(r["y"], r["x"]): (r["a"], r["b"]) for r in R.best_line(df, ["y", "x"]).collect()}
    assert got[("y", "x")] == (-1, 1_000_000)
    assert [R.half_away(n, 2) for n in (-3, -2, -1, 0, 1, 3)] == [-2, -1, -1, 0, 1, 2]


def test_lines_and_files_go_by_chunks(spark, monkeypatch):
    """Files are cut in chunks and joined line by line: no array holds all lines of a file."""
    monkeypatch.setattr(L, "_CHUNK", 7)
    contents = [b"", b"\n", b"\n\n", b"a", b"a,b\nc,d\n", b"\r\n,\n\xe9,long line over chunks\n\nend", b"x" * 30 + b"\n" + b"y" * 7]
    files = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "file_ordinal int, content binary")
    rows = L.lines(files)
    got = {i: [] for i in range(len(contents))}
    for r in rows.orderBy("file_ordinal", "line_no").collect():
        assert r["line_no"] == len(got[r["file_ordinal"]]) and r["trailing"] == contents[r["file_ordinal"]].endswith(b"\n")
        got[r["file_ordinal"]].append(r["line"].encode("latin-1"))
    for i, c in enumerate(contents):
        assert got[i] == ((c[:-1] if c.endswith(b"\n") else c).split(b"\n") if c else [])
    bodies = {r["file_ordinal"]: bytes(r["body"]) for r in L.joined(rows, "line_no").collect()}
    assert bodies == {i: c[:-1] if c.endswith(b"\n") else c for i, c in enumerate(contents) if c}
    for plan in (rows, L.joined(rows, "line_no")):
        assert "collect_list" not in plan._jdf.queryExecution().toString() and "posexplode" not in plan._jdf.queryExecution().toString()
