import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloom.functions import bytes_np as B
from colloom.functions.coders import CODERS, best, decode, encode
from colloom.operators.binary import candidates, compress, decompress, undo
from colloom.sources import containers as C

BYTES = st.binary(max_size=300)
EDGES = [
    b"", b"A", bytes(100_000), b"\xff" * 50_000, random.Random(17).randbytes(20_000), b"a" * 30_000, b"\n" * 10_000,
    b"a,b\n1,2,3\n4\n" * 500, b'"a,b",c\n"d,e",f\n' * 500, "héllo wörld ".encode() * 2000,
]


@settings(max_examples=80, deadline=None)
@given(BYTES, st.integers(1, 9))
def test_stream_transforms_invert(data, p):
    assert B.un_delta(B.delta(data, p), p) == data
    assert B.un_delta2(B.delta2(data, p), p) == data
    assert B.un_zigzag(B.zigzag(data)) == data
    assert B.un_transpose(B.transpose(data, p), p) == data
    for op in ("none", "delta", "xor", "delta2", "lag2"):
        assert B.un_planes(B.planes(data, p, op), p, op) == data
    ops, body = B.best_planes(data, p)
    assert B.un_best_planes(ops, body, p) == data
    assert B.un_run_lengths(B.run_lengths(data)) == data
    row, last = B.bwt(data)
    assert B.un_bwt(row, last) == data


@settings(max_examples=60, deadline=None)
@given(BYTES, st.sampled_from([(4, 2), (8, 2), (8, 4), (12, 4), (6, 1), (16, 8)]), st.booleans())
def test_field_transforms_invert(data, shape, big):
    p, w = shape
    assert B.un_field_delta(B.field_delta(data, p, w, big), p, w, big) == data
    for op in ("sub", "xor"):
        coded = B.cross_fields(data, p, w, 0, [1], op)
        assert B.cross_fields(coded, p, w, 0, [1], op, True) == data
    assert B.line(B.line(data, p, w, 0, 1, -3, 7), p, w, 0, 1, -3, 7, True) == data
    fields = B.dictionary_fields(data, p)
    tables, coded = B.dictionary_coded(data, p, fields)
    assert B.un_dictionary_coded(tables, coded, p) == data


@given(st.lists(st.integers(0, 2**40)))
def test_varints(values):
    data = B.to_varints(values)
    assert B.varints(data) == values
    if values:
        width, fixed = B.varint_widen(data)
        assert B.varint_narrow(width, fixed) == data


def test_varints_refuse_what_would_not_come_back():
    assert B.varints(b"\x80") is None
    assert B.varints(b"\x80\x00") is None


@given(st.lists(st.integers(0, 6)))
def test_base_pack(values):
    assert B.base_unpack(B.base_pack(values, 7), 7) == values


@given(BYTES, st.integers(4, 15))
def test_sub_byte(data, bits):
    values, rest = B.sub_byte(data, bits)
    tail = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[len(values) * bits :]
    assert len(tail) == rest and B.un_sub_byte(values, bits, tail) == data


def test_sub_byte_finds_twelve_bits():
    r = np.random.default_rng(1)
    v = (np.cumsum(r.integers(-3, 4, 4000)) + 2000).astype(np.uint16)
    assert B.best_sub_byte(B.un_sub_byte(v, 12)) == 12
    with pytest.raises(ValueError):
        B.sub_byte(b"abc", 3)


def test_gcd_length_prefix_float_and_waveform():
    v = (np.arange(50) * 300).astype("<u4").tobytes()
    g, body = B.gcd_extract(v, 4)
    assert g == 300 and B.gcd_restore(g, body, 4) == v
    assert B.gcd_extract(np.array([3, 5], "<u2").tobytes(), 2) is None
    data = b"".join(struct.pack("<H", n) + b"x" * n for n in (3, 0, 9))
    assert B.un_length_prefixed(*B.length_prefixed(data)) == data
    assert B.length_prefixed(b"\x09\x00a") is None
    f = np.array([1, -5, 300], "<f4").tobytes()
    assert B.int_to_float(*B.float_to_int(f)) == f
    assert B.float_to_int(np.array([-0.0], "<f4").tobytes()) is None
    assert B.float_to_int(np.array([1.5], "<f4").tobytes()) is None
    s = np.array([5, 6, 100000, -7, -8], dtype=np.int64)
    assert (B.un_waveform_fixed(*B.waveform_fixed(s)) == s).all()
    assert (B.un_waveform_escape(*B.waveform_escape(s)) == s).all()
    n = np.array([1, -2], "<i4").tobytes()
    width, small = B.int_narrow(n, 4)
    assert width == 1 and B.int_widen(width, small, 4) == n


def test_structure():
    r = np.random.default_rng(2)
    rec = np.zeros((500, 7), np.uint8)
    rec[:, 0], rec[:, 1:] = np.arange(500) % 256, r.integers(0, 256, 6)
    data = rec.tobytes()
    assert B.periods(data)[0] == 7
    assert B.header_length(r.integers(0, 256, 1024, dtype=np.uint8).tobytes() + bytes(4096)) == 1024
    assert B.entropy(b"") == 8.0 and B.entropy(b"aaaa") == 0.0
    assert B.segments(bytes(5000))[-1][1] == 5000
    x = np.arange(100)
    assert B.fit_line(3 * x + 11, x) == (3, 11)
    assert B.fit_line(x, np.ones(100)) is None


@pytest.mark.parametrize("data", EDGES, ids=range(len(EDGES)))
def test_edge_cases_come_back_and_never_grow(data):
    name, params, coder, payload = compress(data)
    assert decompress(name, params, coder, payload) == data
    assert len(payload) <= len(data)


@pytest.mark.parametrize("seed", range(6))
def test_every_candidate_inverts(seed):
    r = np.random.default_rng(seed)
    t = np.arange(400)
    rec = np.stack([t * 3, t * 3 + 7, r.integers(0, 50, 400)], axis=1).astype("<u2").tobytes()
    for data in (rec, (t * 100).astype("<u4").tobytes(), B.to_varints((t * 77).tolist()), r.integers(0, 4, 999, dtype=np.uint8).tobytes()):
        for name, params, body in candidates(data):
            assert undo(name, params, body) == data, name


def test_coders():
    for name in CODERS:
        for data in (b"", b"abc" * 1000):
            assert decode(name, encode(name, data)) == data
    assert best(b"")[0] == "raw"
    assert len(best(bytes(10**6))[1]) < 2000
    for name in CODERS:
        if name not in ("raw", "brotli"):
            with pytest.raises(ValueError):
                decode(name, encode(name, b"abc" * 99) + b"x")
            with pytest.raises(ValueError):
                decode(name, encode(name, b"abc" * 99)[:-3])
    with pytest.raises(ValueError):
        decode("nothing", b"")


def mini_seed_record(samples, before, number, length=512):
    head = b"%06dD " % number + b"STA  00BHZNT" + bytes(10) + struct.pack(">H", len(samples)) + bytes(12) + struct.pack(">HH", 64, 48)
    body = C.steim2_encode(samples, before, (length - 64) // 64)
    return (head + struct.pack(">HHBBBB", 1000, 0, 11, 1, length.bit_length() - 1, 0)).ljust(64, b"\0") + body


def test_steim2():
    r = random.Random(3)
    samples = [r.randint(-5, 5)]
    for _ in range(299):
        samples.append(samples[-1] + r.choice([0, 1, -2, 9, -60, 400, -9000]))
    data = mini_seed_record(samples[:100], 0, 1) + mini_seed_record(samples[100:200], samples[99], 2)
    assert C.detect(data)["format"] == "mseed"
    found = C.records(data)
    assert [n for _, _, n in found] == [100, 100]
    got = [C.steim2_samples(data[at : (k + 1) * 512], n) for k, at, n in found]
    assert got[0] + got[1] == samples[:200]
    assert C.can_rebuild(data)
    assert C.steim2_encode([0, 2**31], 0, 7) is None
    assert C.steim2_samples(bytes(64), 3) is None


def test_other_containers():
    f = np.arange(100, dtype="<f4")
    head = bytearray(632)
    struct.pack_into("<i", head, 304, 6)
    struct.pack_into("<i", head, 316, 100)
    struct.pack_into("<i", head, 340, 1)
    assert C.detect(bytes(head) + f.tobytes())["samples"] == 100
    assert C.sac(bytes(head) + f.tobytes()[:40]) is None
    struct.pack_into("<i", head, 316, 9000)
    struct.pack_into("<i", head, 340, -12345)
    cut = C.sac(bytes(head) + bytes(8000))
    assert cut["truncated"] and (cut["samples"], cut["declared"]) == (2000, 9000)
    assert C.sac(bytes(head) + bytes(8001)) is None
    wav = b"RIFF" + struct.pack("<I", 100) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 8) + bytes(8)
    assert C.detect(wav)["channels"] == 2
    assert C.detect(f.tobytes())["format"] == "float32"
    assert C.describe(b"x") == "unknown"


@pytest.mark.parametrize("data", [b">one\nACGTACGT\nACGN\n>two\nAC\n", b">x\nacgt", b">only"])
def test_fasta(data):
    packed, notes = C.fasta_encode(data)
    assert C.fasta_decode(packed, notes) == data
    assert C.fasta_encode(b"no header") is None


def test_text_formats_and_record_candidates():
    from colloom.operators import text_formats as T

    log = "".join(f"Jan {i % 28:02d} 10:{i % 60:02d}:00 host proc[{i}]: message {i} of words\n" for i in range(80)).encode() + b"a b c d\n"
    table = b"# note\n" + b"".join(b"%d,%d.%02d,x%d\n" % (i, i * 3, i % 100, i % 4) for i in range(120))
    fixed = b"".join(b"%08d|%10s|%5s|%020d\n" % (i, b"abc", b"xy", i) for i in range(250)) + b"short"
    fasta = b">seq\n" + b"ACGTACGTACGTNC\n" * 50 + b">two\nACG"
    for name, data in (("log4", log), ("table", table), ("fixed_width", fixed), ("fasta", fasta)):
        coded, back = T.FORMATS[name]
        params, body = coded(data)
        assert back(params, body) == data
        found = {n for n, _, _ in candidates(data)}
        assert name in found
    r = np.random.default_rng(4)
    x = r.integers(0, 4000, 600)
    rec = np.stack([x, 3 * x + 40 + r.integers(0, 3, 600), r.integers(0, 9, 600)], axis=1).astype("<u2").tobytes()
    twelve = B.un_sub_byte((np.cumsum(r.integers(-3, 4, 4000)) + 2000).astype(np.uint16), 12)
    mixed = B.un_delta(bytes(4096)) + np.arange(3000, dtype="<u4").tobytes()
    seen = set()
    for data in (rec, twelve, mixed, log, table, fixed, fasta):
        for name, params, body in candidates(data):
            import json

            assert undo(name, json.loads(json.dumps(params)), body) == data, name
            seen.add(name)
        name, params, coder, payload = compress(data)
        assert decompress(name, json.loads(json.dumps(params)), coder, payload) == data
    assert {"line", "sub_byte", "dictionary", "segments", "table", "log3", "fixed_width", "fasta"} <= seen
