"""Scientific containers: miniSEED with Steim-2, SAC, WAV, float arrays, FASTA. All checks are on bytes.

Detection goes from the most to the least specific. Decoders return None for anything they do not
fully understand, and encoders are used only where their output decodes to the same bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats.
STEIM2 = 11
FRAME = 64
SAC_HEADER = 632
#: File kinds of SAC headers; -12345 stands for an unset field.
SAC_KINDS = (-12345, 1, 2, 3, 4, 5)
SAC_SAMPLES = 1 << 28
#: Bytes after the header that a cut file has more than.
SAC_CUT = 4096
#: Packings of a Steim-2 word by (nibble, upper two bits): how many differences, of how many bits.
PACKINGS = {(1, None): (4, 8), (2, 1): (1, 30), (2, 2): (2, 15), (2, 3): (3, 10), (3, 0): (5, 6), (3, 1): (6, 5), (3, 2): (7, 4)}


# --- detection ------------------------------------------------------------------------------


def mini_seed(data: bytes) -> dict | None:
    """Record length, encoding and data offset of the first record; the next record must start like it."""
    if len(data) < 64 or not data[:6].isdigit() or data[6:7] not in (b"D", b"R", b"Q", b"M"):
        return None
    blockette = struct.unpack_from(">H", data, 46)[0]
    if not 48 <= blockette <= len(data) - 8:
        return None
    kind, _, encoding, order, exponent, _ = struct.unpack_from(">HHBBBB", data, blockette)
    length = 1 << exponent
    if kind != 1000 or not 256 <= length <= 8192 or len(data) % length:
        return None
    if len(data) > length and not (data[length : length + 6].isdigit() and data[length + 6 : length + 7] in (b"D", b"R", b"Q", b"M")):
        return None
    return {"format": "mseed", "record": length, "encoding": encoding, "big": bool(order)}


def sac(data: bytes) -> dict | None:
    """Byte order and samples of a version 6 header with as many floats after it as it declares, or fewer in a cut file."""
    if len(data) < SAC_HEADER + 4:
        return None
    for order in "<>":
        version, npts, kind = (struct.unpack_from(order + "i", data, at)[0] for at in (304, 316, 340))
        if version != 6 or kind not in SAC_KINDS or not 0 < npts <= SAC_SAMPLES:
            continue
        body, whole = len(data) - SAC_HEADER, 4 * npts
        if body == whole or body < whole and body % 4 == 0 and body > SAC_CUT:
            return {"format": "sac", "big": order == ">", "samples": body // 4, "declared": npts, "truncated": body < whole}
    return None


def wav(data: bytes) -> dict | None:
    """Channels, bits and place of the samples of a PCM file."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            if form and form[0] == 1:
                return {"format": "wav", "channels": form[1], "bits": form[5], "start": at + 8, "size": min(size, len(data) - at - 8)}
            return None
        at += 8 + size + (size & 1)
    return None


def float_array(data: bytes) -> dict | None:
    """Whole 32-bit floats, finite, not above 1e30, with at most 40 exponents in the first 64 KB."""
    if len(data) < 64 or len(data) % 4:
        return None
    for order in "<>":
        f = np.frombuffer(data[: 1 << 16], order + "f4")
        with np.errstate(invalid="ignore"):
            if np.isfinite(f).all() and np.abs(f).max() <= 1e30:
                exponents = np.unique((np.frombuffer(f.astype("<f4").tobytes(), "<u4") >> 23) & 255)
                if 1 < len(exponents) <= 40:
                    return {"format": "float32", "big": order == ">", "samples": len(data) // 4}
    return None


def detect(data: bytes) -> dict | None:
    for check in (mini_seed, sac, wav, float_array):
        if (found := check(data)) is not None:
            return found
    return None


def describe(data: bytes) -> str:
    found = detect(data)
    return "unknown" if found is None else ", ".join(f"{k}={v}" for k, v in found.items())


def detect_table(files: DataFrame) -> DataFrame:
    """files with `format` and `details` (a map, null where nothing is known)."""
    schema = f"file_ordinal {files.schema['file_ordinal'].dataType.simpleString()}, format string, details map<string,string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [detect(x or b"") for x in batch.column(1).to_pylist()]
            details = [None if d is None else [(k, str(v)) for k, v in d.items()] for d in found]
            cols = [pa.array([None if d is None else d["format"] for d in found], pa.string()), pa.array(details, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["file_ordinal", "format", "details"])

    return files.select("file_ordinal", "content").mapInArrow(run, schema)


# --- Steim-2 --------------------------------------------------------------------------------


def _signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> (bits - 1) else value


def steim2_differences(body: bytes, n: int) -> tuple[int, int, list[int]] | None:
    """(first sample, last sample, n differences) of a record's frames; the words follow the nibbles of each frame."""
    out: list[int] = []
    first = last = 0
    for f in range(len(body) // FRAME):
        words = struct.unpack_from(">16I", body, f * FRAME)
        for w in range(1, 16):
            if f == 0 and w == 1:
                first = _signed(words[1], 32)
                continue
            if f == 0 and w == 2:
                last = _signed(words[2], 32)
                continue
            nibble = words[0] >> (30 - 2 * w) & 3
            if not nibble:
                continue
            key = (1, None) if nibble == 1 else (nibble, words[w] >> 30)
            if key not in PACKINGS:
                return None
            count, bits = PACKINGS[key]
            out += [_signed(words[w] >> (bits * (count - 1 - i)) & ((1 << bits) - 1), bits) for i in range(count)]
        if len(out) >= n:
            break
    return (first, last, out[:n]) if len(out) >= n else None


def steim2_samples(body: bytes, n: int) -> list[int] | None:
    """Samples of a record, if they end in the last sample that it states."""
    found = steim2_differences(body, n)
    if found is None or n < 1:
        return None
    first, last, d = found
    out = [first]
    for x in d[1:]:
        out.append(out[-1] + x)
    return out if out[-1] == last else None


def steim2_encode(samples: list[int], before: int, frames: int) -> bytes | None:
    """Frames of a record: each word takes the most differences that fit. None if one is too large or they do not fit."""
    d = [samples[0] - before] + [b - a for a, b in zip(samples, samples[1:])]
    shapes = [((k[0], k[1]), *v) for k, v in PACKINGS.items()]
    shapes.sort(key=lambda s: -s[1])
    if not all(-(1 << 31) <= x < 1 << 31 for x in (samples[0], samples[-1])):
        return None
    at, body = 0, []
    for f in range(frames):
        nibbles, words = 0, []
        for w in range(1, 16):
            if f == 0 and w in (1, 2):
                words.append(struct.pack(">i", samples[0] if w == 1 else samples[-1]))
                continue
            if at >= len(d):
                words.append(bytes(4))
                continue
            for (nibble, upper), count, bits in shapes:
                part = d[at : at + count]
                if len(part) == count and all(-(1 << bits - 1) <= x < 1 << bits - 1 for x in part):
                    value = 0
                    for x in part:
                        value = value << bits | x & ((1 << bits) - 1)
                    words.append(struct.pack(">I", value | ((upper or 0) << 30)))
                    nibbles |= nibble << (30 - 2 * w)
                    at += count
                    break
            else:
                return None
        body.append(struct.pack(">I", nibbles) + b"".join(words))
    return b"".join(body) if at >= len(d) else None


def records(data: bytes) -> list[tuple[int, int, int]] | None:
    """(record number, start of its data, samples) of a Steim-2 miniSEED file, or None."""
    form = mini_seed(data)
    if form is None or form["encoding"] != STEIM2:
        return None
    out = []
    for k in range(len(data) // form["record"]):
        at = k * form["record"]
        n, start = struct.unpack_from(">H", data, at + 30)[0], struct.unpack_from(">H", data, at + 44)[0]
        if not 48 <= start < form["record"]:
            return None
        out.append((k, at + start, n))
    return out


def sample_rows(files: DataFrame) -> DataFrame:
    """(file_ordinal, record_no, sample_no, value) of Steim-2 files; files of other kinds have no rows.

    A record that does not decode is one row with a null sample_no and value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ordinal, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = records(data or b"")
                size = mini_seed(data)["record"] if found else 0
                for k, at, n in found or ():
                    s = steim2_samples(data[at : (k + 1) * size], n)
                    places, s = (range(n), s) if s is not None else ([None], [None])
                    cols = [pa.array([ordinal] * len(s), pa.int32()), pa.array([k] * len(s), pa.int32()), pa.array(places, pa.int32()), pa.array(s, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["file_ordinal", "record_no", "sample_no", "value"])

    return files.select(F.col("file_ordinal").cast("int").alias("file_ordinal"), "content").mapInArrow(run, "file_ordinal int, record_no int, sample_no int, value long")


def mini_seed_file(samples: list[int], per_record: int = 100, length: int = 512) -> bytes | None:
    """A Steim-2 file of the samples, per_record in each record; None if a difference does not fit."""
    out, before = [], 0
    for k, at in enumerate(range(0, len(samples), per_record)):
        part = samples[at : at + per_record]
        body = steim2_encode(part, before, (length - FRAME) // FRAME)
        if body is None:
            return None
        head = b"%06dD STA  00BHZNT" % (k % 10**6) + bytes(10) + struct.pack(">H", len(part)) + bytes(12) + struct.pack(">HH", FRAME, 48)
        out.append((head + struct.pack(">HHBBBB", 1000, 0, STEIM2, 1, length.bit_length() - 1, 0)).ljust(FRAME, b"\0") + body)
        before = part[-1]
    return b"".join(out)


def mini_seed_files(series: DataFrame, per_record: int = 100) -> DataFrame:
    """(file_ordinal, content) of series(file_ordinal, samples array<long>): a file is what one task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mini_seed_file(s or [], per_record) for s in batch.column(1).to_pylist()], pa.binary())], names=["file_ordinal", "content"])

    return series.select(F.col("file_ordinal").cast("int").alias("file_ordinal"), "samples").mapInArrow(run, "file_ordinal int, content binary")


def record_table(files: DataFrame) -> DataFrame:
    """(file_ordinal, record_no, n_samples, rebuilt) of Steim-2 files; rebuilt: the file's samples give its frames again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ordinal, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := records(data or b""):
                    n, good = len(found), can_rebuild(data)
                    cols = [pa.array([ordinal] * n, pa.int32()), pa.array([k for k, _, _ in found], pa.int32()), pa.array([c for _, _, c in found], pa.int32()), pa.array([good] * n)]
                    yield pa.RecordBatch.from_arrays(cols, names=["file_ordinal", "record_no", "n_samples", "rebuilt"])

    return files.select(F.col("file_ordinal").cast("int").alias("file_ordinal"), "content").mapInArrow(run, "file_ordinal int, record_no int, n_samples int, rebuilt boolean")


def can_rebuild(data: bytes) -> bool:
    """Whether encoding the samples again gives every record's frames, so that samples may stand for them."""
    found = records(data)
    if not found:
        return False
    size, before = mini_seed(data)["record"], None
    for k, at, n in found:
        body = data[at : (k + 1) * size]
        parsed, samples = steim2_differences(body, n), steim2_samples(body, n)
        if samples is None:
            return False
        start = samples[0] - parsed[2][0] if before is None else before
        if steim2_encode(samples, start, len(body) // FRAME) != body[: len(body) // FRAME * FRAME]:
            return False
        before = samples[-1]
    return True


# --- FASTA ----------------------------------------------------------------------------------


def fasta_encode(data: bytes) -> tuple[bytes, dict] | None:
    """(two bits a base, what is needed besides): headers, line lengths, other letters. None if not exact."""
    if not data.startswith(b">"):
        return None
    trailing = data.endswith(b"\n")
    rows = (data[:-1] if trailing else data).split(b"\n")
    heads = [(i, r) for i, r in enumerate(rows) if r.startswith(b">")]
    body = [r for r in rows if not r.startswith(b">")]
    flat = np.frombuffer(b"".join(body), np.uint8)
    codes = np.full(256, 255, np.uint8)
    codes[list(b"ACGT")] = range(4)
    two = codes[flat]
    odd = np.flatnonzero(two == 255)
    two = np.where(two == 255, 0, two)
    padded = np.concatenate([two, np.zeros(-len(two) % 4, np.uint8)]).reshape(-1, 4)
    packed = (padded[:, 0] | padded[:, 1] << 2 | padded[:, 2] << 4 | padded[:, 3] << 6).astype(np.uint8).tobytes()
    notes = {"n": len(flat), "trailing": trailing, "heads": [(i, r.decode("latin-1")) for i, r in heads], "lengths": [len(r) for r in body], "odd": [(int(i), int(flat[i])) for i in odd]}
    return (packed, notes) if fasta_decode(packed, notes) == data else None


def fasta_decode(packed: bytes, notes: dict) -> bytes:
    p = np.frombuffer(packed, np.uint8)
    two = np.stack([p & 3, p >> 2 & 3, p >> 4 & 3, p >> 6], axis=1).ravel()[: notes["n"]]
    flat = np.frombuffer(b"ACGT", np.uint8)[two].copy()
    for i, letter in notes["odd"]:
        flat[i] = letter
    flat, at, body = flat.tobytes(), 0, []
    for n in notes["lengths"]:
        body.append(flat[at : at + n])
        at += n
    heads, rows, rest = dict(notes["heads"]), [], iter(body)
    for i in range(len(heads) + len(body)):
        rows.append(heads[i].encode("latin-1") if i in heads else next(rest))
    return b"\n".join(rows) + (b"\n" if notes["trailing"] else b"")
