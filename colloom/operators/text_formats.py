"""Text files as columns inside a task: tables, logs, fixed-width lines, FASTA. Exact inverses only.

Each encoder gives (params, body) or None; params are small and go with the body. These compete with
the byte transforms by coded size.
"""

from __future__ import annotations

import json
import struct
from collections import Counter

import numpy as np

from ..sources.containers import fasta_decode, fasta_encode
from .blocks import Parsed, choose, decode_column, decode_columns, encode_columns, parse, render


def _join(parts: list[bytes]) -> bytes:
    return struct.pack("<I", len(parts)) + b"".join(struct.pack("<Q", len(p)) for p in parts) + b"".join(parts)


def _cut(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    sizes = struct.unpack_from(f"<{n}Q", data, 4)
    out, at = [], 4 + 8 * n
    for s in sizes:
        out.append(data[at : at + s])
        at += s
    return out


def table_encode(data: bytes) -> tuple[dict, bytes] | None:
    """One delimited file by columns; four rows at least."""
    parsed = parse([data])
    if parsed is None or parsed.heads[0][0] < 4:
        return None
    groups = encode_columns(parsed)
    n, trailing, prelude = parsed.heads[0]
    params = {"width": parsed.width, "rows": n, "trailing": trailing, "prelude": [p.decode("latin-1") for p in prelude], "groups": [g for g, _ in groups]}
    return params, _join([b for _, b in groups])


def table_decode(params: dict, body: bytes) -> bytes:
    head = (params["rows"], params["trailing"], [p.encode("latin-1") for p in params["prelude"]])
    parsed = Parsed(params["width"], [head], None)
    return render(parsed, decode_columns(list(zip(params["groups"], _cut(body))), parsed))[0]


def _columns(columns: list[list[bytes]]) -> tuple[list[str], bytes]:
    coded = [choose(c) for c in columns]
    return [m for m, _ in coded], _join([b for _, b in coded])


def looks_like_log(data: bytes) -> bool:
    """2048 bytes, a final newline, 32 lines in the first 64 KB, 95 % printable, three spaces in each line."""
    if len(data) < 2048 or not data.endswith(b"\n"):
        return False
    head = data[: 1 << 16]
    rows = [x for x in head.split(b"\n")[: -1 if len(data) > len(head) else None] if x]
    printable = np.isin(np.frombuffer(head, np.uint8), np.r_[32:127, 9, 10]).sum()
    return len(rows) >= 32 and printable >= 0.95 * len(head) and min(r.count(b" ") for r in rows) >= 3


def log_encode(data: bytes, k: int) -> tuple[dict, bytes] | None:
    """Lines as k leading fields and a rest, by columns; how many fields a line has is a column too."""
    if not looks_like_log(data):
        return None
    rows = [x.split(b" ", k) for x in data[:-1].split(b"\n")]
    columns = [[b"%d" % len(r) for r in rows]] + [[r[c] if c < len(r) else b"" for r in rows] for c in range(k + 1)]
    methods, body = _columns(columns)
    return {"k": k, "rows": len(rows), "methods": methods}, body


def log_decode(params: dict, body: bytes) -> bytes:
    columns = [decode_column(m, b, params["rows"]) for m, b in zip(params["methods"], _cut(body))]
    rows = [b" ".join(r[1 : 1 + int(r[0])]) for r in zip(*columns)]
    return b"\n".join(rows) + b"\n"


def fixed_encode(data: bytes) -> tuple[dict, bytes] | None:
    """Lines of the most frequent length (16 at least, half of 200 lines) by character place; a bit tells which."""
    trailing = data.endswith(b"\n")
    rows = (data[:-1] if trailing else data).split(b"\n")
    width, n = Counter(map(len, rows)).most_common(1)[0]
    if width < 16 or n * 2 < len(rows) or len(rows) < 200:
        return None
    is_fixed = np.array([len(r) == width for r in rows])
    planes = np.frombuffer(b"".join(r for r in rows if len(r) == width), np.uint8).reshape(n, width).T.tobytes()
    rest = b"\n".join(r for r in rows if len(r) != width)
    return {"width": width, "rows": len(rows), "fixed": n, "trailing": trailing}, _join([np.packbits(is_fixed).tobytes(), planes, rest])


def fixed_decode(params: dict, body: bytes) -> bytes:
    bits, planes, rest = _cut(body)
    width, n = params["width"], params["fixed"]
    is_fixed = np.unpackbits(np.frombuffer(bits, np.uint8), count=params["rows"]).astype(bool).tolist()
    flat = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).tobytes()
    fixed = iter([flat[i * width : (i + 1) * width] for i in range(n)])
    odd = iter(rest.split(b"\n"))
    return b"\n".join(next(fixed) if f else next(odd) for f in is_fixed) + (b"\n" if params["trailing"] else b"")


def fasta_pack(data: bytes) -> tuple[dict, bytes] | None:
    """Two bits a base if nine in ten of the letters after the first line are bases."""
    start = data.find(b"\n") + 1
    head = data[start : start + 4000].replace(b"\n", b"") if data.startswith(b">") and start else b""
    if sum(head.count(x) for x in (b"A", b"C", b"G", b"T")) <= 0.9 * max(1, len(head)):
        return None
    found = fasta_encode(data)
    if found is None:
        return None
    packed, notes = found
    return {}, _join([packed, json.dumps(notes).encode()])


def fasta_unpack(params: dict, body: bytes) -> bytes:
    packed, notes = _cut(body)
    notes = json.loads(notes)
    return fasta_decode(packed, notes | {"heads": [tuple(x) for x in notes["heads"]]})


FORMATS = {
    "table": (table_encode, table_decode),
    "fixed_width": (fixed_encode, fixed_decode),
    "fasta": (fasta_pack, fasta_unpack),
    **{f"log{k}": ((lambda d, k=k: log_encode(d, k)), log_decode) for k in (3, 4, 5, 6)},
}
