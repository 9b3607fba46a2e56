"""One batch of files inside a task: parsed to aligned columns, columns coded in groups, and back.

Cells are bytes. A value that cannot be coded exactly makes its column fall back to plain text, and a
batch that is no table at all is refused (None), which the archive stores raw.
"""

from __future__ import annotations

import bz2
import struct
from collections import Counter
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import numpy as np

from .relate import greedy_groups

PRELUDE_LINES = 4
SEPARATORS = (b",", b"\t", b";", b"|", b" ")
MAX_CODES = 255
#: Kinds of integers from here on are timestamps of STAMPS: what parts a date, and it from the time.
STAMP = 64
STAMPS = ((b"-", b" "), (b"-", b"T"), (b"/", b" "))
EPOCH = datetime(1970, 1, 1)
#: Columns from which on groups of columns side by side are tried, and how many groups.
SPLIT_COLUMNS = 8
SPLIT_GROUPS = 4
#: Rows by which the coding of a column is chosen that has more than twice as many.
PROBE_ROWS = 16384


@dataclass
class Parsed:
    """width columns over all files; heads: (rows, final newline, prelude lines) of each file."""

    width: int
    heads: list[tuple[int, bool, list[bytes]]]
    columns: list[list[bytes]] | None
    separator: bytes = b","


def split_line(line: bytes, sep: bytes) -> list[bytes]:
    """Fields; a separator after an odd number of quotes parts nothing, quotes stay."""
    if b'"' not in line:
        return line.split(sep)
    out, open_, odd = [], [], False
    for piece in line.split(sep):
        open_.append(piece)
        odd ^= piece.count(b'"') & 1 == 1
        if not odd:
            out.append(sep.join(open_))
            open_ = []
    if open_:
        out.append(sep.join(open_))
    return out


def _table(content: bytes, sep: bytes) -> tuple[list[bytes], list[list[bytes]], bool]:
    trailing = content.endswith(b"\n")
    body = content[:-1] if trailing else content
    rows = [split_line(x, sep) for x in body.split(b"\n")] if content else []
    if not rows:
        return [], [], trailing
    widths = Counter(map(len, rows))
    width = max(widths, key=widths.get)
    lead = 0
    while lead < min(PRELUDE_LINES, len(rows)) and len(rows[lead]) != width:
        lead += 1
    return [sep.join(r) for r in rows[:lead]], rows[lead:], trailing


def parse(contents: list[bytes]) -> Parsed | None:
    """The batch as aligned columns, by the separator that gives one width to all rows; the widest wins.

    Of rows that differ in width by an eighth at most (or by one), the narrowest sets it: the last
    column holds what the others have besides, separators and all, so joining gives the rows again.
    Other batches are refused, as is one without columns. The separator is the last field of the first head's place in the coded batch: see encode_columns.
    """
    found, even = None, False
    for sep in SEPARATORS:
        if not any(sep in x for x in contents):
            continue
        tables = [_table(x, sep) for x in contents]
        widths = {len(r) for _, rows, _ in tables for r in rows}
        w = min(widths, default=0)
        if w > 1 and max(widths) - w <= (max(1, w // 8) if len(widths) > 1 else 0) and (found is None or (w, len(widths) == 1) > (found.width, even)):
            even = len(widths) == 1
            columns = [[r[c] for _, rows, _ in tables for r in rows] for c in range(w - 1)]
            columns.append([r[-1] if len(r) == w else sep.join(r[w - 1 :]) for _, rows, _ in tables for r in rows])
            found = Parsed(w, [(len(rows), trailing, prelude) for prelude, rows, trailing in tables], columns, sep)
    return found


def number(values: list[bytes]) -> tuple[int, list[int]] | None:
    """(decimals, integers) if all values are numbers of one form that renders to the same bytes."""
    try:
        whole = list(map(int, values))
    except ValueError:
        whole = []
    if whole and max(map(len, values)) < 19 and list(map(b"%d".__mod__, whole)) == values:
        return 0, whole
    places, out = None, []
    for v in values:
        dot = v.find(b".")
        d = len(v) - dot - 1 if dot >= 0 else 0
        places = d if places is None else places
        if d != places or d > 9 or dot == 0 or not 0 < len(v) < 19:
            return None
        try:
            out.append(int(v.replace(b".", b"", 1)))
        except ValueError:
            return None
    if places is None or any(_number_text(n, places) != v for n, v in zip(out, values)):
        return None
    return places, out


def timestamps(values: list[bytes]) -> tuple[int, list[int]] | None:
    """(kind, seconds since 1970) if all values are of one of STAMPS; kind is a number from STAMP on."""
    for k, (date, mark) in enumerate(STAMPS):
        out = []
        for v in values:
            if len(v) != 19 or v[10:11] != mark:
                break
            try:
                moment = datetime.fromisoformat(v.decode("latin-1").replace("/", "-") if date == b"/" else v.decode("latin-1"))
            except ValueError:
                break
            out.append(int(moment.replace(tzinfo=UTC).timestamp()))
        if out and len(out) == len(values) and all(_number_text(n, STAMP + k) == v for n, v in zip(out, values)):
            return STAMP + k, out
    return None


def integers(values: list[bytes]) -> tuple[int, list[int]] | None:
    """number() or timestamps(): the kind tells how to render."""
    found = number(values)
    return timestamps(values) if found is None else found


def _number_text(n: int, places: int) -> bytes:
    if places >= STAMP:
        date, mark = STAMPS[places - STAMP]
        text = (EPOCH + timedelta(seconds=n)).isoformat(sep=mark.decode()).encode()
        return text.replace(b"-", date) if date != b"-" else text
    if not places:
        return b"%d" % n
    digits = str(abs(n)).rjust(places + 1, "0")
    return f"{'-' if n < 0 else ''}{digits[:-places]}.{digits[-places:]}".encode()


def _number_texts(values: list[int], places: int) -> list[bytes]:
    return [_number_text(n, places) for n in values] if places else list(map(b"%d".__mod__, values))


def _texts(values: list[bytes]) -> bytes:
    return np.array([len(v) for v in values], "<u4").tobytes() + b"".join(values)


def _untexts(data: bytes, n: int) -> list[bytes]:
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", n))]).astype(np.int64) + 4 * n
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encodings(values: list[bytes], found: tuple[int, list[int]] | None | bool = True) -> list[tuple[str, bytes]]:
    """All exact codings of a column, plain first. found: what integers() says of it, if that is known."""
    n = len(values)
    lines = b"\n".join(values)
    plain = b"\x00" + lines if n and b"\n" not in lines.replace(b"\n", b"", max(0, n - 1)) and lines.count(b"\n") == n - 1 else b"\x01" + _texts(values)
    out = [("plain", plain)]
    if not n:
        return out
    distinct = set(values)
    if len(distinct) == 1:
        out.append(("constant", values[0]))
    if len(distinct) <= MAX_CODES and 2 * len(distinct) < n:
        words = sorted(distinct)
        code = {w: i for i, w in enumerate(words)}
        table = _texts(words)
        out.append(("dictionary", struct.pack("<II", len(words), len(table)) + table + bytes(code[v] for v in values)))
    same = np.array([False] + [a == b for a, b in zip(values, values[1:])])
    if same.sum() * 2 > n:
        kept = [v for v, s in zip(values, same.tolist()) if not s]
        out.append(("blank", np.packbits(same).tobytes() + _texts(kept)))
    widths = Counter(map(len, values))
    width, often = widths.most_common(1)[0]
    if width >= 2 and often >= 0.9 * n:
        fixed = [v for v in values if len(v) == width]
        odd = [(i, v) for i, v in enumerate(values) if len(v) != width]
        planes = np.frombuffer(b"".join(fixed), np.uint8).reshape(len(fixed), width).T.tobytes()
        out.append(("places", struct.pack("<II", width, len(odd)) + np.array([i for i, _ in odd], "<u4").tobytes() + planes + _texts([v for _, v in odd])))
    if n > 1 and (found := integers(values) if found is True else found) is not None:
        places, ints = found
        steps = np.diff(np.array(ints, dtype=np.int64))
        if len(steps) and np.abs(np.array(ints, dtype=object)).max() < 2**62:
            kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= steps.min() and steps.max() <= np.iinfo(t).max)
            planes = steps.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()
            out.append(("delta", struct.pack("<BBq", places, np.dtype(kind).itemsize, ints[0]) + planes))
    return out


def decode_column(method: str, data: bytes, n: int) -> list[bytes]:
    if method == "plain":
        return data[1:].split(b"\n") if data[:1] == b"\x00" else _untexts(data[1:], n)
    if method == "constant":
        return [data] * n
    if method == "dictionary":
        k, size = struct.unpack_from("<II", data)
        words = _untexts(data[8 : 8 + size], k)
        return [words[c] for c in data[8 + size :]]
    if method == "blank":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8)), count=n).astype(bool)
        kept = _untexts(data[-(-n // 8) :], int(n - bits.sum()))
        return [kept[i] for i in (np.cumsum(~bits) - 1).tolist()]
    if method == "places":
        width, n_odd = struct.unpack_from("<II", data)
        at = np.frombuffer(data, "<u4", n_odd, 8).tolist()
        start, m = 8 + 4 * n_odd, n - n_odd
        flat = np.ascontiguousarray(np.frombuffer(data, np.uint8, m * width, start).reshape(width, m).T).tobytes()
        fixed = iter([flat[i * width : (i + 1) * width] for i in range(m)])
        odd = dict(zip(at, _untexts(data[start + m * width :], n_odd)))
        return [odd[i] if i in odd else next(fixed) for i in range(n)]
    if method == "delta":
        places, size, base = struct.unpack_from("<BBq", data)
        raw = np.frombuffer(data, np.uint8, (n - 1) * size, 10).reshape(size, n - 1).T
        steps = np.ascontiguousarray(raw).view(f"<i{size}").ravel().astype(np.int64)
        return _number_texts(np.concatenate([[base], base + np.cumsum(steps)]).tolist(), places)
    raise ValueError(f"no method {method!r}")


def choose(values: list[bytes], found: tuple[int, list[int]] | None | bool = True) -> tuple[str, bytes]:
    """The coding whose compressed size is smallest; of equals the first. Of long columns, PROBE_ROWS in the middle decide."""
    size = lambda c: len(bz2.compress(c[1], 1))
    coded = encodings(values, found)
    if len(values) <= 2 * PROBE_ROWS:
        return min(coded, key=size)
    at, methods = (len(values) - PROBE_ROWS) // 2, dict(coded)
    return next((m, methods[m]) for m, _ in sorted(encodings(values[at : at + PROBE_ROWS]), key=size) if m in methods)


def best_difference(target: list[int], earlier: dict[int, list[int]], most: int = 3, probe: int = 400) -> list[int]:
    """Up to `most` earlier columns whose subtraction makes a column cheaper as varints; else none.

    Combinations are ranked on evenly spread rows, and the best is compared on all of them.
    """
    from itertools import combinations

    def cost(values: np.ndarray) -> int:
        z = np.where(values < 0, -2 * values - 1, 2 * values).astype(np.float64)
        return int(np.maximum(1, np.ceil(np.log2(z + 1) / 7)).sum())

    step = max(1, len(target) // probe)
    t, small = np.array(target[::step], np.int64), {c: np.array(v[::step], np.int64) for c, v in earlier.items()}
    found, best = [], cost(t)
    for k in range(1, most + 1):
        for refs in combinations(small, k) if len(small) <= 16 or k == 1 else ():
            c = cost(t - sum(small[r] for r in refs))
            if c < best:
                found, best = list(refs), c
    if found:
        whole = np.array(target, np.int64)
        if cost(whole - sum(np.array(earlier[r], np.int64) for r in found)) >= cost(whole):
            return []
    return found


def difference_column(values: list[int], places: int, refs: list[int], numbers: dict[int, list[int]]) -> bytes:
    left = np.array(values, np.int64) - sum(np.array(numbers[r], np.int64) for r in refs)
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= left.min() and left.max() <= np.iinfo(t).max)
    size = np.dtype(kind).itemsize
    head = struct.pack("<BBB", places, size, len(refs)) + b"".join(struct.pack("<H", r) for r in refs)
    return head + left.astype(kind).view(np.uint8).reshape(-1, size).T.tobytes()


def undifference_column(data: bytes, columns: list[list[bytes]], n: int) -> list[bytes]:
    places, size, k = struct.unpack_from("<BBB", data)
    refs = struct.unpack_from(f"<{k}H", data, 3)
    raw = np.frombuffer(data, np.uint8, n * size, 3 + 2 * k).reshape(size, n).T
    total = np.ascontiguousarray(raw).view(f"<i{size}").ravel().astype(np.int64)
    for r in refs:
        total = total + np.array(integers(columns[r])[1], np.int64)
    return _number_texts(total.tolist(), places)


def vocabulary_groups(columns: list[list[bytes]], share: float = 0.3, parts: int = 300) -> list[list[int]]:
    """Columns grouped by what samples of their values share; relative to each group's first column."""
    words = [set(c[:: max(1, len(c) // parts)]) for c in columns]
    pairs = []
    for a in range(len(words)):
        for b in range(a + 1, len(words)):
            n = len(words[a] & words[b])
            if n > 1 and n >= share * min(len(words[a]), len(words[b])):
                pairs.append((a, b))
    return greedy_groups(pairs, list(range(len(columns))))


def split_groups(width: int, related: list[tuple[int, int]], groups: int = SPLIT_GROUPS) -> list[list[int]]:
    """Columns in up to `groups` groups of about one size; related columns are in one."""
    first = list(range(width))
    for a, b in sorted(related):
        first = [first[a] if x == first[b] else x for x in first]
    sets: dict[int, list[int]] = {}
    for c in range(width):
        sets.setdefault(first[c], []).append(c)
    out: list[list[int]] = [[] for _ in range(min(groups, width))]
    for s in sorted(sets.values(), key=lambda s: (-len(s), s)):
        min(out, key=len).extend(s)
    return [sorted(g) for g in out if g]


def encode_columns(parsed: Parsed) -> list[tuple[list[dict], bytes]]:
    """(columns, body) of each group; the separator leads the first body.

    The smallest of three arrangements: columns with shared vocabularies together, wide tables in
    SPLIT_GROUPS groups of neighbours (a difference with the columns it refers to), all in one.
    """
    found = [integers(c) for c in parsed.columns]
    coded = [choose(c, f) for c, f in zip(parsed.columns, found)]
    numbers = {c: v for c, v in enumerate(found) if v is not None and len(v[1]) > 1 and max(map(abs, v[1])) < 2**60}
    related: list[tuple[int, int]] = []
    for c, (places, values) in numbers.items():
        same = {r: v for r, (p, v) in numbers.items() if r < c and p == places}
        if refs := best_difference(values, same):
            body = difference_column(values, places, refs, same)
            if len(bz2.compress(body, 1)) < len(bz2.compress(coded[c][1], 1)):
                coded[c] = ("difference", body)
                related += [(r, c) for r in refs]

    def body(group: list[int]) -> tuple[list[dict], bytes]:
        notes = [{"col_no": c, "method": coded[c][0], "raw_bytes": len(coded[c][1])} for c in group]
        return notes, b"".join(coded[c][1] for c in group)

    groups = [body(g) for g in vocabulary_groups(parsed.columns)]
    together = [body(list(range(parsed.width)))]
    tried = [groups, together] if len(groups) > 1 else [together]
    if parsed.width >= SPLIT_COLUMNS:
        tried.append([body(g) for g in split_groups(parsed.width, related)])
    size = lambda gs: sum(len(bz2.compress(b, 9)) for _, b in gs)
    out = min(tried, key=size) if len(tried) > 1 else together
    out[0] = (out[0][0], parsed.separator + out[0][1])
    return out


def decode_columns(groups: list[tuple[list[dict], bytes]], parsed: Parsed) -> tuple[bytes, list[list[bytes]]]:
    n = sum(h[0] for h in parsed.heads)
    columns: list[list[bytes]] = [[]] * parsed.width
    separator, late = groups[0][1][:1], {}
    for i, (notes, body) in enumerate(groups):
        at = 1 if i == 0 else 0
        for c in notes:
            data = body[at : at + c["raw_bytes"]]
            at += c["raw_bytes"]
            if c["method"] == "difference":
                late[c["col_no"]] = data
            else:
                columns[c["col_no"]] = decode_column(c["method"], data, n)
    for c in sorted(late):  # a difference refers to earlier columns only
        columns[c] = undifference_column(late[c], columns, n)
    return separator, columns


def render(parsed: Parsed, decoded: tuple[bytes, list[list[bytes]]]) -> list[bytes]:
    """The files again."""
    separator, columns = decoded
    rows = [separator.join(r) for r in zip(*columns)]
    out, at = [], 0
    for n, trailing, prelude in parsed.heads:
        out.append(b"\n".join([*prelude, *rows[at : at + n]]) + (b"\n" if trailing else b""))
        at += n
    return out
