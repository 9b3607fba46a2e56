r"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

The four base kinds (email, ip, card, phone) are kept whenever their pattern and check hold. Further
spans (iban by mod-97; cards of 13 to 15 digits by Luhn; secrets, which are values given to a name such
as token, by their entropy) need a score of THRESHOLD, which words nearby raise or lower. The patterns are written so that each character is looked at a bounded number of
times, also in one very long run of digits or letters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("card_short", "iban", "secret")
THRESHOLD = 0.6
CONTEXT = 40
#: Bits a character that a secret's value must have; hexadecimal digits at random have nearly 4.
ENTROPY = 3.0

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# A value of 16 to 256 characters, and what must stand before it: a name that speaks of a secret, then = or :.
_VALUE = re.compile(r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/.-]{16,256}+(?![A-Za-z0-9_+/.-])={0,2}")
_GIVEN = re.compile(
    r"(?:token|secret|passwo?r?d|pwd|credential|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth)[a-z0-9_-]{0,20}[\"']?\s{0,4}(?::=|=>|=|:)\s{0,4}[\"']?(?:bearer\s)?\Z",
    re.IGNORECASE,
)
_BEFORE = 64
# What a score starts from, and words that speak for a kind or against any.
_START = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "card_short": 0.5, "secret": 0.7}
_FOR = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "card_short": ("card", "amex", "american express", "diners", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "secret": ("key", "token", "password", "credential"),
}
_AGAINST = ("example", "version", "test", "isbn", "order number", "tracking")
_AGAINST_WORDS = re.compile(rf"(?<![a-z])(?:{'|'.join(_AGAINST)})(?![a-z])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of international account numbers: letters count 10 to 35, the first four stand last."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Each match holds one @: what precedes it back to the last match, then the domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and not _NOT_LOCAL.match(text[a - 1]):
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            end = m.end()
        else:
            end = max(end, at)
        at = text.find("@", at + 1)
    return out


def _ip_ok(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def entropy(value: str) -> float:
    """Bits a character."""
    counts = Counter(value).values()
    return math.log2(len(value)) - sum(n * math.log2(n) for n in counts) / len(value)


def secrets(text: str) -> list[tuple[int, int]]:
    """Values with a letter, a digit and ENTROPY that are given to a name for secrets, as in token = "…"."""
    out = []
    for m in _VALUE.finditer(text):
        a, value = m.start(), m[0]
        if re.search("[0-9]", value) and re.search("[A-Za-z]", value) and _GIVEN.search(text[max(0, a - _BEFORE) : a]) and entropy(value) >= ENTROPY:
            out.append((a, m.end()))
    return out


def _context_score(kind: str, text: str, a: int, b: int) -> float:
    near = text[max(0, a - CONTEXT) : a].lower() + " " + text[b : b + CONTEXT].lower()
    score = _START[kind]
    if any(w in near for w in _FOR[kind]):
        score += 0.2
    if _AGAINST_WORDS.search(near):
        score -= 0.2
    return round(min(1.0, max(0.0, score)), 2)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in KINDS + EXTRA, then start; offsets are code points. Null is empty."""
    text = text or ""
    spans: list[tuple[str, int, int]] = []
    if "@" in text:
        spans += [("email", a, b) for a, b in emails(text)]
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip_ok(m[0])]
    short = []
    for m in _CARD.finditer(text):
        n = len(d := _digits(m[0])) if m.end() - m.start() < 64 else 99
        if 13 <= n <= 19 and luhn(d):
            (spans if n >= 16 else short).append(("card" if n >= 16 else "card_short", m.start(), m.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    out = [(*s, _context_score(s[0], text, s[1], s[2])) for s in spans]
    more = short + [("iban", m.start(), m.end()) for m in _IBAN.finditer(text) if 15 <= len(c := m[0].replace(" ", "")) <= 34 and mod97(c)]
    more += [("secret", a, b) for a, b in secrets(text)]
    for s in more:
        if (score := _context_score(s[0], text, s[1], s[2])) >= THRESHOLD:
            out.append((*s, score))
    return out


def redact(text: str | None) -> str | None:
    """Each stretch of found characters is replaced by its kind in angle brackets; overlapping spans by the first's."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:] if out else text


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with pii: array<struct<kind, start, end, score>>; all its own columns stay.

    Where docs has a column of that name, the new one's is preceded by as many underscores as it takes.
    Null and empty texts have no spans; repeated rows give repeated results; an empty table, none.
    """
    small_batches(docs.sparkSession)
    at, name = docs.columns.index(text_col), "pii"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    @frugal
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(x)] for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(kind))], names=[*batch.schema.names, name])

    out = docs.withColumn(name, F.lit(None).cast("array<struct<kind:string,start:long,end:long,score:double>>"))
    return docs.mapInArrow(search, out.schema)


def pii_report(docs: DataFrame) -> DataFrame:
    """The counts and digests of every document's spans; n_spans counts all kinds.

    Null and empty texts have none; repeated rows give repeated results; an empty table, none.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    @frugal
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                found = find(text)
                said = [f"{k}:{a}:{b}" for k, a, b, _ in found]
                base = sum(k in KINDS for k, *_ in found)
                for col, kind in zip(cols, KINDS):
                    col.append(sum(k == kind for k, *_ in found))
                cols[4].append(sha256(",".join(said[:base]).encode()).hexdigest())
                cols[5].append(",".join(said))
                cols[6].append(len(said))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(digest, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long")


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with found spans replaced in text, and n_chars (where there is one) of the new text.

    Null and empty texts stay as they are; so do all other columns, repeated rows and empty tables.
    """
    small_batches(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema

    @frugal
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([redact(x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    out = docs.mapInArrow(clean, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out
