"""Column expressions: zigzag, varint lengths, exact number text, delimiter splits, entropy terms.

All of them stay inside whole-stage codegen but for the quote fold, which lines without a quote skip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO-8859-1 maps every byte to one character and back, so text functions serve for bytes.
BYTES = "ISO-8859-1"
INTEGER = r"^-?(0|[1-9][0-9]*)$"
DECIMAL = r"^-?[0-9]+(\.[0-9]+)?$"


def zigzag(x: Column) -> Column:
    """0, -1, 1, -2, 2 ... as 0, 1, 2, 3, 4 ..."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1))))


def zigzag_byte(b: Column) -> Column:
    """The same for signed bytes held as 0..255."""
    return F.when(b < 128, b * 2).otherwise((256 - b) * 2 - 1)


def unzigzag_byte(z: Column) -> Column:
    return F.when(z % 2 == 0, (z / 2).cast("int")).otherwise(256 - ((z + 1) / 2).cast("int"))


def varint_length(u: Column) -> Column:
    """Bytes of a non-negative integer at seven bits each."""
    out = F.lit(10)
    for n in range(9, 0, -1):
        out = F.when(u < F.lit(1 << (7 * n)) if n < 9 else F.shiftrightunsigned(u, 63) == 0, n).otherwise(out)
    return F.when(u < 0, 10).otherwise(out)


def decimals(text: Column) -> Column:
    """Digits after the point of a plain decimal number, null for any other text."""
    plain = text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]{1,9})?$") & ~text.rlike(r"^-0(\.0*)?$")
    return F.when(plain, F.greatest(F.lit(0), F.length(text) - F.locate(".", text)) * (F.locate(".", text) > 0).cast("int"))


def scaled(text: Column, places: int) -> Column:
    """The number as an integer count of 10**-places, exactly; null if it does not fit."""
    dot = F.locate(".", text)
    whole = F.when(dot > 0, F.substring(text, F.lit(1), dot - 1)).otherwise(text)
    part = F.when(dot > 0, F.substring(text, dot + 1, F.lit(9))).otherwise(F.lit(""))
    return F.concat(whole, F.rpad(part, places, "0")).try_cast("bigint")


def unscaled(n: Column, places: int) -> Column:
    """The exact text of n * 10**-places with that many digits after the point."""
    if places == 0:
        return n.cast("string")
    digits = F.lpad(F.abs(n).cast("string"), F.greatest(F.length(F.abs(n).cast("string")), F.lit(places + 1)), F.lit("0"))
    cut = F.length(digits) - places
    return F.concat(F.when(n < 0, "-").otherwise(""), F.substring(digits, F.lit(1), cut), F.lit("."), F.substring(digits, cut + 1, F.lit(places)))


#: The forms of timestamps that are read as integers, as pattern and as Spark's format.
FORMATS = (
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss"),
)


def timestamp_seconds(text: Column, form: int) -> Column:
    """Seconds since 1970 of a text of one of FORMATS, read as UTC; null for any other text."""
    moment = F.try_to_timestamp(F.when(text.rlike(FORMATS[form][0]), F.concat(text, F.lit(" +0000"))), F.lit(FORMATS[form][1] + " Z"))
    return F.unix_timestamp(moment)


def timestamp_text(seconds: Column, form: int) -> Column:
    """The text again, whatever the session's time zone."""
    days, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy/MM/dd" if form == 2 else "yyyy-MM-dd")
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(rest / 3600)), two(F.floor(rest / 60) % 60), two(rest % 60))
    return F.concat(date, F.lit("T" if form == 1 else " "), clock)


def human_size(n: Column) -> Column:
    """A number of bytes as people read it: 999 B, 1.0 KB, 12.3 MB."""
    out = F.format_string("%.1f TB", n / 1e12)
    for unit, size in (("GB", 1e9), ("MB", 1e6), ("KB", 1e3)):
        out = F.when(n < size * 1000, F.format_string(f"%.1f {unit}", n / size)).otherwise(out)
    return F.when(n < 1000, F.format_string("%d B", n)).otherwise(out)


def split_quoted(line: Column, sep: str) -> Column:
    """Fields of a line: a separator inside double quotes does not part them, quotes stay in the value.

    The line is cut at each separator; a piece joins the one before while the quotes so far are odd,
    so that an unclosed quote runs to the end of the line.
    """
    import re

    pieces = F.split(line, re.escape(sep), -1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(False).alias("odd"))

    def step(acc: Column, piece: Column) -> Column:
        text = F.when(acc["odd"], F.concat(acc["open"], F.lit(sep), piece)).otherwise(piece)
        odd = (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1
        done = F.when(odd, acc["done"]).otherwise(F.concat(acc["done"], F.array(text)))
        return F.struct(done.alias("done"), F.when(odd, text).otherwise("").alias("open"), odd.alias("odd"))

    def finish(acc: Column) -> Column:
        return F.when(acc["odd"], F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    folded = F.aggregate(pieces, start, step, finish)
    return F.when(F.contains(line, F.lit('"')), folded).otherwise(pieces)


def split_log(line: Column, k: int) -> Column:
    """k leading fields and the rest of the line, padded with empty fields."""
    parts = F.split(line, " ", k + 1)
    return F.concat(parts, F.array_repeat(F.lit(""), F.lit(k + 1) - F.size(parts)))


def decode_bytes(content: Column) -> Column:
    return F.decode(content, BYTES)


def encode_bytes(text: Column) -> Column:
    return F.encode(text, BYTES)
