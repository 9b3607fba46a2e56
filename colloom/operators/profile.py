"""What is measured of columns before an encoding is chosen. Columns come in long form: col, key, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decimals
from .encodings import blank_repeats


def long_form(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(col, key, value): one row for each cell, values as text."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(F.col(key).alias("key"), cells.alias("c")).select("c.col", "key", "c.value")


def distinct_counts(cells: DataFrame) -> DataFrame:
    """(col, n, n_distinct, mean_length)."""
    by_value = cells.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    return by_value.groupBy("col").agg(F.sum("n").alias("n"), F.count("value").alias("n_distinct"), (F.sum(F.col("n") * F.length("value")) / F.sum("n")).alias("mean_length"))


def constants(cells: DataFrame) -> DataFrame:
    """(col, value) of columns with one value."""
    one = cells.groupBy("col").agg(F.min("value").alias("value"), F.max("value").alias("most"), F.count_if(F.col("value").isNull()).alias("nulls"))
    return one.filter("value = most and nulls = 0").select("col", "value")


def repeat_rates(cells: DataFrame) -> DataFrame:
    """(col, n, repeats, method): blank if over half of the values equal the one before, else plain."""
    marked = blank_repeats(cells, "key", "value", ["col"])
    out = marked.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("repeated").cast("long")).alias("repeats"))
    return out.withColumn("method", F.when(F.col("repeats") * 2 > F.col("n"), "blank").otherwise("plain"))


def uniform_decimals(cells: DataFrame) -> DataFrame:
    """(col, lowest, highest, uniform): whether all values are numbers with one count of decimals."""
    d = cells.withColumn("d", decimals(F.col("value")))
    out = d.groupBy("col").agg(F.min("d").alias("lowest"), F.max("d").alias("highest"), F.count(F.lit(1)).alias("n"), F.count("d").alias("numbers"))
    return out.select("col", "lowest", "highest", (F.col("lowest").eqNullSafe(F.col("highest")) & F.col("lowest").isNotNull() & (F.col("n") == F.col("numbers"))).alias("uniform"))


def modal_widths(cells: DataFrame) -> DataFrame:
    """(col, width, n, share, fixed): most frequent length, of equals that which comes first; fixed from 90 % and 2 on."""
    counted = cells.groupBy("col", F.length("value").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
    top = counted.groupBy("col").agg(F.max(F.struct("n", (-F.col("first")).alias("early"), "width")).alias("t"), F.sum("n").alias("all"))
    share = F.col("t.n") / F.col("all")
    return top.select("col", F.col("t.width").alias("width"), F.col("t.n").alias("n"), share.alias("share"), ((share >= 0.9) & (F.col("t.width") >= 2)).alias("fixed"))


def entropies(cells: DataFrame) -> DataFrame:
    """(col, entropy) in bits, rounded to six places; of no values, 8."""
    by_value = cells.groupBy("col", "value").agg(F.count(F.lit(1)).alias("c"))
    totals = by_value.groupBy("col").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return totals.select("col", F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("entropy"))


def byte_entropy(content: Column) -> Column:
    """Bits a byte of a binary value, by its histogram."""
    chars = F.split(F.decode(content, "ISO-8859-1"), "")
    n = F.octet_length(content)
    counts = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.size(F.filter(chars, lambda c: F.ascii(c) == b)))
    bits = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0))
    return F.when(n == 0, 8.0).otherwise(bits)


def column_order(cells: DataFrame) -> DataFrame:
    """(col, place): by distinct values, then mean length, then name."""
    from pyspark.sql import Window

    order = Window.orderBy("n_distinct", "mean_length", "col")
    return distinct_counts(cells).select("col", "n_distinct", (F.row_number().over(order) - 1).alias("place"))


def int_widths(cells: DataFrame) -> DataFrame:
    """(col, low, high, kind): the narrowest of u8 i8 u16 i16 u32 i32 i64 that holds a column of integers."""
    x = cells.select("col", F.col("value").try_cast("bigint").alias("x"), "value")
    out = x.groupBy("col").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("c"), F.count(F.lit(1)).alias("n")).filter("c = n")
    kind = F.lit("i64")
    for bits in (32, 16, 8):
        kind = F.when((F.col("low") >= -(1 << bits - 1)) & (F.col("high") < 1 << bits - 1), f"i{bits}").otherwise(kind)
        kind = F.when((F.col("low") >= 0) & (F.col("high") < 1 << bits), f"u{bits}").otherwise(kind)
    return out.select("col", "low", "high", kind.alias("kind"))


def whole_floats(df: DataFrame, column: str) -> DataFrame:
    """One row: whether all values are whole and fit 32 bits, and how many are whole."""
    c = F.col(column)
    whole = (F.floor(c) == c) & (F.abs(c) <= 2**31 - 1)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("n_whole")).withColumn("narrow", F.col("n") == F.col("n_whole"))


def gcd(df: DataFrame, column: str) -> DataFrame:
    """One row: the greatest common divisor of a column of integers, 0 of none. Each task folds its own rows first."""

    def fold(parts):
        import numpy as np
        import pyarrow as pa

        total = 0
        for part in parts:
            values = np.abs(part.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            total = int(np.gcd.reduce(values, initial=total))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["gcd"])

    folded = df.select(F.col(column).cast("long").alias("x")).mapInArrow(fold, "gcd long")
    return folded.coalesce(1).mapInArrow(fold, "gcd long")


def position_buckets(df: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """(bucket, n, low, high, mean) of values in stretches of `size` places."""
    return df.groupBy(F.floor(F.col(key) / size).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"))
