"""Column encodings, each with its exact inverse.

A column in long form has `key` (a unique integer order) and `value`. Encoders return plans; nothing
marks a special value inside the data, so any value, also null and empty text, survives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import unzigzag, zigzag
from ..sources.shared import stored
from .sequences import carry_forward, key_span, previous, row_numbers, running_sum, running_xor

#: Rows of a column that one text of a plane holds.
PLANE_ROWS = 1 << 16


def delta(df: DataFrame, key: str, value: str, n: int = 1, by: Sequence[str] = (), span: tuple[int, int] | None = None) -> DataFrame:
    """value less the value n rows before, as `delta`; the first n rows keep theirs (the base)."""
    out = previous(df, key, value, "__prev", n, by, span=span)
    return out.withColumn("delta", F.col(value) - F.coalesce("__prev", F.lit(0))).drop("__prev")


def undelta(df: DataFrame, key: str, n: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """The values from `delta`: running sums, one for each of n interleaved rows."""
    if n == 1:
        return running_sum(df, key, "delta", "value", by)
    placed = row_numbers(df, key, "__at", by).withColumn("__lane", F.col("__at") % n)
    return running_sum(placed, key, "delta", "value", [*by, "__lane"]).drop("__at", "__lane")


def delta2(df: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Differences of differences, as `delta2`."""
    span = None if by else key_span(df, key)
    first = delta(df, key, value, 1, by, span).withColumnRenamed("delta", "__d1")
    return delta(first, key, "__d1", 1, by, span).withColumnRenamed("delta", "delta2").drop("__d1")


def undelta2(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    span = None if by else key_span(df, key)
    once = running_sum(df, key, "delta2", "__d1", by, span=span)
    return running_sum(once, key, "__d1", "value", by, span=span).drop("__d1")


def xor_previous(df: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    out = previous(df, key, value, "__prev", 1, by)
    return out.withColumn("xored", F.col(value).bitwiseXOR(F.coalesce("__prev", F.lit(0)))).drop("__prev")


def unxor(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    return running_xor(df, key, "xored", "value", by)


def zigzagged(df: DataFrame, column: str, name: str = "zigzag") -> DataFrame:
    return df.withColumn(name, zigzag(F.col(column)))


def unzigzagged(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    return df.withColumn(name, unzigzag(F.col(column)))


def blank_repeats(df: DataFrame, key: str, value: str, by: Sequence[str] = (), span: tuple[int, int] | None = None) -> DataFrame:
    """`repeated` says that a value equals the one before; only others are kept in `kept`."""
    rows = df.withColumn("__cell", F.struct(F.col(value).alias("v")))
    rows = previous(rows, key, "__cell", "__prev", 1, by, span=span)
    same = F.col("__prev").isNotNull() & F.col(value).eqNullSafe(F.col("__prev.v"))
    return rows.withColumn("repeated", same).withColumn("kept", F.when(~same, F.col("__cell"))).drop("__cell", "__prev")


def fill_repeats(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    out = carry_forward(df, key, "kept", "__cell", by)
    return out.withColumn("value", F.col("__cell.v")).drop("__cell")


def run_lengths(df: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Runs of equal values: run (from 1), first and last key, length, value."""
    span = None if by else key_span(df, key)
    marked = blank_repeats(df, key, value, by, span).withColumn("__new", (~F.col("repeated")).cast("long"))
    numbered = running_sum(marked, key, "__new", "run", by, span=span)
    return numbered.groupBy(*by, "run").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("length"), F.min_by(value, key).alias("value"))


def expand_runs(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(run, place in the run, value) of every row."""
    return runs.select(*by, "run", F.explode(F.sequence(F.lit(0), F.col("length").cast("int") - 1)).alias("place"), "value")


def dictionary(df: DataFrame, value: str) -> DataFrame:
    """(code, value): distinct values in order of their bytes, coded from 0.

    Values are dealt by ranges and numbered in each; only one count for each range meets in one task.
    The ranges are stored, as a second reading could cut them elsewhere.
    """
    distinct = df.select(F.col(value).alias("value")).filter(F.col(value).isNotNull()).distinct()
    ranges = stored(distinct.repartitionByRange("value").withColumn("__range", F.spark_partition_id()), "dictionary")
    counts = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy("value")) - 1
    return ranges.withColumn("__place", place).join(F.broadcast(offsets), F.col("__range") == F.col("__r")).select((F.col("__place") + F.col("__before")).alias("code"), "value")


def dictionary_encode(df: DataFrame, value: str, codes: DataFrame) -> DataFrame:
    """df with `code`, null for null; Spark broadcasts the codes if they are small."""
    d = codes.select(F.col("value").alias("__v"), "code")
    return df.join(d, F.col(value) == F.col("__v"), "left").drop("__v")


def dictionary_decode(df: DataFrame, codes: DataFrame) -> DataFrame:
    d = codes.select(F.col("code").alias("__c"), "value")
    return df.join(d, F.col("code") == F.col("__c"), "left").drop("__c")


def transpose(df: DataFrame, key: str, value: str, rows: int = PLANE_ROWS) -> DataFrame:
    """(block, pos, text): for each block of `rows` rows and each character place of a fixed-width column its characters in order."""
    placed = row_numbers(df.select(key, value), key, "__at").withColumn("block", F.floor(F.col("__at") / rows))
    chars = placed.select("block", "__at", F.posexplode(F.split(F.col(value), "")).alias("pos", "ch"))
    ordered = F.sort_array(F.collect_list(F.struct("__at", "ch")))
    return chars.groupBy("block", "pos").agg(F.array_join(F.transform(ordered, lambda x: x["ch"]), "").alias("text"))


def untranspose(planes: DataFrame, rows: int = PLANE_ROWS) -> DataFrame:
    """(row, value) from transposed planes; row counts from 0."""
    chars = planes.select("block", "pos", F.posexplode(F.split(F.col("text"), "")).alias("__in", "ch"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "ch")))
    row = (F.col("block") * rows + F.col("__in")).alias("row")
    return chars.groupBy(row).agg(F.array_join(F.transform(ordered, lambda x: x["ch"]), "").alias("value"))


def sub_split(df: DataFrame, value: str) -> DataFrame:
    """Inner comma fields of a quoted cell, as `parts`; null if it is not quoted."""
    quoted = F.col(value).rlike('(?s)^".*"$') & (F.length(value) >= 2)
    return df.withColumn("parts", F.when(quoted, F.split(F.substring(F.col(value), F.lit(2), F.length(value) - 2), ",", -1)))


def sub_join(df: DataFrame, name: str = "value") -> DataFrame:
    return df.withColumn(name, F.concat(F.lit('"'), F.array_join("parts", ","), F.lit('"')))
