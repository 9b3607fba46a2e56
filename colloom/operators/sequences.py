"""Neighbours and running folds over a global order, without one task that holds it.

A window without partitions would move all rows to one task. Here rows are cut in blocks of the order
key; a window works inside each block, and one summary row per block is carried to the next blocks.
A block spans as many keys as give BLOCK rows on average, so that sparse keys (hashes, timestamps)
make no more blocks than dense ones: only rows / BLOCK summaries meet in one task. `by` names columns whose values have
orders of their own; `key` is a unique integer column. `span` (of key_span) saves a look at the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def key_span(df: DataFrame, key: str, block: int = BLOCK) -> tuple[int, int]:
    """(lowest key, keys of a block): one row of figures comes to the driver. Serves for all columns of the same rows."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    return (0, 1) if not n else (int(low), max(1, -(-(int(high) - int(low) + 1) // -(-n // block))))


def _blocked(df: DataFrame, key: str, by: Sequence[str], block: int, span: tuple[int, int] | None) -> DataFrame:
    """df with __block, ascending with key; a group of `by` has a span of its own, joined to it."""
    at = F.col(key).cast("double")
    if not by:
        low, width = span or key_span(df, key, block)
        return df.withColumn("__block", F.floor((at - F.lit(float(low))) / F.lit(float(width))))
    figures = df.groupBy(*by).agg(F.min(key).cast("double").alias("__low"), F.max(key).cast("double").alias("__high"), F.count(F.lit(1)).alias("__rows"))
    width = F.greatest(F.lit(1.0), (F.col("__high") - F.col("__low") + 1) / F.ceil(F.col("__rows") / block))
    figures = figures.select(*by, "__low", width.alias("__width"))
    on = " and ".join(f"l.`{c}` <=> r.`{c}`" for c in by)
    rows = df.alias("l").join(figures.alias("r"), F.expr(on)).select("l.*", "r.__low", "r.__width")
    return rows.withColumn("__block", F.floor((at - F.col("__low")) / F.col("__width"))).drop("__low", "__width")


def _scan(
    df: DataFrame,
    key: str,
    summary: Column,
    carry: Callable[[Column, Window], Column],
    combine: Callable[[Window, Column], Column],
    name: str,
    by: Sequence[str],
    block: int,
    span: tuple[int, int] | None,
) -> DataFrame:
    """df with `name`: combine(window inside the block, what the earlier blocks carry)."""
    blocked = _blocked(df, key, by, block, span)
    sums = blocked.groupBy(*by, "__block").agg(summary.alias("__sum"))
    order = Window.partitionBy(*by).orderBy("__block") if by else Window.orderBy("__block")
    carried = sums.select(*by, "__block", carry(F.col("__sum"), order).alias("__carry"))
    inside = Window.partitionBy(*by, "__block").orderBy(key)
    on = " and ".join(f"l.`{c}` <=> r.`{c}`" for c in [*by, "__block"])
    joined = blocked.alias("l").join(carried.alias("r"), F.expr(on)).select("l.*", "r.__carry")
    return joined.withColumn(name, combine(inside, F.col("__carry"))).drop("__block", "__carry")


def _before(order: Window) -> Window:
    return order.rowsBetween(Window.unboundedPreceding, -1)


def previous(df: DataFrame, key: str, value: str, name: str, n: int = 1, by: Sequence[str] = (), block: int = BLOCK, span: tuple[int, int] | None = None) -> DataFrame:
    """The value n rows before, null for the first n rows."""
    if n < 1:
        raise ValueError("n counts rows back, from 1")
    last = F.slice(F.reverse(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))), 1, n)
    # The last n rows of a block are found by an ordered window, so that no block is gathered as a list.
    blocked = _blocked(df, key, by, block, span)
    back = Window.partitionBy(*by, "__block").orderBy(F.col(key).desc())
    tail = blocked.select(*by, "__block", key, value, F.row_number().over(back).alias("__rn")).filter(F.col("__rn") <= n)
    sums = tail.groupBy(*by, "__block").agg(last.alias("__sum"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("__block")
    # A block may have fewer than n rows: the lists of n earlier blocks hold n rows at least.
    lists = F.flatten(F.reverse(F.collect_list("__sum").over(order.rowsBetween(-n, -1))))
    carried = sums.select(*by, "__block", F.slice(lists, 1, n).alias("__carry"))
    on = " and ".join(f"l.`{c}` <=> r.`{c}`" for c in [*by, "__block"])
    joined = blocked.alias("l").join(carried.alias("r"), F.expr(on)).select("l.*", "r.__carry")
    inside = Window.partitionBy(*by, "__block").orderBy(key)
    at = F.row_number().over(inside)
    out = joined.withColumn("__at", at).withColumn(name, F.when(F.col("__at") > n, F.lag(value, n).over(inside)).otherwise(F.get("__carry", F.lit(n) - F.col("__at"))["v"]))
    return out.drop("__block", "__carry", "__at")


def running_sum(df: DataFrame, key: str, value: str, name: str, by: Sequence[str] = (), block: int = BLOCK, span: tuple[int, int] | None = None) -> DataFrame:
    """The sum of value up to and with this row; nulls count nothing."""
    return _scan(
        df, key, F.sum(value), lambda s, w: F.sum(s).over(_before(w)),
        lambda w, c: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.coalesce(c, F.lit(0)), name, by, block, span,
    )


def running_xor(df: DataFrame, key: str, value: str, name: str, by: Sequence[str] = (), block: int = BLOCK, span: tuple[int, int] | None = None) -> DataFrame:
    return _scan(
        df, key, F.bit_xor(value), lambda s, w: F.bit_xor(s).over(_before(w)),
        lambda w, c: F.bit_xor(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).bitwiseXOR(F.coalesce(c, F.lit(0))), name, by, block, span,
    )


def carry_forward(df: DataFrame, key: str, value: str, name: str, by: Sequence[str] = (), block: int = BLOCK, span: tuple[int, int] | None = None) -> DataFrame:
    """The last value up to this row that is not null."""
    summary = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(key)))
    return _scan(
        df, key, summary, lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        lambda w, c: F.coalesce(F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), c), name, by, block, span,
    )


def row_numbers(df: DataFrame, key: str, name: str, by: Sequence[str] = (), block: int = BLOCK, span: tuple[int, int] | None = None) -> DataFrame:
    """Places from 0 in the order of key."""
    return _scan(
        df, key, F.count(F.lit(1)), lambda s, w: F.sum(s).over(_before(w)),
        lambda w, c: F.row_number().over(w) - 1 + F.coalesce(c, F.lit(0)), name, by, block, span,
    )
