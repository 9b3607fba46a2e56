"""Relations between columns: shared vocabularies, differences of columns, straight lines."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import FORMATS, scaled, timestamp_seconds, timestamp_text, unscaled, varint_length, zigzag
from .sequences import row_numbers


def vocabularies(cells: DataFrame) -> DataFrame:
    """(col, value, n_col): distinct values with their column's number of them."""
    distinct = cells.select("col", "value").filter("value is not null").distinct()
    n = distinct.groupBy("col").agg(F.count(F.lit(1)).alias("n_col"))
    return distinct.join(n, "col")


def overlaps(cells: DataFrame) -> DataFrame:
    """(a, b, shared, n_a, n_b, jaccard) of column pairs a < b with common values.

    Only columns of one value are paired: the join is on the value, and a value stands once for each
    column, so the pairs are bounded by the number of columns, not of rows.
    """
    v = vocabularies(cells)
    x, y = v.alias("x"), v.alias("y")
    pairs = x.join(y, F.expr("x.value = y.value and x.col < y.col")).groupBy(F.col("x.col").alias("a"), F.col("y.col").alias("b"))
    out = pairs.agg(F.count(F.lit(1)).alias("shared"), F.max("x.n_col").alias("n_a"), F.max("y.n_col").alias("n_b"))
    return out.withColumn("jaccard", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), 6))


def sampled(cells: DataFrame, parts: int = 300) -> DataFrame:
    """Every max(1, n div parts)-th value of each column, by place in the order of key; a fixed choice, not a random one."""
    n = cells.groupBy("col").agg(F.count(F.lit(1)).alias("__n"))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / parts))
    return row_numbers(cells, "key", "__at", ["col"]).join(n, "col").filter(F.col("__at") % step == 0).drop("__n", "__at")


def shared_vocabularies(cells: DataFrame, threshold: float = 0.5, variety: float = 0.8) -> list[list]:
    """Groups of two columns and more whose vocabularies' Jaccard similarity with the group's first column is over threshold.

    A group's first column has two values at least and at most `variety` of its cells' number.
    """
    sizes = {r["col"]: (r["n"], r["d"]) for r in cells.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("d")).collect()}
    near = {(r["a"], r["b"]) for r in overlaps(cells).filter(F.col("shared") > threshold * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b").collect()}
    used, out = set(), []
    for a in sorted(sizes):
        n, d = sizes[a]
        if a in used or d < 2 or d > n * variety:
            continue
        group = [a, *(b for b in sorted(sizes) if b > a and b not in used and (a, b) in near)]
        used.update(group)
        if len(group) > 1:
            out.append(group)
    return out


def read_integers(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, tuple[str, int]]]:
    """(df with the readable columns as integers, {column: (kind, scale)}).

    kind "ts": all values are of one of FORMATS (scale: its number) and become seconds since 1970 in
    UTC; "num": all are plain decimals, counted in units of 10**-scale of the longest fraction.
    Unreadable columns, and those with a null, are as they were and not in the dictionary.
    """
    cells = []
    for c in columns:
        v = F.col(c)
        fits = [F.sum(F.coalesce(timestamp_seconds(v, i).isNotNull() & v.rlike(p), F.lit(False)).cast("long")).alias(f"t{i}") for i, (p, _) in enumerate(FORMATS)]
        plain = v.rlike(r"^-?[0-9]{1,15}(\.[0-9]{1,9})?$")
        places = F.max(F.when(plain & F.contains(v, F.lit(".")), F.length(v) - F.locate(".", v)).otherwise(0))
        cells.append(F.struct(*fits, F.sum(F.coalesce(plain, F.lit(False)).cast("long")).alias("num"), places.alias("places"), F.count(F.lit(1)).alias("n")).alias(c))
    found, kinds, out = df.agg(*cells).first(), {}, df
    for c in columns:
        r = found[c]
        stamp = next((i for i in range(len(FORMATS)) if r["n"] and r[f"t{i}"] == r["n"]), None)
        if stamp is not None:
            kinds[c], out = ("ts", stamp), out.withColumn(c, timestamp_seconds(F.col(c), stamp))
        elif r["n"] and r["num"] == r["n"]:
            kinds[c], out = ("num", r["places"]), out.withColumn(c, scaled(F.col(c), r["places"]))
    return out, kinds


def render_integers(df: DataFrame, kinds: dict[str, tuple[str, int]]) -> DataFrame:
    """The texts again: timestamps exactly, decimals with `scale` places."""
    for c, (kind, scale) in kinds.items():
        df = df.withColumn(c, timestamp_text(F.col(c), scale) if kind == "ts" else unscaled(F.col(c), scale))
    return df


def greedy_groups(pairs: list[tuple[int, int]], columns: list[int]) -> list[list[int]]:
    """Columns in order; each free one takes all later free ones that it is paired with. Not transitive."""
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    free, out = list(columns), []
    while free:
        seed = free.pop(0)
        group = [seed] + [c for c in free if c in near.get(seed, ())]
        free = [c for c in free if c not in group]
        out.append(group)
    return out


def vocabulary_groups(cells: DataFrame, share: float = 0.3) -> list[list]:
    """Groups of columns whose sampled vocabularies share over one value and `share` of the smaller."""
    found = overlaps(sampled(cells)).filter((F.col("shared") > 1) & (F.col("shared") >= share * F.least("n_a", "n_b")))
    columns = sorted(r["col"] for r in cells.select("col").distinct().collect())
    return greedy_groups([(r["a"], r["b"]) for r in found.select("a", "b").collect()], columns)


def difference(target: Column, *others: Column) -> Column:
    for c in others:
        target = target - c
    return target


def difference_costs(df: DataFrame, columns: list[str], most: int = 3) -> DataFrame:
    """(target, minus, cost, own): bytes as varints of each column and of it less 1 to 3 earlier ones.

    All candidates are expressions of one select over the wide rows: no join, one pass.
    """
    names, costs = [], []
    for i, t in enumerate(columns):
        names.append((t, ""))
        costs.append(F.sum(varint_length(zigzag(F.col(t)))))
        for k in range(1, most + 1):
            for others in combinations(columns[:i], k):
                names.append((t, ",".join(others)))
                costs.append(F.sum(varint_length(zigzag(difference(F.col(t), *map(F.col, others))))))
    row = df.agg(F.array(*(F.struct(F.lit(t).alias("target"), F.lit(m).alias("minus"), c.alias("cost")) for (t, m), c in zip(names, costs))).alias("all"))
    flat = row.select(F.inline("all"))
    own = flat.filter("minus = ''").select(F.col("target").alias("t"), F.col("cost").alias("own"))
    return flat.filter("minus != ''").join(own, F.col("target") == F.col("t")).select("target", "minus", "cost", "own")


def best_differences(df: DataFrame, columns: list[str], most: int = 3) -> DataFrame:
    """For each target the cheapest difference that is cheaper than the column itself; fewer columns first on ties."""
    c = difference_costs(df, columns, most).filter("cost < own")
    rank = F.struct("cost", F.size(F.split("minus", ",")), "minus")
    return c.groupBy("target").agg(F.min_by("minus", rank).alias("minus"), F.min("cost").alias("cost"), F.min("own").alias("own"))


def linear_fit(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """slope and intercept of y over x, rounded to four places."""
    return df.groupBy(*(by or [])).agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"))


def linear_residual(y: Column, x: Column, a: int, b: int) -> Column:
    return y - x * a - b


def linear_value(residual: Column, x: Column, a: int, b: int) -> Column:
    return residual + x * a + b


def half_away(n: int, d: int) -> int:
    """n / d (d over 0), rounded to the nearest integer, halves away from zero as in SQL."""
    return (2 * abs(n) + d) // (2 * d) * (1 if n >= 0 else -1)


def _exact_sums(u: Column, v: Column) -> Column:
    """Count, sums, sums of squares and of products over rows in which both are known."""
    both = u.isNotNull() & v.isNotNull()
    cells = {"n": F.count(F.when(both, 1))} | {k: F.sum(F.when(both, c)) for k, c in (("u", u), ("v", v), ("uu", u * u), ("vv", v * v), ("uv", u * v))}
    return F.struct(*(c.alias(k) for k, c in cells.items()))


def best_line(df: DataFrame, columns: list[str]) -> DataFrame:
    """(y, x, a, b, cost, own) of lines with an integer slope in -127..127, not 0, that make y cheaper."""
    pairs = [(y, x) for y in columns for x in columns if x != y]
    if not pairs:
        return df.sparkSession.createDataFrame([], "y string, x string, a long, b long, cost long, own long")
    # Sums are exact: a slope of one half must not round up or down as the order of rows has it.
    sides = list(combinations(columns, 2))
    sums = [_exact_sums(F.col(u).cast("decimal(19,0)"), F.col(v).cast("decimal(19,0)")).alias(f"f{n}") for n, (u, v) in enumerate(sides)]
    found = df.agg(*sums).first()
    usable = []
    for y, x in pairs:
        n = sides.index((y, x) if (y, x) in sides else (x, y))
        count, u, v, uu, vv, uv = (int(c or 0) for c in found[f"f{n}"])
        sx, sy, sxx = (v, u, vv) if sides[n] == (y, x) else (u, v, uu)
        spread = count * sxx - sx * sx
        a = half_away(count * uv - sx * sy, spread) if spread else 0
        if -127 <= a <= 127 and a:
            usable.append((y, x, a, half_away(sy * sxx - sx * uv, spread)))
    if not usable:
        return df.sparkSession.createDataFrame([], "y string, x string, a long, b long, cost long, own long")
    size = lambda c: F.sum(varint_length(zigzag(c)))
    cells = [
        F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), size(linear_residual(F.col(y), F.col(x), a, b)).alias("cost"), size(F.col(y)).alias("own"))
        for y, x, a, b in usable
    ]
    return df.agg(F.array(*cells).alias("all")).select(F.inline("all")).filter("cost < own")


def cross_field(target: Column, refs: list[Column], op: str, bits: int) -> Column:
    """target less (or xor) its references, within `bits`."""
    mask = F.lit((1 << bits) - 1)
    for r in refs:
        target = target.bitwiseXOR(r) if op == "xor" else target - r
    return target.bitwiseAND(mask)


def uncross_field(residual: Column, refs: list[Column], op: str, bits: int) -> Column:
    mask = F.lit((1 << bits) - 1)
    for r in refs:
        residual = residual.bitwiseXOR(r) if op == "xor" else residual + r
    return residual.bitwiseAND(mask)
