"""Choice among candidates by measured size: the smallest, of equals the first, never worse than raw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coders import coded_size


def code_sizes(df: DataFrame, key: str, content: str, coders: Sequence[str]) -> DataFrame:
    """(key, coder, ordinal, bytes): each binary value after each coder, long form."""
    sizes = df.select(key, *(coded_size(c)(F.col(content)).alias(f"s{i}") for i, c in enumerate(coders)))
    cells = F.array(*(F.struct(F.lit(c).alias("coder"), F.lit(i).alias("ordinal"), F.col(f"s{i}").alias("bytes")) for i, c in enumerate(coders)))
    return sizes.select(key, F.inline(cells))


def choose(candidates: DataFrame, by: Sequence[str], candidate: str = "coder", size: str = "bytes", ordinal: str = "ordinal") -> DataFrame:
    """(by..., candidate, size) of the cheapest candidate; of equals that of the lowest ordinal."""
    rank = F.struct(size, ordinal)
    return candidates.groupBy(*by).agg(F.min_by(candidate, rank).alias(candidate), F.min(size).alias(size))


def never_worse(candidates: DataFrame, raw: DataFrame, by: Sequence[str], candidate: str = "coder", size: str = "bytes") -> DataFrame:
    """choose() with the raw size as candidate 'raw', which wins ties. raw: by..., bytes."""
    plain = raw.select(*by, F.lit("raw").alias(candidate), F.lit(-1).alias("ordinal"), F.col("bytes").alias(size))
    return choose(candidates.select(*by, candidate, "ordinal", size).unionByName(plain), by, candidate, size)


def narrow(candidates: DataFrame, by: Sequence[str], keep: int, size: str = "bytes", ordinal: str = "ordinal") -> DataFrame:
    """The `keep` cheapest candidates of each group: the screen before a dearer measure."""
    best = F.slice(F.sort_array(F.collect_list(F.struct(size, ordinal))), 1, keep)
    kept = candidates.groupBy(*by).agg(best.alias("__best")).select(*by, F.explode(F.transform("__best", lambda x: x[ordinal])).alias("__ordinal"))
    on = [F.col(f"c.{b}").eqNullSafe(F.col(f"k.{b}")) for b in by]
    return candidates.alias("c").join(kept.alias("k"), [*on, F.col(f"c.{ordinal}") == F.col("k.__ordinal")], "left_semi")
