"""Size and time reports: coders over arrangements, Parquet and ORC beside the archive, a CSV cut in files."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coders import CODERS, QUALITIES, decode
from ..operators.archive import compare, pack, unpack
from ..sources.files import read_files
from .planner import code_sizes


def arrangements(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(arrangement, part, content): rows as one stream, column by column, and each column alone.

    rows: file_ordinal, row_no, fields. A part is what a coder sees at once.
    """
    at = F.struct("file_ordinal", "row_no")
    whole = rows.withColumn("line", F.array_join("fields", ","))
    stream = whole.groupBy("file_ordinal").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at.alias("a"), "line"))), lambda x: x["line"]), "\n").alias("text"))
    cells = rows.select(at.alias("a"), F.posexplode("fields").alias("col_no", "value"))
    column = cells.groupBy("col_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "value"))), lambda x: x["value"]), "\n").alias("text"))
    parts = stream.select(F.lit("rows by file").alias("arrangement"), F.col("file_ordinal").cast("int").alias("part"), "text")
    parts = parts.union(column.select(F.lit("columns"), F.col("col_no").cast("int"), "text"))
    return parts.select("arrangement", "part", F.encode("text", "ISO-8859-1").alias("content"))


def size_matrix(parts: DataFrame, coders: list[str] | None = None) -> DataFrame:
    """(arrangement, coder, bytes) over all parts."""
    keyed = parts.withColumn("key", F.struct("arrangement", "part"))
    sizes = code_sizes(keyed, "key", "content", coders or list(CODERS))
    return sizes.groupBy(F.col("key.arrangement").alias("arrangement"), "coder").agg(F.sum("bytes").alias("bytes"))


def storage_sizes(df: DataFrame, path: str, formats: tuple[tuple[str, str], ...] = (("parquet", "snappy"), ("parquet", "zstd"), ("parquet", "gzip"), ("orc", "zstd"), ("orc", "snappy"))) -> list[tuple[str, str, int, float, bool]]:
    """(format, codec, bytes, seconds, same rows back) of a table written each way; bytes by Spark's own file listing."""
    spark, out = df.sparkSession, []
    for kind, codec in formats:
        where, start = f"{path}/{kind}-{codec}", time.perf_counter()
        df.write.mode("overwrite").option("compression", codec).format(kind).save(where)
        seconds = time.perf_counter() - start
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", "true").load(where)
        size = files.agg(F.sum("length")).first()[0] or 0
        back = spark.read.format(kind).load(where).select(*(f"`{c}`" for c in df.columns))
        out.append((kind, codec, int(size), seconds, df.exceptAll(back).isEmpty() and back.exceptAll(df).isEmpty()))
    return out


def text_table(spark: SparkSession, paths: list[str], header: bool = True) -> DataFrame:
    """CSV files of differing columns as one table of text; absent columns are null."""
    out = None
    for p in paths:
        one = spark.read.option("header", header).option("inferSchema", False).csv(p)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def typed_table(tables: list[DataFrame]) -> DataFrame:
    """Tables of differing columns as one: a column's types are widened to long, double or, if they do not agree, text."""
    names = list(dict.fromkeys(c for t in tables for c in t.columns))
    kinds = {c: {t.schema[c].dataType.simpleString() for t in tables if c in t.columns} for c in names}
    whole, real = {"tinyint", "smallint", "int", "bigint"}, {"float", "double"}

    def joint(kinds: set[str]) -> str:
        if len(kinds) == 1:
            return next(iter(kinds))
        return "bigint" if kinds <= whole else "double" if kinds <= whole | real else "string"

    out = None
    for t in tables:
        one = t.select(*((F.col(f"`{c}`") if c in t.columns else F.lit(None)).cast(joint(kinds[c])).alias(c) for c in names))
        out = one if out is None else out.union(one)
    return out


def delta_ablation(df: DataFrame, key: str, columns: list[str], block: int = 1 << 16, coders: tuple[str, ...] = ("raw", "bz2", "lzma")) -> DataFrame:
    """(col, coder, plain_bytes, delta_bytes): whole numbers as text, one a line in blocks of rows, with and without differences."""
    from ..operators.encodings import delta
    from ..operators.sequences import row_numbers

    rows, parts = row_numbers(df.select(key, *columns), key, "__place"), None
    for c in columns:
        both = delta(rows.select("__place", c), "__place", c)
        for kind, value in (("plain", c), ("delta", "delta")):
            lines = F.transform(F.sort_array(F.collect_list(F.struct("__place", F.col(value).cast("string").alias("v")))), lambda x: x["v"])
            one = both.groupBy(F.floor(F.col("__place") / block).alias("b")).agg(F.array_join(lines, "\n").cast("binary").alias("content"))
            one = one.select(F.struct(F.lit(c).alias("col"), F.lit(kind).alias("kind"), "b").alias("part"), "content")
            parts = one if parts is None else parts.union(one)
    sizes = code_sizes(parts, "part", "content", list(coders)).groupBy(F.col("part.col").alias("col"), "coder")
    total = lambda kind: F.sum(F.when(F.col("part.kind") == kind, F.col("bytes"))).alias(f"{kind}_bytes")
    return sizes.agg(total("plain"), total("delta"))


def quality_sweep(rows: DataFrame, key: str, content: str, coder: str) -> DataFrame:
    """(key, quality, bytes, exact): each value at each of the coder's QUALITIES, and whether it comes back."""
    levels = QUALITIES[coder]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [(k, q, len(c := f(x)), decode(coder, c) == x) for k, x in zip(keys, values) if x is not None for q, f in levels.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["key", "quality", "bytes", "exact"])

    return rows.select(F.col(key).cast("long").alias("key"), content).mapInArrow(run, "key long, quality long, bytes long, exact boolean")


def throughput(spark: SparkSession, source: str, path: str) -> dict[str, float | int | bool]:
    """Bytes in and out, seconds to pack, to read back, and whether every file is the same again."""
    start = time.perf_counter()
    pack(spark, source, path)
    packed = time.perf_counter()
    back = unpack(spark, path)
    n = back.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    read = time.perf_counter()
    bad = compare(back, read_files(spark, source)).filter("state != 'same'").count()
    size = spark.read.parquet(f"{path}/segments").agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    return {"bytes": int(n), "coded_bytes": int(size), "pack_s": packed - start, "read_s": read - packed, "exact": bad == 0}


def split_rows(lines: DataFrame, n: int) -> DataFrame:
    """(file_ordinal, name, content): lines (line_no, line; line 0 is the header) cut in n files, the header in each.

    Files are as even as can be, and lines stay in order; nothing is deleted anywhere.
    """
    header = lines.filter("line_no = 0").select(F.col("line").alias("header"))
    total = lines.filter("line_no > 0").agg(F.count(F.lit(1)).alias("total"))
    body = lines.filter("line_no > 0").join(F.broadcast(total))
    part = F.floor((F.col("line_no") - 1) * n / F.col("total")).cast("int")
    files = body.groupBy(part.alias("file_ordinal")).agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("rows"))
    text = F.concat(F.col("header"), F.lit("\n"), F.array_join("rows", "\n"), F.lit("\n"))
    return files.join(F.broadcast(header)).select("file_ordinal", F.format_string("part-%05d.csv", "file_ordinal").alias("name"), F.encode(text, "ISO-8859-1").alias("content"))


def log_extracts(lines: DataFrame) -> DataFrame:
    """lines with hex runs and fractional timestamps taken out: rest, hexes, stamps; log_restore puts them back."""
    hexes = F.regexp_extract_all("line", F.lit("[0-9a-f]{16,}"), F.lit(0))
    stamp = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\.\d{1,6}"
    bare = F.regexp_replace("line", "[\x01\x02]", "")
    clean = bare == F.col("line")
    rest = F.regexp_replace(F.regexp_replace("line", stamp, "\x02"), "[0-9a-f]{16,}", "\x01")
    found = lines.select("*", F.when(clean, rest).otherwise(F.col("line")).alias("rest"), clean.alias("clean"))
    none = F.array().cast("array<string>")
    without = F.regexp_replace("line", stamp, "\x02")
    return found.select(*lines.columns, "rest", F.when(F.col("clean"), F.regexp_extract_all(without, F.lit("[0-9a-f]{16,}"), F.lit(0))).otherwise(none).alias("hexes"), F.when(F.col("clean"), F.regexp_extract_all("line", F.lit(stamp), F.lit(0))).otherwise(none).alias("stamps"))


def log_restore(taken: DataFrame, name: str = "line") -> DataFrame:
    def fill(text, mark: str, values: str):
        pieces = F.split(text, mark, -1)
        return F.when(F.size(values) == 0, text).otherwise(F.array_join(F.flatten(F.zip_with(pieces, F.concat(F.col(values), F.array(F.lit(""))), lambda a, b: F.array(a, b))), ""))

    return taken.withColumn(name, fill(fill(F.col("rest"), "\x01", "hexes"), "\x02", "stamps"))


def human(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1000 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1000
