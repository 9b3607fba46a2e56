"""Files as rows, byte for byte: batches, lines, fields, delimiters, preludes, logs, fixed widths.

Text is read as ISO-8859-1, in which every byte is one character, and never by a CSV reader, which
would lose carriage returns, blank lines, quotes and the final newline. Types are found later, as
notes on columns; cells stay text.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import decode_bytes, split_log, split_quoted
from ..operators.sequences import running_sum

#: Lead lines whose field count may differ from the rest of the file.
PRELUDE_LINES = 4
SEPARATORS = (",", "\t", ";", "|")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file_ordinal, name, n_bytes, content of the files at path, in order of their names.

    A file that cannot be read fails the job; none is skipped silently.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    named = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("n_bytes"), "content")
    names = named.select("name").distinct()
    # Names alone (not contents) meet in one task to be numbered.
    numbered = names.withColumn("file_ordinal", (F.row_number().over(Window.orderBy("name")) - 1).cast("int"))
    return named.join(numbered, "name").select("file_ordinal", "name", "n_bytes", "content")


def batches(sizes: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """(file_ordinal, batch_id): a batch ends before it would exceed max_files or max_bytes.

    A file larger than max_bytes starts a batch of its own. Of files in pieces, sizes also has piece, start and
    file_bytes, which are returned: such a file goes on in further batches. The rule restarts at each cut, so
    it is walked in order in one Python task: a few numbers a piece, no contents.
    """
    more = [c for c in ("piece", "start", "file_bytes") if c in sizes.columns]

    def walk(parts):
        import pyarrow as pa

        batch, files, total, now = 0, 0, 0, None
        for part in parts:
            out = []
            whole = part.column("file_bytes" if more else "n_bytes").to_pylist()
            for ordinal, size, all_ in zip(part.column("file_ordinal").to_pylist(), part.column("n_bytes").to_pylist(), whole):
                new = ordinal != now
                if now is not None and (files + new > max_files or total + (all_ if new else size) > max_bytes):
                    batch, files, total, new = batch + 1, 0, 0, True
                files, total, now = files + new, total + size, ordinal
                out.append(batch)
            kept = ["file_ordinal", *more]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(out, pa.int32())], names=[*kept, "batch_id"])

    longs = [F.col(c).cast("long").alias(c) for c in ("file_ordinal", "n_bytes", *more)]
    one = sizes.select(*longs).coalesce(1).sortWithinPartitions("file_ordinal", *(["start", "piece"] if more else []))
    return one.mapInArrow(walk, ", ".join(f"{c} long" for c in ("file_ordinal", *more)) + ", batch_id int")


def pieces(files: DataFrame, most: int) -> DataFrame:
    """(file_ordinal, name, piece, content): files cut behind newlines, where there are any, to at most `most` bytes."""

    def cut(parts):
        import pyarrow as pa

        names = ["file_ordinal", "name", "piece", "content"]
        for part in parts:
            contents = part.column("content")
            if all(len(x.as_buffer()) <= most for x in contents):
                yield pa.RecordBatch.from_arrays([part.column("file_ordinal"), part.column("name"), pa.array([0] * len(contents), pa.int64()), contents], names=names)
                continue
            for i, content in enumerate(contents):
                data, at, n = memoryview(content.as_buffer()), 0, 0
                while n == 0 or at < len(data):
                    piece = bytes(data[at : at + most])
                    if at + most < len(data):
                        piece = piece[: piece.rfind(b"\n") + 1] or piece
                    yield pa.RecordBatch.from_arrays([part.column("file_ordinal").slice(i, 1), part.column("name").slice(i, 1), pa.array([n], pa.int64()), pa.array([piece], pa.binary())], names=names)
                    at, n = at + len(piece), n + 1

    return files.select(F.col("file_ordinal").cast("int").alias("file_ordinal"), "name", "content").mapInArrow(cut, "file_ordinal int, name string, piece long, content binary")


def sorted_pieces(rows: DataFrame, most: int) -> DataFrame:
    """(file_ordinal, piece, content): each file's lines in their own order, a newline behind each, in pieces of at most `most` bytes.

    Spark deals ranges of lines to tasks and sorts them there, so that no task holds a file; `piece` ascends with the lines.
    """

    def join(parts):
        import pyarrow as pa
        from pyspark import TaskContext

        now, body, n = None, bytearray(), TaskContext.get().partitionId() << 32

        def piece(size):
            nonlocal n
            out = pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([n], pa.int64()), pa.array([bytes(body[:size])], pa.binary())], names=["file_ordinal", "piece", "content"])
            del body[:size]
            n += 1
            return out

        for part in parts:
            ordinals, found, at = part.column("file_ordinal").to_pylist(), part.column("line").to_pylist(), 0
            while at < len(found):
                if ordinals[at] != now:
                    if body:
                        yield piece(len(body))
                    now = ordinals[at]
                end = len(found) if ordinals[-1] == now else bisect_right(ordinals, now, at)
                body += b"".join(found[at:end])
                at = end
                while len(body) > most:
                    yield piece(body.rfind(b"\n", 0, most) + 1 or most)
        if body:
            yield piece(len(body))

    lines_ = rows.filter("line is not null").select(F.col("file_ordinal").cast("int").alias("file_ordinal"), "line")
    ranged = lines_.repartitionByRange("file_ordinal", "line").sortWithinPartitions("file_ordinal", "line")
    coded = ranged.select("file_ordinal", F.encode(F.concat("line", F.lit("\n")), "ISO-8859-1").alias("line"))
    return coded.mapInArrow(join, "file_ordinal int, piece long, content binary")


#: Bytes of a file that are made lines at once.
_CHUNK = 1 << 20


def lines(files: DataFrame) -> DataFrame:
    """file_ordinal, line_no, line, and trailing (whether the file ends in a newline).

    A task holds its files' bytes and the lines of one chunk, never all lines of a file.
    """

    def cut(parts):
        import pyarrow as pa

        for part in parts:
            for i, content in enumerate(part.column("content")):
                data = memoryview(content.as_buffer() or b"")
                trailing = len(data) > 0 and data[-1] == 10
                at, end, n = 0, len(data) - trailing, 0
                while at <= end and len(data):
                    stop = min(end, at + _CHUNK)
                    piece = bytes(data[at:stop])
                    while stop < end and b"\n" not in piece:
                        stop = min(end, stop + _CHUNK)
                        piece = bytes(data[at:stop])
                    if stop < end:
                        piece = piece[: piece.rindex(b"\n")]
                    found = piece.decode("latin-1").split("\n")
                    numbers = pa.array(range(n, n + len(found)), pa.int32())
                    ordinal = part.column("file_ordinal").take(pa.array([i] * len(found), pa.int32()))
                    yield pa.RecordBatch.from_arrays([ordinal, pa.array([trailing] * len(found)), numbers, pa.array(found, pa.string())], names=["file_ordinal", "trailing", "line_no", "line"])
                    at, n = at + len(piece) + 1, n + len(found)

    kind = files.schema["file_ordinal"].dataType.simpleString()
    return files.select("file_ordinal", "content").mapInArrow(cut, f"file_ordinal {kind}, trailing boolean, line_no int, line string")


def joined(rows: DataFrame, order: str) -> DataFrame:
    """(file_ordinal, body): the lines of each file as bytes, in the order of `order`, parted by newlines.

    Rows of a file are sorted by Spark, which spills, and joined one by one: a task holds one file's bytes.
    """

    def join(parts):
        import pyarrow as pa

        now, body, schema = None, None, None

        def file():
            return pa.RecordBatch.from_arrays([pa.array([now], schema), pa.array([bytes(body)], pa.binary())], names=["file_ordinal", "body"])

        for part in parts:
            schema = part.column("file_ordinal").type
            for ordinal, line in zip(part.column("file_ordinal").to_pylist(), part.column("line").to_pylist()):
                if body is None or ordinal != now:
                    if body is not None:
                        yield file()
                    now, body = ordinal, bytearray()
                else:
                    body += b"\n"
                body += line.encode("latin-1")
        if body is not None:
            yield file()

    kind = rows.schema["file_ordinal"].dataType.simpleString()
    sorted_ = rows.filter("line is not null").repartition("file_ordinal").sortWithinPartitions("file_ordinal", order, "line")
    return sorted_.select("file_ordinal", "line").mapInArrow(join, f"file_ordinal {kind}, body binary")


def fields(rows: DataFrame, sep: str | None, line: str = "line") -> DataFrame:
    """rows with `fields`; sep None parts at runs of white space."""
    cut = F.filter(F.split(F.col(line), r"\s+", -1), lambda x: x != "") if sep is None else split_quoted(F.col(line), sep)
    return rows.withColumn("fields", cut)


def modal(df: DataFrame, by: list[str], value: Column, order: Column) -> DataFrame:
    """(by..., modal, share): the most frequent value, of equals that which is first in `order`."""
    counted = df.groupBy(*by, value.alias("modal")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    ranked = counted.groupBy(*by).agg(F.max(F.struct(F.col("n"), (-F.col("first")).alias("early"), F.col("modal"))).alias("top"), F.sum("n").alias("all"))
    return ranked.select(*by, F.col("top.modal").alias("modal"), (F.col("top.n") / F.col("all")).alias("share"))


def table(files: DataFrame, sep: str | None = ",") -> tuple[DataFrame, DataFrame]:
    """(rows, heads): rows are file_ordinal, row_no, fields; heads are file_ordinal, width, prelude, trailing.

    Up to PRELUDE_LINES lead lines of another field count than the file's most frequent one are the
    prelude, kept as text with a count, so that one blank line and none differ.
    """
    cut = fields(lines(files), sep)
    width = modal(cut, ["file_ordinal"], F.size("fields"), F.col("line_no")).select("file_ordinal", F.col("modal").alias("width"))
    cut = cut.join(width, "file_ordinal")
    first = cut.filter(F.size("fields") == F.col("width")).groupBy("file_ordinal").agg(F.min("line_no").alias("first_row"))
    cut = cut.join(first, "file_ordinal").withColumn("skip", F.when(F.col("first_row") <= PRELUDE_LINES, F.col("first_row")).otherwise(0))
    rows = cut.filter("line_no >= skip").select("file_ordinal", (F.col("line_no") - F.col("skip")).alias("row_no"), "fields")
    lead = F.sort_array(F.collect_list(F.when(F.col("line_no") < F.col("skip"), F.struct("line_no", "line"))))
    heads = cut.groupBy("file_ordinal").agg(F.first("width").alias("width"), F.first("trailing").alias("trailing"), F.count(F.when(F.col("line_no") >= F.col("skip"), 1)).alias("n_rows"), F.transform(lead, lambda x: x["line"]).alias("prelude"))
    return rows, heads


def rebuild(rows: DataFrame, heads: DataFrame, sep: str = ",") -> DataFrame:
    """(file_ordinal, content): the files again from their rows and heads."""
    body = joined(rows.select("file_ordinal", "row_no", F.array_join("fields", sep).alias("line")), "row_no")
    both = heads.join(body, "file_ordinal", "left")
    newline, empty = F.encode(F.lit("\n"), "ISO-8859-1"), F.encode(F.lit(""), "ISO-8859-1")
    prelude = F.encode(F.array_join("prelude", "\n"), "ISO-8859-1")
    between = F.when((F.size("prelude") > 0) & F.col("body").isNotNull(), newline).otherwise(empty)
    return both.select("file_ordinal", F.concat(prelude, between, F.coalesce("body", empty), F.when(F.col("trailing"), newline).otherwise(empty)).alias("content"))


def sniff(files: DataFrame, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(sep, width, share) of the best delimiter: most rows of one width over 1, then the widest, then the first."""
    rows = lines(files)
    found = None
    for i, sep in enumerate((*separators, None)):
        cut = fields(rows, sep).withColumn("at", F.col("file_ordinal") * F.lit(1 << 32) + F.col("line_no"))
        one = modal(cut, [], F.size("fields"), F.col("at")).select(F.lit(i).alias("rank"), F.lit(sep).alias("sep"), F.col("modal").alias("width"), "share")
        found = one if found is None else found.union(one)
    usable = found.filter("width > 1")
    return usable.orderBy(F.desc("share"), F.desc("width"), "rank").limit(1).select("sep", "width", "share")


def looks_like_log(files: DataFrame) -> DataFrame:
    """(file_ordinal, is_log): 2048 bytes, a final newline, and in the first 64 KB 32 lines, 95 % printable, 3 spaces a line."""
    text = decode_bytes(F.col("content"))
    head = F.substring(text, 1, 65536)
    all_lines = F.filter(F.split(head, "\n", -1), lambda x: x != "")
    printable = F.length(head) - F.regexp_count(head, F.lit(r"[^\x20-\x7e\n\t]"))
    spaces = F.array_min(F.transform(all_lines, lambda x: F.regexp_count(x, F.lit(" "))))
    good = (F.length(text) >= 2048) & text.endswith("\n") & (F.size(all_lines) >= 32) & (printable >= F.length(head) * 0.95) & (spaces >= 3)
    return files.select("file_ordinal", F.coalesce(good, F.lit(False)).alias("is_log"))


def log_fields(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("fields", split_log(F.col("line"), k))


def fixed_width(files: DataFrame) -> DataFrame:
    """(file_ordinal, width, share, is_fixed): the most frequent line length, 16 at least, in half of 200 lines or more."""
    rows = lines(files)
    top = modal(rows, ["file_ordinal"], F.length("line"), F.col("line_no"))
    n = rows.groupBy("file_ordinal").agg(F.count(F.lit(1)).alias("n"))
    good = (F.col("modal") >= 16) & (F.col("share") >= 0.5) & (F.col("n") >= 200)
    return top.join(n, "file_ordinal").select("file_ordinal", F.col("modal").alias("width"), "share", good.alias("is_fixed"))


def looks_like_fasta(files: DataFrame) -> DataFrame:
    text = decode_bytes(F.col("content"))
    body = F.substring(text, F.locate("\n", text) + 1, F.lit(4000))
    bases = F.regexp_count(body, F.lit("[ACGTacgt]"))
    return files.select("file_ordinal", F.coalesce(text.startswith(">") & (bases > 0.9 * F.length(F.replace(body, F.lit("\n"), F.lit("")))), F.lit(False)).alias("is_fasta"))


def gather_by_name(rows: DataFrame) -> DataFrame:
    """(name, file_ordinal, row_no, value): each column by its name in the file's first row, in which quotes are dropped.

    rows: file_ordinal, row_no, fields. Fields beyond the header have no name and are left out.
    """
    heads = rows.filter("row_no = 0").select("file_ordinal", F.transform("fields", lambda x: F.trim(F.trim(x), F.lit('"'))).alias("names"))
    cells = rows.filter("row_no > 0").select("file_ordinal", (F.col("row_no") - 1).alias("row_no"), F.posexplode("fields").alias("at", "value"))
    return cells.join(heads, "file_ordinal").filter(F.col("at") < F.size("names")).select(F.get("names", F.col("at")).alias("name"), "file_ordinal", "row_no", "value")


def aligned_columns(rows: DataFrame) -> DataFrame:
    """(col_no, gpos, file_ordinal, row_no, value): each column over all files, in file and row order."""
    per_file = rows.groupBy("file_ordinal").agg(F.max("row_no").alias("last"))
    counted = per_file.withColumn("n", F.col("last") + 1)
    offsets = running_sum(counted, "file_ordinal", "n", "upto").select("file_ordinal", (F.col("upto") - F.col("n")).alias("offset"))
    placed = rows.join(offsets, "file_ordinal").withColumn("gpos", F.col("offset") + F.col("row_no"))
    return placed.select("gpos", "file_ordinal", "row_no", F.posexplode("fields").alias("col_no", "value")).select("col_no", "gpos", "file_ordinal", "row_no", "value")
