r"""Quality rules with cross-document line frequency, in DataFrame functions only.

Normalised lines are hashed, and for each host (the column source) the distinct documents with a line
are counted; documents are distinct if their texts are, so exact copies count once. A line in MIN_DOCS
documents and in MIN_SHARE_PERCENT of the host's that have lines is boilerplate and is removed; a
document is rejected if what remains is under MIN_WORDS words or under a fifth of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored

MIN_WORDS = 10
MIN_DOCS = 50
MIN_SHARE_PERCENT = 2
_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["__doc", "__hash", "__host"]


def _words(text: Column) -> Column:
    stripped = F.trim(text, F.lit(_SPACES))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, _SPACE))


def _lines(text: Column) -> Column:
    """Lines with a word, as (place, line)."""
    all_lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return F.filter(all_lines, lambda x: F.trim(x["line"], F.lit(_SPACES)) != "")


def _line_key(line: Column) -> Column:
    """60 bits of the digest of a line: A-Z lower-cased, white space runs as one space, trimmed."""
    normal = F.translate(F.regexp_replace(F.trim(line, F.lit(_SPACES)), _SPACE, " "), _UPPER, _LOWER)
    return F.conv(F.substring(F.md5(normal.cast("binary")), 1, 15), 16, 10).cast("long")


def base_columns(df: DataFrame, prefix: str = "") -> DataFrame:
    """df with the base figures of its column text; null texts have no words.

    Words in repeated 5-word windows: window hashes are compared through a set first, and only texts
    with a repetition sort theirs.
    """
    p = f"__q_{prefix}"
    text = F.coalesce("text", F.lit(""))
    df = df.withColumns({p + "words": _words(text), p + "lines": F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_SPACES)) != "")})
    words, n = F.col(p + "words"), F.size(p + "words")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))).otherwise(F.array().cast("array<long>"))
    df = df.withColumns({
        prefix + "n_words": n.cast("long"),
        prefix + "word_chars": F.length(F.array_join(words, "")).cast("long"),
        prefix + "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        prefix + "n_dup_lines": (F.size(p + "lines") - F.size(F.array_distinct(p + "lines"))).cast("long"),
        p + "windows": windows,
    })
    placed = F.sort_array(F.transform(p + "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct(p + "windows")) < F.size(p + "windows")
    df = df.withColumn(p + "sorted", F.when(repeated, placed))
    s = F.col(p + "sorted")
    # A window is repeated if a neighbour in hash order is equal; the fold keeps (last hash, last place, whether that one is counted, places).
    same = F.filter(
        F.zip_with(F.concat(F.slice(s, 1, 1), F.slice(s, F.lit(1), F.size(s) - 1)), s, lambda a, b: F.struct(b["i"].alias("i"), a["i"].alias("j"), (a["h"] == b["h"]).alias("e"))),
        lambda x: x["e"] & (x["i"] != x["j"]),
    )
    df = df.withColumn(p + "same", same)
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(p + "same", lambda x: F.array(x["i"], x["j"])))))
    df = df.withColumn(p + "places", places)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(p + "places", start, lambda a, i: F.struct((a["n"] + 5 - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + 5).alias("end")))
    df = df.withColumn(prefix + "n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long"))
    return df.drop(*(p + x for x in ("words", "lines", "windows", "sorted", "same", "places")))


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < MIN_WORDS) | (r * 100 > n * 20)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__doc": F.col("doc_id"), "__hash": F.xxhash64(F.coalesce("text", F.lit(""))), "__host": F.col("source")})


def boilerplate_lines(docs: DataFrame) -> DataFrame:
    """For each document with boilerplate: __doc, __hash, __host, removed (words), removed_lines (their places).

    Repeated rows have the same key and give one row. A null source is a host of its own.
    """
    text = F.coalesce("text", F.lit(""))
    rows = _keyed(docs.select("doc_id", "text", "source")).select(*_KEY, _lines(text).alias("l"))
    rows = rows.select(*_KEY, F.transform("l", lambda x: F.struct(x["i"].alias("i"), _line_key(x["line"]).alias("key"), F.size(_words(x["line"])).alias("n"))).alias("l"))
    lines = stored(rows.select(*_KEY, F.inline("l")), "lines")
    seen = lines.select("__host", "key", "__hash").distinct().groupBy("__host", "key").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= MIN_DOCS)
    hosts = lines.select("__host", "__hash").distinct().groupBy("__host").agg(F.count(F.lit(1)).alias("all"))
    limit = seen.alias("s").join(hosts.alias("h"), F.expr("s.__host <=> h.__host")).filter(F.col("docs") * 100 >= F.col("all") * MIN_SHARE_PERCENT)
    often = limit.select(F.col("s.__host").alias("host"), F.col("key").alias("often"))
    found = lines.join(often, F.expr("__host <=> host and key = often")).select(*_KEY, "i", "n").distinct()
    return found.groupBy(*_KEY).agg(F.sum("n").alias("removed"), F.sort_array(F.collect_list("i")).alias("removed_lines"))


def _with_lines(rows: DataFrame, removed: DataFrame) -> DataFrame:
    r = small_side(stored(removed, "removed").toDF("__d", "__h", "__s", "__removed", "__removed_lines"), 128 + 4 * F.size("__removed_lines"))
    return rows.join(r, F.expr("__doc <=> __d and __hash = __h and __host <=> __s"), "left").drop("__d", "__h", "__s")


def _depleted(prefix: str = "") -> Column:
    n, gone = F.col(prefix + "n_words"), F.coalesce("__removed", F.lit(0))
    return (gone > 0) & ((n - gone < MIN_WORDS) | ((n - gone) * 5 < n))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: base figures, base_failed, kept, removed_words.

    Null and empty texts fail by their number of words; an empty table gives an empty result.
    """
    own = base_columns(_keyed(docs.select("doc_id", "text", "source"))).select("doc_id", *_KEY, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = _with_lines(own, boilerplate_lines(docs)).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & ~_depleted()
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.coalesce("__removed", F.lit(0)).cast("long").alias("removed_words"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The kept documents with their own columns; boilerplate lines are removed from text, n_chars follows.

    Null, empty and short texts go; repeated rows stay or go together; an empty table gives an empty result.
    Verdicts are stored first: a filter on their expressions would copy them into every use. Only
    documents that are rejected or lose lines are joined with the texts.
    """
    cols = list(docs.columns)
    own = base_columns(_keyed(docs.select("doc_id", "text", "source"))).select(*_KEY, "n_words", "n_repeat_words")
    judged = _with_lines(own, boilerplate_lines(docs))
    kept = (~base_failed() & ~_depleted()).alias("__kept")
    judged = stored(judged.select(*_KEY, kept, "__removed_lines"), "verdicts").filter("not __kept or __removed_lines is not null")
    marks = judged.toDF("__d", "__h", "__s", "__kept", "__removed_lines").dropDuplicates(["__d", "__h", "__s"])
    marks = small_side(stored(marks, "marks"), 128 + 4 * F.coalesce(F.size("__removed_lines"), F.lit(0)))
    rows = _keyed(docs).join(marks, F.expr("__doc <=> __d and __hash = __h and __host <=> __s"), "left").filter("coalesce(__kept, true)")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__removed_lines", i)), "\n")
    rows = rows.withColumn("text", F.when(F.col("__removed_lines").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in cols:
        rows = rows.withColumn("n_chars", F.when(F.col("__removed_lines").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*(f"`{c}`" for c in cols))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_no, doc_id, source, text, CASE WHEN text = '' THEN [] ELSE list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x != '') END AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
windows AS (SELECT row_no, i, array_to_string(words[i:i+4], ' ') AS win FROM (SELECT row_no, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
places AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT row_no, sum(least(5, coalesce(next_i - i, 5))) AS n FROM (SELECT row_no, i, lead(i) OVER (PARTITION BY row_no ORDER BY i) AS next_i FROM places) GROUP BY row_no),
lines AS (SELECT row_no, source, text, ('0x' || substr(md5(translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 1, 15))::BIGINT AS key,
  len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x != '')) AS n
  FROM (SELECT row_no, source, text, unnest(lines) AS line FROM w)),
seen AS (SELECT source, key, count(DISTINCT text) AS docs FROM lines GROUP BY source, key),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM lines GROUP BY source),
often AS (SELECT s.source, key FROM seen s JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source WHERE s.docs >= 50 AND s.docs * 100 >= 2 * h.docs),
removed AS (SELECT row_no, sum(n) AS removed FROM lines l JOIN often o ON l.key = o.key AND l.source IS NOT DISTINCT FROM o.source GROUP BY row_no),
f AS (SELECT w.row_no, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(r.removed, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN covered c USING (row_no) LEFT JOIN removed r USING (row_no))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (removed_words > 0 AND (n_words - removed_words < 10 OR (n_words - removed_words) * 5 < n_words)) AS kept, removed_words
FROM f
"""
