"""Queries over binary contents: byte transforms and their inverses, containers, text formats, periods.

Contents are made of the sample tables, in the plan and in SQL alike. A transform's query gives the
digest of the coded and of the restored bytes; its SQL computes the coded bytes one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import binary as Y
from ..sources import containers as C
from ..sources import files as L
from .catalogue import QUERIES, SQL, query, table

# --- contents ---------------------------------------------------------------------------------


def _le(x: Column, width: int) -> Column:
    """Hex of a whole number's bytes, the low one first."""
    return F.concat(*(F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)))


def _le_sql(x: str, width: int) -> str:
    return " || ".join(f"printf('%02x', ((({x}) >> {8 * i}) & 255)::INT)" for i in range(width))


def _float_bits(n: Column) -> Column:
    """Bits of the 32-bit float of a whole number from 0 to 2**24."""
    e = F.length(F.bin(n)) - 1
    bits = F.shiftleft((e + 127).cast("long"), 23) + ((n - F.pow(F.lit(2), e).cast("long")) * F.pow(F.lit(2), 23 - e).cast("long"))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(bits)


_FLOAT_SQL = "CASE WHEN {n} = 0 THEN 0 ELSE ((length(bin({n})) - 1 + 127) << 23) + ({n} - (1 << (length(bin({n})) - 1))) * (1 << (23 - (length(bin({n})) - 1))) END"


def _joined(rows: DataFrame, by: Column, order: str, piece: Column) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))), lambda x: x["p"])
    return rows.groupBy(by.cast("long").alias("id")).agg(F.array_join(ordered, "").alias("text"))


def _hexed(piece: Callable[[], Column]):
    return lambda spark, sf_dir: _joined(table(spark, sf_dir, "customer"), F.col("c_nationkey"), "c_custkey", piece()).select("id", F.unhex("text").alias("content"))


def _hexed_sql(piece: str) -> str:
    return f"blob AS (SELECT c_nationkey::BIGINT AS id, unhex(string_agg({piece}, '' ORDER BY c_custkey)) AS content FROM customer GROUP BY 1)"


def _names(spark, sf_dir) -> DataFrame:
    line = F.concat("c_name", F.lit("|"), "c_mktsegment", F.lit("|"), F.col("c_nationkey").cast("string"), F.lit("\n"))
    return _joined(table(spark, sf_dir, "customer"), F.col("c_nationkey"), "c_custkey", line).select("id", F.encode("text", "ISO-8859-1").alias("content"))


_K = lambda: F.col("c_custkey")
_VARINT_HEX = "CASE WHEN c_custkey < 128 THEN {one} WHEN c_custkey < 16384 THEN {a} || {two} ELSE {a} || {b} || {three} END".format(
    one=_le_sql("c_custkey", 1), a=_le_sql("(c_custkey & 127) | 128", 1), two=_le_sql("c_custkey >> 7", 1), b=_le_sql("((c_custkey >> 7) & 127) | 128", 1), three=_le_sql("c_custkey >> 14", 1)
)


def _varint_hex() -> Column:
    k, more = _K(), lambda x: _le(x.bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128)), 1)
    return F.when(k < 128, _le(k, 1)).when(k < 16384, F.concat(more(k), _le(F.shiftright(k, 7), 1))).otherwise(F.concat(more(k), more(F.shiftright(k, 7)), _le(F.shiftright(k, 14), 1)))


def _cents() -> Column:
    return F.round(F.col("c_acctbal") * 100).cast("long")


#: Contents by name, one for each nation: the plan and the SQL of blob(id, content).
SOURCES: dict[str, tuple[Callable, str]] = {
    "names": (_names, "blob AS (SELECT c_nationkey::BIGINT AS id, encode(string_agg(c_name || '|' || c_mktsegment || '|' || c_nationkey || chr(10), '' ORDER BY c_custkey)) AS content FROM customer GROUP BY 1)"),
    "records": (
        _hexed(lambda: F.concat(_le(_K(), 4), _le(F.col("c_nationkey").cast("long") * 7, 2), _le(_K() * 3 + 5, 2))),
        _hexed_sql(_le_sql("c_custkey", 4) + " || " + _le_sql("c_nationkey * 7", 2) + " || " + _le_sql("c_custkey * 3 + 5", 2)),
    ),
    "multiples": (_hexed(lambda: _le(_K() * 12, 4)), _hexed_sql(_le_sql("c_custkey * 12", 4))),
    "prefixed": (_hexed(lambda: F.concat(_le(F.length("c_name").cast("long"), 2), F.hex("c_name"))), _hexed_sql(_le_sql("length(c_name)", 2) + " || hex(encode(c_name))")),
    "varints": (_hexed(_varint_hex), _hexed_sql(_VARINT_HEX)),
    "floats": (_hexed(lambda: _le(_float_bits(_K()), 4)), _hexed_sql(_le_sql(_FLOAT_SQL.format(n="c_custkey"), 4))),
    "ints": (_hexed(lambda: _le(_K(), 4)), _hexed_sql(_le_sql("c_custkey", 4))),
    "samples": (_hexed(lambda: _le(_cents(), 4)), _hexed_sql(_le_sql("round(c_acctbal * 100)::BIGINT", 4))),
    "digits": (_hexed(lambda: _le(_K() % 5, 1)), _hexed_sql(_le_sql("c_custkey % 5", 1))),
    "runs": (_hexed(lambda: F.concat(F.repeat(_le(_K() % 7, 1), 9), _le(_K(), 2))), _hexed_sql(f"repeat({_le_sql('c_custkey % 7', 1)}, 9) || {_le_sql('c_custkey', 2)}")),
}
_BYTES = "bytes AS (SELECT id, octet_length(content) AS n, i, ('0x' || substr(h, 2 * i + 1, 2))::INT AS b FROM (SELECT id, content, hex(content) AS h, unnest(range(octet_length(content))) AS i FROM blob))"


def _transform(name: str, source: str, transform: str, params: dict | None = None, coded: str | None = None) -> None:
    """Registers a query; coded: SQL of v(id, o, v), the coded bytes and their order."""
    rows, blob = SOURCES[source]

    def run(spark, sf_dir) -> DataFrame:
        made = Y.transform_table(rows(spark, sf_dir), transform, params)
        back = Y.restore_table(made, transform).select("id", F.sha2("content", 256).alias("sha256"))
        return back if coded is None else back.join(made.select("id", F.sha2("content", 256).alias("coded_sha256")), "id")

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"WITH {blob} SELECT id, sha256(content) AS sha256 FROM blob"
    if coded is not None:
        SQL[name] = f"WITH {blob}, {_BYTES}, {coded}, c AS (SELECT id, sha256(unhex(string_agg(printf('%02x', v::INT), '' ORDER BY o))) AS coded_sha256 FROM v GROUP BY id) SELECT id, sha256(content) AS sha256, coded_sha256 FROM blob JOIN c USING (id)"


def _lag(x: str, by: str = "", k: int = 1) -> str:
    return f"coalesce(lag({x}, {k}) OVER (PARTITION BY id{by} ORDER BY i), 0)"


def _plane(p: int, value: str = "b", source: str = "bytes") -> str:
    """v of planes of p bytes; bytes after the last whole record stay at the end."""
    return f"m AS (SELECT *, n // {p} AS k, i < n // {p} * {p} AS whole, i % {p} AS c FROM {source}), v AS (SELECT id, CASE WHEN whole THEN c * k + i // {p} ELSE i END AS o, CASE WHEN whole THEN {value} ELSE b END AS v FROM m)"


def _fields(width: int) -> str:
    parts = " + ".join(f"(lead(b::BIGINT, {j}) OVER (PARTITION BY id ORDER BY i) << {8 * j})" for j in range(1, width))
    return f"fields AS (SELECT id, n, i, f FROM (SELECT *, b::BIGINT + {parts} AS f FROM bytes) WHERE i % {width} = 0)"


_PLANE_DELTA = "(b - coalesce(lag(b) OVER (PARTITION BY id, whole, c ORDER BY i), 0)) & 255"
_transform("q70_bytes_delta", "names", "delta", {"p": 1}, f"v AS (SELECT id, i AS o, (b - {_lag('b')}) & 255 AS v FROM bytes)")
_transform("q71_bytes_lag_delta", "names", "delta", {"p": 7}, f"v AS (SELECT id, i AS o, (b - {_lag('b', '', 7)}) & 255 AS v FROM bytes)")
_transform("q72_bytes_second_delta", "names", "delta2", {"p": 1}, f"d AS (SELECT id, i, (b - {_lag('b')}) & 255 AS d FROM bytes), v AS (SELECT id, i AS o, (d - {_lag('d')}) & 255 AS v FROM d)")
_transform("q73_bytes_zigzag", "samples", "zigzag", None, "v AS (SELECT id, i AS o, CASE WHEN b < 128 THEN 2 * b ELSE 511 - 2 * b END AS v FROM bytes)")
_transform("q74_planes_split", "names", "transpose", {"p": 5}, _plane(5))
_transform("q75_planes_delta", "names", "planes", {"p": 5, "op": "delta"}, _plane(5, _PLANE_DELTA))
_transform("q76_planes_xor", "names", "planes", {"p": 5, "op": "xor"}, _plane(5, "xor(b, coalesce(lag(b) OVER (PARTITION BY id, whole, c ORDER BY i), 0))"))
_transform("q77_planes_lag2", "names", "planes", {"p": 5, "op": "lag2"}, _plane(5, "(b - coalesce(lag(b, 2) OVER (PARTITION BY id, whole, c ORDER BY i), 0)) & 255"))
_transform("q78_planes_best_op", "records", "best_planes", {"p": 8})
_transform(
    "q79_planes_dictionary", "records", "dictionary", {"p": 8},
    "t AS (SELECT *, i % 8 AS c8 FROM bytes), u AS (SELECT id, c8, count(DISTINCT b) AS d FROM t GROUP BY 1, 2), w AS (SELECT t.id, n, i, CASE WHEN d <= 16 THEN dense_rank() OVER (PARTITION BY t.id, t.c8 ORDER BY b) - 1 ELSE b END AS b FROM t JOIN u ON t.id = u.id AND t.c8 = u.c8), "
    + _plane(8, "b", "w"),
)
_transform("q80_gcd_extract", "multiples", "gcd", {"width": 4}, _fields(4) + ", g AS (SELECT id, list_reduce(list(f), lambda a, b: gcd(a, b)) AS g FROM fields GROUP BY id), v AS (SELECT id, i + j AS o, ((f // g) >> (8 * j)) & 255 AS v FROM fields JOIN g USING (id), range(4) r(j))")
_transform("q81_length_prefixed", "prefixed", "length_prefixed")
SQL["q81_length_prefixed"] = f"WITH {SOURCES['prefixed'][1]} SELECT id, sha256(content) AS sha256 FROM blob"
_transform("q82_varints", "varints", "varint_widen", None, "x AS (SELECT c_nationkey::BIGINT AS id, c_custkey AS k, max(c_custkey) OVER (PARTITION BY c_nationkey) AS top FROM customer), y AS (SELECT *, CASE WHEN top < 256 THEN 1 WHEN top < 65536 THEN 2 ELSE 4 END AS w FROM x), v AS (SELECT id, k * 4 + j AS o, (k >> (8 * j)) & 255 AS v FROM y, range(4) r(j) WHERE j < w)")
_transform("q83_floats_as_ints", "floats", "float_to_int", None, "x AS (SELECT c_nationkey::BIGINT AS id, c_custkey AS k, max(c_custkey) OVER (PARTITION BY c_nationkey) AS top FROM customer), y AS (SELECT *, CASE WHEN top < 128 THEN 1 WHEN top < 32768 THEN 2 ELSE 4 END AS w FROM x), v AS (SELECT id, k * 4 + j AS o, (k >> (8 * j)) & 255 AS v FROM y, range(4) r(j) WHERE j < w)")
_transform("q84_int_narrow", "ints", "int_narrow", {"width": 4}, "x AS (SELECT c_nationkey::BIGINT AS id, c_custkey AS k, max(c_custkey) OVER (PARTITION BY c_nationkey) AS top FROM customer), y AS (SELECT *, CASE WHEN top < 128 THEN 1 ELSE 2 END AS w FROM x), v AS (SELECT id, k * 4 + j AS o, (k >> (8 * j)) & 255 AS v FROM y, range(2) r(j) WHERE j < w)")
_RECORD_DELTA = _fields(2) + ", d AS (SELECT id, n, i, (f - coalesce(lag(f) OVER (PARTITION BY id, i % 8 ORDER BY i), 0)) & 65535 AS d FROM fields), w AS (SELECT id, n, i + j AS i, (d >> (8 * j)) & 255 AS b FROM d, range(2) r(j))"
_transform("q85_record_field_delta", "records", "record_delta", {"p": 8, "width": 2}, _RECORD_DELTA + ", v AS (SELECT id, i AS o, b AS v FROM w)")
_transform("q86_field_delta_planes", "records", "field_delta", {"p": 8, "width": 2}, _RECORD_DELTA + ", " + _plane(8, "b", "w"))


def _crossed(value: str) -> str:
    """Field 3 of each record of four 16-bit fields becomes `value` of f0 to f3; then planes of differences."""
    return (
        _fields(2)
        + ", r AS (SELECT id, n, i // 8 AS rec, max(CASE WHEN i % 8 = 0 THEN f END) AS f0, max(CASE WHEN i % 8 = 2 THEN f END) AS f1, max(CASE WHEN i % 8 = 4 THEN f END) AS f2, max(CASE WHEN i % 8 = 6 THEN f END) AS f3 FROM fields GROUP BY ALL), "
        + f"x AS (SELECT id, n, rec, [f0, f1, f2, ({value}) & 65535] AS fs FROM r), w AS (SELECT id, n, rec * 8 + 2 * q + j AS i, (fs[q + 1] >> (8 * j)) & 255 AS b FROM x, range(4) a(q), range(2) c(j)), "
        + _plane(8, _PLANE_DELTA, "w")
    )


_transform("q87_cross_field_difference", "records", "cross", {"p": 8, "width": 2, "target": 3, "refs": [0, 1], "op": "sub"}, _crossed("f3 - f0 - f1"))
_transform("q88_cross_field_xor", "records", "cross", {"p": 8, "width": 2, "target": 3, "refs": [0], "op": "xor"}, _crossed("xor(f3, f0)"))
_transform("q89_cross_field_line", "records", "line", {"p": 8, "width": 2, "target": 3, "ref": 0, "a": 3, "b": 5}, _crossed("f3 - 3 * f0 - 5"))
_transform("q90_sub_byte_fields", "ints", "sub_byte", {"bits": 12})
_transform("q91_run_length_bytes", "runs", "run_lengths", None, None)
_transform("q92_base_packing", "digits", "base_pack", {"base": 5})
_transform(
    "q93_sorted_rotations", "names", "bwt", None,
    "t AS (SELECT id, decode(content) AS s, octet_length(content) AS n FROM blob), r AS (SELECT id, s, n, unnest(range(n)) AS i FROM t), v AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY substr(s || s, i + 1, n)) AS o, ascii(substr(s, CASE WHEN i = 0 THEN n ELSE i END, 1)) AS v FROM r)",
)
_transform("q94_segments", "names", "segments")


@query(
    f"WITH {SOURCES['samples'][1]}, x AS (SELECT c_nationkey::BIGINT AS id, c_custkey, round(c_acctbal * 100)::BIGINT AS x FROM customer), d AS (SELECT id, x - lag(x) OVER (PARTITION BY id ORDER BY c_custkey) AS d FROM x), "
    "s AS (SELECT id, count(d) * CASE WHEN min(d) >= -128 AND max(d) < 128 THEN 1 WHEN min(d) >= -32768 AND max(d) < 32768 THEN 2 WHEN min(d) >= -2147483648 AND max(d) < 2147483648 THEN 4 ELSE 8 END AS fixed, sum(CASE WHEN d BETWEEN -127 AND 127 THEN 1 WHEN d IS NULL THEN 0 ELSE 9 END) AS escape FROM d GROUP BY id) "
    "SELECT id, CASE WHEN escape < fixed THEN 'escape' ELSE 'fixed' END AS kind, least(escape, fixed)::BIGINT AS coded_bytes, sha256(content) AS sha256 FROM s JOIN blob USING (id)"
)
def q95_waveform_choice(spark, sf_dir):
    made = Y.transform_table(SOURCES["samples"][0](spark, sf_dir), "waveform")
    back = Y.restore_table(made, "waveform").select("id", F.sha2("content", 256).alias("sha256"))
    return made.select("id", F.get_json_object("params", "$.kind").alias("kind"), F.octet_length("content").cast("long").alias("coded_bytes")).join(back, "id")


_LAGS = (
    "w AS (SELECT id, i - greatest(0, (n - 4096) // 2) AS i, b FROM bytes WHERE i >= greatest(0, (n - 4096) // 2) AND i < greatest(0, (n - 4096) // 2) + 4096), "
    "h AS (SELECT x.id, k, (x.b - y.b) & 255 AS d, count(*) AS c FROM range(1, {most} + 1) r(k), w x JOIN w y ON x.id = y.id AND y.i = x.i - k GROUP BY ALL), "
    "e AS (SELECT id, k, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM h GROUP BY 1, 2)"
)


@query(f"WITH {SOURCES['records'][1]}, {_BYTES}, {_LAGS.format(most=40)} SELECT blob.id, r.k::INT AS lag, coalesce(round(e, 6), 8.0) AS entropy FROM blob CROSS JOIN range(1, 41) r(k) LEFT JOIN e ON e.id = blob.id AND e.k = r.k")
def q96_lag_entropies(spark, sf_dir):
    return Y.lag_table(SOURCES["records"][0](spark, sf_dir), 40)


@query(f"WITH {SOURCES['records'][1]}, {_BYTES}, {_LAGS.format(most=64)} SELECT id, arg_min(k, round(e, 3) * 1000 + k / 1000)::INT AS period FROM e WHERE k >= 2 GROUP BY id")
def q97_small_periods(spark, sf_dir):
    return Y.period_table(SOURCES["records"][0](spark, sf_dir)).select("id", F.col("by_entropy")[0].alias("period"))


@query(
    f"WITH {SOURCES['records'][1]}, {_BYTES}, p AS (SELECT unnest([2, 3, 4, 8]) AS p), h AS (SELECT id, p, i % p AS c, b, count(*) AS k FROM bytes, p WHERE i < least(n, 16384) // p * p GROUP BY ALL), "
    "e AS (SELECT id, p, c, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS e FROM h GROUP BY ALL), s AS (SELECT id, p, round(stddev_pop(e), 6) AS s FROM e GROUP BY ALL) SELECT id, arg_max(p, s - p / 1e9)::INT AS period FROM s GROUP BY id"
)
def q98_periods_by_alignment(spark, sf_dir):
    return Y.period_table(SOURCES["records"][0](spark, sf_dir), [2, 3, 4, 8]).select("id", F.col("by_alignment")[0].alias("period"))


_HEADED = "blob AS (SELECT c_nationkey::BIGINT AS id, encode(repeat('HEAD', 64 * (1 + c_nationkey % 5)) || string_agg(md5(c_custkey::VARCHAR), '' ORDER BY c_custkey)) AS content FROM customer GROUP BY c_nationkey)"


@query(
    f"WITH {_HEADED}, {_BYTES}, h AS (SELECT id, i // 256 AS w, b, count(*) AS c FROM bytes WHERE i < least(n, 65536) // 256 * 256 GROUP BY ALL), e AS (SELECT id, w, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM h GROUP BY ALL), "
    "d AS (SELECT id, w, abs(e - lag(e) OVER (PARTITION BY id ORDER BY w)) AS d FROM e), t AS (SELECT id, arg_max(w, d) AS w, max(d) AS d FROM d GROUP BY id) SELECT id, CASE WHEN d > 1 THEN w * 256 ELSE 0 END::INT AS header FROM t"
)
def q99_header_boundary(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    blobs = _joined(c, F.col("c_nationkey"), "c_custkey", F.md5(F.col("c_custkey").cast("string").cast("binary")))
    head = F.expr("repeat('HEAD', cast(64 * (1 + id % 5) as int))")
    return Y.structure(blobs.select("id", F.encode(F.concat(head, F.col("text")), "ISO-8859-1").alias("content"))).select("id", "header")


@query(
    f"WITH {SOURCES['records'][1]}, {_BYTES}, h AS (SELECT id, b, count(*) AS c FROM bytes GROUP BY ALL), e AS (SELECT id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM h GROUP BY id), {_LAGS.format(most=512)[0:-len('e AS (SELECT id, k, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM h GROUP BY 1, 2)')].replace('h AS', 'g AS').rstrip(', ')}, "
    "l AS (SELECT id, k, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM g GROUP BY 1, 2), t AS (SELECT id, arg_min(k, round(e, 3) * 1000 + k / 1000)::INT AS period FROM l GROUP BY id) SELECT id, entropy, period FROM e JOIN t USING (id)"
)
def q54_binary_structure(spark, sf_dir):
    return Y.structure(SOURCES["records"][0](spark, sf_dir)).select("id", "entropy", F.col("periods")[0].alias("period"))


# --- containers -------------------------------------------------------------------------------


@query(
    "WITH n AS (SELECT c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1) SELECT id AS file_ordinal, CASE id % 4 WHEN 0 THEN 'sac' WHEN 1 THEN 'wav' WHEN 2 THEN CASE WHEN n >= 16 THEN 'float32' END END AS format, "
    "CASE WHEN id % 4 = 0 OR id % 4 = 2 AND n >= 16 THEN n::VARCHAR END AS samples, CASE WHEN id % 4 = 1 THEN (2 * n)::VARCHAR END AS size FROM n"
)
def q100_containers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    floats = F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda k: _le(_float_bits(k), 4)), "")
    rows = c.groupBy(F.col("c_nationkey").alias("file_ordinal")).agg(F.count(F.lit(1)).alias("n"), floats.alias("f"))
    kind = F.when(F.col("file_ordinal") % 8 == 0, F.lit(-12345)).otherwise(F.lit(1)).cast("long")
    zeros = lambda k: F.lit("00" * k)
    sac = F.concat(zeros(304), _le(F.lit(6).cast("long"), 4), zeros(8), _le(F.col("n"), 4), zeros(20), _le(kind, 4), zeros(632 - 344), F.col("f"))
    riff = F.concat(F.hex(F.lit("RIFF")), _le(F.col("n") * 2 + 36, 4), F.hex(F.lit("WAVEfmt ")), _le(F.lit(16).cast("long"), 4), _le(F.lit(1).cast("long"), 2), _le(F.lit(1).cast("long"), 2), zeros(8), _le(F.lit(2).cast("long"), 2), _le(F.lit(16).cast("long"), 2))
    wav = F.concat(riff, F.hex(F.lit("data")), _le(F.col("n") * 2, 4), F.substring(F.col("f"), F.lit(1), (F.col("n") * 4).cast("int")))
    content = F.unhex(F.when(F.col("file_ordinal") % 4 == 0, sac).when(F.col("file_ordinal") % 4 == 1, wav).when(F.col("file_ordinal") % 4 == 2, F.col("f")).otherwise(F.hex(F.lit("plain text, no container"))))
    found = C.detect_table(rows.select("file_ordinal", content.alias("content")))
    return found.select("file_ordinal", "format", F.col("details")["samples"].alias("samples"), F.col("details")["size"].alias("size"))


_SERIES = "s AS (SELECT (event_id % 20)::INT AS file_ordinal, row_number() OVER (PARTITION BY event_id % 20 ORDER BY event_id) - 1 AS place, round(value * 100)::BIGINT AS value FROM events)"


def _mini_seed(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 20).alias("file_ordinal"))
    x = F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.round(F.col("value") * 100).cast("long").alias("x")))), lambda r: r["x"])
    return C.mini_seed_files(e.agg(x.alias("samples")))


@query(f"WITH {_SERIES} SELECT file_ordinal, place::BIGINT AS place, value FROM s")
def q101_steim_samples(spark, sf_dir):
    s = C.sample_rows(_mini_seed(spark, sf_dir))
    return s.select("file_ordinal", (F.col("record_no") * 100 + F.col("sample_no")).cast("long").alias("place"), "value")


@query(f"WITH {_SERIES} SELECT file_ordinal, (place // 100)::INT AS record_no, count(*)::INT AS n_samples, bool_and(value < 2147483648) AS rebuilt FROM s GROUP BY 1, 2")
def q102_steim_records(spark, sf_dir):
    return C.record_table(_mini_seed(spark, sf_dir))


@query(f"WITH {_SERIES}, n AS (SELECT file_ordinal, ceil(count(*) / 100) AS n FROM s GROUP BY 1) SELECT file_ordinal, 'mseed' AS format, '512' AS record, '11' AS encoding, (512 * n)::BIGINT AS n_bytes FROM n")
def q103_mini_seed_detect(spark, sf_dir):
    files = _mini_seed(spark, sf_dir)
    found = C.detect_table(files).select("file_ordinal", "format", F.col("details")["record"].alias("record"), F.col("details")["encoding"].alias("encoding"))
    return found.join(files.select("file_ordinal", F.octet_length("content").cast("long").alias("n_bytes")), "file_ordinal")


# --- text formats -----------------------------------------------------------------------------


def _round_trip(files: DataFrame, transform: str) -> DataFrame:
    made = Y.transform_table(files.select(F.col("file_ordinal").alias("id"), "content"), transform)
    return Y.restore_table(made, transform).select(F.col("id").cast("int").alias("file_ordinal"), F.sha2("content", 256).alias("sha256"))


def _text_files(rows: DataFrame, by: Column, order: str, line: Column, head: Column | None = None) -> DataFrame:
    text = _joined(rows, by, order, F.concat(line, F.lit("\n")))
    body = F.col("text") if head is None else F.concat(head, F.col("text"))
    return text.select(F.col("id").cast("int").alias("file_ordinal"), F.encode(body, "ISO-8859-1").alias("content"))


_LOGS = "f AS (SELECT (event_id % 8)::INT AS file_ordinal, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' user' || user_id || ' ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' of ' || event_id ELSE '' END || chr(10), '' ORDER BY event_id) AS text FROM events GROUP BY 1)"


@query(f"WITH {_LOGS}, l AS (SELECT file_ordinal, unnest(string_split(substr(text, 1, 65536), chr(10))) AS line FROM f), s AS (SELECT file_ordinal, min(length(line) - length(replace(line, ' ', ''))) AS least, count(*) AS lines FROM l WHERE line != '' GROUP BY 1) SELECT file_ordinal, length(text) >= 2048 AND least >= 3 AND lines >= 32 AS is_log, sha256(text) AS sha256 FROM f JOIN s USING (file_ordinal)")
def q104_log_round_trip(spark, sf_dir):
    tail = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" of "), F.col("event_id").cast("string"))).otherwise("")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" user"), F.col("user_id").cast("string"), F.lit(" "), "event_type", tail)
    files = _text_files(table(spark, sf_dir, "events"), F.col("event_id") % 8, "event_id", line)
    return L.looks_like_log(files).join(_round_trip(files, "log3"), "file_ordinal")


_FIXED = "f AS (SELECT (c_custkey % 3)::INT AS file_ordinal, string_agg(lpad(c_custkey::VARCHAR, 9, '0') || rpad(c_name, 24, '.') || CASE WHEN c_custkey % 50 = 7 THEN '!' ELSE '' END || chr(10), '' ORDER BY c_custkey) AS text FROM customer GROUP BY 1)"


@query(
    f"WITH {_FIXED}, l AS (SELECT file_ordinal, length(line) AS w, count(*) AS n FROM (SELECT file_ordinal, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line FROM f) GROUP BY 1, 2), t AS (SELECT file_ordinal, arg_max(w, n) AS width, max(n) / sum(n) AS share, sum(n) AS lines FROM l GROUP BY 1) "
    "SELECT file_ordinal, width::INT AS width, share, width >= 16 AND share >= 0.5 AND lines >= 200 AS is_fixed, CASE WHEN is_fixed THEN sha256(text) END AS sha256 FROM f JOIN t USING (file_ordinal)"
)
def q105_fixed_width_round_trip(spark, sf_dir):
    line = F.concat(F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.rpad("c_name", 24, "."), F.when(F.col("c_custkey") % 50 == 7, "!").otherwise(""))
    files = _text_files(table(spark, sf_dir, "customer"), F.col("c_custkey") % 3, "c_custkey", line)
    return L.fixed_width(files).join(_round_trip(files, "fixed_width"), "file_ordinal")


_FASTA = "f AS (SELECT c_nationkey AS file_ordinal, '>nation ' || c_nationkey || chr(10) || string_agg(translate(md5(c_custkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGN') || chr(10), '' ORDER BY c_custkey) AS text FROM customer GROUP BY 1)"


@query(f"WITH {_FASTA}, b AS (SELECT *, substr(text, strpos(text, chr(10)) + 1, 4000) AS body FROM f) SELECT file_ordinal, length(regexp_replace(body, '[^ACGTacgt]', '', 'g')) > 0.9 * length(replace(body, chr(10), '')) AS is_fasta, CASE WHEN is_fasta THEN sha256(text) END AS sha256 FROM b")
def q106_fasta_round_trip(spark, sf_dir):
    line = F.translate(F.md5(F.col("c_custkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN")
    files = _text_files(table(spark, sf_dir, "customer"), F.col("c_nationkey"), "c_custkey", line, F.concat(F.lit(">nation "), F.col("id").cast("string"), F.lit("\n")))
    return L.looks_like_fasta(files).join(_round_trip(files, "fasta"), "file_ordinal")
