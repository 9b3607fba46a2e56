"""Queries over the sample tables, one for each operator that SQL can express, with that SQL.

Each name stands in QUERIES (a function of session and folder) and, with equal column names, in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import encodings as E
from ..operators import profile as P
from ..operators import relate as R
from ..operators import sequences as Q
from ..sources import files as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("x"))


_CENTS = "SELECT event_id, round(value * 100)::BIGINT AS x FROM events"


# --- sequences and their inverses -------------------------------------------------------------


@query(f"WITH c AS ({_CENTS}) SELECT event_id, x - coalesce(lag(x) OVER (ORDER BY event_id), 0) AS delta FROM c")
def q01_scaled_delta(spark, sf_dir):
    return E.delta(cents(spark, sf_dir), "event_id", "x").select("event_id", "delta")


@query(f"WITH c AS ({_CENTS}) SELECT event_id, x AS value FROM c")
def q02_delta_decode(spark, sf_dir):
    coded = E.delta(cents(spark, sf_dir), "event_id", "x").select("event_id", "delta")
    return E.undelta(coded, "event_id").select("event_id", "value")


@query(
    f"WITH c AS ({_CENTS}), d AS (SELECT event_id, x, x - coalesce(lag(x) OVER (ORDER BY event_id), 0) AS delta FROM c) "
    "SELECT event_id, delta, CASE WHEN delta < 0 THEN -2 * delta - 1 ELSE 2 * delta END AS zigzag, delta AS back FROM d"
)
def q03_zigzag(spark, sf_dir):
    d = E.zigzagged(E.delta(cents(spark, sf_dir), "event_id", "x"), "delta")
    return E.unzigzagged(d, "zigzag", "back").select("event_id", "delta", "zigzag", "back")


@query(
    f"WITH c AS ({_CENTS}), d AS (SELECT event_id, x, x - coalesce(lag(x) OVER (ORDER BY event_id), 0) AS d1 FROM c) "
    "SELECT event_id, d1 - coalesce(lag(d1) OVER (ORDER BY event_id), 0) AS delta2, x AS value FROM d"
)
def q04_second_order_delta(spark, sf_dir):
    coded = E.delta2(cents(spark, sf_dir), "event_id", "x").select("event_id", "delta2")
    return E.undelta2(coded, "event_id").select("event_id", "delta2", "value")


@query(f"WITH c AS ({_CENTS}) SELECT event_id, x - coalesce(lag(x, 2) OVER (ORDER BY event_id), 0) AS delta, x AS value FROM c")
def q05_lag2_delta(spark, sf_dir):
    coded = E.delta(cents(spark, sf_dir), "event_id", "x", 2).select("event_id", "delta")
    return E.undelta(coded, "event_id", 2).select("event_id", "delta", "value")


@query("SELECT event_id, xor(user_id, coalesce(lag(user_id) OVER (ORDER BY event_id), 0)) AS xored, user_id AS value FROM events")
def q06_xor_previous(spark, sf_dir):
    coded = E.xor_previous(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", "user_id").select("event_id", "xored")
    return E.unxor(coded, "event_id").select("event_id", "xored", "value")


_BLANK = "SELECT event_id, event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AND row_number() OVER (ORDER BY event_id) > 1 AS repeated, event_type FROM events"


@query(f"SELECT event_id, repeated, CASE WHEN NOT repeated THEN event_type END AS kept FROM ({_BLANK})")
def q07_blank_repeat(spark, sf_dir):
    b = E.blank_repeats(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type")
    return b.select("event_id", "repeated", F.col("kept.v").alias("kept"))


@query("SELECT event_id, event_type AS value FROM events")
def q08_blank_decode(spark, sf_dir):
    b = E.blank_repeats(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type")
    return E.fill_repeats(b.select("event_id", "kept"), "event_id").select("event_id", "value")


_RUNS = (
    "WITH m AS (SELECT event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AND row_number() OVER (ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS new FROM events), "
    "r AS (SELECT event_id, event_type, sum(new) OVER (ORDER BY event_id) AS run FROM m) "
)


@query(_RUNS + "SELECT run::BIGINT AS run, min(event_id) AS first_key, max(event_id) AS last_key, count(*) AS length, min(event_type) AS value FROM r GROUP BY run")
def q09_run_lengths(spark, sf_dir):
    return E.run_lengths(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type")


@query(_RUNS + "SELECT run::BIGINT AS run, row_number() OVER (PARTITION BY run ORDER BY event_id) - 1 AS place, event_type AS value FROM r")
def q10_run_expand(spark, sf_dir):
    runs = E.run_lengths(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type")
    return E.expand_runs(runs).select("run", F.col("place").cast("long").alias("place"), "value")


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def q11_dictionary_codes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return E.dictionary_encode(o, "o_orderpriority", E.dictionary(o, "o_orderpriority")).select("o_orderkey", F.col("code").cast("long").alias("code"))


@query("SELECT o_orderkey, o_orderpriority AS value FROM orders")
def q12_dictionary_decode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    codes = E.dictionary(o, "o_orderpriority")
    coded = E.dictionary_encode(o, "o_orderpriority", codes).select("o_orderkey", "code")
    return E.dictionary_decode(coded, codes).select("o_orderkey", "value")


# --- profiles ---------------------------------------------------------------------------------


def order_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("source", F.lit("erp"))
    return P.long_form(o, "o_orderkey", ["o_orderstatus", "o_orderpriority", "source"])


_ORDER_CELLS = (
    "cells AS (SELECT 'o_orderstatus' AS col, o_orderkey AS key, o_orderstatus AS value FROM orders "
    "UNION ALL SELECT 'o_orderpriority', o_orderkey, o_orderpriority FROM orders UNION ALL SELECT 'source', o_orderkey, 'erp' FROM orders) "
)


@query(f"WITH {_ORDER_CELLS} SELECT col, min(value) AS value FROM cells GROUP BY col HAVING count(DISTINCT value) = 1 AND count(value) = count(*)")
def q13_constant_columns(spark, sf_dir):
    return P.constants(order_cells(spark, sf_dir))


@query(
    f"WITH {_ORDER_CELLS}, r AS (SELECT col, coalesce(value = lag(value) OVER (PARTITION BY col ORDER BY key), false) AS rep FROM cells) "
    "SELECT col, count(*) AS n, sum(rep::INT)::BIGINT AS repeats, CASE WHEN 2 * sum(rep::INT) > count(*) THEN 'blank' ELSE 'plain' END AS method FROM r GROUP BY col"
)
def q14_repeat_rate(spark, sf_dir):
    return P.repeat_rates(order_cells(spark, sf_dir))


def price_cells(spark, sf_dir):
    c = cents(spark, sf_dir)
    fixed = S.unscaled(F.col("x"), 2)
    short = F.when(F.col("x") % 100 == 0, S.unscaled(F.floor(F.col("x") / 100), 0)).otherwise(fixed)
    return P.long_form(c.select("event_id", fixed.alias("fixed"), short.alias("mixed"), F.col("event_id").cast("string").alias("whole"), F.lit("n/a").alias("text")), "event_id", ["fixed", "mixed", "whole", "text"])


_PRICE_CELLS = (
    f"c AS ({_CENTS}), f AS (SELECT event_id, x, CASE WHEN x < 0 THEN '-' ELSE '' END || (abs(x) // 100)::VARCHAR || '.' || lpad((abs(x) % 100)::VARCHAR, 2, '0') AS fixed FROM c), "
    "cells AS (SELECT 'fixed' AS col, event_id AS key, fixed AS value FROM f UNION ALL SELECT 'mixed', event_id, CASE WHEN x % 100 = 0 THEN (x // 100)::VARCHAR ELSE fixed END FROM f "
    "UNION ALL SELECT 'whole', event_id, event_id::VARCHAR FROM f UNION ALL SELECT 'text', event_id, 'n/a' FROM f) "
)


@query(
    f"WITH {_PRICE_CELLS}, d AS (SELECT col, CASE WHEN regexp_full_match(value, '-?(0|[1-9][0-9]*)(\\.[0-9]{{1,9}})?') AND NOT regexp_full_match(value, '-0(\\.0*)?') THEN CASE WHEN strpos(value, '.') > 0 THEN length(value) - strpos(value, '.') ELSE 0 END END AS d FROM cells) "
    "SELECT col, coalesce(min(d), -1)::INT AS lowest, coalesce(max(d), -1)::INT AS highest, coalesce(min(d) = max(d) AND count(d) = count(*), false) AS uniform FROM d GROUP BY col"
)
def q15_uniform_decimals(spark, sf_dir):
    return P.uniform_decimals(price_cells(spark, sf_dir)).fillna(-1, ["lowest", "highest"])


@query(
    f"WITH {_ORDER_CELLS}, w AS (SELECT col, length(value) AS width, count(*) AS n, min(key) AS first FROM cells GROUP BY 1, 2), "
    "t AS (SELECT col, width, n, sum(n) OVER (PARTITION BY col) AS total, row_number() OVER (PARTITION BY col ORDER BY n DESC, first) AS rn FROM w) "
    "SELECT col, width::INT AS width, n, n / total AS share, n / total >= 0.9 AND width >= 2 AS fixed FROM t WHERE rn = 1"
)
def q16_modal_width(spark, sf_dir):
    return P.modal_widths(order_cells(spark, sf_dir))


@query(
    "WITH o AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 65536 AS block FROM orders) "
    "SELECT block, (p - 1)::INT AS pos, string_agg(substr(o_orderpriority, p, 1), '' ORDER BY o_orderkey) AS text FROM o, range(1, 6) t(p) WHERE p <= length(o_orderpriority) GROUP BY block, p"
)
def q17_character_transposition(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 5).alias("v"))
    return E.transpose(o, "o_orderkey", "v")


@query(
    f"WITH {_ORDER_CELLS}, v AS (SELECT col, value, count(*) AS c FROM cells GROUP BY 1, 2) "
    "SELECT col, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM v GROUP BY col"
)
def q18_entropy(spark, sf_dir):
    return P.entropies(order_cells(spark, sf_dir))


@query(
    f"WITH {_ORDER_CELLS}, a AS (SELECT col, count(DISTINCT value) AS n_distinct, sum(length(value)) / count(*) AS m FROM cells GROUP BY col) "
    "SELECT col, n_distinct, (row_number() OVER (ORDER BY n_distinct, m, col) - 1)::INT AS place FROM a"
)
def q19_column_order(spark, sf_dir):
    return P.column_order(order_cells(spark, sf_dir))


def int_cells(spark, sf_dir):
    return P.long_form(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"])


@query(
    "WITH cells AS (SELECT 'l_orderkey' AS col, l_orderkey AS x FROM lineitem UNION ALL SELECT 'l_partkey', l_partkey FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem), "
    "m AS (SELECT col, min(x) AS low, max(x) AS high FROM cells GROUP BY col) "
    "SELECT col, low, high, CASE WHEN low >= 0 AND high < 256 THEN 'u8' WHEN low >= -128 AND high < 128 THEN 'i8' WHEN low >= 0 AND high < 65536 THEN 'u16' WHEN low >= -32768 AND high < 32768 THEN 'i16' "
    "WHEN low >= 0 AND high < 4294967296 THEN 'u32' WHEN low >= -2147483648 AND high < 2147483648 THEN 'i32' ELSE 'i64' END AS kind FROM m"
)
def q20_narrowest_int(spark, sf_dir):
    return P.int_widths(int_cells(spark, sf_dir))


# --- relations --------------------------------------------------------------------------------


def key_cells(spark, sf_dir):
    one = table(spark, sf_dir, "orders").select(F.lit("o_custkey").alias("col"), F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("value"))
    two = table(spark, sf_dir, "customer").select(F.lit("c_custkey").alias("col"), F.col("c_custkey").alias("key"), F.col("c_custkey").cast("string").alias("value"))
    three = table(spark, sf_dir, "supplier").select(F.lit("s_suppkey").alias("col"), F.col("s_suppkey").alias("key"), F.col("s_suppkey").cast("string").alias("value"))
    return one.union(two).union(three)


_KEY_CELLS = (
    "cells AS (SELECT 'o_custkey' AS col, o_orderkey AS key, o_custkey::VARCHAR AS value FROM orders UNION ALL SELECT 'c_custkey', c_custkey, c_custkey::VARCHAR FROM customer "
    "UNION ALL SELECT 's_suppkey', s_suppkey, s_suppkey::VARCHAR FROM supplier) "
)
_OVERLAP = (
    "v AS (SELECT DISTINCT col, value FROM {src}), n AS (SELECT col, count(*) AS n FROM v GROUP BY col), "
    "p AS (SELECT x.col AS a, y.col AS b, count(*) AS shared FROM v x JOIN v y ON x.value = y.value AND x.col < y.col GROUP BY 1, 2) "
    "SELECT a, b, shared, na.n AS n_a, nb.n AS n_b, round(shared / (na.n + nb.n - shared), 6) AS jaccard FROM p JOIN n na ON na.col = a JOIN n nb ON nb.col = b"
)


@query(f"WITH {_KEY_CELLS}, {_OVERLAP.format(src='cells')}")
def q21_shared_vocabulary(spark, sf_dir):
    return R.overlaps(key_cells(spark, sf_dir))


@query(
    f"WITH {_KEY_CELLS}, k AS (SELECT col, greatest(1, count(*) // 300) AS step FROM cells GROUP BY col), s AS (SELECT p.col, value FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY key) - 1 AS at_ FROM cells) p JOIN k USING (col) WHERE at_ % step = 0), " + _OVERLAP.format(src="s")
)
def q22_sampled_overlap(spark, sf_dir):
    return R.overlaps(R.sampled(key_cells(spark, sf_dir)))


def money(spark, sf_dir):
    c = lambda x: F.round(F.col(x) * 100).cast("long")
    li = table(spark, sf_dir, "lineitem").select(c("l_extendedprice").alias("price"), c("l_quantity").alias("qty"), c("l_tax").alias("tax"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    return li.withColumn("total", F.col("price") + F.col("qty") + F.col("tax"))


_MONEY = (
    "m AS (SELECT *, price + qty + tax AS total FROM (SELECT round(l_extendedprice * 100)::BIGINT AS price, round(l_quantity * 100)::BIGINT AS qty, round(l_tax * 100)::BIGINT AS tax, "
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate FROM lineitem)) "
)


@query(f"WITH {_MONEY} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, total - price AS residual FROM m")
def q23_one_column_difference(spark, sf_dir):
    m = money(spark, sf_dir)
    return m.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", R.difference(F.col("total"), F.col("price")).alias("residual"))


_VARINT = "(CASE WHEN {z} < 128 THEN 1 WHEN {z} < 16384 THEN 2 WHEN {z} < 2097152 THEN 3 WHEN {z} < 268435456 THEN 4 WHEN {z} < 34359738368 THEN 5 ELSE 6 END)"
_ZZ = "(CASE WHEN ({x}) < 0 THEN -2 * ({x}) - 1 ELSE 2 * ({x}) END)"


def _cost(x: str) -> str:
    return f"sum({_VARINT.format(z=_ZZ.format(x=x))})::BIGINT"


_OWN = {c: _cost(c) for c in ("qty", "tax", "total")}
_COSTS = [("qty", "price"), ("tax", "price"), ("tax", "qty"), ("tax", "price,qty"), ("total", "price"), ("total", "qty"), ("total", "tax"), ("total", "price,qty"), ("total", "price,tax"), ("total", "qty,tax"), ("total", "price,qty,tax")]


@query(f"WITH {_MONEY} " + " UNION ALL ".join(f"SELECT '{t}' AS target, '{m}' AS minus, {_cost(t + ' - ' + m.replace(',', ' - '))} AS cost, {_OWN[t]} AS own FROM m" for t, m in _COSTS))
def q24_difference_costs(spark, sf_dir):
    return R.difference_costs(money(spark, sf_dir), ["price", "qty", "tax", "total"])


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1")
def q25_least_squares(spark, sf_dir):
    return R.linear_fit(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])


@query(f"WITH {_MONEY} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, price - 15 * qty - 7 AS residual, price AS value FROM m")
def q26_linear_residual(spark, sf_dir):
    m = money(spark, sf_dir).withColumn("residual", R.linear_residual(F.col("price"), F.col("qty"), 15, 7))
    return m.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "residual", R.linear_value(F.col("residual"), F.col("qty"), 15, 7).alias("value"))


@query(f"WITH {_MONEY} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, (total - price - qty) & 65535 AS minus, xor(xor(total, price), qty) & 65535 AS xored, total & 65535 AS value FROM m")
def q27_two_reference_checksum(spark, sf_dir):
    refs = [F.col("price"), F.col("qty")]
    m = money(spark, sf_dir).withColumn("minus", R.cross_field(F.col("total"), refs, "sub", 16))
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
    return m.select(*keys, "minus", R.cross_field(F.col("total"), refs, "xor", 16).alias("xored"), R.uncross_field(F.col("minus"), refs, "sub", 16).alias("value"))


@query("SELECT list_reduce(list(round(p_retailprice * 100)::BIGINT * 25), lambda a, b: gcd(a, b)) AS gcd FROM part")
def q28_gcd(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.round(F.col("p_retailprice") * 100).cast("long") * 25).alias("x"))
    return P.gcd(p, "x")


# --- batches, manifests, lookups --------------------------------------------------------------


@query(
    "WITH RECURSIVE f AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents), "
    "w AS (SELECT i, doc_id, 0 AS batch_id, 1 AS files, n_chars AS total FROM f WHERE i = 1 "
    "UNION ALL SELECT f.i, f.doc_id, CASE WHEN w.files + 1 > 16 OR w.total + f.n_chars > 20000 THEN w.batch_id + 1 ELSE w.batch_id END, "
    "CASE WHEN w.files + 1 > 16 OR w.total + f.n_chars > 20000 THEN 1 ELSE w.files + 1 END, "
    "CASE WHEN w.files + 1 > 16 OR w.total + f.n_chars > 20000 THEN f.n_chars ELSE w.total + f.n_chars END FROM w JOIN f ON f.i = w.i + 1) "
    "SELECT doc_id AS file_ordinal, batch_id FROM w"
)
def q29_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_ordinal"), F.col("n_chars").alias("n_bytes"))
    return L.batches(d, 16, 20000)


@query("SELECT doc_id AS name, sha256(text) AS sha256, strlen(text) AS n_bytes FROM documents")
def q30_digest_manifest(spark, sf_dir):
    from ..operators.archive import digests

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").cast("binary").alias("content"))
    return digests(d).select("name", "sha256", "n_bytes")


@query(
    "WITH a AS (SELECT doc_id, sha256(text) AS s FROM documents), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || ' ' ELSE text END) AS s FROM documents WHERE doc_id % 7 != 5) "
    "SELECT CASE WHEN b.s IS NULL THEN 'missing' WHEN a.s IS NULL THEN 'new' WHEN a.s = b.s THEN 'same' ELSE 'differs' END AS state, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1"
)
def q31_verify(spark, sf_dir):
    from ..operators.archive import compare

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").cast("binary").alias("content"))
    changed = d.filter("name % 7 != 5").withColumn("content", F.when(F.col("name") % 10 == 3, F.concat("content", F.lit(b" "))).otherwise(F.col("content")))
    return compare(d, changed).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id::VARCHAR AS name, sha256(text) AS sha256 FROM documents WHERE doc_id = 42")
def q32_point_lookup(spark, sf_dir):
    from ..operators.archive import unpack

    return unpack(spark, _packed_texts(spark, sf_dir), ["42"]).select("name", F.sha2("content", 256).alias("sha256"))


# --- lines and fields -------------------------------------------------------------------------


def document_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return d


_LINES = "l AS (SELECT doc_id, line, (line_no - 1)::INT AS line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)) "


@query(
    f"WITH {_LINES}, s AS (SELECT doc_id, line_no, string_split(line, ' ') AS p FROM l) "
    "SELECT doc_id, line_no, coalesce(p[1], '') AS f0, coalesce(p[2], '') AS f1, coalesce(p[3], '') AS f2, array_to_string(p[4:], ' ') AS rest FROM s"
)
def q33_log_fields(spark, sf_dir):
    f = L.log_fields(document_lines(spark, sf_dir), 3)
    return f.select("doc_id", "line_no", *(F.col("fields")[i].alias(f"f{i}") for i in range(3)), F.col("fields")[3].alias("rest"))


@query("SELECT doc_id, h.pos::BIGINT AS pos, h.x AS hex FROM (SELECT doc_id, unnest(list_zip(range(len(regexp_extract_all(text, '[0-9a-f]{16,}'))), regexp_extract_all(text, '[0-9a-f]{16,}'))) AS z FROM documents) q, LATERAL (SELECT z[1] AS pos, z[2] AS x) h")
def q34_hex_runs(spark, sf_dir):
    from .measure import log_extracts

    d = log_extracts(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("line"))).select("doc_id", F.posexplode("hexes").alias("pos", "hex"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "hex")


@query(
    f"WITH c AS ({_CENTS}) " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS lag, sum((x = p)::INT)::BIGINT AS equal, count(*) AS pairs, round(avg(abs(x - p)), 4) AS mean_step FROM (SELECT x, lag(x, {k}) OVER (ORDER BY event_id) AS p FROM c) WHERE p IS NOT NULL" for k in range(1, 5))
)
def q35_period_scores(spark, sf_dir):
    out = None
    for k in range(1, 5):
        p = Q.previous(cents(spark, sf_dir), "event_id", "x", "p", k).filter("p is not null")
        one = p.agg(F.lit(k).cast("long").alias("lag"), F.sum((F.col("x") == F.col("p")).cast("long")).alias("equal"), F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.abs(F.col("x") - F.col("p"))), 4).alias("mean_step"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT event_id // 1024 AS bucket, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def q36_position_buckets(spark, sf_dir):
    return P.position_buckets(table(spark, sf_dir, "events"), "event_id", "value", 1024)


@query("SELECT count(*) AS n, count(*) FILTER (floor(l_quantity) = l_quantity AND abs(l_quantity) <= 2147483647) AS n_whole, count(*) = count(*) FILTER (floor(l_quantity) = l_quantity AND abs(l_quantity) <= 2147483647) AS narrow FROM lineitem")
def q37_whole_floats(spark, sf_dir):
    return P.whole_floats(table(spark, sf_dir, "lineitem"), "l_quantity")


@query(f"SELECT {_VARINT.format(z='l_partkey')} AS bytes, count(*) AS n FROM lineitem GROUP BY 1")
def q38_varint_lengths(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(S.varint_length(F.col("l_partkey")).alias("bytes")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT c_custkey, c_name || ',x' AS f1, c_acctbal_text AS f2, n AS n_fields FROM (SELECT c_custkey, c_name, (round(c_acctbal * 100)::BIGINT)::VARCHAR AS c_acctbal_text, 3 AS n FROM customer)"
)
def q41_quoted_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.col("c_name"), F.lit(',x"')), F.round(F.col("c_acctbal") * 100).cast("long").cast("string"))
    f = c.select("c_custkey", S.split_quoted(line, ",").alias("f"))
    return f.select("c_custkey", F.regexp_replace(F.col("f")[1], '"', "").alias("f1"), F.col("f")[2].alias("f2"), F.size("f").alias("n_fields"))


@query(
    "WITH f AS (SELECT o_orderkey, [o_orderkey::VARCHAR, o_orderstatus, o_orderpriority] AS f FROM orders) "
    "SELECT (o_orderkey % 4)::INT AS file_ordinal, c::INT AS col_no, count(*) AS n, sum(length(f[c + 1]))::BIGINT AS chars FROM f, range(3) t(c) GROUP BY 1, 2"
)
def q42_aligned_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("file_ordinal", (F.col("o_orderkey") % 4).cast("int"))
    rows = Q.row_numbers(o.select("file_ordinal", "o_orderkey", F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("fields")), "o_orderkey", "row_no", ["file_ordinal"])
    cells = L.aligned_columns(rows.select("file_ordinal", F.col("row_no").cast("long").alias("row_no"), "fields"))
    return cells.groupBy("file_ordinal", "col_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))


@query("SELECT c_custkey AS row, rpad(substr(c_name, 1, 12), 12, '.') AS value FROM customer")
def q43_transposition_inverse(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.rpad(F.substring("c_name", 1, 12), 12, ".").alias("v"))
    keyed = Q.row_numbers(c, "c_custkey", "row").select(F.col("row").cast("long").alias("row"), "c_custkey")
    back = E.untranspose(E.transpose(c, "c_custkey", "v", 100), 100)
    return back.join(keyed, "row").select(F.col("c_custkey").alias("row"), "value")


@query("SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS place, c_custkey FROM customer")
def q44_row_numbers(spark, sf_dir):
    return Q.row_numbers(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "place").select(F.col("place").cast("long").alias("place"), "c_custkey")


@query(
    f"WITH {_PRICE_CELLS}, d AS (SELECT key, value, replace(value, '.', '')::BIGINT AS n FROM cells WHERE col = 'fixed') SELECT key, n, value AS back FROM d"
)
def q45_exact_decimals(spark, sf_dir):
    c = price_cells(spark, sf_dir).filter("col = 'fixed'")
    n = c.select("key", S.scaled(F.col("value"), 2).alias("n"))
    return n.select("key", "n", S.unscaled(F.col("n"), 2).alias("back"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') AS back FROM events")
def q46_timestamp_text(spark, sf_dir):
    text = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"))
    parsed = S.timestamp_seconds(F.col("t"), 0)
    return text.select("event_id", parsed.alias("seconds"), S.timestamp_text(parsed, 0).alias("back"))


@query()
def q47_crc_manifest(spark, sf_dir):
    from ..operators.archive import digests

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").cast("binary").alias("content"))
    return digests(d).select(F.col("name").alias("doc_id"), "crc32")


# --- coders, archives, binary records ---------------------------------------------------------


@query()
def q39_codec_sizes(spark, sf_dir):
    from .planner import code_sizes

    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return code_sizes(d, "doc_id", "content", ["raw", "zlib", "bz2", "lzma"])


_SIZES = "SELECT col, count(*) + sum(length(value)) AS plain, count(*) + max(own) AS coded FROM cells JOIN (SELECT col, sum(length(value) + 1) AS own FROM (SELECT DISTINCT col, value FROM cells) GROUP BY col) USING (col) GROUP BY col"


@query(
    f"WITH {_ORDER_CELLS}, s AS ({_SIZES}), c AS (SELECT col, 'plain' AS coder, 0 AS ordinal, plain AS bytes FROM s UNION ALL SELECT col, 'dictionary', 1, coded FROM s UNION ALL SELECT col, 'raw', -1, 3 * 15000 FROM s) "
    "SELECT col, arg_min(coder, bytes * 10 + ordinal) AS coder, min(bytes)::BIGINT AS bytes FROM c GROUP BY col"
)
def q40_planner_choice(spark, sf_dir):
    from .planner import narrow, never_worse

    cells = order_cells(spark, sf_dir)
    plain = cells.groupBy("col").agg((F.count(F.lit(1)) + F.sum(F.length("value"))).alias("bytes"), F.count(F.lit(1)).alias("n"))
    words = cells.select("col", "value").distinct().groupBy("col").agg(F.sum(F.length("value") + 1).alias("own"))
    coded = plain.join(words, "col").select("col", (F.col("n") + F.col("own")).alias("bytes"))
    both = plain.select("col", F.lit("plain").alias("coder"), F.lit(0).alias("ordinal"), "bytes").union(coded.select("col", F.lit("dictionary"), F.lit(1), "bytes"))
    raw = plain.select("col", F.lit(3 * 15000).cast("long").alias("bytes"))
    return never_worse(narrow(both, ["col"], 1), raw, ["col"])


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def q64_coder_round_trip(spark, sf_dir):
    from ..functions.coders import best_coder, decoded

    d = table(spark, sf_dir, "documents").select("doc_id", best_coder(F.col("text").cast("binary")).alias("c"))
    return d.select("doc_id", F.sha2(decoded(F.col("c.coder"), F.col("c.payload")), 256).alias("sha256"))


def order_files(spark, sf_dir):
    """Orders as 20 CSV files."""
    o = table(spark, sf_dir, "orders")
    cells = ["o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("p"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_orderpriority"]
    rows = o.select((F.col("o_orderkey") % 20).cast("int").alias("file_ordinal"), "o_orderkey", F.concat_ws(",", *cells).alias("line"))
    content = F.concat("body", F.encode(F.lit("\n"), "ISO-8859-1"))
    return L.joined(rows, "o_orderkey").select("file_ordinal", F.format_string("orders-%02d.csv", "file_ordinal").alias("name"), content.alias("content"))


_ORDER_FILES = (
    "f AS (SELECT (o_orderkey % 20)::INT AS k, string_agg(o_orderkey || ',' || o_custkey || ',' || o_orderstatus || ',' || round(o_totalprice * 100)::BIGINT || ',' || strftime(o_orderdate, '%Y-%m-%d') || ',' || o_orderpriority, chr(10) ORDER BY o_orderkey) || chr(10) AS text FROM orders GROUP BY 1)"
)


#: Archives of this session by what they hold, so that several queries read one.
_ARCHIVES: dict[tuple[str, str, str], str] = {}


def _archive(spark, sf_dir, name: str, files: Callable[[], DataFrame], max_files: int) -> str:
    from ..operators.archive import pack_files
    from ..sources.shared import new_path

    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ARCHIVES:
        path = new_path(spark, "archive")
        pack_files(files(), path, max_files=max_files)
        _ARCHIVES[key] = path
    return _ARCHIVES[key]


def _packed(spark, sf_dir) -> str:
    return _archive(spark, sf_dir, "orders", lambda: order_files(spark, sf_dir), 3)


def _packed_texts(spark, sf_dir) -> str:
    d = table(spark, sf_dir, "documents")
    files = d.select(F.col("doc_id").cast("int").alias("file_ordinal"), F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"))
    return _archive(spark, sf_dir, "texts", lambda: files, 64)


@query("SELECT doc_id::VARCHAR AS name, sha256(text) AS sha256, strlen(text) AS n_bytes FROM documents")
def q65_archive_of_texts(spark, sf_dir):
    """Files of no common shape: their batches are stored raw."""
    from ..operators.archive import unpack

    back = unpack(spark, _packed_texts(spark, sf_dir))
    return back.select("name", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("n_bytes"))


@query(f"WITH {_ORDER_FILES} SELECT 'orders-' || lpad(k::VARCHAR, 2, '0') || '.csv' AS name, sha256(text) AS sha256, strlen(text) AS n_bytes FROM f")
def q48_archive_round_trip(spark, sf_dir):
    from ..operators.archive import unpack

    back = unpack(spark, _packed(spark, sf_dir))
    return back.select("name", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("n_bytes"))


@query(f"WITH {_ORDER_FILES} SELECT 'orders-13.csv' AS name, sha256(text) AS sha256 FROM f WHERE k = 13")
def q49_archive_get(spark, sf_dir):
    from ..operators.archive import unpack

    return unpack(spark, _packed(spark, sf_dir), ["orders-13.csv"]).select("name", F.sha2("content", 256).alias("sha256"))


@query(f"WITH {_ORDER_FILES} SELECT 'orders-' || lpad(k::VARCHAR, 2, '0') || '.csv' AS name, (k // 3)::INT AS batch_id, strlen(text) AS n_bytes FROM f")
def q50_archive_list(spark, sf_dir):
    from ..operators.archive import list_files

    return list_files(spark, _packed(spark, sf_dir)).select("name", F.col("batch_id").cast("int").alias("batch_id"), "n_bytes")


@query(f"WITH {_ORDER_FILES} SELECT k AS file_ordinal, sha256(text) AS sha256, len(string_split(text, chr(10)))::BIGINT - 1 AS n_rows, 6 AS width FROM f")
def q51_table_round_trip(spark, sf_dir):
    files = order_files(spark, sf_dir)
    rows, heads = L.table(files)
    back = L.rebuild(rows, heads).join(heads.select("file_ordinal", "n_rows", "width"), "file_ordinal")
    return back.select("file_ordinal", F.sha2("content", 256).alias("sha256"), "n_rows", "width")


@query("SELECT ';' AS sep, 3 AS width, count(*) FILTER (c_custkey % 7 != 3) / count(*) AS share FROM customer")
def q52_sniffed_delimiter(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit(';"')), F.concat(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 7 == 3, ";more").otherwise("")))
    rows = c.groupBy((F.col("c_custkey") % 5).cast("int").alias("file_ordinal")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return L.sniff(rows.select("file_ordinal", F.encode(F.concat("t", F.lit("\n")), "ISO-8859-1").alias("content")))


def binary_rows(spark, sf_dir):
    """Documents' embeddings and texts as binary values."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.encode(F.array_join(F.transform("embedding", lambda x: F.round(x * 1000).cast("int").cast("string")), ","), "ISO-8859-1").alias("content"))


@query("SELECT vec_id AS id, sha256(array_to_string(list_transform(embedding, lambda x: CASE WHEN x < 0 THEN -floor(abs(x::DOUBLE * 1000) + 0.5)::INT ELSE floor(x::DOUBLE * 1000 + 0.5)::INT END), ',')) AS sha256 FROM embeddings")
def q53_binary_round_trip(spark, sf_dir):
    from ..operators.binary import compress_table, decompress_table

    return decompress_table(compress_table(binary_rows(spark, sf_dir))).select("id", F.sha2("content", 256).alias("sha256"))


_LINED = "l AS (SELECT l_partkey AS part, l_suppkey AS supp, 7 * l_partkey + l_linenumber + 40 AS lined, 900 - 2 * l_suppkey AS falling FROM lineitem)"
_LINE_PAIRS = [(y, x) for y in ("part", "supp", "lined", "falling") for x in ("part", "supp", "lined", "falling") if x != y]


def _line_sql(y: str, x: str) -> str:
    return f"SELECT '{y}' AS y, '{x}' AS x, a, b, {_cost(f'{y} - {x} * a - b')} AS cost, {_cost(y)} AS own FROM l, (SELECT round(regr_slope({y}, {x}))::BIGINT AS a, round(regr_intercept({y}, {x}))::BIGINT AS b FROM l) GROUP BY a, b HAVING a BETWEEN -127 AND 127 AND a != 0"


@query(f"WITH {_LINED}, c AS (" + " UNION ALL ".join(_line_sql(y, x) for y, x in _LINE_PAIRS) + ") SELECT * FROM c WHERE cost < own")
def q55_best_lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    columns = li.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), (F.col("l_partkey") * 7 + F.col("l_linenumber") + 40).alias("lined"), (F.lit(900) - F.col("l_suppkey") * 2).alias("falling"))
    return R.best_line(columns, ["part", "supp", "lined", "falling"])


@query(
    f"WITH {_MONEY}, c AS (" + " UNION ALL ".join(f"SELECT '{m}' AS minus, {_cost('total - ' + m.replace(',', ' - '))} AS cost FROM m" for t, m in _COSTS if t == "total") + ") "
    "SELECT 'total' AS target, minus FROM c ORDER BY cost, len(string_split(minus, ',')), minus LIMIT 1"
)
def q56_best_difference(spark, sf_dir):
    return R.best_differences(money(spark, sf_dir), ["price", "qty", "tax", "total"]).filter("target = 'total'").select("target", "minus")


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def q57_windowed_profile(spark, sf_dir):
    from ..streaming.ingest import windowed_profile

    return windowed_profile(table(spark, sf_dir, "events"))


@query("WITH l AS (SELECT doc_id, text FROM documents) SELECT doc_id, sha256(text) AS sha256 FROM l")
def q58_log_extract_restore(spark, sf_dir):
    from .measure import log_extracts, log_restore

    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("line"))
    return log_restore(log_extracts(d).drop("line")).select("doc_id", F.sha2(F.col("line").cast("binary"), 256).alias("sha256"))


@query("SELECT k.kind, 'zstd' AS codec, n_regionkey, count(*) AS n, sum(n_nationkey)::BIGINT AS keys, min(n_name) AS first_name FROM nation, (VALUES ('parquet'), ('orc')) k(kind) GROUP BY ALL")
def q59_storage_round_trip(spark, sf_dir):
    from ..sources.shared import new_path
    from .measure import storage_sizes

    rows, path, out = table(spark, sf_dir, "nation"), new_path(spark, "sizes"), None
    for kind, codec, size, _, same in storage_sizes(rows, path, (("parquet", "zstd"), ("orc", "zstd"))):
        if not same or not size:
            raise ValueError(f"{kind} gave other rows back")
        back = spark.read.format(kind).load(f"{path}/{kind}-{codec}").select(F.lit(kind).alias("kind"), F.lit(codec).alias("codec"), "n_regionkey", "n_nationkey", "n_name")
        out = back if out is None else out.union(back)
    return out.groupBy("kind", "codec", "n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("keys"), F.min("n_name").alias("first_name"))


@query("SELECT (i * 8 // n)::INT AS file_ordinal, count(*) AS n_lines FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) GROUP BY 1")
def q60_split_rows(spark, sf_dir):
    from .measure import split_rows

    c = Q.row_numbers(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "at")
    lines = c.select((F.col("at") + 1).cast("long").alias("line_no"), "c_name").toDF("line_no", "line")
    head = spark.createDataFrame([(0, "c_name")], "line_no long, line string")
    files = split_rows(head.union(lines), 8)
    return files.select("file_ordinal", (F.size(F.split(F.decode("content", "ISO-8859-1"), "\n")).cast("long") - 2).alias("n_lines"))


@query(f"WITH {_ORDER_FILES} SELECT k::BIGINT AS id, sha256(text) AS sha256, strlen(text) AS raw_bytes FROM f")
def q61_text_formats_round_trip(spark, sf_dir):
    from ..operators.binary import compress_table, decompress_table

    files = order_files(spark, sf_dir).select(F.col("file_ordinal").cast("long").alias("id"), "content")
    coded = compress_table(files)
    back = decompress_table(coded).select("id", F.sha2("content", 256).alias("sha256"))
    return back.join(coded.select("id", "raw_bytes"), "id")


@query(f"WITH {_ORDER_FILES}, x AS (SELECT k, string_split(rtrim(text, chr(10)), chr(10)) AS l FROM f) SELECT k AS file_ordinal, length(l[1])::INT AS first_width, len(l)::BIGINT AS n_lines FROM x")
def q62_lines(spark, sf_dir):
    rows = L.lines(order_files(spark, sf_dir))
    return rows.groupBy("file_ordinal").agg(F.min_by(F.length("line"), "line_no").alias("first_width"), F.count(F.lit(1)).alias("n_lines"))


_PAIRED = "x AS (SELECT a, b FROM o WHERE shared > 1 AND shared >= 0.3 * least(n_a, n_b)), f AS (SELECT EXISTS (FROM x WHERE a = 'c_custkey' AND b = 'o_custkey') AS co, EXISTS (FROM x WHERE a = 'c_custkey' AND b = 's_suppkey') AS cs, EXISTS (FROM x WHERE a = 'o_custkey' AND b = 's_suppkey') AS os)"
_SAMPLED = "k AS (SELECT col, greatest(1, count(*) // 300) AS step FROM cells GROUP BY col), s AS (SELECT p.col, value FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY key) - 1 AS at_ FROM cells) p JOIN k USING (col) WHERE at_ % step = 0)"


@query(
    f"WITH {_KEY_CELLS}, {_SAMPLED}, o AS (WITH {_OVERLAP.format(src='s')}), {_PAIRED}, g AS (SELECT 'c_custkey' AS col, 0 AS seed FROM f UNION ALL SELECT 'o_custkey', CASE WHEN co THEN 0 ELSE 1 END FROM f UNION ALL SELECT 's_suppkey', CASE WHEN cs THEN 0 WHEN NOT co AND os THEN 1 ELSE 2 END FROM f) "
    "SELECT (dense_rank() OVER (ORDER BY seed) - 1)::INT AS group_id, col FROM g"
)
def q63_vocabulary_groups(spark, sf_dir):
    groups = R.vocabulary_groups(key_cells(spark, sf_dir))
    return spark.createDataFrame([(i, c) for i, g in enumerate(groups) for c in g], "group_id int, col string")
