"""The registered queries of the library, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.functions import delimited, habits, sqltable
from rowproof.functions.cells import as_text, is_number, row_hash, to_text
from rowproof.operators import columns, compare, differences, keys
from rowproof.plans import delimited_sql
from rowproof.plans.sides import CMP_SQL, LINE_SQL, ORDER_SQL, line_sides, order_sides, table
from rowproof.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_CELLS = [f"c{i}" for i in range(1, 6)]
_CELL_LIST = ", ".join(_CELLS)
_ORDERS, _LINES = f"WITH {ORDER_SQL}, {CMP_SQL} ", f"WITH {LINE_SQL}, {CMP_SQL} "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _hex(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.lower(F.hex("h")))


_METRICS_SQL = """SELECT CAST(sum(least(an, bn)) AS BIGINT) AS matched_rows, CAST(coalesce(sum(an) FILTER (bn = 0), 0) AS BIGINT) AS only_a,
CAST(coalesce(sum(bn) FILTER (an = 0), 0) AS BIGINT) AS only_b, CAST(coalesce(sum(an - bn) FILTER (an > bn AND bn > 0), 0) AS BIGINT) AS extra_a,
CAST(coalesce(sum(bn - an) FILTER (bn > an AND an > 0), 0) AS BIGINT) AS extra_b, count(*) FILTER (an > 0) AS distinct_a, count(*) FILTER (bn > 0) AS distinct_b,
CAST(sum(an) AS BIGINT) AS rows_a, CAST(sum(bn) AS BIGINT) AS rows_b, 100.0 * sum(least(an, bn)) / greatest(sum(an), sum(bn)) AS match_rate FROM cmp"""


@query(_ORDERS + _METRICS_SQL)
def row_compare_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.metrics(compare.counts(*order_sides(spark, sf_dir)))


@query(_LINES + _METRICS_SQL)
def row_compare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.metrics(compare.counts(*line_sides(spark, sf_dir)))


@query(_ORDERS + "SELECT h, an, bn FROM cmp")
def row_counts_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(compare.counts(*order_sides(spark, sf_dir)))


@query(_ORDERS + f"SELECT {_CELL_LIST}, copies FROM only_a")
def only_in_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = order_sides(spark, sf_dir)
    return compare.one_sided(a, compare.counts(a, b), "an").select(*_CELLS, "copies")


@query(_ORDERS + f"SELECT {_CELL_LIST}, copies FROM only_b")
def only_in_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = order_sides(spark, sf_dir)
    return compare.one_sided(b, compare.counts(a, b), "bn").select(*_CELLS, "copies")


_EXTRA_SQL = f"""SELECT DISTINCT CASE WHEN an > bn THEN 'Extra copies in A' ELSE 'Extra copies in B' END AS status, an AS a_copies, bn AS b_copies,
abs(an - bn) AS unmatched_copies, {_CELL_LIST} FROM a JOIN cmp ON a.h = cmp.h WHERE an <> bn AND an > 0 AND bn > 0"""


@query(_ORDERS + _EXTRA_SQL)
def extra_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = order_sides(spark, sf_dir)
    return compare.surplus(a, b, compare.counts(a, b))


_MISMATCH_SQL = f"""SELECT 'Only in A' AS status, copies AS a_copies, 0 AS b_copies, copies AS unmatched_copies, {_CELL_LIST} FROM only_a
UNION ALL SELECT 'Only in B', 0, copies, copies, {_CELL_LIST} FROM only_b UNION ALL {_EXTRA_SQL}"""


@query(_ORDERS + _MISMATCH_SQL)
def mismatch_rows_nokey(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = order_sides(spark, sf_dir)
    return compare.mismatches(a, b, compare.counts(a, b))


@query(f"WITH {ORDER_SQL}, {CMP_SQL}, m AS ({_MISMATCH_SQL}) SELECT status, count(*) AS n FROM m GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.status_counts(mismatch_rows_nokey(spark, sf_dir))


def _keyed(sides: tuple[DataFrame, DataFrame], key: list[str], manual: bool) -> differences.Keyed:
    return differences.keyed(*sides, compare.counts(*sides), key, manual)


_PAIRED_SQL = """SELECT x.c1, x.c2 AS a_c2, x.c3 AS a_c3, x.c4 AS a_c4, x.c5 AS a_c5, x.copies AS a_copies,
y.c2 AS b_c2, y.c3 AS b_c3, y.c4 AS b_c4, y.c5 AS b_c5, y.copies AS b_copies FROM only_a x JOIN only_b y ON x.c1 = y.c1"""


@query(_ORDERS + _PAIRED_SQL)
def paired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(order_sides(spark, sf_dir), ["c1"], False).paired


_DIFF_SQL = " UNION ALL ".join(f"SELECT c1, {i} AS pos, b_c{i} AS b_val, a_c{i} AS a_val, b_copies, a_copies FROM p WHERE a_c{i} <> b_c{i}" for i in range(2, 6))


@query(f"WITH {ORDER_SQL}, {CMP_SQL}, p AS ({_PAIRED_SQL}) {_DIFF_SQL}")
def cell_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(order_sides(spark, sf_dir), ["c1"], False).differences


@query(f"WITH {ORDER_SQL}, {CMP_SQL}, p AS ({_PAIRED_SQL}), d AS ({_DIFF_SQL}) SELECT pos, count(*) AS paired_differing FROM d GROUP BY pos")
def paired_differing_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.differing_by_column(cell_differences(spark, sf_dir))


@query(f"WITH {ORDER_SQL}, {CMP_SQL}, p AS ({_PAIRED_SQL}), d AS ({_DIFF_SQL}) SELECT * FROM d ORDER BY c1, pos LIMIT 100")
def sample_topk_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample sheet: the first hundred differences in key and column order."""
    return cell_differences(spark, sf_dir).orderBy("c1", "pos").limit(100)


def _unpaired_sql(key: str, manual: bool) -> str:
    on = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in key.split(", "))
    parts, a, b = [], "only_a", "only_b"
    head = "WITH "
    if manual:
        head = f"da AS (SELECT {key} FROM only_a GROUP BY ALL HAVING count(*) > 1), db AS (SELECT {key} FROM only_b GROUP BY ALL HAVING count(*) > 1), "
        head += f"pa AS (SELECT * FROM only_a x WHERE NOT EXISTS (FROM da WHERE {on('x', 'da')})), pb AS (SELECT * FROM only_b x WHERE NOT EXISTS (FROM db WHERE {on('x', 'db')})) "
        parts.append(f"SELECT 'Duplicate key in A' AS status, copies AS a_copies, 0 AS b_copies, copies AS unmatched_copies, {_CELL_LIST} FROM only_a x WHERE EXISTS (FROM da WHERE {on('x', 'da')})")
        parts.append(f"SELECT 'Duplicate key in B', 0, copies, copies, {_CELL_LIST} FROM only_b x WHERE EXISTS (FROM db WHERE {on('x', 'db')})")
        a, b = "pa", "pb"
    else:
        head = ""
    parts.append(f"SELECT 'Only in A' AS status, copies AS a_copies, 0 AS b_copies, copies AS unmatched_copies, {_CELL_LIST} FROM {a} x WHERE NOT EXISTS (FROM {b} y WHERE {on('x', 'y')})")
    parts.append(f"SELECT 'Only in B', 0, copies, copies, {_CELL_LIST} FROM {b} x WHERE NOT EXISTS (FROM {a} y WHERE {on('x', 'y')})")
    parts.append(_EXTRA_SQL)
    return head + " UNION ALL ".join(parts)


@query(_ORDERS + _unpaired_sql("c1", False))
def unpaired_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(order_sides(spark, sf_dir), ["c1"], False).unpaired


@query(f"WITH {LINE_SQL}, {CMP_SQL}, " + _unpaired_sql("c1", True))
def unpaired_manual_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key chosen by hand that repeats: order numbers of lines."""
    return _keyed(line_sides(spark, sf_dir), ["c1"], True).unpaired


@query(_LINES + "" + " UNION ALL ".join(f"SELECT x.c1, x.c2, {i} AS pos, y.c{i} AS b_val, x.c{i} AS a_val, y.copies AS b_copies, x.copies AS a_copies FROM only_a x JOIN only_b y ON x.c1 = y.c1 AND x.c2 = y.c2 WHERE x.c{i} <> y.c{i}" for i in (3, 4, 5)))
def cell_differences_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(line_sides(spark, sf_dir), ["c1", "c2"], False).differences


@query(_LINES + "SELECT c1, count(*) AS n FROM only_a GROUP BY c1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = line_sides(spark, sf_dir)
    return differences.duplicate_keys(compare.one_sided(a, compare.counts(a, b), "an"), ["c1"])


_VALUES_SQL = "v AS (SELECT pos, v, bool_or(s) AS in_a, bool_or(NOT s) AS in_b FROM (" + " UNION ALL ".join(f"SELECT {i} AS pos, c{i} AS v, {s} AS s FROM {t}" for i in range(1, 6) for t, s in (("a", "true"), ("b", "false"))) + ") GROUP BY pos, v)"
_OVERLAP_SQL = """SELECT pos, count(*) FILTER (in_a) AS a_distinct, count(*) FILTER (in_b) AS b_distinct, count(*) FILTER (in_a AND NOT in_b) AS only_a,
count(*) FILTER (in_b AND NOT in_a) AS only_b, count(*) FILTER (in_a AND in_b) / greatest(count(*) FILTER (in_a), count(*) FILTER (in_b)) AS overlap FROM v GROUP BY pos"""


@query(f"WITH {ORDER_SQL}, {_VALUES_SQL} {_OVERLAP_SQL}")
def column_distinct_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.overlap(columns.values(*order_sides(spark, sf_dir)))


@query(f"""WITH {ORDER_SQL}, {_VALUES_SQL} SELECT pos, CASE WHEN in_a THEN 'A' ELSE 'B' END AS side, CAST(row_number() OVER (PARTITION BY pos, in_a ORDER BY v) AS INTEGER) AS rank, v
FROM v WHERE in_a <> in_b QUALIFY rank <= 3""")  # fmt: skip
def column_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.examples(columns.values(*order_sides(spark, sf_dir)))


def _shape_sql(rows: str, names: list[str]) -> str:
    whole, part = "regexp_full_match({0}, '-?[0-9]+')", "regexp_full_match({0}, '-?([0-9]+\\.[0-9]*|\\.[0-9]+)')"
    one = " UNION ALL ".join(
        f"SELECT {i} AS pos, count_if({c} <> '' AND {whole.format(c)}) AS integer, count_if({c} <> '' AND {part.format(c)}) AS decimal, count_if({c} <> '' AND NOT {whole.format(c)} AND NOT {part.format(c)}) AS text FROM t"
        for i, c in enumerate(names, 1)
    )
    return f"""WITH t AS ({rows}), s AS ({one}) SELECT pos, CAST(integer AS BIGINT) AS integer, CAST(decimal AS BIGINT) AS decimal, CAST(text AS BIGINT) AS text,
CASE WHEN integer + decimal + text = 0 THEN 'Empty' WHEN (integer > 0)::INT + (decimal > 0)::INT + (text > 0)::INT > 1 THEN 'Mixed'
WHEN integer > 0 THEN 'Integer-like' WHEN decimal > 0 THEN 'Decimal-like' ELSE 'Text' END AS label FROM s"""


@query(_shape_sql(f"WITH {ORDER_SQL} SELECT * FROM b", _CELLS))
def column_type_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.shapes(order_sides(spark, sf_dir)[1])


@query(_shape_sql("SELECT CAST(p_partkey AS VARCHAR) AS c1, coalesce(p_name, '') AS c2, coalesce(p_brand, '') AS c3, coalesce(CAST(p_size AS VARCHAR), '') AS c4, coalesce(CAST(CAST(p_retailprice AS DECIMAL(38,6)) AS VARCHAR), '') AS c5 FROM part", _CELLS))
def column_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.shapes(to_text(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]))


@query(f"""WITH {ORDER_SQL}, {_VALUES_SQL}, o AS ({_OVERLAP_SQL}), d AS (SELECT (SELECT count(DISTINCT h) FROM a) AS da, (SELECT count(DISTINCT h) FROM b) AS db)
SELECT pos, overlap, a_distinct = da AS unique_a, b_distinct = db AS unique_b, overlap >= 0.8 AS enough FROM o, d""")  # fmt: skip
def key_single_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns judged as single keys: overlap, and uniqueness against the distinct rows (one row of counts, read first)."""
    a, b = order_sides(spark, sf_dir)
    n = compare.metrics(compare.counts(a, b)).first()
    stats = columns.statistics(a, b, n.distinct_a, n.distinct_b)
    return stats.select("pos", "overlap", "unique_a", "unique_b", (F.col("overlap") >= keys.MIN_OVERLAP).alias("enough"))


@query(f"""WITH {LINE_SQL}, k AS (SELECT c1, c2, bool_or(s) AS in_a, bool_or(NOT s) AS in_b FROM (SELECT c1, c2, true AS s FROM a UNION ALL SELECT c1, c2, false FROM b) GROUP BY c1, c2)
SELECT count(*) FILTER (in_a) AS a_distinct, count(*) FILTER (in_b) AS b_distinct, count(*) FILTER (in_a AND in_b) AS common,
count(*) FILTER (in_a AND in_b) / greatest(count(*) FILTER (in_a), count(*) FILTER (in_b)) AS overlap FROM k""")  # fmt: skip
def key_pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.tuple_stats(*line_sides(spark, sf_dir), ["c1", "c2"])


_PAIRS_OF = [(i, j) for i in range(1, 6) for j in range(i + 1, 6)]


@query(
    f"WITH {LINE_SQL} " + " UNION ALL ".join(f"SELECT 'c{i},c{j}' AS columns, (SELECT count(DISTINCT (c{i}, c{j})) >= 0.9 * count(DISTINCT h) FROM a) AND (SELECT count(DISTINCT (c{i}, c{j})) >= 0.9 * count(DISTINCT h) FROM b) AS likely" for i, j in _PAIRS_OF)
)
def key_approx_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rough screen of all column pairs, as one aggregate over each side."""
    return keys.screened(*line_sides(spark, sf_dir), [[f"c{i}", f"c{j}"] for i, j in _PAIRS_OF])


_SETS = [["c1", "c2"], ["c1", "c3"], ["c2", "c3"], ["c1", "c2", "c3"]]


@query(
    f"WITH {LINE_SQL} " + " UNION ALL ".join(
        f"SELECT {i} AS number, count(*) FILTER (in_a) AS a_distinct, count(*) FILTER (in_b) AS b_distinct, count(*) FILTER (in_a AND in_b) AS common, count(*) FILTER (in_a AND in_b) / greatest(count(*) FILTER (in_a), count(*) FILTER (in_b)) AS overlap "
        f"FROM (SELECT {', '.join(s)}, bool_or(s) AS in_a, bool_or(NOT s) AS in_b FROM (SELECT {', '.join(s)}, true AS s FROM a UNION ALL SELECT {', '.join(s)}, false FROM b) GROUP BY {', '.join(s)})" for i, s in enumerate(_SETS)
    )
)
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of several column sets in one job."""
    return keys.set_stats(*line_sides(spark, sf_dir), _SETS)


@query(f"""WITH {ORDER_SQL}, d AS (SELECT (SELECT count(DISTINCT h) FROM a) AS da, (SELECT count(DISTINCT h) FROM b) AS db),
s AS ({" UNION ALL ".join(f"SELECT {i} AS pos, (SELECT count(DISTINCT c{i}) FROM a) AS na, (SELECT count(DISTINCT c{i}) FROM b) AS nb, (SELECT count(*) FROM (SELECT c{i} FROM a INTERSECT SELECT c{i} FROM b)) AS common" for i in range(1, 6))})
SELECT 'detected' AS source, 'c' || pos AS columns, overlap FROM (SELECT pos, na, nb, common / greatest(na, nb) AS overlap FROM s) q, d WHERE na = da AND nb = db AND overlap >= 0.8
ORDER BY q.overlap DESC, pos LIMIT 1""")  # fmt: skip
def key_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record key that detection chooses among single columns and sets of them, for headers that give no hint."""
    a, b = order_sides(spark, sf_dir)
    n = compare.metrics(compare.counts(a, b)).first()
    stats = columns.statistics(a, b, n.distinct_a, n.distinct_b).orderBy("pos").collect()  # one row a column
    key = keys.select(a, b, "orders", stats, [f"f{i}" for i in range(1, 6)], (n.distinct_a, n.distinct_b))
    return spark.createDataFrame([(key.source, ",".join(f"c{p}" for p in key.positions), key.overlap)], "source string, columns string, overlap double")


def _hash_sql(of: str, cols: list[str]) -> str:
    text = [f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols]
    return f"SELECT {cols[0]}, md5(concat(" + ", ".join(f"strlen({t}), ':', {t}" for t in text) + f")) AS h FROM {of}"


@query(_hash_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))
def row_hash_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    text = to_text(c)
    return text.select(F.col("c1").cast("long").alias("c_custkey"), F.lower(F.hex(row_hash(text.columns))).alias("h"))


@query("SELECT event_id, coalesce(props, '') AS props FROM events")
def coalesce_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", as_text(F.col("props"), e.schema["props"].dataType).alias("props"))


@query(f"WITH {ORDER_SQL} SELECT {_CELL_LIST} FROM a EXCEPT ALL SELECT {_CELL_LIST} FROM b")
def multiset_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.multiset_except(*order_sides(spark, sf_dir))


@query(f"WITH {ORDER_SQL} SELECT {_CELL_LIST} FROM a INTERSECT ALL SELECT {_CELL_LIST} FROM b")
def multiset_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.multiset_intersect(*order_sides(spark, sf_dir))


# ---- quoting profiles over text columns -------------------------------------------------------------------------


@query("""SELECT source, count(*) AS texts, CAST(count_if(contains(t, ',')) AS BIGINT) AS with_delim, CAST(count_if(contains(t, '"')) AS BIGINT) AS with_quote, CAST(count_if(contains(t, chr(10)) OR contains(t, chr(13))) AS BIGINT) AS with_break,
CAST(count_if(contains(t, ',') OR contains(t, '"') OR contains(t, chr(10)) OR contains(t, chr(13))) AS BIGINT) AS needs_quotes FROM (SELECT source, coalesce(text, '') AS t FROM documents) GROUP BY source""")  # fmt: skip
def quote_needed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which values a writer that quotes only where it must would quote."""
    return delimited.quotes_needed(table(spark, sf_dir, "documents"), "source", "text")


@query("""SELECT kind, count(*) AS n, CAST(count_if(num AND kind = 'bare') AS BIGINT) AS numeric FROM (SELECT CASE WHEN v = '' THEN 'bare_empty' WHEN trim(v, ' ' || chr(9)) = '' THEN 'ws_bare' ELSE 'bare' END AS kind,
strlen(v) <= 64 AND regexp_full_match(v, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') AS num
FROM (SELECT unnest(string_split(coalesce(props, ''), ',')) AS v FROM events)) GROUP BY kind""")  # fmt: skip
def value_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").select(F.explode(F.split(F.coalesce("props", F.lit("")), ",", -1)).alias("v"))
    kind = delimited.field_kind(F.col("v"), F.lit(False), F.btrim("v", F.lit(" \t")) == "", F.lit(False))
    return v.select(kind.alias("kind"), is_number(F.col("v")).alias("num")).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("num") & (F.col("kind") == "bare")).alias("numeric"))


@query("""SELECT size_text, count(*) AS n FROM (SELECT regexp_full_match(v, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') AS size_text
FROM (SELECT unnest(string_split(p_name || ' ' || p_size || ' ' || p_brand, ' ')) AS v FROM part)) GROUP BY size_text""")  # fmt: skip
def numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), "p_brand"), " ", -1)).alias("v"))
    return v.select(is_number(F.col("v")).alias("size_text")).groupBy("size_text").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT event_type, len(string_split(coalesce(props, ''), ',')) AS width, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, width, n FROM w QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, width) = 1""")  # fmt: skip
def width_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest number of fields of each event type's property text, the smaller on ties."""
    widths = table(spark, sf_dir, "events").select("event_type", F.size(F.split(F.coalesce("props", F.lit("")), ",", -1)).cast("long").alias("width"))
    return delimited.width_modes(widths, "event_type").drop("records")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(delimited_sql.CSV_TOKENS)
def csv_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every document, read as comma-separated text."""
    return delimited.classified(delimited.tokens(_texts(spark, sf_dir), "doc_id")).drop("end")


@query(delimited_sql.TABLE_FUNCTION)
def csv_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of every document through the SQL table function."""
    sqltable.register(spark)
    return spark.sql("SELECT d.doc_id, t.* FROM {texts} d, LATERAL csv_tokens(d.text) t", texts=_texts(spark, sf_dir))


@query(delimited_sql.CSV_PROFILE)
def csv_profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quoting profile of every document, with its habits and checks."""
    return habits.judged(delimited.profile(_texts(spark, sf_dir), "doc_id")).withColumn("checks", F.array_join(habits.checks(), " "))


@query(delimited_sql.CSV_COLUMNS)
def csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted and bare cells of each document's columns."""
    tok = delimited.records_of(delimited.classified(delimited.tokens(_texts(spark, sf_dir), "doc_id")), "doc_id")
    return delimited.column_habits(tok, "doc_id")


@query(delimited_sql.CSV_SAMPLES)
def csv_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field of each kind in each document."""
    tok = delimited.records_of(delimited.classified(delimited.tokens(_texts(spark, sf_dir), "doc_id")), "doc_id")
    return delimited.first_samples(tok, "doc_id")


@query(delimited_sql.DIALECTS)
def dialect_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delimiter and quote mark that read each document best."""
    return delimited.choose_dialect(delimited.dialect_scores(_texts(spark, sf_dir), "doc_id"), "doc_id")


@query(delimited_sql.ACROSS)
def across_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return habits.across(habits.judged(delimited.profile(_texts(spark, sf_dir), "doc_id")))


@query("""SELECT doc_id, crlf, lf, cr, CASE WHEN crlf + lf + cr = 0 THEN 'none' WHEN (crlf > 0)::INT + (lf > 0)::INT + (cr > 0)::INT = 1 THEN CASE WHEN crlf > 0 THEN 'CRLF' WHEN lf > 0 THEN 'LF' ELSE 'CR' END
ELSE 'mixed (' || concat_ws(', ', CASE WHEN crlf > 0 THEN 'CRLF' END, CASE WHEN lf > 0 THEN 'LF' END, CASE WHEN cr > 0 THEN 'CR' END) || ')' END AS label FROM (
SELECT doc_id, len(regexp_extract_all(t, '\\r\\n')) AS crlf, len(regexp_extract_all(t, '\\n')) - len(regexp_extract_all(t, '\\r\\n')) AS lf, len(regexp_extract_all(t, '\\r')) - len(regexp_extract_all(t, '\\r\\n')) AS cr
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")  # fmt: skip
def newline_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks of each document by kind."""
    return delimited.newline_counts(table(spark, sf_dir, "documents"), "doc_id")
