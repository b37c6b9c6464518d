"""Profiles and lexical matching over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.functions import text as T
from graniteloom.operators import lexical, profiling
from graniteloom.runtime import table

#: The tables that stand for the profiled databases, with their columns.
TABLES = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "cim_eqp_mst": ("site", "eqp_id", "eqp_no", "eqp_group", "cim_eqp_desc", "cim_eqp_type", "eqp_ip", "robot_ip", "funac_ip", "use_yn", "create_user", "create_time", "update_user", "update_time", "mode_type", "stop_base", "run_base", "cim_id"),
    "eqp_mode_gen_hist": ("site", "eqp_id", "eqp_no", "cur_time", "create_time", "work_center", "test_user", "prod_order_number", "process_name", "lot_id", "item_number", "status", "eqp_part_number", "part_number", "start_date_time", "use_yn", "fst_create_sys", "last_update_sys", "last_update_time", "base_time", "eqp_mode", "status_d"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "region": ("r_regionkey", "r_name"),
}
_DOUBLE, _TIME = {"c_acctbal", "o_totalprice", "p_retailprice"}, {"o_orderdate"}
LITERALS = ("BUILDING", "URGENT", "1-URGENT", "Brand 12", "United States", "Germany", "DRILLNG", "coating line", "standard brass", "EQ0038", "N2-037", "ASIA")


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in TABLES}


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return profiling.profile_tables(tables(spark, d))


def literals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LITERALS], "literal string")


def a1_counts(spark, d):
    """Total, null, non-null and distinct counts of every column."""
    return profiles(spark, d).select("table_name", "column_name", "total_records", "null_count", "non_null_count", "distinct_count")


def a2_top_values(spark, d):
    return profiles(spark, d).select("table_name", "column_name", F.posexplode("top_k_values").alias("position", "t")).select("table_name", "column_name", "position", "t.value", "t.cnt")


def a3_indexed_values(spark, d):
    return profiles(spark, d).select("table_name", "column_name", F.size("indexed_values").alias("n"), F.md5(F.array_join("indexed_values", "|")).alias("digest"))


def a4_samples(spark, d):
    return profiles(spark, d).select("table_name", "column_name", F.array_join("sample_values", "|").alias("samples"))


def a5_ranges(spark, d):
    """Ranges, numeric or text, and lengths of text columns."""
    return profiles(spark, d).select("table_name", "column_name", "is_numeric", "min_value", "max_value", "min_length", "max_length")


def a9_kinds(spark, d):
    return profiles(spark, d).select("table_name", "column_name", "is_numeric", "is_date_like", "common_pattern")


def a11_keys(spark, d):
    return profiling.key_candidates(profiles(spark, d)).select("table_name", "column_name", "is_pk", "is_fk")


def a13_tables(spark, d):
    t = profiling.table_profiles(profiles(spark, d))
    return t.select("table_name", "total_records", "total_columns", "first_column", F.array_join("primary_keys", ",").alias("primary_keys"), F.array_join("foreign_keys", ",").alias("foreign_keys"))


def pred3_index_worthy(spark, d):
    return profiles(spark, d).select("table_name", "column_name", profiling.index_worthy(True, True).alias("worthy"))


def pred4_numeric(spark, d):
    return profiles(spark, d).select("table_name", "column_name", profiling.numeric_column().alias("numeric"))


def f42_contexts(spark, d):
    return profiling.describe(profiles(spark, d))


def f3_normal(spark, d):
    """Normal forms of equipment descriptions."""
    return table(spark, d, "cim_eqp_mst").select("eqp_id", T.normalize(F.col("cim_eqp_desc")).alias("norm"))


def f4_shingles(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(T.shingles(T.normalize(F.col("p_name")))).alias("shingles"))


def j15_index(spark, d):
    i = lexical.index_values(profiles(spark, d))
    return i.groupBy("table_name", "column_name").agg(F.count("*").alias("indexed"), F.sum(F.size("shingles")).alias("shingles"))


def j9_matches(spark, d):
    return lexical.matches(literals(spark), lexical.index_values(profiles(spark, d)), threshold=0.5).drop("column_type", "is_numeric")


def j16_fields(spark, d):
    """The best 5 values of each literal with the type of their column."""
    return lexical.matches(literals(spark), lexical.index_values(profiles(spark, d)), top_k=5)


def pred2_field_scores(spark, d):
    return lexical.field_scores(lexical.matches(literals(spark), lexical.index_values(profiles(spark, d))), 0.3)


def f7_minhash(spark, d):
    """MinHash candidates at 0.6, scored exactly (rows only: it may miss pairs)."""
    return lexical.minhash_matches(literals(spark), lexical.index_values(profiles(spark, d)), 0.6)


def o9_coverage(spark, d):
    m = lexical.matches(literals(spark), lexical.index_values(profiles(spark, d)))
    return lexical.coverage(m, spark.createDataFrame([("customer", "c_mktsegment"), ("nation", "n_name")], "table_name string, column_name string"))


def _text_sql(c: str) -> str:
    if c in _DOUBLE:
        return f"regexp_replace(printf('%.6f', {c}), '\\.?0+$', '')"
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c in _TIME else f"CAST({c} AS VARCHAR)"


_TYPES = {"c_custkey": "BIGINT", "o_orderkey": "BIGINT", "o_custkey": "BIGINT", "p_partkey": "BIGINT", "c_nationkey": "INT", "p_size": "INT", "n_nationkey": "INT", "n_regionkey": "INT", "r_regionkey": "INT", "o_orderdate": "TIMESTAMP_NTZ"} | {c: "DOUBLE" for c in _DOUBLE}
_CELLS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal, '{_TYPES.get(c, 'STRING')}' AS data_type, {_text_sql(c)} AS v FROM {t}" for t, cs in TABLES.items() for i, c in enumerate(cs))
_NUM = "regexp_full_match(v, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*')"
_SHAPE = "regexp_replace(regexp_replace(v, '\\pL', 'A', 'g'), '\\p{Nd}', 'N', 'g')"
_BASE = f"""
        WITH u AS ({_CELLS}),
        vc AS (SELECT table_name, column_name, ordinal, data_type, v, count(*) AS n FROM u GROUP BY ALL),
        b AS (SELECT table_name, column_name, ordinal, data_type, CAST(sum(n) AS BIGINT) AS total_records, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS null_count,
                     CAST(coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS non_null_count, count(v) AS distinct_count, min(v) AS smin, max(v) AS smax,
                     min(TRY_CAST(v AS DOUBLE)) AS nmin, max(TRY_CAST(v AS DOUBLE)) AS nmax, count(*) FILTER (v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL) = 0 AS all_numbers,
                     CAST(min(length(v)) AS INT) AS lmin, CAST(max(length(v)) AS INT) AS lmax FROM vc GROUP BY ALL),
        ro AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY n DESC, v) AS r, row_number() OVER (PARTITION BY table_name, column_name ORDER BY v) AS o FROM vc WHERE v IS NOT NULL),
        s AS (SELECT table_name, column_name, avg(CAST({_NUM} AS INT)) FILTER (o <= 50) > 0.8 AS looks, avg(CAST(regexp_matches(v, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}}|\\d{{4}}/\\d{{2}}/\\d{{2}})') AS INT)) FILTER (o <= 50) > 0.8 AS dates,
                     CASE WHEN count(DISTINCT length(v)) FILTER (o <= 20) = 1 AND count(DISTINCT {_SHAPE}) FILTER (o <= 20) = 1 THEN min({_SHAPE}) FILTER (o <= 20) END AS shape FROM ro GROUP BY ALL),
        p AS (SELECT b.*, coalesce(looks, false) AND all_numbers AS is_numeric, coalesce(dates, false) AS is_date_like, shape AS common_pattern FROM b LEFT JOIN s USING (table_name, column_name)),
        k AS (SELECT *, distinct_count = non_null_count AND null_count = 0 AND (contains(column_name, 'id') OR contains(column_name, 'key') OR column_name = 'pk') AS is_pk FROM p),
        fk AS (SELECT *, NOT is_pk AND (ends_with(column_name, '_id') OR contains(column_name, 'fk') OR starts_with(column_name, 'ref_')) AS is_fk FROM k)"""
_RANGE = """CASE WHEN is_numeric THEN regexp_replace(printf('%.6f', nmin), '\\.?0+$', '') ELSE smin END AS min_value, CASE WHEN is_numeric THEN regexp_replace(printf('%.6f', nmax), '\\.?0+$', '') ELSE smax END AS max_value,
               CASE WHEN NOT is_numeric THEN lmin END AS min_length, CASE WHEN NOT is_numeric THEN lmax END AS max_length"""
_NORMAL = lambda c: f"trim(regexp_replace(regexp_replace(translate(lower({c}), '_-', '  '), '[^\\pL\\pM\\p{{Nd}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_SHINGLES = lambda c: f"CASE WHEN length({c}) < 3 THEN [{c}] ELSE list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) END"
_WORTHY = "distinct_count > 0 AND NOT (distinct_count = 1 AND total_records > 20)"
_DECLARED = "regexp_matches(data_type, '^(BIGINT|INT|DOUBLE)')"
_INDEX = (
    _BASE
    + f""",
        ix AS (SELECT fk.table_name, fk.column_name, data_type AS column_type, {_DECLARED} AS is_numeric, trim(v) AS value FROM ro JOIN (SELECT * EXCLUDE (data_type), data_type AS dt FROM fk) fk USING (table_name, column_name) WHERE r <= 10000 AND {_WORTHY}),
        iy AS (SELECT DISTINCT *, {_NORMAL("value")} AS norm FROM ix WHERE value <> ''),
        iz AS (SELECT *, {_SHINGLES("norm")} AS sh FROM iy WHERE norm <> ''),
        lq AS (SELECT literal, {_SHINGLES("ln")} AS qs FROM (SELECT literal, {_NORMAL("literal")} AS ln FROM (VALUES {", ".join(f"('{x}')" for x in LITERALS)}) AS l(literal))),
        mt AS (SELECT literal, table_name, column_name, value, column_type, is_numeric, round(len(list_intersect(sh, qs)) / (len(sh) + len(qs) - len(list_intersect(sh, qs))), 6) AS score FROM iz, lq WHERE len(list_intersect(sh, qs)) > 0),
        mr AS (SELECT *, row_number() OVER (PARTITION BY literal ORDER BY score DESC, table_name, column_name, value) AS r FROM mt)"""
)

ORACLES = {
    "a1_counts": _BASE + " SELECT table_name, column_name, total_records, null_count, non_null_count, distinct_count FROM b",
    "a2_top_values": _BASE + " SELECT table_name, column_name, CAST(r - 1 AS INT) AS position, v AS value, n AS cnt FROM ro WHERE r <= 10",
    "a3_indexed_values": _BASE + " SELECT table_name, column_name, CAST(count(*) AS INT) AS n, md5(string_agg(v, '|' ORDER BY r)) AS digest FROM ro WHERE r <= 10000 GROUP BY ALL",
    "a4_samples": _BASE + " SELECT table_name, column_name, string_agg(v, '|' ORDER BY o) AS samples FROM ro WHERE o <= 100 GROUP BY ALL",
    "a5_ranges": _BASE + f" SELECT table_name, column_name, is_numeric, {_RANGE} FROM p",
    "a9_kinds": _BASE + " SELECT table_name, column_name, is_numeric, is_date_like, common_pattern FROM p",
    "a11_keys": _BASE + " SELECT table_name, column_name, is_pk, is_fk FROM fk",
    "a13_tables": _BASE + """ SELECT table_name, arg_min(total_records, ordinal) AS total_records, count(*) AS total_columns, arg_min(column_name, ordinal) AS first_column,
            coalesce(string_agg(column_name, ',' ORDER BY ordinal) FILTER (is_pk), '') AS primary_keys, coalesce(string_agg(column_name, ',' ORDER BY ordinal) FILTER (is_fk), '') AS foreign_keys FROM fk GROUP BY table_name""",
    "pred3_index_worthy": _BASE + f" SELECT table_name, column_name, {_WORTHY} AND NOT (is_numeric AND distinct_count >= 0.9 * total_records AND total_records >= 1000 AND (ends_with(column_name, 'id') OR starts_with(column_name, 'id_'))) AS worthy FROM p",
    "pred4_numeric": _BASE + f" SELECT table_name, column_name, {_DECLARED} OR (is_numeric AND NOT data_type = 'STRING') AS numeric FROM p",
    "f42_contexts": _BASE
    + f""", z AS (SELECT *, {_RANGE} FROM fk),
        t5 AS (SELECT table_name, column_name, string_agg(v || ' (' || n || ')', ', ' ORDER BY r) AS top FROM ro WHERE r <= 5 GROUP BY ALL)
        SELECT table_name, column_name, concat_ws(chr(10), 'Column: ' || table_name || '.' || column_name, 'Type: ' || data_type, 'Records: ' || total_records || ' (NULL: ' || printf('%.1f', 100.0 * null_count / greatest(total_records, 1)) || '%)',
               'Distinct: ' || distinct_count, CASE WHEN is_pk THEN 'Key: likely primary key' WHEN is_fk THEN 'Key: likely foreign key' END, 'Range: ' || min_value || ' to ' || max_value, 'Length: ' || min_length || ' to ' || max_length,
               'Pattern: ' || common_pattern, 'Top values: ' || top) AS context FROM z LEFT JOIN t5 USING (table_name, column_name)""",
    "f3_normal": f"SELECT eqp_id, {_NORMAL('cim_eqp_desc')} AS norm FROM cim_eqp_mst",
    "f4_shingles": f"SELECT p_partkey, CAST(len({_SHINGLES('n')}) AS INT) AS shingles FROM (SELECT p_partkey, {_NORMAL('p_name')} AS n FROM part)",
    "j15_index": _INDEX + " SELECT table_name, column_name, count(*) AS indexed, CAST(sum(len(sh)) AS BIGINT) AS shingles FROM iz GROUP BY ALL",
    "j9_matches": _INDEX + " SELECT literal, table_name, column_name, value, score FROM mt WHERE score >= 0.5",
    "j16_fields": _INDEX + " SELECT literal, table_name, column_name, value, score, column_type, is_numeric FROM mr WHERE r <= 5",
    "pred2_field_scores": _INDEX + " SELECT table_name, column_name, max(score) AS score FROM mt WHERE score >= 0.3 GROUP BY ALL",
    "o9_coverage": _INDEX + " SELECT literal, bool_or((table_name = 'customer' AND column_name = 'c_mktsegment') OR (table_name = 'nation' AND column_name = 'n_name')) AS covered FROM mr WHERE r <= 5 GROUP BY literal",
}

QUERIES = {f.__name__: f for f in (a1_counts, a2_top_values, a3_indexed_values, a4_samples, a5_ranges, a9_kinds, a11_keys, a13_tables, pred3_index_worthy, pred4_numeric, f42_contexts, f3_normal, f4_shingles, j15_index, j9_matches, j16_fields, pred2_field_scores, f7_minhash, o9_coverage)}
