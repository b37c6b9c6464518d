"""Schema linking over stated scores: a fixed set of semantic and lexical matches against the profiled tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graniteloom.operators import linking, profiling, routing
from graniteloom.plans.base import typed
from graniteloom.plans.profiles import profiles
from graniteloom.runtime import table

SEMANTIC = (("customer", "c_mktsegment", 0.82), ("customer", "c_name", 0.41), ("orders", "o_orderpriority", 0.77), ("orders", "o_totalprice", 0.15), ("part", "p_type", 0.35), ("cim_eqp_mst", "cim_eqp_desc", 0.64), ("cim_eqp_mst", "eqp_id", 0.3), ("nation", "n_name", 0.2))
LEXICAL = (("customer", "c_mktsegment", 1.0), ("orders", "o_orderpriority", 0.62), ("nation", "n_name", 0.5), ("cim_eqp_mst", "eqp_group", 0.33), ("part", "p_brand", 0.29))
_SQL = lambda rows, n: f"(SELECT * FROM (VALUES {', '.join(str(r) for r in rows)}) AS {n}(table_name, column_name, score))"


def _fields(spark, rows):
    return spark.createDataFrame(list(rows), "table_name string, column_name string, score double")


def _both(spark):
    return _fields(spark, SEMANTIC), _fields(spark, LEXICAL)


def o6_focused_fields(spark, d):
    s, x = _both(spark)
    return linking.ordered(linking.merge(s, x, "union", 0.2, 0.3))


def j5_intersection(spark, d):
    s, x = _both(spark)
    return linking.merge(s, x, "intersection", 0.2, 0.3)


def t1_single_sided(spark, d):
    """The semantic-only and lexical-only strategies, one below the other."""
    s, x = _both(spark)
    a = linking.merge(s, x, "semantic_only", 0.2, 0.3).withColumn("strategy", F.lit("semantic_only"))
    return a.unionByName(linking.merge(s, x, "lexical_only", 0.2, 0.3).withColumn("strategy", F.lit("lexical_only")))


def a22_field_statistics(spark, d):
    return linking.field_statistics(linking.merge(*_both(spark), "union", 0.2, 0.3))


def _scores(spark):
    return linking.table_scores(*_both(spark))


def a20_table_scores(spark, d):
    return _scores(spark).select("table_name", "semantic_score", F.array_join("matched", ",").alias("matched"))


def o7_relevant_tables(spark, d):
    known = profiles(spark, d).select("table_name").distinct()
    return linking.relevant_tables(_scores(spark), known, 4).select("table_name", "position", "semantic_score", F.array_join("matched", ",").alias("matched"))


def w5_shown_columns(spark, d):
    """Columns of the relevant tables as a summary shows them; tables over 5 columns by priority."""
    p = profiling.key_candidates(profiles(spark, d))
    return linking.shown_columns(p, _scores(spark), 5).select("table_name", "column_name", "place", "is_matched", "is_pk", "is_fk", "is_first")


def f41_planner_text(spark, d):
    p = profiling.key_candidates(profiles(spark, d))
    about = p.select("table_name", "column_name", F.concat(F.lit("about "), "column_name").alias("description"))
    tables = p.select("table_name").distinct().select("table_name", F.lit(None).cast("string").alias("column_name"), F.concat(F.lit("Stores data of "), "table_name").alias("description"))
    return linking.planner_text(linking.shown_columns(p, _scores(spark), 5), _scores(spark), about.unionByName(tables))


def _metadata(spark, d):
    p = profiles(spark, d)
    return p.select("table_name", "column_name", "ordinal", F.concat(F.lit("short "), "column_name").alias("short_description"), F.concat(F.lit("long "), "column_name", F.lit(" of "), "table_name").alias("long_description"), F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("expert "), "column_name")).alias("sme_description"))


def f39_schema_texts(spark, d):
    """All five variants."""
    focused = linking.ordered(linking.merge(*_both(spark), "union", 0.2, 0.3))
    m = _metadata(spark, d)
    out = None
    for v in linking.VARIANTS:
        t = linking.schema_text(v, linking.variant_fields(v, m, focused), m, with_scores=True)
        out = t if out is None else out.unionByName(t)
    return out


def f43_context(spark, d):
    return linking.context_text(_metadata(spark, d))


def f39_compact(spark, d):
    return linking.compact_text(linking.merge(*_both(spark), "union", 0.2, 0.3))


def x3_schema_map(spark, d):
    return linking.schema_map(_metadata(spark, d)).select("table_name", F.array_join("columns", ",").alias("columns"))


def j7_enriched(spark, d):
    """Metadata with expert descriptions of the first source, gaps filled by the second."""
    m = _metadata(spark, d).select("table_name", "column_name")
    csv = m.where("column_name LIKE '%key'").select("table_name", "column_name", F.concat(F.lit("csv "), "column_name").alias("description"), F.lit("csv").alias("source"))
    js = m.where("table_name IN ('nation', 'region')").select("table_name", "column_name", F.concat(F.lit("json "), "column_name").alias("description"), F.lit("json").alias("source"))
    return linking.enrich(m, linking.csv_first(csv, js))


def t3_new_fields(spark, d):
    s, x = _both(spark)
    return linking.new_fields(s, x)


def t2_all_fields(spark, d):
    return linking.all_fields(*_both(spark))


def k9_routes(spark, d):
    """Every document's text taken for a question: how many take each path."""
    r = routing.route(table(spark, d, "documents").select("doc_id", F.col("text").alias("question")))
    return r.groupBy("path").agg(F.count("*").alias("questions"))


def k9_best_path(spark, d):
    """Paths of stated scores, ties included."""
    n = table(spark, d, "events").select("event_id", F.create_map(F.lit("llm_only"), (F.col("event_id") % 4).cast("int"), F.lit("fact_only"), (F.col("event_id") % 3).cast("int"), F.lit("doc_only"), (F.col("event_id") % 5).cast("int"), F.lit("complex_dual"), (F.col("event_id") % 2).cast("int")).alias("s"))
    return n.select("event_id", routing.best_path(F.col("s")).alias("path"))


_S, _X = _SQL(SEMANTIC, "s"), _SQL(LEXICAL, "x")
_M = f"""sm AS (SELECT table_name, column_name, CAST(score AS DOUBLE) AS semantic_score FROM {_S} WHERE score >= 0.2), lx AS (SELECT table_name, column_name, CAST(score AS DOUBLE) AS lexical_score FROM {_X} WHERE score >= 0.3),
        m AS (SELECT *, CASE WHEN semantic_score IS NOT NULL AND lexical_score IS NOT NULL THEN 'both' WHEN semantic_score IS NOT NULL THEN 'semantic' ELSE 'lexical' END AS selected_by FROM sm FULL JOIN lx USING (table_name, column_name)),
        o AS (SELECT *, row_number() OVER (ORDER BY CASE selected_by WHEN 'both' THEN 3 WHEN 'semantic' THEN 2 ELSE 1 END DESC, greatest(coalesce(semantic_score, 0), coalesce(lexical_score, 0)) DESC, table_name, column_name) AS position FROM m),
        ts AS (SELECT table_name, max(semantic_score) AS semantic_score FROM sm GROUP BY table_name), tx AS (SELECT table_name, list_sort(list(DISTINCT column_name)) AS matched FROM lx GROUP BY table_name),
        sc AS (SELECT table_name, semantic_score, coalesce(matched, []) AS matched FROM ts FULL JOIN tx USING (table_name))"""


def _full() -> str:
    from graniteloom.plans.profiles import _BASE

    return _BASE + ", " + _M


_SHOWN = """w AS (SELECT fk.table_name, fk.column_name, data_type, ordinal, list_contains(matched, fk.column_name) AS is_matched, is_pk, is_fk, ordinal = min(ordinal) OVER t AS is_first, count(*) OVER t AS n, distinct_count / greatest(non_null_count, 1) AS dist, semantic_score, matched
              FROM fk JOIN sc ON fk.table_name = sc.table_name WINDOW t AS (PARTITION BY fk.table_name)),
        y AS (SELECT *, CASE WHEN is_matched THEN 1 WHEN is_pk THEN 2 WHEN is_fk THEN 3 WHEN is_first THEN 4 ELSE 5 END AS tier FROM w),
        z AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY CASE WHEN n > 5 THEN tier ELSE 0 END, CASE WHEN n > 5 AND tier = 5 THEN dist ELSE 0 END DESC, ordinal) AS place FROM y QUALIFY place <= 5)"""
_META = "md AS (SELECT table_name, column_name, ordinal, 'short ' || column_name AS sd, 'long ' || column_name || ' of ' || table_name AS ld, CASE WHEN ordinal % 2 = 0 THEN 'expert ' || column_name END AS ed FROM b)"


def _variant(v: str) -> str:
    about = {"minimal": "sd", "maximal": "ld", "full": "concat_ws(chr(10) || chr(10), ed, ld)"}[linking.profile_kind(v)]
    src = "SELECT table_name, column_name, position AS place, semantic_score AS a, lexical_score AS l FROM o" if v.startswith("focused_") else "SELECT table_name, column_name, ordinal AS place, NULL AS a, NULL AS l FROM md"
    sc = "CASE WHEN a IS NOT NULL OR l IS NOT NULL THEN ' (' || concat_ws(', ', 'semantic=' || printf('%.2f', a), 'lexical=' || printf('%.2f', l)) || ')' ELSE '' END" if v.startswith("focused_") else "''"
    return f"""SELECT '{v}' AS variant, '=== Schema ({v}) ===' || chr(10) || chr(10) || string_agg('Table: ' || table_name || chr(10) || lines || chr(10), chr(10) ORDER BY table_name) AS text
        FROM (SELECT table_name, string_agg('  - ' || column_name || {sc} || CASE WHEN coalesce(about, '') <> '' THEN ': ' || about ELSE '' END, chr(10) ORDER BY place) AS lines
              FROM (SELECT f.*, {about} AS about FROM ({src}) f LEFT JOIN md USING (table_name, column_name)) GROUP BY table_name)"""


_RULE = {p: "regexp_matches(text, '" + r.replace("(?iu)", "(?i)") + "')" for p, r in routing.RULES.items()}

ORACLES = {
    "k9_routes": f"""WITH r AS (SELECT text IS NULL AS none, {_RULE["fact_only"]} AS f, {_RULE["doc_only"]} AS d, {_RULE["llm_only"]} AS l FROM documents)
        SELECT CASE WHEN none OR (f AND d) OR NOT (f OR d OR l) THEN 'complex_dual' WHEN d THEN 'doc_only' WHEN f THEN 'fact_only' ELSE 'llm_only' END AS path, count(*) AS questions FROM r GROUP BY 1""",
    "o6_focused_fields": f"WITH {_M} SELECT * FROM o",
    "j5_intersection": f"WITH {_M} SELECT * FROM m WHERE selected_by = 'both'",
    "t1_single_sided": f"""WITH {_M} SELECT table_name, column_name, semantic_score, NULL AS lexical_score, 'semantic' AS selected_by, 'semantic_only' AS strategy FROM sm
        UNION ALL SELECT table_name, column_name, NULL, lexical_score, 'lexical', 'lexical_only' FROM lx""",
    "a22_field_statistics": f"WITH {_M} SELECT count(*) AS total_fields, count(*) FILTER (selected_by = 'semantic') AS semantic_only, count(*) FILTER (selected_by = 'lexical') AS lexical_only, count(*) FILTER (selected_by = 'both') AS both, count(DISTINCT table_name) AS unique_tables FROM m",
    "a20_table_scores": f"WITH {_M} SELECT table_name, semantic_score, array_to_string(matched, ',') AS matched FROM sc",
    "o7_relevant_tables": f"""WITH {_M} SELECT table_name, row_number() OVER (ORDER BY round(coalesce(semantic_score, 0) + CASE WHEN len(matched) > 0 THEN 0.1 ELSE 0 END, 6) DESC, semantic_score IS NOT NULL AND len(matched) > 0 DESC, len(matched) DESC, table_name) AS position,
            semantic_score, array_to_string(matched, ',') AS matched FROM sc QUALIFY position <= 4""",
    "w5_shown_columns": _full() + f", {_SHOWN} SELECT table_name, column_name, place, is_matched, is_pk, is_fk, is_first FROM z",
    "f41_planner_text": _full()
    + f""", {_SHOWN} SELECT table_name, concat_ws(chr(10), table_name || CASE WHEN coalesce(any_value(semantic_score), 0) > 0 THEN ' (semantic: ' || printf('%.2f', any_value(semantic_score)) || ')' WHEN len(any_value(matched)) > 0 THEN ' (lexical match)' ELSE '' END,
            '  Description: Stores data of ' || table_name, '', '  Columns (' || count(*) || ' total):',
            string_agg('  ' || CASE WHEN is_matched THEN '[*]' WHEN is_pk THEN '[K]' WHEN is_fk THEN '[F]' ELSE '   ' END || ' ' || column_name || ' (' || data_type || ') - about ' || column_name, chr(10) ORDER BY place)) AS text FROM z GROUP BY table_name""",
    "f39_schema_texts": _full() + f", {_META} " + " UNION ALL ".join(f"SELECT * FROM ({_variant(v)})" for v in linking.VARIANTS),
    "f43_context": _full() + " SELECT string_agg('# ' || table_name || ' (' || c || ')', chr(10) ORDER BY table_name) AS text FROM (SELECT table_name, string_agg(column_name, ', ' ORDER BY column_name) AS c FROM b GROUP BY table_name)",
    "f39_compact": f"WITH {_M} SELECT string_agg(table_name || ': ' || c, chr(10) ORDER BY table_name) AS text FROM (SELECT table_name, string_agg(column_name, ', ' ORDER BY column_name) AS c FROM m GROUP BY table_name)",
    "x3_schema_map": _full() + " SELECT table_name, string_agg(column_name, ',' ORDER BY column_name) AS columns FROM b GROUP BY table_name",
    "j7_enriched": _full()
    + """ SELECT table_name, column_name, CASE WHEN column_name LIKE '%key' THEN 'csv ' || column_name WHEN table_name IN ('nation', 'region') THEN 'json ' || column_name END AS sme_description,
            CASE WHEN column_name LIKE '%key' THEN 'csv' WHEN table_name IN ('nation', 'region') THEN 'json' END AS sme_source FROM b""",
    "t3_new_fields": f"SELECT table_name, column_name FROM {_S} EXCEPT SELECT table_name, column_name FROM {_X}",
    "t2_all_fields": f"SELECT table_name, column_name FROM {_S} UNION SELECT table_name, column_name FROM {_X}",
    "k9_best_path": """SELECT event_id, CASE WHEN event_id % 2 >= greatest(event_id % 5, event_id % 3, event_id % 4) THEN 'complex_dual' WHEN event_id % 5 >= greatest(event_id % 3, event_id % 4) THEN 'doc_only'
            WHEN event_id % 3 >= event_id % 4 THEN 'fact_only' ELSE 'llm_only' END AS path FROM events""",
}

ORACLES = typed(ORACLES, o6_focused_fields={"position": "INTEGER"}, o7_relevant_tables={"position": "INTEGER"}, w5_shown_columns={"place": "INTEGER"})

QUERIES = {
    f.__name__: f
    for f in (o6_focused_fields, j5_intersection, t1_single_sided, a22_field_statistics, a20_table_scores, o7_relevant_tables, w5_shown_columns, f41_planner_text, f39_schema_texts, f43_context, f39_compact, x3_schema_map, j7_enriched, t3_new_fields, t2_all_fields, k9_routes, k9_best_path)
}
