"""The SQL surface: week-over-week utilisation of equipment, and results compared, over the equipment tables.

Statements are Spark SQL with an explicit day instead of the system date.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graniteloom.operators import voting
from graniteloom.plans.base import typed
from graniteloom.plans.documents import masked_sql
from graniteloom.runtime import table
from graniteloom.sources.catalog import Database
from graniteloom.sources import parsing, stores
from graniteloom.streaming import logs

AS_OF = "2015-01-08"
LIKE = "%machine%"


NAMES = ("eqp_mode_gen_hist", "cim_eqp_mst", "orders", "customer", "nation", "region", "lineitem")


def _db(spark, d) -> Database:
    return Database(spark, {n: table(spark, d, n) for n in NAMES}, {"cim_eqp_mst": ("eqp_id",), "orders": ("o_orderkey",)}, {("orders", "o_custkey"): "customer.c_custkey"})


_TWO_WEEKS = """
    WITH last_week AS (
        SELECT h.eqp_id, sum(CASE WHEN h.status = 'RUN' THEN 1 ELSE 0 END) AS run_count, count(*) AS total_count
        FROM eqp_mode_gen_hist h JOIN cim_eqp_mst m ON h.eqp_id = m.eqp_id
        WHERE m.cim_eqp_desc LIKE :pattern
          AND h.create_time >= {day}({monday} - INTERVAL 7 DAYS) || '000000' AND h.create_time < {day}({monday}) || '000000'
        GROUP BY h.eqp_id),
    this_week AS (
        SELECT h.eqp_id, sum(CASE WHEN h.status = 'RUN' THEN 1 ELSE 0 END) AS run_count, count(*) AS total_count
        FROM eqp_mode_gen_hist h JOIN cim_eqp_mst m ON h.eqp_id = m.eqp_id
        WHERE m.cim_eqp_desc LIKE :pattern
          AND h.create_time >= {day}({monday}) || '000000' AND h.create_time < {day}({monday} + INTERVAL 7 DAYS) || '000000'
        GROUP BY h.eqp_id)
    SELECT m.cim_eqp_desc, l.eqp_id,
           round(coalesce(t.run_count, 0) / nullif(t.total_count, 0) * 100, 2) AS this_week_rate,
           round(coalesce(l.run_count, 0) / nullif(l.total_count, 0) * 100, 2) AS last_week_rate
    FROM last_week l JOIN this_week t ON l.eqp_id = t.eqp_id JOIN cim_eqp_mst m ON l.eqp_id = m.eqp_id
    WHERE round(coalesce(t.run_count, 0) / nullif(t.total_count, 0) * 100, 2) < round(coalesce(l.run_count, 0) / nullif(l.total_count, 0) * 100, 2)"""

_PIVOT = """
    WITH eqp AS (SELECT eqp_id, cim_eqp_desc FROM cim_eqp_mst WHERE cim_eqp_desc LIKE :pattern AND use_yn = 'Y'),
    hist AS (
        SELECT h.eqp_id, extract(YEAROFWEEK FROM d) AS y, extract(WEEK FROM d) AS w, sum(CASE WHEN h.status = 'RUN' THEN 1 ELSE 0 END) AS run_count, count(*) AS total_count
        FROM (SELECT *, try_to_date(substr(create_time, 1, 8), 'yyyyMMdd') AS d FROM eqp_mode_gen_hist) h
        WHERE h.eqp_id IN (SELECT eqp_id FROM eqp) AND d >= trunc(DATE '{as_of}', 'WEEK') - INTERVAL 14 DAYS
        GROUP BY h.eqp_id, extract(YEAROFWEEK FROM d), extract(WEEK FROM d)),
    agg AS (
        SELECT eqp_id,
               max(CASE WHEN y = extract(YEAROFWEEK FROM DATE '{as_of}') AND w = extract(WEEK FROM DATE '{as_of}') THEN run_count / total_count END) AS last_rate,
               max(CASE WHEN y = extract(YEAROFWEEK FROM DATE '{as_of}' - INTERVAL 7 DAYS) AND w = extract(WEEK FROM DATE '{as_of}' - INTERVAL 7 DAYS) THEN run_count / total_count END) AS prev_rate
        FROM hist GROUP BY eqp_id)
    SELECT e.eqp_id, e.cim_eqp_desc, round(a.prev_rate, 6) AS previous_week_rate, round(a.last_rate, 6) AS last_week_rate
    FROM agg a JOIN eqp e ON a.eqp_id = e.eqp_id WHERE a.prev_rate > a.last_rate AND a.prev_rate IS NOT NULL AND a.last_rate IS NOT NULL"""


def sql_two_weeks(spark, d):
    """Equipment that ran less this week than last, from two common table expressions."""
    sql = _TWO_WEEKS.replace("{monday}", f"trunc(DATE '{AS_OF}', 'WEEK')").replace("{day}(", "date_format(").replace(") || '000000'", ", 'yyyyMMdd') || '000000'")
    return _db(spark, d).run(sql, pattern=LIKE)


def sql_week_pivot(spark, d):
    """The same by ISO week, as a pivot."""
    return _db(spark, d).run(_PIVOT.replace("{as_of}", AS_OF), pattern=LIKE)


def sql_status_by_week(spark, d):
    """Rows, distinct equipment and run share by ISO week and site."""
    return _db(spark, d).run("""
        SELECT site, extract(YEAROFWEEK FROM d) AS iso_year, extract(WEEK FROM d) AS iso_week, count(*) AS n, count(DISTINCT eqp_id) AS equipment, round(sum(CASE WHEN status = 'RUN' THEN 1 ELSE 0 END) / count(*), 6) AS run_share
        FROM (SELECT *, try_to_date(substr(create_time, 1, 8), 'yyyyMMdd') AS d FROM eqp_mode_gen_hist) WHERE d IS NOT NULL GROUP BY ALL""")


def sql_running_equipment(spark, d):
    """Equipment of the master that never ran, by subquery and left join."""
    return _db(spark, d).run("""
        SELECT m.eqp_id, m.eqp_group FROM cim_eqp_mst m LEFT JOIN (SELECT DISTINCT eqp_id FROM eqp_mode_gen_hist WHERE status = 'DOWN') r ON m.eqp_id = r.eqp_id
        WHERE r.eqp_id IS NULL AND m.eqp_id IN (SELECT eqp_id FROM eqp_mode_gen_hist WHERE status = 'RUN')""")


def s3_describe(spark, d):
    """Columns and row counts of the catalog."""
    db = _db(spark, d)
    rows = [(t.name, i, c.name, c.primary_key, c.foreign_key, t.row_count) for n in db.table_names() for t in [db.describe(n)] for i, c in enumerate(t.columns)]
    return spark.createDataFrame(rows, "table_name string, position bigint, column_name string, primary_key boolean, foreign_key string, row_count bigint")


def s6_parameters(spark, d):
    return _db(spark, d).run("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > :low AND o_orderpriority = :priority GROUP BY o_orderstatus", low=50000.0, priority="1-URGENT")


def s7_sample(spark, d):
    return _db(spark, d).sample("cim_eqp_mst", "eqp_group", 10)


def s8_row_count(spark, d):
    return _db(spark, d).row_count("lineitem")


def s12_parser_choice(spark, d):
    p = table(spark, d, "parents").dropDuplicates(["parent_id"])
    return p.select("parent_id", parsing.parser_choice(F.length("parent_text") * 20000).alias("parser"), parsing.media_type(F.col("source_file")).alias("media_type"))


def s14_element_types(spark, d):
    c = table(spark, d, "parents").select("parent_type").distinct()
    return c.select("parent_type", parsing.element_type(F.concat(F.upper("parent_type"), F.lit("1"))).alias("as_numbered"), parsing.element_type(F.col("parent_type")).alias("as_is"))


def s21_upserted(spark, d):
    """The first load of every parent, then the second load on top: the text is replaced, created_at stays."""
    from pyspark.sql import window as W

    p = table(spark, d, "parents").select("parent_id", "parent_text", "created_at", "updated_at")
    n = p.withColumn("r", F.row_number().over(W.Window.partitionBy("parent_id").orderBy("updated_at")))
    old, new = n.where("r = 1").drop("r"), n.where("r = 2").drop("r")
    u = stores.upserted(old, new, "parent_id", keep=("created_at",))
    return u.select("parent_id", F.md5("parent_text").alias("digest"), "created_at", "updated_at")


def s26_status(spark, d):
    e = F.when(F.col("event_type") == "error", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", stores.ingestion_status(e, (F.col("user_id") % 2).cast("int")).alias("status"))


def o27_paths(spark, d):
    """The events table as a log: errors as results that failed, all else as decisions."""
    ev = table(spark, d, "events")
    err = F.col("event_type") == "error"
    log = ev.select(F.when(err, "result").otherwise("routing_decision").alias("type"), F.col("event_type").alias("selected_path"), F.when(err, F.lit("error")).alias("path"), (~err | (F.col("value") > 10)).alias("success"), (err & (F.col("value") <= 10)).alias("has_error"))
    return stores.path_statistics(log)


def streaming_windows(spark, d):
    """Event counts by ten minutes and type, as the stream gives them."""
    return logs.windowed(table(spark, d, "events"), "ts", "event_type")


def streaming_sessions(spark, d):
    return logs.sessions(table(spark, d, "events"), "ts", "user_id", "2 hours")


def a29_latency(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("difficulty"), F.col("value").alias("seconds"))
    return voting.latency(e)


def a28_accuracy(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("difficulty"), (F.col("value") > 5).alias("ok"))
    return voting.accuracy(e)


def _results(spark, d):
    """Four candidates for each market segment: two agree, one differs, one agrees but is longer."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("question"), "c_custkey", "c_acctbal")
    parts = []
    for i, (sql, keep) in enumerate((("SELECT a FROM t WHERE x > 0", F.col("c_acctbal") > 0), ("SELECT a FROM t", F.lit(True)), ("SELECT a FROM t WHERE NOT x <= 0", ~(F.col("c_acctbal") <= 0)), ("SELECT b FROM t", F.col("c_custkey") % 2 == 0))):
        parts.append(c.where(keep).select("question", F.lit(i).alias("candidate"), F.lit(sql).alias("sql"), F.col("c_custkey").cast("string").alias("row")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def a23_votes(spark, d):
    return voting.vote_rows(_results(spark, d))


def x4_fallback(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("question"), F.col("event_type").alias("variant"), F.col("event_id").alias("iteration"), F.col("props").alias("sql"))
    return voting.fallback_sql(e)


def w6_stratified(spark, d):
    """Three events of each type (rows only: the draw is by hash)."""
    return voting.stratified(table(spark, d, "events"), "event_type", "event_id", 3)


def t7_examples(spark, d):
    """Master descriptions as masked questions, each once."""
    q = voting.masked(table(spark, d, "cim_eqp_mst").where("cim_eqp_desc is not null").select(F.lit("mes").alias("db_id"), F.col("cim_eqp_desc").alias("question"), F.lit("SELECT 1").alias("sql")))
    return voting.add_examples(None, q).select("masked").distinct()


_MON = f"date_trunc('week', DATE '{AS_OF}')"
_DAY = lambda e: f"strftime({e}, '%Y%m%d') || '000000'"
_WEEK = lambda a, b: f"SELECT h.eqp_id, count(*) FILTER (h.status = 'RUN') AS r, count(*) AS n FROM eqp_mode_gen_hist h JOIN cim_eqp_mst m ON h.eqp_id = m.eqp_id WHERE m.cim_eqp_desc LIKE '{LIKE}' AND h.create_time >= {a} AND h.create_time < {b} GROUP BY h.eqp_id"
_D = "TRY_CAST(try_strptime(substr(create_time, 1, 8), '%Y%m%d') AS DATE)"

ORACLES = {
    "t7_examples": f"SELECT DISTINCT {masked_sql('cim_eqp_desc')} AS masked FROM cim_eqp_mst WHERE cim_eqp_desc IS NOT NULL",
    "s3_describe": "WITH n AS (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in NAMES) + """)
        SELECT table_name, CAST(column_index - 1 AS BIGINT) AS position, column_name, (table_name, column_name) IN (('cim_eqp_mst', 'eqp_id'), ('orders', 'o_orderkey')) AS primary_key,
               CASE WHEN (table_name, column_name) = ('orders', 'o_custkey') THEN 'customer.c_custkey' END AS foreign_key, row_count FROM duckdb_columns() JOIN n USING (table_name)""",
    "sql_two_weeks": f"""WITH l AS ({_WEEK(_DAY(_MON + " - INTERVAL 7 DAY"), _DAY(_MON))}), t AS ({_WEEK(_DAY(_MON), _DAY(_MON + " + INTERVAL 7 DAY"))})
        SELECT m.cim_eqp_desc, l.eqp_id, round(t.r / t.n * 100, 2) AS this_week_rate, round(l.r / l.n * 100, 2) AS last_week_rate FROM l JOIN t ON l.eqp_id = t.eqp_id JOIN cim_eqp_mst m ON l.eqp_id = m.eqp_id WHERE round(t.r / t.n * 100, 2) < round(l.r / l.n * 100, 2)""",
    "sql_week_pivot": f"""WITH e AS (SELECT eqp_id, cim_eqp_desc FROM cim_eqp_mst WHERE cim_eqp_desc LIKE '{LIKE}' AND use_yn = 'Y'), h AS (SELECT eqp_id, status, {_D} AS d FROM eqp_mode_gen_hist),
        w AS (SELECT eqp_id, date_trunc('week', d) AS w, count(*) FILTER (status = 'RUN') / count(*) AS rate FROM h WHERE d IS NOT NULL GROUP BY ALL),
        a AS (SELECT eqp_id, max(rate) FILTER (w = {_MON}) AS last_rate, max(rate) FILTER (w = {_MON} - INTERVAL 7 DAY) AS prev_rate FROM w GROUP BY eqp_id)
        SELECT eqp_id, cim_eqp_desc, round(prev_rate, 6) AS previous_week_rate, round(last_rate, 6) AS last_week_rate FROM a JOIN e USING (eqp_id) WHERE prev_rate > last_rate""",
    "sql_status_by_week": f"""SELECT site, CAST(isoyear(d) AS INT) AS iso_year, CAST(week(d) AS INT) AS iso_week, count(*) AS n, count(DISTINCT eqp_id) AS equipment, round(count(*) FILTER (status = 'RUN') / count(*), 6) AS run_share
        FROM (SELECT *, {_D} AS d FROM eqp_mode_gen_hist) WHERE d IS NOT NULL GROUP BY ALL""",
    "sql_running_equipment": "SELECT eqp_id, eqp_group FROM cim_eqp_mst m WHERE eqp_id NOT IN (SELECT eqp_id FROM eqp_mode_gen_hist WHERE status = 'DOWN' AND eqp_id IS NOT NULL) AND eqp_id IN (SELECT eqp_id FROM eqp_mode_gen_hist WHERE status = 'RUN')",
    "s6_parameters": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 50000 AND o_orderpriority = '1-URGENT' GROUP BY o_orderstatus",
    "s7_sample": "SELECT DISTINCT eqp_group AS value FROM cim_eqp_mst WHERE eqp_group IS NOT NULL ORDER BY 1 LIMIT 10",
    "s8_row_count": "SELECT count(*) AS row_count FROM lineitem",
    "s12_parser_choice": """SELECT parent_id, CASE WHEN length(parent_text) * 20000 > 20971520 THEN 'async' ELSE 'sync' END AS parser,
            CASE WHEN source_file ILIKE '%.pdf' THEN 'application/pdf' WHEN source_file ILIKE '%.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN source_file ILIKE '%.pptx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation'
                 WHEN source_file ILIKE '%.xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN source_file ILIKE '%.hwp' THEN 'application/x-hwp' ELSE 'application/octet-stream' END AS media_type FROM (SELECT DISTINCT ON (parent_id) * FROM parents)""",
    "s14_element_types": "SELECT DISTINCT parent_type, CASE WHEN parent_type = 'heading' THEN 'heading' ELSE 'text' END AS as_numbered, parent_type AS as_is FROM parents",
    "s21_upserted": "SELECT parent_id, md5(arg_max(parent_text, updated_at)) AS digest, arg_min(created_at, updated_at) AS created_at, max(updated_at) AS updated_at FROM parents GROUP BY parent_id",
    "s26_status": "SELECT event_id, CASE WHEN event_type <> 'error' THEN 'completed' WHEN user_id % 2 > 0 THEN 'partial' ELSE 'failed' END AS status FROM events",
    "o27_paths": """SELECT event_type AS path, CASE WHEN event_type = 'error' THEN 0 ELSE count(*) END AS decisions, CASE WHEN event_type = 'error' THEN count(*) ELSE 0 END AS results,
            CASE WHEN event_type = 'error' THEN count(*) FILTER (value > 10) ELSE 0 END AS successes, CASE WHEN event_type = 'error' THEN count(*) FILTER (value <= 10) ELSE 0 END AS errors FROM events GROUP BY event_type""",
    "streaming_windows": "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "streaming_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
    "a29_latency": "SELECT event_type AS difficulty, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "a28_accuracy": "SELECT event_type AS difficulty, count(*) AS n, count(*) FILTER (value > 5) AS correct, round(avg(CAST(value > 5 AS INT)), 6) AS accuracy FROM events GROUP BY event_type",
    "a23_votes": "SELECT c_mktsegment AS question, 'SELECT a FROM t WHERE x > 0' AS sql, 2 AS votes FROM customer GROUP BY c_mktsegment",
    "x4_fallback": "SELECT user_id AS question, arg_max(props, struct_pack(a := event_type, b := event_id)) AS sql FROM events GROUP BY user_id",
}

ORACLES = typed(ORACLES, a23_votes={"votes": "BIGINT"})

QUERIES = {
    f.__name__: f
    for f in (sql_two_weeks, sql_week_pivot, sql_status_by_week, sql_running_equipment, s3_describe, s6_parameters, s7_sample, s8_row_count, s12_parser_choice, s14_element_types, s21_upserted, s26_status, o27_paths, streaming_windows, streaming_sessions, a29_latency, a28_accuracy, a23_votes, x4_fallback, w6_stratified, t7_examples)
}
