"""The column-quality queries of problem 2 and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.operators import load_profile
from graniteloom.runtime import table

COLUMNS = (
    "site eqp_id eqp_no cur_time create_time work_center test_user prod_order_number process_name lot_id item_number status eqp_part_number part_number "
    "start_date_time use_yn fst_create_sys last_update_sys last_update_time eqp_mode status_d"
).split()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(base_time, column_name, finding): where a load departs from the accepted profile."""
    return load_profile.departures(table(spark, d, "eqp_mode_gen_hist"), table(spark, d, "column_profile"), "base_time")


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """The full profile of every load and column, the top values as one text."""
    p = load_profile.profile(table(spark, d, "eqp_mode_gen_hist"), "base_time")
    top = F.array_join(F.transform("top_k_values", lambda x: F.concat(x["value"], F.lit(" ("), x["cnt"].cast("string"), F.lit(")"))), ", ")
    return p.withColumn("top_k_values", top)


def p2_divergence(spark: SparkSession, d: str) -> DataFrame:
    """How far the mask distribution of each column moved since the load before."""
    return load_profile.mask_divergence(table(spark, d, "eqp_mode_gen_hist"), "base_time")


def p2_rare_masks(spark: SparkSession, d: str) -> DataFrame:
    """The values of rare masks, load by load."""
    return load_profile.rare_masks(table(spark, d, "eqp_mode_gen_hist"), "base_time")


_LONG = " UNION ALL ".join(f"SELECT base_time, '{c}' AS column_name, {c} AS v FROM eqp_mode_gen_hist" for c in COLUMNS)
_MASK = "regexp_replace(regexp_replace(v, '[A-Za-z]', 'A', 'g'), '[0-9]', 'N', 'g')"

ORACLES = {
    "p2_found": f"""
        WITH u AS ({_LONG}),
        x AS (SELECT u.base_time, u.column_name, CASE WHEN trim(v) <> '' THEN v END AS v FROM u),
        p AS (SELECT * FROM column_profile),
        s AS (SELECT x.base_time, x.column_name, count(*) AS n, count(v) AS present, count(DISTINCT v) AS vals,
                     count(*) FILTER (v IS NOT NULL AND {_MASK} = p.common_pattern) AS fits,
                     count(*) FILTER (regexp_full_match(v, '[0-9]+')) AS digits,
                     count(*) FILTER (regexp_full_match(v, '[0-9]+') AND (TRY_CAST(v AS HUGEINT) < TRY_CAST(p.min_value AS HUGEINT) OR TRY_CAST(v AS HUGEINT) > TRY_CAST(p.max_value AS HUGEINT))) AS outside
              FROM x JOIN p USING (column_name) GROUP BY ALL),
        c AS (SELECT base_time, column_name, v, count(*) AS k FROM x WHERE v IS NOT NULL GROUP BY ALL),
        t AS (SELECT column_name, unnest(top_k_values) AS e, non_null_count FROM p WHERE distinct_count <= 10),
        q AS (SELECT column_name, e.value AS v, e.cnt / non_null_count AS share FROM t),
        a AS (SELECT c.base_time, c.column_name, c.v, k / present AS share FROM c JOIN s USING (base_time, column_name)),
        f AS (SELECT s.base_time, q.column_name, q.v, q.share FROM q JOIN s USING (column_name)),
        d AS (SELECT base_time, column_name, sum(abs(coalesce(a.share, 0) - coalesce(f.share, 0))) / 2 AS dist
              FROM a FULL JOIN f USING (base_time, column_name, v) JOIN p USING (column_name) WHERE p.distinct_count <= 10 GROUP BY ALL),
        r AS (SELECT s.*, p.*, d.dist FROM s JOIN p USING (column_name) LEFT JOIN d USING (base_time, column_name))
        SELECT base_time, column_name, 'null_rate' AS finding FROM r WHERE (n - present) / n - null_count / total_records > 0.05
        UNION ALL SELECT base_time, column_name, 'distinct' FROM r WHERE distinct_count <= 50 AND abs(vals - distinct_count) > 0.5 * distinct_count
        UNION ALL SELECT base_time, column_name, 'range' FROM r WHERE column_name IN ('item_number', 'prod_order_number', 'status_d') AND outside > 0.01 * digits
        UNION ALL SELECT base_time, column_name, 'pattern' FROM r WHERE common_pattern IS NOT NULL AND present - fits > 0.02 * present
        UNION ALL SELECT base_time, column_name, 'distribution' FROM r WHERE distinct_count <= 10 AND present > 0 AND dist > 0.2""",
    "p2_profile": f"""
        WITH u AS ({_LONG}),
        x AS (SELECT base_time, column_name, CASE WHEN trim(v) <> '' THEN v END AS v FROM u),
        c AS (SELECT base_time, column_name, v, count(*) AS k, {_MASK} AS mask FROM x GROUP BY ALL),
        s AS (SELECT base_time, column_name, CAST(sum(k) AS BIGINT) AS total_records, CAST(coalesce(sum(k) FILTER (v IS NULL), 0) AS BIGINT) AS null_count,
                     CAST(coalesce(sum(k) FILTER (v IS NOT NULL), 0) AS BIGINT) AS non_null_count, count(v) AS distinct_count,
                     CAST(min(length(v)) AS INT) AS min_length, CAST(max(length(v)) AS INT) AS max_length, min(v) AS min_value, max(v) AS max_value FROM c GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY base_time, column_name ORDER BY k DESC, v) AS r FROM c WHERE v IS NOT NULL),
        t AS (SELECT base_time, column_name, string_agg(v || ' (' || k || ')', ', ' ORDER BY r) AS top_k_values FROM o WHERE r <= 10 GROUP BY ALL),
        m AS (SELECT base_time, column_name, mask, sum(k) AS k FROM c WHERE v IS NOT NULL GROUP BY ALL),
        b AS (SELECT m.base_time, m.column_name, max(m.k) / any_value(non_null_count) AS pattern_share, arg_min(mask, struct_pack(a := -m.k, b := mask)) AS common_pattern,
                     count(*) FILTER (m.k < 0.01 * non_null_count) AS rare_masks, CAST(coalesce(sum(m.k) FILTER (m.k < 0.01 * non_null_count), 0) AS BIGINT) AS rare_mask_rows
              FROM m JOIN s USING (base_time, column_name) GROUP BY ALL)
        SELECT s.*, coalesce(top_k_values, '') AS top_k_values, common_pattern, pattern_share, coalesce(rare_masks, 0) AS rare_masks, coalesce(rare_mask_rows, 0) AS rare_mask_rows
        FROM s LEFT JOIN t USING (base_time, column_name) LEFT JOIN b USING (base_time, column_name)""",
    "p2_divergence": f"""
        WITH u AS ({_LONG}),
        m AS (SELECT base_time, column_name, {_MASK} AS mask, count(*) AS n FROM u WHERE trim(v) <> '' AND base_time IS NOT NULL GROUP BY ALL),
        s AS (SELECT *, n / sum(n) OVER (PARTITION BY base_time, column_name) AS share FROM m),
        o AS (SELECT base_time, lag(base_time) OVER (ORDER BY base_time) AS prev FROM (SELECT DISTINCT base_time FROM eqp_mode_gen_hist WHERE base_time IS NOT NULL)),
        z AS (SELECT o.base_time, prev, column_name, mask, share AS a, 0 AS b FROM s JOIN o USING (base_time) WHERE prev IS NOT NULL
              UNION ALL SELECT o.base_time, prev, column_name, mask, 0, share FROM s JOIN o ON s.base_time = o.prev),
        g AS (SELECT base_time, prev, column_name, mask, sum(a) AS a, sum(b) AS b FROM z GROUP BY ALL)
        SELECT base_time, prev AS previous_load, column_name, round(sum(abs(a - b)) / 2, 6) AS divergence FROM g GROUP BY ALL HAVING sum(a) > 0 AND sum(b) > 0""",
    "p2_rare_masks": f"""
        WITH u AS ({_LONG}),
        c AS (SELECT base_time, column_name, {_MASK} AS mask, v AS value, count(*) AS n FROM u WHERE trim(v) <> '' GROUP BY ALL),
        w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY base_time, column_name, mask) AS BIGINT) AS mask_rows, sum(n) OVER (PARTITION BY base_time, column_name) AS t FROM c)
        SELECT base_time, column_name, mask, mask_rows, mask_rows / t AS share, value, n FROM w WHERE mask_rows < 0.01 * t""",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p2_divergence, p2_rare_masks)}
