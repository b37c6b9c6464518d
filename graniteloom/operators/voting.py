"""Comparing candidate SQL by results, few-shot examples, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import window as W

from graniteloom.functions import text as T

# Fixed value: the statement given where no candidate is valid.
NO_SQL = "SELECT 'No valid SQL generated'"


def _cell(f: ST.StructField, places: bool) -> Column:
    c = F.col(f"`{f.name}`")
    if places and isinstance(f.dataType, (ST.DoubleType, ST.FloatType, ST.DecimalType)):
        c = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"0+$", ""), r"\.$", "")
    return F.coalesce(c.cast("string"), F.lit("__NULL__"))


def row_text(df: DataFrame, places: bool = False, width: int | None = None) -> DataFrame:
    """(row): each row as text, columns by name, nulls marked; ``places`` cuts numbers to six places, ``width`` keeps the first columns as they stand."""
    fields = df.schema.fields[:width] if width else sorted(df.schema.fields, key=lambda f: f.name.lower())
    return df.select(F.concat_ws("\u001f", *[F.concat(F.length(x).cast("string"), F.lit(":"), x) for x in (_cell(f, places) for f in fields)]).alias("row"))


def fingerprint(df: DataFrame, distinct: bool = False, **how) -> tuple[int, str]:
    """An order-free summary of a result: row count and a 128-bit sum of row hashes. Rows are combined map-side, never gathered.

    Equal bags have equal fingerprints; unequal ones collide with a chance of about 2 ** -120.
    """
    rows = row_text(df, **how)
    rows = rows.distinct() if distinct else rows
    h = lambda s: F.sum(F.xxhash64("row", F.lit(s)).cast("decimal(20,0)"))
    n, a, b = rows.agg(F.count("*"), h(1), h(2)).first()
    return n, f"{a}/{b}"


def same_result(a: DataFrame, b: DataFrame) -> bool:
    """Set equality: nulls equal, numbers to six places, columns by position."""
    w = min(len(a.columns), len(b.columns))
    return fingerprint(a, True, places=True, width=w) == fingerprint(b, True, places=True, width=w)


def vote(candidates: list[str], signatures: list[object | None]) -> str:
    """The shortest SQL of the result with most votes; ties to the result seen first. None marks a failed candidate; if all failed, the first one."""
    if not candidates:
        return NO_SQL
    groups: dict[object, list[str]] = {}
    for sql, sig in zip(candidates, signatures):
        if sig is not None:
            groups.setdefault(sig, []).append(sql)
    return min(max(groups.values(), key=len), key=len) if groups else candidates[0]


def solve(spark: SparkSession, candidates: list[str], lint=None) -> str:
    """Lint, run and vote. Candidates that fail to run get no vote; if lint rejects all, the placeholder statement."""
    ok = [c for c in candidates if lint is None or lint(spark, c).valid]
    if candidates and not ok:
        return NO_SQL
    sigs: list[object | None] = []
    for c in ok:
        try:
            sigs.append(fingerprint(spark.sql(c)))
        except Exception:
            sigs.append(None)
    return vote(ok, sigs)


def vote_rows(results: DataFrame) -> DataFrame:
    """The vote over a table of results (question, candidate, sql, row): one row (question, sql, votes) for each question."""
    h = lambda s: F.sum(F.xxhash64("row", F.lit(s)).cast("decimal(20,0)"))
    sig = results.groupBy("question", "candidate", "sql").agg(F.concat_ws("/", F.count("*").cast("string"), h(1).cast("string"), h(2).cast("string")).alias("sig"))
    g = sig.groupBy("question", "sig").agg(F.count("*").alias("votes"), F.min("candidate").alias("first"), F.min(F.struct(F.length("sql").alias("n"), "candidate", "sql")).alias("s"))
    w = W.Window.partitionBy("question").orderBy(F.desc("votes"), "first")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").select("question", F.col("s.sql").alias("sql"), "votes")


def fallback_sql(iterations: DataFrame) -> DataFrame:
    """(question, sql): the last iteration's SQL of the last variant (question, variant, iteration, sql)."""
    return iterations.groupBy("question").agg(F.max_by("sql", F.struct("variant", "iteration")).alias("sql"))


def accuracy(outcomes: DataFrame) -> DataFrame:
    """(difficulty, n, correct, accuracy) of (difficulty, ok)."""
    return outcomes.groupBy("difficulty").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("bigint")).alias("correct"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("accuracy"))


def latency(times: DataFrame) -> DataFrame:
    """(difficulty, n, mean, p95) of (difficulty, seconds); p95 interpolates."""
    return times.groupBy("difficulty").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 6).alias("mean"), F.round(F.percentile("seconds", 0.95), 6).alias("p95"))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum in a random but fixed order of ``key``."""
    w = W.Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def add_examples(store: DataFrame | None, new: DataFrame) -> DataFrame:
    """Few-shot examples (db_id, question, masked, sql, ...) with ``digest``, each once; those of the store stay."""
    key = F.sha2(F.to_json(F.struct(F.col("db_id"), F.col("masked"), F.col("sql"))), 256)
    n = new.withColumn("digest", key)
    w = W.Window.partitionBy("digest").orderBy("question")
    n = n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return n if store is None else store.unionByName(n.join(store.select("digest"), "digest", "left_anti").select(*store.columns))


def retrieve_examples(store: DataFrame, query: DataFrame, db_id: str | None = None, k: int = 5, threshold: float = 0.4, dim: int = 64) -> DataFrame:
    """(query, digest, score, rank): the examples most similar to each query vector (query, vector).

    The first max(3 k, 50) by cosine are found before the filter on database and threshold, as a bounded index search would.
    """
    from graniteloom.operators.retrieval import dense_search, overfetch_filter

    pool = max(3 * k, 50)
    m = dense_search(store, "digest", "embedding", query, pool, dim).join(store.select(F.col("digest").alias("doc"), "db_id"), "doc")
    keep = F.col("score") >= threshold
    if db_id is not None:
        keep = keep & (F.col("db_id") == db_id)
    return overfetch_filter(m, keep, k, pool).select("query", F.col("doc").alias("digest"), "score", "rank")


def masked(questions: DataFrame, question: str = "question") -> DataFrame:
    """Questions with ``masked``, the offline form of masking."""
    return questions.withColumn("masked", T.mask_values(F.col(question)))
