"""The lexical value index: normalised values, character shingles, exact Jaccard over a shingle join, and MinHash as an accelerator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graniteloom.functions import text as T
from graniteloom.operators.profiling import index_worthy, numeric_column


def index_values(profiles: DataFrame, k: int = 3, skip_constants: bool = True, skip_ids: bool = False) -> DataFrame:
    """(table_name, column_name, value, norm, shingles, column_type, is_numeric): the indexed values of worthy columns, top values first met, once each.

    Values are trimmed; empty ones and those that normalise to nothing are left out. Originals that share a normal form all stay.
    """
    use = profiles.where(index_worthy(skip_constants, skip_ids))
    top = F.transform("top_k_values", lambda x: x["value"])
    vals = F.array_distinct(F.concat(top, F.when(F.size("indexed_values") > 0, F.col("indexed_values")).otherwise(F.col("sample_values"))))
    v = use.select("table_name", "column_name", F.col("data_type").alias("column_type"), numeric_column().alias("is_numeric"), F.explode(vals).alias("value"))
    v = v.withColumn("value", F.trim("value")).where("value <> ''").withColumn("norm", T.normalize(F.col("value"))).where("norm <> ''")
    return v.dropDuplicates(["table_name", "column_name", "value"]).withColumn("shingles", T.shingles(F.col("norm"), k))


def literal_shingles(literals: DataFrame, k: int = 3) -> DataFrame:
    """(literal, shingles) of distinct literals."""
    n = T.normalize(F.col("literal"))
    return literals.select("literal").distinct().withColumn("norm", n).where("norm <> ''").select("literal", T.shingles(F.col("norm"), k).alias("shingles"))


def matches(literals: DataFrame, index: DataFrame, k: int = 3, top_k: int | None = None, threshold: float | None = None) -> DataFrame:
    """(literal, table_name, column_name, value, score, column_type, is_numeric): indexed values that share a shingle, with exact Jaccard.

    All sharing values are scored: the overlap is a count over a shingle equi-join, so no set is compared that shares nothing. The literals are a
    query's few; they are joined as rows. ``top_k`` 0 gives none, None all; ties go to table, column and value.
    """
    q = literal_shingles(literals, k)
    qs = q.select("literal", F.size("shingles").alias("qn"), F.explode("shingles").alias("s"))
    vs = index.select("table_name", "column_name", "value", "column_type", "is_numeric", F.size("shingles").alias("vn"), F.explode("shingles").alias("s"))
    both = vs.join(qs, "s").groupBy("literal", "table_name", "column_name", "value").agg(F.count("*").alias("i"), F.first("qn").alias("qn"), F.first("vn").alias("vn"), F.first("column_type").alias("column_type"), F.first("is_numeric").alias("is_numeric"))
    out = both.withColumn("score", F.round(F.col("i") / (F.col("qn") + F.col("vn") - F.col("i")), 6)).drop("i", "qn", "vn")
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    if top_k is not None:
        w = W.Window.partitionBy("literal").orderBy(F.desc("score"), "table_name", "column_name", "value")
        out = out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_k).drop("r")
    return out


def field_scores(found: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(table_name, column_name, score): the best score of each field over all literals, from ``threshold`` on."""
    return found.where(F.col("score") >= threshold).groupBy("table_name", "column_name").agg(F.max("score").alias("score"))


def minhash_matches(literals: DataFrame, index: DataFrame, threshold: float = 0.5, tables: int = 16, features: int = 1 << 18) -> DataFrame:
    """Candidates of MinHash LSH with exact Jaccard on them: an accelerator that may miss pairs near the threshold.

    Shingles are hashed to ``features`` positions; the exact score is taken on the shingles themselves.
    """
    from pyspark.ml.feature import HashingTF, MinHashLSH

    tf = HashingTF(inputCol="shingles", outputCol="f", numFeatures=features, binary=True)
    left = tf.transform(literal_shingles(literals))
    right = tf.transform(index.select("table_name", "column_name", "value", "shingles"))
    model = MinHashLSH(inputCol="f", outputCol="h", numHashTables=tables, seed=42).fit(right)
    j = model.approxSimilarityJoin(left, right, 1.0 - threshold / 2, distCol="d")
    score = F.round(T.jaccard(F.col("datasetA.shingles"), F.col("datasetB.shingles")), 6)
    return j.select(F.col("datasetA.literal").alias("literal"), "datasetB.table_name", "datasetB.column_name", "datasetB.value", score.alias("score")).where(F.col("score") >= threshold)


def coverage(found: DataFrame, fields: DataFrame, top_k: int = 5) -> DataFrame:
    """(literal, covered): whether a literal with matches has one of its best ``top_k`` in ``fields`` (table_name, column_name); the score is not looked at."""
    w = W.Window.partitionBy("literal").orderBy(F.desc("score"), "table_name", "column_name", "value")
    best = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_k)
    f = fields.select("table_name", "column_name").distinct().withColumn("hit", F.lit(True))
    return best.join(f, ["table_name", "column_name"], "left").groupBy("literal").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("covered"))
