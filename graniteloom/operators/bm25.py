"""The sparse index: term frequencies, statistics, scores, updates, top-k search over many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graniteloom.functions import text as T


def term_frequencies(docs: DataFrame, key: str, text: str, **how) -> DataFrame:
    """(doc, term, tf, doc_length): one row for each term of a document; documents without terms have none."""
    toks = docs.select(F.col(f"`{key}`").alias("doc"), T.tokens(F.col(f"`{text}`"), **how).alias("t"))
    toks = toks.select("doc", F.size("t").alias("doc_length"), F.explode("t").alias("term"))
    return toks.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("doc_length").cast("bigint").alias("doc_length"))


def from_maps(index: DataFrame, key: str = "child_id", frequencies: str = "term_frequencies", newest: str | None = "updated_at") -> DataFrame:
    """(doc, term, tf, doc_length) of stored frequency maps; the newest row of a document counts, its length is the sum of its counts."""
    use = index.where(F.col(key).isNotNull() & F.col(frequencies).isNotNull())
    if newest:
        e = F.transform(F.map_entries(frequencies), lambda x: F.struct(x["key"].alias("term"), x["value"].cast("bigint").alias("tf")))
        use = use.groupBy(F.col(key).alias("doc")).agg(F.max(F.struct(F.col(newest), F.array_sort(e).alias("e"))).alias("r")).select("doc", F.col("r.e").alias("e"))
    else:
        use = use.select(F.col(key).alias("doc"), F.transform(F.map_entries(frequencies), lambda x: F.struct(x["key"].alias("term"), x["value"].cast("bigint").alias("tf"))).alias("e"))
    total = F.aggregate("e", F.lit(0).cast("bigint"), lambda a, x: a + x["tf"])
    return use.select("doc", total.alias("doc_length"), F.explode("e").alias("x")).select("doc", "x.term", "x.tf", "doc_length")


def frequency_maps(tf: DataFrame) -> DataFrame:
    """(doc, term_frequencies map, doc_length) of the long form."""
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "tf"))))
    return tf.groupBy("doc").agg(m.alias("term_frequencies"), F.sum("tf").alias("doc_length"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df)."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def statistics(tf: DataFrame) -> DataFrame:
    """One row: total_documents, avg_doc_length, total_terms (distinct)."""
    docs = tf.groupBy("doc").agg(F.first("doc_length").alias("n"))
    s = docs.agg(F.count("*").alias("total_documents"), F.avg("n").alias("avg_doc_length"))
    return s.join(F.broadcast(tf.agg(F.countDistinct("term").alias("total_terms"))))


def idf(n: Column, df: Column) -> Column:
    """max(ln((N - df + 0.5) / (df + 0.5)), 0); 0 for an unknown term."""
    return F.coalesce(F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(0.0)), F.lit(0.0))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query, term, times): a term that a query repeats counts as often."""
    t = queries.select(F.col(f"`{key}`").alias("query"), F.explode(T.tokens(F.col(f"`{text}`"))).alias("term"))
    return t.groupBy("query", "term").agg(F.count("*").alias("times"))


def scores(tf: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score) of every document that has a term of the query, 0 included.

    Postings are cut to the queries' terms first (those are few and broadcast if Spark finds them so); document
    frequency is then counted on what is left, so no corpus-wide term table is built for a search.
    """
    asked = terms.select("term").distinct()
    # the corpus statistics are one row
    n = tf.groupBy("doc").agg(F.max("doc_length").alias("doc_length")).agg(F.count("*").alias("n"), F.avg("doc_length").alias("avgdl"))
    return scored(tf.join(asked, "term", "left_semi"), terms, n, k1, b)


def scored(hits: DataFrame, terms: DataFrame, n: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score) from all postings ``hits`` of the queries' terms and the one row ``n`` (n, avgdl)."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    avgdl = F.when(F.coalesce("avgdl", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("avgdl"))
    w = terms.join(df, "term").join(F.broadcast(n)).select("query", "term", "times", idf(F.col("n"), F.col("df")).alias("idf"), avgdl.alias("avgdl"))
    one = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_length") / F.col("avgdl")))
    return hits.join(w, "term").groupBy("query", "doc").agg(F.round(F.sum(one), 6).alias("score"))


def search(tf: DataFrame, terms: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score, rank): the top k of each query, ties to the smaller document id. ``sparse_index`` searches a stored index."""
    return top(scores(tf, terms, k1, b), k)


def top(scores: DataFrame, k: int) -> DataFrame:
    w = W.Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def upsert(tf: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the documents of ``new`` replaced or added."""
    return delete(tf, new.select("doc").distinct()).unionByName(new)


def delete(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """The index without the documents (doc)."""
    return tf.join(docs.select("doc").distinct(), "doc", "left_anti")


def index_batch(docs: DataFrame, key: str, text: str, atomic: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tf, status): status (doc, success, error) has every document; with ``atomic`` one empty document fails all."""
    st = docs.select(F.col(f"`{key}`").alias("doc"), (F.size(T.tokens(F.col(f"`{text}`"))) > 0).alias("ok"))
    tf = term_frequencies(docs, key, text)
    if atomic:
        all_ok = st.agg(F.coalesce(F.min("ok"), F.lit(True)).alias("all_ok"))
        st = st.join(F.broadcast(all_ok))
        tf = tf.join(F.broadcast(all_ok)).where("all_ok").drop("all_ok")
        good = F.col("all_ok")
        error = F.when(~F.col("ok"), "no terms").when(~F.col("all_ok"), "rolled back")
    else:
        good, error = F.col("ok"), F.when(~F.col("ok"), "no terms")
    return tf, st.select("doc", good.alias("success"), error.alias("error"))


def batch_result(status: DataFrame) -> DataFrame:
    """One row: total, successful, failed, success_rate, failed_ids in order (as many as failed)."""
    return status.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.col("success").cast("bigint")), F.lit(0)).alias("successful"),
        F.coalesce(F.sum((~F.col("success")).cast("bigint")), F.lit(0)).alias("failed"),
        F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)).alias("success_rate"),
        F.array_sort(F.collect_list(F.when(~F.col("success"), F.col("doc")))).alias("failed_ids"),
    )


def health(tf: DataFrame, children: DataFrame, key: str = "child_id") -> DataFrame:
    """One row: children, indexed children, terms, children without an index entry."""
    c = children.select(F.col(key).alias("doc")).where("doc is not null").distinct()
    i = tf.select("doc").distinct().withColumn("hit", F.lit(1))
    one = c.join(i, "doc", "left").agg(F.count("*").alias("total_children"), F.count("hit").alias("indexed_children"), F.count(F.when(F.col("hit").isNull(), 1)).alias("missing"))
    return one.join(F.broadcast(tf.agg(F.countDistinct("term").alias("unique_terms"))))
