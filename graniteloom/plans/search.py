"""Sparse and dense search, fusion and context over the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.functions import text as T
from graniteloom.operators import bm25, retrieval, sparse_index
from graniteloom.plans.base import CHILDREN_SQL, QUESTIONS_SQL, TF_SQL, children, questions, tokens_sql, typed
from graniteloom.runtime import scratch_path, table, written


def _tf(spark: SparkSession, d: str) -> DataFrame:
    return bm25.term_frequencies(children(spark, d), "doc", "text")


_indexes: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, d: str) -> str:
    """The path of the stored index of the children: built by the first search of an application over a folder, read by all that follow."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        path = scratch_path(spark, "index")
        sparse_index.add(spark, path, _tf(spark, d))
        _indexes[key] = path
    return _indexes[key]


def _terms(spark: SparkSession) -> DataFrame:
    return bm25.query_terms(questions(spark), "query", "question")


def f1_tokens(spark, d):
    """Number of index terms and of distinct ones of each document."""
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("terms"), F.size(F.array_distinct(t)).alias("unique_terms"))


def a14_term_frequencies(spark, d):
    return _tf(spark, d)


def a15_doc_lengths(spark, d):
    return bm25.frequency_maps(_tf(spark, d)).select("doc", "doc_length", F.size("term_frequencies").alias("terms"))


def a16_document_frequencies(spark, d):
    return bm25.document_frequencies(_tf(spark, d))


def a16_stored_frequencies(spark, d):
    """Document frequencies of the stored maps, as they are spelt."""
    return bm25.document_frequencies(bm25.from_maps(table(spark, d, "bm25_index")))


def a17_statistics(spark, d):
    s = bm25.statistics(_tf(spark, d))
    return s.select("total_documents", F.round("avg_doc_length", 6).alias("avg_doc_length"), "total_terms")


def a18_idf(spark, d):
    tf = _tf(spark, d)
    n = tf.agg(F.countDistinct("doc").alias("n"))
    return bm25.document_frequencies(tf).join(F.broadcast(n)).select("term", "df", F.round(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def k1_bm25_search(spark, d):
    return sparse_index.search(spark, _index(spark, d), _terms(spark), 10)


def s35_build_index(spark, d):
    """The stored index built anew: its statistics, and its frequencies summed up."""
    path = scratch_path(spark, "index")
    sparse_index.add(spark, path, _tf(spark, d))
    p = sparse_index.postings(spark, path).agg(F.count("*").alias("postings"), F.sum("tf").cast("bigint").alias("terms"))
    return sparse_index.statistics(spark, path).select(F.col("n").alias("documents"), F.round("avgdl", 6).alias("avg_doc_length")).join(F.broadcast(p))


def s24_changed_index(spark, d):
    """The index once headings are deleted and every hundredth child is replaced by its text twice over: a search on three segments, then on one."""
    path = scratch_path(spark, "index")
    ch = children(spark, d)
    sparse_index.add(spark, path, _tf(spark, d))
    sparse_index.add(spark, path, None, ch.select("doc").where(F.col("doc").contains("_heading")))
    twice = ch.where("doc like '%00%'").select("doc", F.concat_ws(" ", "text", "text").alias("text"))
    sparse_index.add(spark, path, bm25.term_frequencies(twice, "doc", "text"))
    three = written(sparse_index.search(spark, path, _terms(spark), 10).withColumn("segments", F.lit(3)), "found")
    sparse_index.compact(spark, path)
    return three.unionByName(sparse_index.search(spark, path, _terms(spark), 10).withColumn("segments", F.lit(1)))


def pred6_any_term(spark, d):
    """How many documents have any term of each question."""
    terms = _terms(spark)
    hit = sparse_index.postings(spark, _index(spark, d), terms).join(terms, "term").select("query", "doc").distinct()
    return hit.groupBy("query").agg(F.count("*").alias("docs"))


def s24_delete(spark, d):
    """Document frequencies once the heading pieces are taken out."""
    tf = _tf(spark, d)
    gone = children(spark, d).where(F.col("doc").contains("_heading")).select("doc")
    return bm25.document_frequencies(bm25.delete(tf, gone))


def s23_batch_status(spark, d):
    """A best-effort load of the documents: what failed for want of terms."""
    _, status = bm25.index_batch(table(spark, d, "documents"), "doc_id", "text")
    r = bm25.batch_result(status)
    return r.select("total", "successful", "failed", F.round("success_rate", 6).alias("success_rate"), F.array_join("failed_ids", ",").alias("failed_ids"))


def s23_atomic_status(spark, d):
    _, status = bm25.index_batch(table(spark, d, "documents"), "doc_id", "text", atomic=True)
    return status.groupBy("success", "error").agg(F.count("*").alias("documents"))


def a27_health(spark, d):
    return bm25.health(bm25.from_maps(table(spark, d, "bm25_index")), table(spark, d, "children"))


def _vectors(spark, d):
    v = table(spark, d, "embedding_results")
    ok = (F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return v.where(ok)


def _asked(spark, d):
    """The query set: every vector whose id is divisible by 100, against all vectors."""
    return _vectors(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def k2_dense_search(spark, d):
    return retrieval.dense_search(_vectors(spark, d), "vec_id", "embedding", _asked(spark, d), 10)


def _hybrid_lists(spark, d):
    """Dense lists over child vectors and sparse lists over children for the same questions, all keyed by query."""
    vec = _vectors(spark, d)
    # a question's vector is that of its best sparse hit that has one: offline there is no model to ask
    sparse = written(sparse_index.search(spark, _index(spark, d), _terms(spark), 50), "sparse")
    has = vec.groupBy(F.col("child_id").alias("doc")).agg(F.min(F.struct("vec_id", "embedding")).alias("m")).select("doc", "m.embedding")
    first = sparse.join(has, "doc").groupBy("query").agg(F.min(F.struct("rank", "embedding")).alias("m")).select("query", F.col("m.embedding").alias("vector"))
    dense = retrieval.dense_search(has, "doc", "embedding", first, 50)
    dense = written(dense, "dense")
    # texts of the hits alone
    ch = children(spark, d, dense.select("doc").union(sparse.select("doc")).distinct())
    text = lambda x: x.join(ch, "doc").select("query", "doc", "text", "score", "rank")
    return text(dense), text(sparse)


def o14_hybrid(spark, d):
    """Fused, weighted 0.6 dense and 0.4 sparse, the first 10 with their parents."""
    dense, sparse = _hybrid_lists(spark, d)
    f = retrieval.fuse(dense, sparse, 60, {"dense": 0.6, "sparse": 0.4}, 10)
    p = table(spark, d, "parents")
    return retrieval.with_parents(f, table(spark, d, "children"), p).select("query", "doc", "rank", "rrf_score", "dense_rank", "sparse_rank", "parent_id", "source_file", "page_number")


def f30_multi_query(spark, d):
    """Every question as three variants (its words, its first and its last half), fused unweighted."""
    w = T.words(F.col("question"))
    half = F.ceil(F.size(w) / 2).cast("int")
    v = questions(spark).select("query", F.posexplode(F.array("question", F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " "))).alias("variant", "question"))
    terms = bm25.query_terms(v.select(F.struct("query", "variant").alias("qv"), "question"), "qv", "question")
    lists = sparse_index.search(spark, _index(spark, d), terms, 20).select(F.col("query.query").alias("query"), F.col("query.variant").alias("variant"), "doc", "rank")
    return retrieval.fuse_variants(lists, 60, 10)


def j1_with_parents(spark, d):
    c = table(spark, d, "children").select(F.col("child_id").alias("doc")).distinct()
    r = retrieval.with_parents(c, table(spark, d, "children"), table(spark, d, "parents").dropDuplicates(["parent_id"]))
    return r.groupBy("source_file").agg(F.count("*").alias("children"), F.countDistinct("parent_id").alias("parents"))


def j3_document_overview(spark, d):
    return retrieval.document_overview(table(spark, d, "parents"), table(spark, d, "children"))


def pred11_visible(spark, d):
    p = table(spark, d, "parents")
    return retrieval.visible_to(p, "kim", ("quality",)).groupBy("parent_type").agg(F.countDistinct("parent_id").alias("parents"))


_BM25_SQL = f"""
        WITH {TF_SQL},
        n AS (SELECT count(*) AS n, avg(doc_length) AS avgdl FROM (SELECT DISTINCT doc, doc_length FROM tf)),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        q AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest({tokens_sql("question")}) AS term FROM {QUESTIONS_SQL}) GROUP BY ALL),
        s AS (SELECT query, doc, round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_length / avgdl))), 6) AS score
              FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)"""

_VEC_SQL = """v AS (SELECT vec_id, child_id, CAST(embedding AS DOUBLE[]) AS e FROM embedding_results
              WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

ORACLES = {
    "f1_tokens": f"SELECT doc_id, coalesce(len({tokens_sql('text')}), 0) AS terms, coalesce(len(list_distinct({tokens_sql('text')})), 0) AS unique_terms FROM documents",
    "a14_term_frequencies": f"WITH {TF_SQL} SELECT * FROM tf",
    "a15_doc_lengths": f"WITH {TF_SQL} SELECT doc, sum(tf) AS doc_length, count(*) AS terms FROM tf GROUP BY doc",
    "a16_document_frequencies": f"WITH {TF_SQL} SELECT term, count(*) AS df FROM tf GROUP BY term",
    "a16_stored_frequencies": """
        WITH m AS (SELECT child_id, arg_max(term_frequencies, updated_at) AS m FROM bm25_index GROUP BY child_id)
        SELECT term, count(*) AS df FROM (SELECT child_id, unnest(map_keys(m)) AS term FROM m) GROUP BY term""",
    "a17_statistics": f"""WITH {TF_SQL}
        SELECT count(*) AS total_documents, round(avg(doc_length), 6) AS avg_doc_length, (SELECT count(DISTINCT term) FROM tf) AS total_terms FROM (SELECT DISTINCT doc, doc_length FROM tf)""",
    "a18_idf": f"""WITH {TF_SQL}, n AS (SELECT count(DISTINCT doc) AS n FROM tf)
        SELECT term, count(*) AS df, round(greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 0), 6) AS idf FROM tf, n GROUP BY term""",
    "k1_bm25_search": _BM25_SQL + " SELECT query, doc, score, rank FROM r WHERE rank <= 10",
    "s35_build_index": f"WITH {TF_SQL}, n AS (SELECT count(*) AS documents, round(avg(doc_length), 6) AS avg_doc_length FROM (SELECT DISTINCT doc, doc_length FROM tf)) SELECT documents, avg_doc_length, (SELECT count(*) FROM tf) AS postings, (SELECT CAST(sum(tf) AS BIGINT) FROM tf) AS terms FROM n",
    "s24_changed_index": _BM25_SQL.replace(f"FROM {CHILDREN_SQL})", f"FROM (SELECT doc, CASE WHEN doc LIKE '%00%' THEN text || ' ' || text ELSE text END AS text FROM {CHILDREN_SQL} WHERE doc LIKE '%00%' OR NOT contains(doc, '_heading')))", 1) + " SELECT query, doc, score, rank, s.segments FROM r, (VALUES (1), (3)) AS s(segments) WHERE rank <= 10",
    "pred6_any_term": f"""WITH {TF_SQL}, q AS (SELECT query, unnest({tokens_sql("question")}) AS term FROM {QUESTIONS_SQL})
        SELECT query, count(DISTINCT doc) AS docs FROM tf JOIN q USING (term) GROUP BY query""",
    "s24_delete": f"WITH {TF_SQL} SELECT term, count(*) AS df FROM tf WHERE NOT contains(doc, '_heading') GROUP BY term",
    "s23_batch_status": f"""WITH s AS (SELECT doc_id, coalesce(len({tokens_sql("text")}), 0) > 0 AS ok FROM documents)
        SELECT count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, round(avg(CAST(ok AS INT)), 6) AS success_rate,
               string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (NOT ok) AS failed_ids FROM s""",
    "s23_atomic_status": f"""WITH s AS (SELECT doc_id, coalesce(len({tokens_sql("text")}), 0) > 0 AS ok FROM documents), a AS (SELECT bool_and(ok) AS every FROM s)
        SELECT every AS success, CASE WHEN NOT ok THEN 'no terms' WHEN NOT every THEN 'rolled back' END AS error, count(*) AS documents FROM s, a GROUP BY ALL""",
    "a27_health": """
        WITH c AS (SELECT DISTINCT child_id FROM children WHERE child_id IS NOT NULL), m AS (SELECT child_id, arg_max(term_frequencies, updated_at) AS m FROM bm25_index GROUP BY child_id),
        t AS (SELECT child_id, unnest(map_keys(m)) AS term FROM m), i AS (SELECT DISTINCT child_id AS id FROM t)
        SELECT count(*) AS total_children, count(id) AS indexed_children, count(*) - count(id) AS missing, (SELECT count(DISTINCT term) FROM t) AS unique_terms FROM c LEFT JOIN i ON child_id = id""",
    "k2_dense_search": f"""
        WITH {_VEC_SQL},
        s AS (SELECT q.vec_id AS query, v.vec_id AS doc, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "o14_hybrid": _BM25_SQL
    + f""",
        {_VEC_SQL},
        h AS (SELECT child_id AS doc, arg_min(e, vec_id) AS e FROM v GROUP BY child_id),
        sp AS (SELECT query, doc, score, rank FROM r WHERE rank <= 50),
        f AS (SELECT query, arg_min(e, rank) AS e FROM sp JOIN h USING (doc) GROUP BY query),
        ds AS (SELECT f.query, h.doc, round(list_cosine_similarity(f.e, h.e), 6) AS score FROM f, h),
        dn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM ds QUALIFY rank <= 50),
        c AS (SELECT * FROM {CHILDREN_SQL}),
        j AS (SELECT query, doc, round(coalesce(0.6 / (60 + dn.rank), 0) + coalesce(0.4 / (60 + sp.rank), 0), 9) AS rrf_score, dn.rank AS dense_rank, sp.rank AS sparse_rank
              FROM (SELECT dn.* FROM dn JOIN c USING (doc)) dn FULL JOIN sp USING (query, doc) JOIN c USING (doc) WHERE trim(c.text) <> ''),
        k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf_score DESC, doc) AS rank FROM j QUALIFY rank <= 10),
        e AS (SELECT child_id AS doc, any_value(parent_id) AS parent_id FROM children GROUP BY child_id),
        p AS (SELECT parent_id, any_value(source_file) AS source_file, any_value(page_number) AS page_number FROM parents GROUP BY parent_id)
        SELECT query, doc, rank, rrf_score, dense_rank, sparse_rank, parent_id, source_file, page_number FROM k LEFT JOIN e USING (doc) LEFT JOIN p USING (parent_id)""",
    "f30_multi_query": f"""
        WITH {TF_SQL},
        n AS (SELECT count(*) AS n, avg(doc_length) AS avgdl FROM (SELECT DISTINCT doc, doc_length FROM tf)),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        w AS (SELECT query, question, string_split(question, ' ') AS w FROM {QUESTIONS_SQL}),
        b AS (SELECT query, 0 AS variant, question FROM w UNION ALL SELECT query, 1, array_to_string(w[:CAST(ceil(len(w) / 2) AS INT)], ' ') FROM w
              UNION ALL SELECT query, 2, array_to_string(w[CAST(ceil(len(w) / 2) AS INT) + 1:], ' ') FROM w),
        q AS (SELECT query, variant, term, count(*) AS times FROM (SELECT query, variant, unnest({tokens_sql("question")}) AS term FROM b) GROUP BY ALL),
        s AS (SELECT query, variant, doc, round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_length / avgdl))), 6) AS score
              FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query, variant ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 20),
        f AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS rrf_score FROM r GROUP BY ALL)
        SELECT query, doc, rrf_score, row_number() OVER (PARTITION BY query ORDER BY rrf_score DESC, doc) AS rank FROM f QUALIFY rank <= 10""",
    "j1_with_parents": """
        WITH c AS (SELECT child_id, any_value(parent_id) AS parent_id FROM children GROUP BY child_id), p AS (SELECT DISTINCT parent_id, source_file FROM parents)
        SELECT source_file, count(*) AS children, count(DISTINCT p.parent_id) AS parents FROM c LEFT JOIN p USING (parent_id) GROUP BY source_file""",
    "j3_document_overview": """
        WITH c AS (SELECT parent_id, count(DISTINCT child_id) AS n FROM children GROUP BY parent_id),
        p AS (SELECT parent_id, any_value(source_file) AS source_file, any_value(file_name) AS file_name, any_value(created_at) AS created_at FROM parents GROUP BY parent_id)
        SELECT source_file, file_name, count(*) AS parents, CAST(coalesce(sum(n), 0) AS BIGINT) AS children, min(created_at) AS first_created FROM p LEFT JOIN c USING (parent_id) GROUP BY ALL""",
    "pred11_visible": """
        SELECT parent_type, count(DISTINCT parent_id) AS parents FROM parents
        WHERE list_contains(coalesce(acl_users, []), 'kim') OR list_contains(coalesce(acl_groups, []), 'quality') OR (len(coalesce(acl_users, [])) = 0 AND len(coalesce(acl_groups, [])) = 0) GROUP BY parent_type""",
}

_RANK = {"rank": "INTEGER"}
ORACLES = typed(ORACLES, f1_tokens={"terms": "INTEGER", "unique_terms": "INTEGER"}, a15_doc_lengths={"doc_length": "BIGINT", "terms": "INTEGER"}, k1_bm25_search=_RANK, s24_changed_index=_RANK | {"segments": "INTEGER"}, k2_dense_search=_RANK, f30_multi_query=_RANK, o14_hybrid=_RANK | {"dense_rank": "INTEGER", "sparse_rank": "INTEGER"})

QUERIES = {
    f.__name__: f
    for f in (s35_build_index, s24_changed_index, f1_tokens, a14_term_frequencies, a15_doc_lengths, a16_document_frequencies, a16_stored_frequencies, a17_statistics, a18_idf, k1_bm25_search, pred6_any_term, s24_delete, s23_batch_status, s23_atomic_status, a27_health, k2_dense_search, o14_hybrid, f30_multi_query, j1_with_parents, j3_document_overview, pred11_visible)
}
