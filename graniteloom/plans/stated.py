"""Queries over small stated inputs, and the remaining relational forms over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graniteloom.functions import text as T
from graniteloom.operators import bm25, linking, retrieval, routing, semantic, voting
from graniteloom.plans.base import QUESTIONS_SQL, questions, typed
from graniteloom.plans.profiles import profiles
from graniteloom.providers import HashedShingles
from graniteloom.runtime import table

DENSE = ((1, "d1", "x", 0.9, 1), (1, "d2", "", 0.8, 2), (1, "d3", "z", 0.7, 3), (2, "d1", "", 0.5, 1), (3, "d9", "only", 0.4, 1))
SPARSE = ((1, "d3", "other", 7.0, 1), (1, "d2", "text", 5.0, 2), (1, "d4", "", 1.0, 3), (2, "d1", "", 2.0, 1), (4, "d7", "sparse", 3.0, 1))
LANES = ("LANE: fast\nCONFIDENCE: 0.9\nREASONING: simple", "lane: SLOW\nconfidence: 0.85", "```\nLANE: fast\nCONFIDENCE: .95\n```", "**LANE**: slow CONFIDENCE: 0.7", "LANE： fast\nCONFIDENCE： 0.88", "x LANE : slow\n\nCONFIDENCE : 0.92", "LANE: fast", "LANE: medium\nCONFIDENCE: 0.8", "LANE: slow\nCONFIDENCE: 7\nREASONING: one\ntwo")
VARIANTS = ((1, 0, "travel cost"), (1, 1, "Travel Cost"), (1, 2, "cost of a trip"), (2, 0, "alarm"), (2, 1, " "), (2, 2, "ALARM"))
CHUNKS = ((1, 0, "c1", "p", "t"), (1, 1, "c1", "q", "t"), (1, 2, None, "p", None), (1, 3, None, "p", "x"), (1, 4, None, None, "t"), (2, 0, "c1", "p", "t"))
_S = "query int, doc string, text string, score double, rank int"


def _q(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _values(rows, name: str, cols: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) AS {name}({cols}))"


def f29_fusion(spark, d):
    """Rank fusion of stated lists at 0.7 to 0.3."""
    return retrieval.fuse(spark.createDataFrame(list(DENSE), _S), spark.createDataFrame(list(SPARSE), _S), 60, {"dense": 70, "sparse": 30})


def x10_result_rows(spark, d):
    return retrieval.result_row(f29_fusion(spark, d))


def f31_rerank_fallback(spark, d):
    """The fused lists reranked without a model."""
    r = retrieval.rerank(f29_fusion(spark, d), None, 2)
    return r.select("query", "doc", "rank", "rerank_score", "final_rank")


def pred5_with_text(spark, d):
    """Candidates with text, ranked after the blank ones are gone."""
    c = spark.createDataFrame(list(DENSE), _S).where(F.trim("text") != "").drop("rank")
    return retrieval.ranked(c)


def pred8_overfetch(spark, d):
    """The first two of each list after a filter that sees only the first 50."""
    m = spark.createDataFrame(list(SPARSE), _S)
    return retrieval.overfetch_filter(m, F.col("doc") != "d3", 2, 100)


def f38_lanes(spark, d):
    t = spark.createDataFrame(list(enumerate(LANES)), "i int, t string")
    return t.select("i", routing.lane(F.col("t")).alias("r")).select("i", "r.lane", "r.confidence", "r.reasoning")


def t5_variants(spark, d):
    return retrieval.unique_variants(spark.createDataFrame(list(VARIANTS), "query int, seq int, text string"))


def t6_chunks(spark, d):
    return retrieval.unique_chunks(spark.createDataFrame(list(CHUNKS), "query int, seq int, child_id string, parent_text string, child_text string"))


def x6_expanded(spark, d):
    """Each question with its word-reversed variant, original first."""
    w = F.array_join(F.reverse(T.words(F.col("question"))), " ")
    return questions(spark).select("query", F.posexplode(F.array("question", w)).alias("seq", "text"))


def j2_parent_context(spark, d):
    """The parent of the first child."""
    first = table(spark, d, "children").agg(F.min("child_id")).first()[0] or ""
    r = retrieval.parent_context(table(spark, d, "children"), table(spark, d, "parents"), first)
    return r.select("parent_id", F.md5("parent_text").alias("digest"), "parent_type", "source_file", "page_number")


def s35_index_statistics(spark, d):
    s = bm25.statistics(bm25.from_maps(table(spark, d, "bm25_index")))
    return s.select("total_documents", F.round("avg_doc_length", 6).alias("avg_doc_length"), "total_terms")


def s13_elements(spark, d):
    """Parents as parsed elements: tables, and what reads as text."""
    p = table(spark, d, "parents").dropDuplicates(["parent_id"])
    return p.groupBy("source_file").agg(F.count(F.when(F.col("parent_type") == "table", 1)).alias("tables"), F.count(F.when(F.col("parent_type").isin("text", "heading", "list"), 1)).alias("texts"))


def pred7_lookup(spark, d):
    """Children named by the vectors."""
    ids = table(spark, d, "embedding_results").select("child_id").distinct()
    return table(spark, d, "children").join(ids, "child_id", "left_semi").select("child_id", "parent_id").distinct()


def t4_same_results(spark, d):
    """Whether pairs of results are equal as sets, and as bags."""
    o = table(spark, d, "orders")
    a = o.select("o_orderstatus", F.round("o_totalprice", 2).alias("p"))
    pairs = {"reordered": (a, a.orderBy("p")), "repeated": (a, a.unionByName(a)), "other": (a, a.where("p > 100000"))}
    rows = [(n, voting.fingerprint(x, True) == voting.fingerprint(y, True), voting.fingerprint(x) == voting.fingerprint(y)) for n, (x, y) in pairs.items()]
    return spark.createDataFrame(rows, "pair string, sets boolean, bags boolean")


def k11_limit_first(spark, d):
    """Five rows first, then sorted (rows only: which five is open)."""
    return table(spark, d, "orders").limit(5).orderBy("o_orderkey")


def s36_semantic_search(spark, d):
    """Fields for the stated questions by hashed-shingle vectors (rows only: a stand-in for a model)."""
    m = profiles(spark, d).select("table_name", "column_name", F.concat_ws(" ", F.translate("column_name", "_", " "), F.array_join(F.slice("sample_values", 1, 5), " ")).alias("description"))
    return semantic.search(semantic.build_index(m, HashedShingles()), questions(spark), HashedShingles(), 5)


def f40_descriptions(spark, d):
    """The three kinds of description of each column."""
    p = profiles(spark, d).select("table_name", "column_name", F.when(F.col("ordinal") != 1, F.lit("s")).alias("short_description"), F.lit("l").alias("long_description"), F.when(F.col("ordinal") == 0, F.lit("e")).alias("sme_description"))
    return p.select("table_name", "column_name", *[linking.described(p, k).alias(k) for k in ("minimal", "maximal", "full")])


def x1_all_columns(spark, d):
    """Tables within the limit show all columns in their own order."""
    from graniteloom.operators import profiling

    p = profiling.key_candidates(profiles(spark, d))
    s = p.select("table_name", F.array().cast("array<string>").alias("matched")).distinct()
    return linking.shown_columns(p, s, 50).select("table_name", "column_name", "place")


_D, _P = _values(DENSE, "d", "query, doc, text, score, rank"), _values(SPARSE, "s", "query, doc, text, score, rank")
_F = f"""j AS (SELECT query, doc, CASE WHEN trim(coalesce(d.text, '')) <> '' THEN d.text ELSE s.text END AS text, CAST(d.score AS DOUBLE) AS dense_score, CAST(s.score AS DOUBLE) AS sparse_score, d.rank AS dense_rank, s.rank AS sparse_rank,
              round(coalesce(0.7 / (60 + d.rank), 0) + coalesce(0.3 / (60 + s.rank), 0), 9) AS rrf_score FROM {_D} d FULL JOIN {_P} s USING (query, doc)),
        f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf_score DESC, doc) AS rank FROM j WHERE trim(coalesce(text, '')) <> '')"""



def _same(others: dict[str, str]) -> str:
    """Whether each result equals that of ``a``: no row of one is left when the other's are taken away."""
    left = lambda x, y, op: f"NOT EXISTS ((SELECT * FROM ({x})) {op} (SELECT * FROM ({y})))"
    both = lambda y, op: f"{left('SELECT * FROM a', y, op)} AND {left(y, 'SELECT * FROM a', op)}"
    rows = " UNION ALL ".join(f"SELECT '{n}' AS pair, {both(y, 'EXCEPT')} AS sets, {both(y, 'EXCEPT ALL')} AS bags" for n, y in others.items())
    return f"WITH a AS (SELECT o_orderstatus, round(o_totalprice, 2) AS p FROM orders) {rows}"


ORACLES = {
    "f29_fusion": f"WITH {_F} SELECT * FROM f",
    "x10_result_rows": f"WITH {_F} SELECT query, doc, text, dense_score, sparse_score, rrf_score, rank FROM f",
    "f31_rerank_fallback": f"WITH {_F} SELECT query, doc, rank, CASE WHEN rank <= 2 THEN round(1 - 0.1 * (rank - 1), 6) END AS rerank_score, rank AS final_rank FROM f",
    "pred5_with_text": f"SELECT query, doc, text, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM {_D} WHERE trim(text) <> ''",
    "pred8_overfetch": f"SELECT query, doc, text, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query ORDER BY rank) AS rank FROM {_P} WHERE doc <> 'd3' QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 2",
    "f38_lanes": rf"""WITH c AS (SELECT i, regexp_replace(t, '(?i)```[a-z]*\s*|\s*```', '', 'g') AS c FROM {_values(list(enumerate(LANES)), 't', 'i, t')}),
        x AS (SELECT i, lower(regexp_extract(c, '{routing.LANE}', 1)) AS lane, regexp_extract(c, '{routing.CONFIDENCE}', 1) AS n, trim(regexp_replace(trim(regexp_extract(c, '{routing.REASONING}', 1), ' '), '[\n\r]+', ' ', 'g'), ' ') AS why FROM c),
        y AS (SELECT *, trim(regexp_replace(why, '{routing.CLOSING}', ''), ' ') AS reason FROM x)
        SELECT i, CASE WHEN lane <> '' THEN lane ELSE 'fast' END AS lane, CASE WHEN n <> '' THEN least(1, greatest(0, CAST(n AS DOUBLE))) ELSE 0.5 END AS confidence, CASE WHEN reason <> '' THEN reason ELSE 'Unable to parse LLM response' END AS reasoning FROM y""",
    "t5_variants": f"SELECT * FROM {_values(VARIANTS, 'v', 'query, seq, text')} WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY query, lower(text) ORDER BY seq) = 1",
    "t6_chunks": f"SELECT * FROM {_values(CHUNKS, 'c', 'query, seq, child_id, parent_text, child_text')} QUALIFY row_number() OVER (PARTITION BY query, coalesce(child_id, md5(coalesce(parent_text, child_text, ''))) ORDER BY seq) = 1",
    "x6_expanded": f"SELECT query, 0 AS seq, question AS text FROM {QUESTIONS_SQL} UNION ALL SELECT query, 1, array_to_string(list_reverse(string_split(question, ' ')), ' ') FROM {QUESTIONS_SQL}",
    "j2_parent_context": "SELECT DISTINCT parent_id, md5(parent_text) AS digest, parent_type, source_file, page_number FROM parents WHERE parent_id IN (SELECT parent_id FROM children WHERE child_id = (SELECT min(child_id) FROM children))",
    "s35_index_statistics": """WITH m AS (SELECT child_id, arg_max(term_frequencies, updated_at) AS m FROM bm25_index GROUP BY child_id),
        t AS (SELECT child_id, unnest(map_keys(m)) AS term, unnest(map_values(m)) AS tf FROM m), s AS (SELECT child_id, sum(tf) AS n FROM t GROUP BY child_id)
        SELECT count(*) AS total_documents, round(avg(n), 6) AS avg_doc_length, (SELECT count(DISTINCT term) FROM t) AS total_terms FROM s""",
    "s13_elements": "SELECT source_file, count(*) FILTER (parent_type = 'table') AS tables, count(*) FILTER (parent_type IN ('text', 'heading', 'list')) AS texts FROM (SELECT DISTINCT ON (parent_id) * FROM parents) GROUP BY source_file",
    "pred7_lookup": "SELECT DISTINCT child_id, parent_id FROM children WHERE child_id IN (SELECT child_id FROM embedding_results)",
    "t4_same_results": _same({"reordered": "SELECT * FROM a ORDER BY p", "repeated": "SELECT * FROM a UNION ALL SELECT * FROM a", "other": "SELECT * FROM a WHERE p > 100000"}),
    "f40_descriptions": "",
    "x1_all_columns": "",
}


def _profile_oracles() -> dict[str, str]:
    from graniteloom.plans.profiles import _BASE

    return {
        "f40_descriptions": _BASE + " SELECT table_name, column_name, CASE WHEN ordinal <> 1 THEN 's' ELSE '' END AS minimal, 'l' AS maximal, CASE WHEN ordinal = 0 THEN 'e' || chr(10) || chr(10) || 'l' ELSE 'l' END AS full FROM b",
        "x1_all_columns": _BASE + " SELECT table_name, column_name, CAST(ordinal + 1 AS INT) AS place FROM b",
    }


ORACLES |= _profile_oracles()

_RANK = {"rank": "INTEGER"}
ORACLES = typed(ORACLES, f29_fusion=_RANK, x10_result_rows=_RANK, f31_rerank_fallback=_RANK | {"rerank_score": "DOUBLE", "final_rank": "INTEGER"}, pred5_with_text=_RANK, pred8_overfetch=_RANK, f38_lanes={"confidence": "DOUBLE"})

QUERIES = {
    f.__name__: f
    for f in (f29_fusion, x10_result_rows, f31_rerank_fallback, pred5_with_text, pred8_overfetch, f38_lanes, t5_variants, t6_chunks, x6_expanded, j2_parent_context, s35_index_statistics, s13_elements, pred7_lookup, t4_same_results, k11_limit_first, s36_semantic_search, f40_descriptions, x1_all_columns)
}
