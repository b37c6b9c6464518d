"""Hybrid retrieval: dense top-k, rank fusion, reranking, context. Every operator serves many queries at once, keyed by ``query``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graniteloom.runtime import latest, written


def ranked(df: DataFrame, score: str = "score", key: str = "doc", by: tuple[str, ...] = ("query",)) -> DataFrame:
    """``rank`` from 1 in each list, by score downwards, ties to the smaller key."""
    return df.withColumn("rank", F.row_number().over(W.Window.partitionBy(*by).orderBy(F.desc(score), key)))


QUERY_BLOCK = 4096  # queries multiplied with a batch at a time
QUERIES_A_SCAN = 65_536  # queries sent to all executors for one scan of the vectors: 32 MB of 64 numbers each; more take more scans


def _rows_of(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the vectors of ``dim`` finite numbers that are not all 0."""
    at = np.nonzero(pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False))[0]
    m = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
    n = np.sqrt((m * m).sum(axis=1))
    ok = np.isfinite(n) & (n > 0)
    return at[ok], m[ok] / n[ok, None]


def _dense(batches: Iterator[pa.RecordBatch], asked: Broadcast, dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """(doc, v) to (query, doc, score): of each batch the k best for each query, ties to the smaller doc."""
    names, q = asked.value
    for batch in batches:
        part = batch.take(pc.sort_indices(batch.column(0)))
        at, m = _rows_of(part.column(1), dim)
        if not len(at):
            continue
        c = min(k, len(at))
        for a in range(0, len(q), QUERY_BLOCK):
            cos = np.round(q[a : a + QUERY_BLOCK] @ m.T, 6)
            edge = -np.partition(-cos, c - 1, axis=1)[:, c - 1]
            rows, cols = [], []
            for i in range(len(cos)):
                x = np.nonzero(cos[i] >= edge[i])[0]
                x = x[np.argsort(-cos[i, x], kind="stable")[:c]]
                rows.append(np.full(len(x), i))
                cols.append(x)
            r, x = np.concatenate(rows), np.concatenate(cols)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a + r)), part.column(0).take(pa.array(at[x])), pa.array(cos[r, x])], ["query", "doc", "score"])


def dense_search(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10, dim: int = 64) -> DataFrame:
    """(query, doc, score, rank): exact cosine top k of a stated query set (query, vector), in blocks against all vectors.

    The queries go to all executors, ``QUERIES_A_SCAN`` of them (by a hash) for one scan of the vectors; at most k rows of a query leave a batch.
    Vectors that are not ``dim`` long, and null, zero or infinite ones, give no row, as queries too. Keys are unique.
    """
    spark = vectors.sparkSession
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, doc {vectors.schema[key].dataType.simpleString()}, score double"
    use = queries.where(F.col("query").isNotNull() & (F.size("vector") == dim)).select("query", "vector")
    v = vectors.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{vector}`").alias("v")).where(F.col("doc").isNotNull())
    asked = use.limit(QUERIES_A_SCAN + 1).toArrow()
    scans = 1 if asked.num_rows <= QUERIES_A_SCAN else -(-use.count() // QUERIES_A_SCAN)
    found = []
    for i in range(scans):
        asked = asked if scans == 1 else use.where(F.pmod(F.xxhash64("query"), F.lit(scans)) == i).toArrow()
        at, q = _rows_of(asked.column("vector").combine_chunks(), dim)
        sent = spark.sparkContext.broadcast((asked.column("query").combine_chunks().take(pa.array(at)), q))
        one = v.mapInArrow(partial(_dense, asked=sent, dim=dim, k=k), kinds)
        if scans > 1:
            # one block of queries is held at a time
            one = written(ranked(one).where(F.col("rank") <= k), "found")
            sent.destroy()
        found.append(one)
    return reduce(DataFrame.unionByName, found) if scans > 1 else ranked(found[0]).where(F.col("rank") <= k)


def check_weights(dense: float, sparse: float) -> tuple[float, float]:
    """The two weights scaled to sum 1; negative ones and a pair of zeros are errors."""
    if dense < 0 or sparse < 0:
        raise ValueError("weights must be non-negative")
    if dense + sparse == 0:
        raise ValueError("At least one weight must be positive")
    return dense / (dense + sparse), sparse / (dense + sparse)


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 60, weights: dict[str, float] | None = None, top_k: int | None = None) -> DataFrame:
    """(query, doc, text, dense_score, sparse_score, dense_rank, sparse_rank, rrf_score, rank) by reciprocal rank fusion.

    Inputs are (query, doc, text, score, rank). A missing weight is 0.5. The dense text is used unless blank, then the sparse one; documents blank
    on both sides are left out after ranks are given. Scores sum w / (k + rank), ties to the smaller document.
    """
    wd, ws = check_weights(*((weights or {}).get(x, 0.5) for x in ("dense", "sparse")))
    d = dense.select("query", "doc", F.col("text").alias("dt"), F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse.select("query", "doc", F.col("text").alias("st"), F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    j = d.join(s, ["query", "doc"], "full_outer")
    text = F.when(~blank(F.col("dt")), F.col("dt")).otherwise(F.col("st"))
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    out = j.withColumn("text", text).where(~blank(F.col("text")))
    out = out.select("query", "doc", "text", "dense_score", "sparse_score", "dense_rank", "sparse_rank", F.round(part(wd, "dense_rank") + part(ws, "sparse_rank"), 9).alias("rrf_score"))
    out = ranked(out, "rrf_score")
    return out.where(F.col("rank") <= top_k) if top_k else out


def fuse_variants(lists: DataFrame, k: int = 60, top_k: int | None = None) -> DataFrame:
    """(query, doc, rrf_score, rank) of the result lists (query, variant, doc, rank) of a query's variants: unweighted sums.

    A null doc falls back to the sha1 of the first 5,000 bytes of ``text`` where that column is there.
    """
    doc = F.coalesce("doc", F.sha1(F.substring(F.encode("text", "UTF-8"), 1, 5000))) if "text" in lists.columns else F.col("doc")
    g = lists.withColumn("doc", doc).groupBy("query", "doc").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("rrf_score"))
    g = ranked(g, "rrf_score")
    return g.where(F.col("rank") <= top_k) if top_k else g


def keep_for_rerank(top_k: int, queries: int, reranker: bool) -> tuple[int, int]:
    """(results asked of each variant, fused results kept)."""
    return top_k * queries, top_k * (4 if reranker else 2)


def rerank(candidates: DataFrame, scored: DataFrame | None, top_n: int) -> DataFrame:
    """``candidates`` (query, doc, rank, text, ...) in their new order, with rerank_score and final_rank.

    The first ``top_n`` with text take the order of ``scored`` (query, doc, rerank_score); blank ones among them follow, then the tail as it
    was. Without scores the fallback is 1 - 0.1 * position.
    """
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    head = F.col("rank") <= top_n
    c = candidates.withColumn("part", F.when(head & ~blank, 0).when(head, 1).otherwise(2))
    pos = F.row_number().over(W.Window.partitionBy("query", "part").orderBy("rank")) - 1
    if scored is None:
        c = c.withColumn("rerank_score", F.when(F.col("part") == 0, F.round(1 - 0.1 * pos, 6)))
    else:
        c = c.join(scored.select("query", "doc", "rerank_score"), ["query", "doc"], "left").withColumn("rerank_score", F.when(F.col("part") == 0, F.col("rerank_score")))
    w = W.Window.partitionBy("query").orderBy("part", F.desc_nulls_last("rerank_score"), "rank")
    return c.withColumn("final_rank", F.row_number().over(w)).drop("part")


def with_parents(candidates: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """Candidates with parent_id, parent_text, source_file and page_number; one without child or parent keeps its own fields.

    Only the candidates' own children and parents are moved; of repeated rows that with the greatest updated_at (children: the greatest parent_id) counts.
    """
    c = children.select(F.col("child_id").alias("doc"), "parent_id").join(candidates.select("doc").distinct(), "doc", "left_semi")
    c = c.groupBy("doc").agg(F.max("parent_id").alias("parent_id"))
    newest = ["updated_at"] if "updated_at" in parents.columns else []
    p = parents.select("parent_id", "parent_text", "source_file", "page_number", *newest).join(c.select("parent_id").distinct(), "parent_id", "left_semi")
    p = latest(p, "parent_id", newest[0] if newest else None).drop(*newest)
    return candidates.join(c, "doc", "left").join(p, "parent_id", "left")


def parent_context(children: DataFrame, parents: DataFrame, child_id: str) -> DataFrame:
    """The parent of one child: (parent_id, parent_text, parent_type, source_file, page_number)."""
    one = children.where(F.col("child_id") == child_id).select("parent_id").distinct()
    return parents.join(one, "parent_id", "left_semi").select("parent_id", "parent_text", "parent_type", "source_file", "page_number").distinct()


def document_overview(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(source_file, file_name, parents, children, first_created) for each source file."""
    c = children.select("child_id", "parent_id").distinct().groupBy("parent_id").agg(F.count("*").alias("n"))
    p = latest(parents.select("parent_id", "source_file", "file_name", "created_at"), "parent_id", "created_at")
    return p.join(c, "parent_id", "left").groupBy("source_file", "file_name").agg(F.count("*").alias("parents"), F.coalesce(F.sum("n"), F.lit(0)).alias("children"), F.min("created_at").alias("first_created"))


def visible_to(parents: DataFrame, user: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose access lists are empty or name the user or a group of theirs."""
    u, g = F.coalesce("acl_users", F.array().cast("array<string>")), F.coalesce("acl_groups", F.array().cast("array<string>"))
    hit = F.array_contains(u, user)
    for x in groups:
        hit = hit | F.array_contains(g, x)
    return parents.where(hit | ((F.size(u) == 0) & (F.size(g) == 0)))


def unique_variants(variants: DataFrame) -> DataFrame:
    """(query, seq, text): variants without case-insensitive repeats, in their first order; seq 0 is the original question."""
    w = W.Window.partitionBy("query", F.lower("text")).orderBy("seq")
    return variants.where(F.trim("text") != "").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """Context chunks (query, seq, child_id, parent_text, child_text) once each, the first kept: by child_id, else by the text's md5."""
    key = F.coalesce("child_id", F.md5(F.coalesce("parent_text", "child_text", F.lit(""))))
    w = W.Window.partitionBy("query", "k").orderBy("seq")
    return chunks.withColumn("k", key).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "k")


def overfetch_filter(matches: DataFrame, keep: Column, k: int, pool: int) -> DataFrame:
    """Top k of each query after a filter that sees only its first min(max(3 k, 50), pool) matches."""
    n = min(max(3 * k, 50), pool)
    m = matches.where((F.col("rank") <= n) & keep)
    return m.withColumn("rank", F.row_number().over(W.Window.partitionBy("query").orderBy("rank"))).where(F.col("rank") <= k)


def result_row(candidates: DataFrame, reranked: bool = False) -> DataFrame:
    """The flat result: scores and ranks of a candidate, rerank fields only where there was a reranking."""
    cols = ["query", "doc", "text", "dense_score", "sparse_score", "rrf_score", "rank"]
    return candidates.select(*cols, *(["rerank_score", "final_rank"] if reranked else []))
