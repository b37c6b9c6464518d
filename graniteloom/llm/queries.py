"""The queries of the training-data problems (all but the core's p2) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graniteloom.llm import boilerplate, mixture, near_duplicates, neighbours, pieces, scans, spans, terms, tokens
from graniteloom.llm.near_duplicates import Similarity
from graniteloom.runtime import table

#: Problem 3: runs of three words, similarity 0.6, texts of 30 words or more.
CHILDREN = Similarity(run=3, threshold=0.6, min_words=30, bands=48, rows=4)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(parent_id, line_no) of the lines that recur within their file_name."""
    occ, _ = boilerplate.blocks(boilerplate.parents_in(table(spark, d, "parents")), "parent_id", "parent_text", "file_name")
    return occ.select(F.col("doc").alias("parent_id"), "line_no")


def p1_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Each record's own lines, with the number of lines taken out."""
    return boilerplate.strip(boilerplate.parents_in(table(spark, d, "parents")), "parent_id", "parent_text", "file_name")


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The boilerplate blocks: how many distinct lines, and in how many records their most frequent line stands."""
    _, members = boilerplate.blocks(boilerplate.parents_in(table(spark, d, "parents")), "parent_id", "parent_text", "file_name")
    return members.groupBy(F.lower(F.hex("block")).alias("block")).agg(F.count("*").alias("lines"), F.max("docs").alias("docs"))


def _origins(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "parents").select("parent_id", "source_file").distinct()
    return table(spark, d, "children").select(F.col("child_id").alias("id"), "parent_id").distinct().join(files, "parent_id").select("id", F.col("source_file").alias("origin"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(child_a, child_b): nearly equal texts from different source files."""
    members, pairs = near_duplicates.similar_classes(table(spark, d, "children"), "child_id", "child_text", CHILDREN)
    return near_duplicates.pairs_between(members, pairs, _origins(spark, d))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per child: its class, its group and its number of links."""
    return near_duplicates.near_duplicates(table(spark, d, "children"), "child_id", "child_text", CHILDREN)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_counts(table(spark, d, "bm25_index"), "child_id", "term_frequencies", F.col("updated_at"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(term, mark) of the terms too rare or too common."""
    return _terms(spark, d).where("mark is not null").select("term", "mark")


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """(term, frequency, df, mark) of every term."""
    return _terms(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(vec_a, vec_b): either is among the other's 5 nearest."""
    n = neighbours.nearest(table(spark, d, "embedding_results"), "vec_id", "embedding")
    return n.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """(id, neighbour, cosine, rank): the 5 nearest of every usable embedding."""
    return neighbours.nearest(table(spark, d, "embedding_results"), "vec_id", "embedding")


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parents").withColumn("is_table", F.col("parent_type") == "table")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(parent_id, boundary) of the oversized parents."""
    return pieces.oversized(_parents(spark, d), "parent_id", "parent_text", "is_table", "updated_at").withColumnRenamed("id", "parent_id")


def p6_children(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the oversized parents."""
    return pieces.split(_parents(spark, d), "parent_id", "parent_text", "is_table", "updated_at").withColumnsRenamed({"id": "parent_id", "piece": "chunk_index", "piece_text": "child_text"})


def _scanned(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "parents"), "parent_id", "parent_text", "file_name", "page_number", F.col("file_name").startswith("scan_"), "element_id", "updated_at"


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """(parent_id, line_no, kind) of the noise in scanned pages."""
    return scans.findings(*_scanned(spark, d)).withColumnRenamed("id", "parent_id")


def p7_pages(spark: SparkSession, d: str) -> DataFrame:
    """(parent_id, file_name, page_number, text): the scanned pages as continuous paragraphs."""
    return scans.repair(*_scanned(spark, d)).withColumnsRenamed({"id": "parent_id", "file": "file_name", "page": "page_number"})


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): the ids decoded again."""
    return tokens.decode(tokens.encode(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "ids")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count(table(spark, d, "documents"), "doc_id", "text", ("source",))
    return mixture.copies(sizes, "doc_id", "source", "n_tokens", table(spark, d, "source_weights"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the records in the mixture."""
    return _mixed(spark, d).where("copies > 0").withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source reached."""
    return mixture.shares(_mixed(spark, d), table(spark, d, "source_weights"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_a, doc_b): records that share a passage of at least 300 characters."""
    return spans.shared_pairs(table(spark, d, "documents"), "doc_id", "text")


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """(doc, start, stop): the passages of each record that stand elsewhere too."""
    return spans.shared_spans(table(spark, d, "documents"), "doc_id", "text")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """(doc, chars, shared_chars, share) of each record."""
    return spans.shares(table(spark, d, "documents"), "doc_id", "text")


def p10_sharers(spark: SparkSession, d: str) -> DataFrame:
    """For each different set of records that share a passage, how many records it has and their smallest and greatest id: linear where pairs are a square."""
    s = spans.sharers(table(spark, d, "documents"), "doc_id", "text")
    sets = s.groupBy("h1", "h2").agg(F.count("*").alias("records"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.sum("doc").alias("sum_doc"))
    return sets.drop("h1", "h2")


def p9_bounds(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each source in the mixture: within a record (the largest of its source) of its share of the total, no record used too often."""
    m = _mixed(spark, d)
    big = m.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    s = mixture.shares(m, table(spark, d, "source_weights")).join(big, "source", "left")
    off = F.abs(F.col("tokens") - F.col("target_share") * F.sum("tokens").over(W.Window.partitionBy()))
    # the total itself is off by at most one record of each source
    return s.select("source", (off <= F.sum(F.coalesce("largest", F.lit(0))).over(W.Window.partitionBy())).alias("at_target"), (F.col("most") <= F.col("max_repeats")).alias("within_repeats"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_stripped, p1_blocks, p3_found, p3_groups, p4_found, p4_frequencies, p5_found, p5_neighbours, p6_found, p6_children, p7_found, p7_pages, p8_ids, p8_decoded, p9_mixture, p9_shares, p9_bounds, p10_found, p10_sharers, p10_spans, p10_shares)
}
