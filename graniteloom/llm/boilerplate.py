"""Lines repeated across the documents of one site.

A weighted graph per site: a node is a line reduced to its letters, its weight the number of distinct documents it stands in;
an edge joins two lines that follow each other, with the number of documents in which they do. Nodes and edges of high support stay; their connected
components are the boilerplate blocks, and every occurrence of a block's line is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteloom.llm.graph import connected_components
from graniteloom.runtime import latest, written


def letters(c: Column) -> Column:
    """The letters (Unicode category L) of a text, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}]+", ""))


def lines(docs: DataFrame, doc: str, text: str, site: str) -> DataFrame:
    """(doc, line_no, node, follower): the lines that have a letter; node = site and letters hashed to 128 bits.

    ``follower`` is the node of the next such line of the same document.
    """
    key = lambda s: F.unhex(F.md5(F.concat_ws("\x00", F.col("_site"), s)))
    rows = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{site}`").cast("string").alias("_site"), F.split(F.col(f"`{text}`"), "\n", -1).alias("_lines"))
    e = F.filter(F.transform("_lines", lambda s, i: F.struct((i + 1).cast("bigint").alias("line_no"), letters(s).alias("key"))), lambda x: x["key"] != "")
    rows = rows.select("doc", "_site", e.alias("e"))
    out = rows.select("doc", "_site", F.posexplode(F.arrays_zip(F.col("e"), F.slice("e", F.lit(2), F.greatest(F.size("e"), F.lit(1))).alias("nx"))).alias("i", "z"))
    return out.select("doc", F.col("z.e.line_no").alias("line_no"), key(F.col("z.e.key")).alias("node"), F.when(F.col("z.nx").isNotNull(), key(F.col("z.nx.key"))).alias("follower"))


def blocks(docs: DataFrame, doc: str, text: str, site: str, min_docs: int = 8, min_follow: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences, members): occurrences (doc, line_no, block) to delete and the blocks' nodes (node, docs, block).

    Documents with a null id, text or site take no part. A document id that stands in several rows counts once (equal rows;
    give ``latest`` rows otherwise). Line breaks are ``\\n``; a ``\\r`` is no letter and so plays no role. Blank lines and lines without letters are kept.
    """
    use = docs.where(F.col(f"`{doc}`").isNotNull() & F.col(f"`{text}`").isNotNull() & F.col(f"`{site}`").isNotNull())
    ln = written(lines(use, doc, text, site), "lines")
    # distinct on (node, doc) first: a line in all documents of a huge site is spread by document
    nodes = ln.select("node", "doc").distinct().groupBy("node").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    nodes = written(nodes, "nodes")
    edges = ln.where(F.col("follower").isNotNull()).join(nodes.select("node"), "node", "left_semi")
    edges = edges.join(nodes.select(F.col("node").alias("follower")), "follower", "left_semi")
    edges = edges.select("node", "follower", "doc").distinct().groupBy("node", "follower").agg(F.count("*").alias("docs")).where(F.col("docs") >= (min_follow or min_docs))
    graph = edges.select("node", "follower").union(nodes.select("node", F.col("node").alias("follower")))
    block = connected_components(graph, "node", "follower")
    members = nodes.join(block.withColumnRenamed("component", "block"), "node")
    members = written(members, "blocks")
    occurrences = ln.join(members.select("node", "block"), "node").select("doc", "line_no", "block")
    return occurrences, members


def strip(docs: DataFrame, doc: str, text: str, site: str, min_docs: int = 8) -> DataFrame:
    """``docs`` (one row per id) with the boilerplate lines taken out of ``text`` and ``removed_lines`` added.

    Rows that take no part come back unchanged with 0; a text of boilerplate only becomes empty.
    """
    occ, _ = blocks(docs, doc, text, site, min_docs)
    gone = occ.groupBy("doc").agg(F.collect_set("line_no").alias("_gone"))
    j = docs.join(gone, docs[doc] == gone["doc"], "left").drop(gone["doc"])
    kept = F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda s, i: ~F.array_contains("_gone", (i + 1).cast("bigint")))
    j = j.withColumn("removed_lines", F.coalesce(F.size("_gone"), F.lit(0)))
    return j.withColumn(text, F.when(F.col("_gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(f"`{text}`"))).drop("_gone")


def parents_in(parents: DataFrame) -> DataFrame:
    """The records of type text, one row per parent_id, the one updated last."""
    t = parents.where((F.col("parent_type") == "text") & F.col("parent_id").isNotNull())
    return latest(t.select("parent_id", "parent_text", "file_name", "updated_at"), "parent_id", "updated_at").drop("updated_at")
