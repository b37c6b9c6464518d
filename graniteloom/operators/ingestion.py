"""Ingestion end to end: parsed elements to stored parents, children, vectors, and a segment of the sparse index, with a status for each source file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.operators import bm25, chunking, sparse_index
from graniteloom.providers import Embedder, embed
from graniteloom.runtime import latest, written
from graniteloom.sources import stores


def chunked(elements: DataFrame, text: chunking.TextSizes = chunking.TextSizes(), table: chunking.TableSizes = chunking.TableSizes()) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of elements (source_file, element_id, type, text).

    Parents are (parent_id, source_file, parent_type, text, token_count), children (child_id, parent_id, source_file, child_type, text, token_count, chunk_index). Ids begin with
    ``{file stem}_elem_{element_id}``. Elements of type table that are no sound table are cut into plain slices; null and blank texts give nothing; an element that
    stands twice counts once (its greatest row); rows with a null source_file or element_id take no part.
    """
    stem = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", "")
    e = elements.where("source_file is not null and element_id is not null").withColumn("element", F.concat(stem, F.lit("_elem_"), F.col("element_id").cast("string")))
    e = latest(e.select("element", "source_file", "type", "text"), "element", None)
    broken = F.coalesce(chunking.broken_table(F.col("text")) | (F.size(F.split(F.trim("text"), "\n")) < 2), F.lit(False))
    tab = F.coalesce(F.col("type") == "table", F.lit(False))
    tp = chunking.text_parents(e.where(~tab), "element", "text", text).select("source", "parent_id", F.lit("text").alias("parent_type"), "text", "token_count")
    tc = chunking.text_children(tp, text).select("parent_id", "child_id", F.lit("text_chunk").alias("child_type"), "text", "token_count", "chunk_index")
    sound = e.where(tab & ~broken)
    rows = ("parent_id", "child_id", F.lit("table_row_group").alias("child_type"), "text", "token_count", "chunk_index")
    parents, children = tp, tc
    bp, bc = chunking.broken_parts(e.where(tab & broken), "element", "text", table)
    for p in (chunking.table_parents(sound, "element", "text", table), bp):
        parents = parents.unionByName(p.select("source", "parent_id", F.lit("table").alias("parent_type"), "text", "token_count"))
    for c in (chunking.table_children(sound, "element", "text", table), bc):
        children = children.unionByName(c.select(*rows))
    parents = parents.join(e.select(F.col("element").alias("source"), "source_file"), "source").drop("source")
    return parents, children.join(parents.select("parent_id", "source_file"), "parent_id")


def ingest(spark: SparkSession, elements: DataFrame, root: str, job: str, provider: Embedder) -> DataFrame:
    """(source_file, parents, children, status, error) of each source file of ``elements``; what came of it is stored under ``root``.

    Stores parents, children and vectors by id (a file that comes again replaces its pieces of the same ids), adds a segment to ``root/index``, and appends each file's
    states to ``root/jobs`` as job ``{job}:{source_file}``, started before and completed or failed after. A file without children is failed and stores nothing; the others are not held up by it.
    """
    files = elements.where("source_file is not null").select("source_file").distinct()
    note = lambda rows, status, error, p, c: rows.select(F.concat(F.lit(job + ":"), "source_file").alias("job_id"), "source_file", status.alias("status"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"), error.alias("error_message"), p.cast("int").alias("total_parents"), c.cast("int").alias("total_children")).write.mode("append").parquet(f"{root}/jobs")
    none = F.lit(None).cast("string")
    note(files, F.lit("started"), none, F.lit(None), F.lit(None))
    parents, children = (written(x, "chunks") for x in chunked(elements))
    parents = parents.join(children.select("parent_id").distinct(), "parent_id", "left_semi")
    stores.upsert(spark, f"{root}/parents", parents, "parent_id")
    stores.upsert(spark, f"{root}/children", children, "child_id")
    stores.upsert(spark, f"{root}/vectors", children.select("child_id", embed(F.col("text"), provider).alias("embedding")), "child_id")
    sparse_index.add(spark, f"{root}/index", bm25.term_frequencies(children, "child_id", "text"))
    n = lambda df, c: df.groupBy("source_file").agg(F.count("*").alias(c))
    out = files.join(n(parents, "parents"), "source_file", "left").join(n(children, "children"), "source_file", "left").fillna(0)
    error = F.when(F.col("children") == 0, "no children: the file is empty or could not be read")
    out = written(out.select("source_file", "parents", "children", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error")), "states")
    note(out, F.col("status"), F.col("error"), F.col("parents"), F.col("children"))
    return out
