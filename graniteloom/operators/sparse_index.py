"""The sparse index as stored tables: postings partitioned by term, with the statistics beside them.

An index is a row of segments, numbered from 1. Segment n has ``postings/v<n>`` (bucket of the term as folder; within it sorted by term), ``documents/v<n>`` (doc, doc_length),
``gone/v<n>`` (documents of earlier segments that it replaces or deletes) and, written last, ``about/v<n>`` (what it adds to the number and
the total length of documents). Only a finished ``about`` makes a segment count, so readers never see half of one. A search reads the folders of its terms only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from graniteloom.operators import bm25
from graniteloom.sources.stores import drop_store, versions

BUCKETS = 64
#: Up to this many distinct terms of a search are named to the scan, which then skips folders and row groups; more are joined.
NAMED_TERMS = 2000
_NOTES = "segment int, kind string, whole boolean, documents bigint, length bigint, gone bigint"
_COLUMNS = {"postings": "term string, tf bigint, doc_length bigint, bucket int", "documents": "doc_length bigint", "gone": "doc_length bigint"}


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _about(spark: SparkSession, path: str) -> list[Row]:
    """What is noted of the segments that count (one row each): from the last whole one on, in order."""
    v = versions(spark, f"{path}/about")
    if not v:
        return []
    rows = sorted(spark.read.schema(_NOTES).parquet(*[f"{path}/about/v{n}" for n in v]).collect(), key=lambda r: r["segment"])
    return rows[max((i for i, r in enumerate(rows) if r["whole"]), default=0) :]


def segments(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the segments that count."""
    return [r["segment"] for r in _about(spark, path)]


def _read(spark: SparkSession, path: str, part: str, about: list[Row]) -> DataFrame:
    read = spark.read.schema(f"doc {about[0]['kind']}, " + _COLUMNS[part])
    return reduce(DataFrame.unionByName, [read.parquet(f"{path}/{part}/v{r['segment']}").withColumn("segment", F.lit(r["segment"])) for r in about])


def _live(spark: SparkSession, path: str, part: str, about: list[Row]) -> DataFrame:
    """The rows of a part whose document no later segment has replaced or deleted."""
    rows = _read(spark, path, part, about)
    if not any(r["gone"] for r in about[1:]):
        return rows.drop("segment")
    gone = _read(spark, path, "gone", [r for r in about[1:] if r["gone"]]).groupBy("doc").agg(F.max("segment").alias("until"))
    # a document comes back with the segment that replaces it
    return rows.join(gone, "doc", "left").where("until is null or segment >= until").drop("segment", "until")


def add(spark: SparkSession, path: str, tf: DataFrame | None, delete: DataFrame | None = None) -> int:
    """Add a segment: the postings ``tf`` (doc, term, tf, doc_length), whose documents replace those of the same id, and the documents ``delete`` (doc) taken out. Its number comes back.

    An empty or missing ``tf`` only deletes. Documents without terms have no posting and are not counted. All segments have one kind of id, that of the first.
    """
    about, n = _about(spark, path), max(versions(spark, f"{path}/about"), default=0) + 1
    kind = about[0]["kind"] if about else (tf if tf is not None else delete).schema["doc"].dataType.simpleString()
    if tf is None:
        tf = spark.createDataFrame([], f"doc {kind}, term string, tf bigint, doc_length bigint")
    use = tf.where(F.col("doc").isNotNull() & F.col("term").isNotNull()).select(F.col("doc").cast(kind).alias("doc"), "term", "tf", "doc_length", _bucket(F.col("term")).alias("bucket"))
    _write(use, f"{path}/postings/v{n}")
    new = _read(spark, path, "postings", [Row(segment=n, kind=kind)]).groupBy("doc").agg(F.max("doc_length").alias("doc_length"))
    new.write.mode("overwrite").parquet(f"{path}/documents/v{n}")
    new = _read(spark, path, "documents", [Row(segment=n, kind=kind)])
    out = new.select("doc") if delete is None else new.select("doc").union(delete.select(F.col("doc").cast(kind)).where("doc is not null")).distinct()
    had = _live(spark, path, "documents", about).join(out, "doc", "left_semi") if about else new.limit(0)
    had.select("doc", "doc_length").write.mode("overwrite").parquet(f"{path}/gone/v{n}")
    _note(spark, path, n, kind, False)
    return n


def _write(postings: DataFrame, path: str) -> None:
    # rebalanced, so that a bucket with a frequent term is cut over several files
    postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _note(spark: SparkSession, path: str, n: int, kind: str, whole: bool) -> None:
    one = [Row(segment=n, kind=kind)]
    total = lambda part: _read(spark, path, part, one).agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("length"))
    (new, length), (gone, lost) = total("documents").first(), total("gone").first()
    spark.createDataFrame([(n, kind, whole, new - gone, length - lost, gone)], _NOTES).coalesce(1).write.mode("overwrite").parquet(f"{path}/about/v{n}")


def compact(spark: SparkSession, path: str) -> None:
    """Write all that counts as one whole segment; the older ones are removed once it is finished."""
    about = _about(spark, path)
    if len(about) < 2:
        return
    n, kind = about[-1]["segment"] + 1, about[0]["kind"]
    _write(_live(spark, path, "postings", about).select("doc", "term", "tf", "doc_length", "bucket"), f"{path}/postings/v{n}")
    _live(spark, path, "documents", about).select("doc", "doc_length").write.mode("overwrite").parquet(f"{path}/documents/v{n}")
    _read(spark, path, "gone", about).select("doc", "doc_length").limit(0).write.mode("overwrite").parquet(f"{path}/gone/v{n}")
    _note(spark, path, n, kind, True)
    for r in about:
        for part in ("about", "gone", "documents", "postings"):
            drop_store(spark, f"{path}/{part}/v{r['segment']}")


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row: n (documents that count) and avgdl (their average length; null without documents), from what the segments note."""
    return _sums(spark, _about(spark, path))


def _sums(spark: SparkSession, about: list[Row]) -> DataFrame:
    n, length = sum(r["documents"] for r in about), sum(r["length"] for r in about)
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(length / n if n else None).cast("double").alias("avgdl"))


def postings(spark: SparkSession, path: str, terms: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf, doc_length) of the whole index, or of the ``terms`` (term) alone: of the others' folders nothing is read."""
    return _postings(spark, path, terms, _about(spark, path))


def _postings(spark: SparkSession, path: str, terms: DataFrame | None, about: list[Row]) -> DataFrame:
    if not about:
        raise FileNotFoundError(path)
    rows = _live(spark, path, "postings", about)
    if terms is not None:
        asked = terms.select("term", _bucket(F.col("term")).alias("bucket")).where("term is not null").distinct()
        named = asked.limit(NAMED_TERMS + 1).collect()
        if len(named) <= NAMED_TERMS:
            rows = rows.where(F.col("bucket").isin(sorted({r["bucket"] for r in named})) & F.col("term").isin(sorted(r["term"] for r in named)))
        else:
            rows = rows.join(asked, ["bucket", "term"], "left_semi")
    return rows.select("doc", "term", "tf", "doc_length")


def search(spark: SparkSession, path: str, terms: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score, rank): the top k of each query (query, term, times), ties to the smaller document id."""
    about = _about(spark, path)
    return bm25.top(bm25.scored(_postings(spark, path, terms, about), terms, _sums(spark, about), k1, b), k)
