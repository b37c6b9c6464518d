"""The semantic field index: descriptions as vectors, searched by questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteloom.operators.retrieval import dense_search
from graniteloom.providers import Embedder, embed


def build_index(metadata: DataFrame, provider: Embedder, description: str = "description") -> DataFrame:
    """(field, table_name, column_name, description, embedding) of the fields that have a description."""
    m = metadata.where(F.trim(F.coalesce(F.col(description), F.lit(""))) != "")
    return m.select(F.concat_ws(".", "table_name", "column_name").alias("field"), "table_name", "column_name", F.col(description).alias("description"), embed(F.col(description), provider).alias("embedding"))


def search(index: DataFrame, questions: DataFrame, provider: Embedder, k: int = 10, threshold: float | None = None) -> DataFrame:
    """(query, table_name, column_name, score, rank) of questions (query, question); blank questions find nothing."""
    q = questions.where(F.trim(F.coalesce("question", F.lit(""))) != "").select("query", embed(F.col("question"), provider).alias("vector"))
    r = dense_search(index, "field", "embedding", q, k, provider.dim)
    r = r if threshold is None else r.where(F.col("score") >= threshold)
    return r.join(index.select(F.col("field").alias("doc"), "table_name", "column_name"), "doc").select("query", "table_name", "column_name", "score", "rank")
