"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.functions.text import ENGLISH_STOPWORDS, KOREAN_STOPWORDS, TERMS
from graniteloom.runtime import table

#: The stated questions of the search queries.
QUESTIONS = (
    (1, "coolant valve pressure alarm on the drilling line"),
    (2, "출장 신청서 승인 안전 담당"),
    (3, "calibration of the spindle and the hydraulic hose"),
    (4, "daily allowance travel desk hotel hotel"),
    (5, "Lieferant Kühlmittelventil Prüfbank"),
)

QUESTIONS_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") AS q(query, question))"

_STOP = ", ".join(f"'{w}'" for w in (*ENGLISH_STOPWORDS, *KOREAN_STOPWORDS))


def tokens_sql(text: str) -> str:
    """The tokens of a text column as the index takes them, in DuckDB."""
    return f"list_filter(regexp_extract_all(lower({text}), '{TERMS}'), lambda t: length(t) BETWEEN 2 AND 50 AND t NOT IN ({_STOP}))"


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query int, question string")


def children(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """(doc, text) of the children, or of those in ``only`` (doc), a child that stands twice once."""
    rows = table(spark, d, "children").where("child_id is not null")
    rows = rows if only is None else rows.join(only.withColumnRenamed("doc", "child_id"), "child_id", "left_semi")
    return rows.select(F.col("child_id").alias("doc"), F.coalesce("child_text", F.lit("")).alias("text")).dropDuplicates(["doc"])


CHILDREN_SQL = "(SELECT child_id AS doc, any_value(coalesce(child_text, '')) AS text FROM children WHERE child_id IS NOT NULL GROUP BY child_id)"

TF_SQL = f"""tok AS (SELECT doc, {tokens_sql("text")} AS t FROM {CHILDREN_SQL}),
        tf AS (SELECT doc, term, count(*) AS tf, any_value(n) AS doc_length FROM (SELECT doc, len(t) AS n, unnest(t) AS term FROM tok) GROUP BY doc, term)"""


def typed(oracles: dict[str, str], **types: dict[str, str]) -> dict[str, str]:
    """``oracles`` with the columns named for a query cast to the types that Spark gives."""
    cast = lambda cs: ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in cs.items())
    return oracles | {k: f"SELECT * REPLACE ({cast(cs)}) FROM ({oracles[k]})" for k, cs in types.items()}
