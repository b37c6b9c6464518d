"""Citations, safety heuristics and answer events, for many answers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graniteloom.functions import text as T

# Phrases by which an answer declines, as the safety check and as the evidence check know them.
SAFETY_REFUSALS = ("i don't know", "i do not know", "i'm not sure", "i am not sure", "cannot answer", "can't answer", "no information", "모르겠습니다", "알 수 없습니다", "정보가 없습니다")
EVIDENCE_REFUSALS = ("모르겠습니다", "알 수 없습니다", "정보가 없습니다", "cannot", "don't know", "no information")


def citation_numbers(sources: DataFrame) -> DataFrame:
    """``sources`` (query, seq, child_id, parent_id, source_file, page_number, parent_type) with ``number``.

    Numbers follow first appearance in a query; a repeated source shares its number; one without ids has 0.
    """
    sid = F.coalesce(F.when(F.col("child_id") != "", F.col("child_id")), F.when(F.col("parent_id") != "", F.col("parent_id")))
    s = sources.withColumn("source_id", sid)
    first = F.min("seq").over(W.Window.partitionBy("query", "source_id"))
    s = s.withColumn("first", F.when(F.col("source_id").isNotNull(), first))
    rank = F.dense_rank().over(W.Window.partitionBy("query", F.col("first").isNull()).orderBy("first"))
    return s.withColumn("number", F.when(F.col("source_id").isNull(), F.lit(0)).otherwise(rank)).drop("first")


def citation_line(language: str = "ko") -> Column:
    """``[1] name.pdf, 5페이지`` of (number, source_file, page_number); the page only where known."""
    page = F.col("page_number").cast("string")
    tail = F.concat(F.lit(", "), page, F.lit("페이지")) if language == "ko" else F.concat(F.lit(", page "), page)
    return F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), T.file_name(F.coalesce("source_file", F.lit("Unknown"))), F.coalesce(tail, F.lit("")))


def citation_list(numbered: DataFrame, language: str = "ko") -> DataFrame:
    """(query, citations): the list of a query's sources under its heading; queries without sources have none."""
    one = numbered.where("number > 0").groupBy("query", "number").agg(F.min(F.struct("seq", "source_file", "page_number")).alias("s")).select("query", "number", "s.source_file", "s.page_number")
    head = "\n\n참고 문서:" if language == "ko" else "\n\nSources:"
    lines = F.transform(F.array_sort(F.collect_list(F.struct("number", citation_line(language).alias("line")))), lambda x: x["line"])
    return one.groupBy("query").agg(F.concat_ws("\n", F.lit(head), F.array_join(lines, "\n")).alias("citations"))


def citation_metadata(numbered: DataFrame) -> DataFrame:
    """(query, id, file, page, source_id, type), one row for each numbered source."""
    one = numbered.where("number > 0").groupBy("query", "number", "source_id").agg(F.min(F.struct("seq", "source_file", "page_number", "parent_type")).alias("s"))
    return one.select("query", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("]")).alias("id"), F.coalesce("s.source_file", F.lit("Unknown")).alias("file"), F.col("s.page_number").alias("page"), "source_id", F.coalesce("s.parent_type", F.lit("text")).alias("type"))


def cited(answer: Column) -> Column:
    """The numbers in brackets in an answer, each once, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))


def invalid_citations(answers: DataFrame, numbered: DataFrame) -> DataFrame:
    """(query, invalid): the cited numbers that no source has."""
    have = numbered.where("number > 0").groupBy("query").agg(F.collect_set(F.col("number").cast("int")).alias("have"))
    j = answers.select("query", cited(F.col("answer")).alias("c")).join(have, "query", "left")
    return j.select("query", F.array_except("c", F.coalesce("have", F.array().cast("array<int>"))).alias("invalid"))


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.lower(text).contains(p)
    return out


def safety(answers: DataFrame, shortest: int = 10, threshold: float = 0.5) -> DataFrame:
    """(query, passed, confidence, issues) of (query, answer, has_citations, nli): nli is an array of entailment scores, or null.

    Issues: too short; no citation, neither marked nor given; a refusal; only if none of these, a mean score under the threshold.
    Confidence is 1 - 0.3 for each issue, at least 0, averaged with the mean score where there are scores.
    """
    a = F.coalesce("answer", F.lit(""))
    short = F.length(F.trim(a)) < shortest
    bare = ~(a.rlike(r"\[\d+\]") | F.coalesce("has_citations", F.lit(False)))
    refusal = _any(a, SAFETY_REFUSALS)
    basic = short.cast("int") + bare.cast("int") + refusal.cast("int")
    mean = F.when((F.size(F.coalesce("nli", F.array().cast("array<double>"))) > 0) & (basic == 0), F.aggregate("nli", F.lit(0.0), lambda s, x: s + x) / F.size("nli"))
    low = F.coalesce(mean < threshold, F.lit(False))
    issues = F.array_compact(F.array(F.when(short, F.lit("too short")), F.when(bare, F.lit("no citations")), F.when(refusal, F.lit("refusal")), F.when(low, F.lit("low entailment"))))
    base = F.greatest(F.lit(0.0), 1 - 0.3 * F.size(issues))
    return answers.select("query", (F.size(issues) == 0).alias("passed"), F.round(F.when(mean.isNotNull(), (base + mean) / 2).otherwise(base), 6).alias("confidence"), issues.alias("issues"))


def evidence_ok(answer: Column, success: Column) -> Column:
    """Whether a step's answer counts as evidence: it succeeded, has 20 characters and does not decline."""
    a = F.coalesce(answer, F.lit(""))
    return F.coalesce(success, F.lit(False)) & (F.length(a) >= 20) & ~_any(a, EVIDENCE_REFUSALS)


def combined_context(chunks: DataFrame, limit: int = 3000) -> DataFrame:
    """(query, context): parent texts, else child texts, in order, cut to ``limit`` characters with an ellipsis."""
    t = F.coalesce(F.when(F.col("parent_text") != "", F.col("parent_text")), F.col("child_text"))
    c = chunks.withColumn("t", t).where("t <> ''").groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), "\n\n").alias("all"))
    return c.select("query", F.when(F.length("all") > limit, F.concat(F.substring("all", 1, limit), F.lit("..."))).otherwise(F.col("all")).alias("context"))


def answer_events(tokens: DataFrame) -> DataFrame:
    """(query, answer): the chunk events (query, seq, event, content) of a stream put together in order."""
    c = tokens.where(F.col("event") == "chunk").groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("content")))), lambda x: x["content"]), "").alias("answer"))
    return c
