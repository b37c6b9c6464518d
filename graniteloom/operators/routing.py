"""Routing questions to paths and lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The paths in the order that settles ties, and the points of a rule that holds.
PATHS = ("complex_dual", "doc_only", "fact_only", "llm_only")
POINTS = 3

# Fixed value: the reasoning where an answer has none.
NO_REASONING = "Unable to parse LLM response"

# The labels of a lane router's answer and the closing phrases that are no reasoning.
LANE = r"(?i)LANE\s*[:：]\s*(fast|slow)"
CONFIDENCE = r"(?i)CONFIDENCE\s*[:：]\s*([0-9]*\.?[0-9]+)"
REASONING = r"(?is)REASONING\s*[:：]\s*(.+)$"
FENCES = r"(?i)```[a-z]*\s*|\s*```"
CLOSING = r"(?i)\s*(hope this helps|let me know).*$"

#: Words that stand for each rule's condition.
RULES = {
    "fact_only": r"(?iu)\b(how many|how much|number|percent|percentage|rate|total|sum|average|count|year|month|week|sales|by product|show|list)\b|[0-9]+|몇|얼마|비율|합계|평균|목록|가동률|매출",
    "doc_only": r"(?iu)\b(how|why|where|process|procedure|explain|can i|policy|rule|guide|receive|regulation)\b|어떻게|왜|어디|절차|방법|규정|설명|신청",
    "llm_only": r"(?iu)\b(what is|when is|define|definition|meaning|who is|holiday)\b|무엇|정의|뜻|공휴일",
}


def path_scores(question: Column) -> Column:
    """Points of each path: a rule that holds gives its path three; facts and explanation together give the double path three."""
    pts = {p: F.when(question.rlike(r), POINTS).otherwise(0) for p, r in RULES.items()}
    both = question.rlike(RULES["fact_only"]) & question.rlike(RULES["doc_only"])
    pts["complex_dual"] = F.when(both, POINTS).otherwise(0)
    return F.create_map(*[x for p in PATHS for x in (F.lit(p), pts[p])])


def best_path(scores: Column) -> Column:
    """The path with most points (map<string,int>); ties in the order of PATHS; no map: complex_dual."""
    ranked = F.array(*[F.struct(F.coalesce(F.element_at(scores, F.lit(p)), F.lit(0)).alias("s"), F.lit(-i).alias("o"), F.lit(p).alias("p")) for i, p in enumerate(PATHS)])
    return F.coalesce(F.array_max(ranked)["p"], F.lit(PATHS[0]))


def route(questions: DataFrame, question: str = "question") -> DataFrame:
    """``questions`` with ``scores`` and ``path``; a null question goes to complex_dual with 5 points there."""
    q = F.col(f"`{question}`")
    zero = F.create_map(*[x for p in PATHS for x in (F.lit(p), F.lit(5 if p == PATHS[0] else 0))])
    s = questions.withColumn("scores", F.when(q.isNull(), zero).otherwise(path_scores(q)))
    return s.withColumn("path", best_path(F.col("scores")))


def lane(response: Column, default: str = "fast") -> Column:
    """struct(lane, confidence, reasoning) read from a router's answer: labels with either colon, any case; confidence 0.5 if missing, cut to [0, 1]."""
    c = F.regexp_replace(response, FENCES, "")
    lane_ = F.lower(F.regexp_extract(c, LANE, 1))
    conf = F.regexp_extract(c, CONFIDENCE, 1)
    why = F.trim(F.regexp_replace(F.trim(F.regexp_extract(c, REASONING, 1)), r"[\n\r]+", " "))
    why = F.trim(F.regexp_replace(why, CLOSING, ""))
    return F.struct(
        F.when(lane_ != "", lane_).otherwise(default).alias("lane"),
        F.when(conf != "", F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf.cast("double")))).otherwise(0.5).alias("confidence"),
        F.when(why != "", why).otherwise(NO_REASONING).alias("reasoning"),
    )


def rules_text(path: str) -> str:
    """The numbered rules of a YAML file (rules: [{description}]), as a router's prompt shows them."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rules = (yaml.safe_load(f) or {}).get("rules", [])
    return "\n".join(f"{i}. {r.get('description', '')}" for i, r in enumerate(rules, 1))
