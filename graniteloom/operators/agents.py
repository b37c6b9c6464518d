"""Driver-side question answering: document lane, refinement loop, multi-step lane. Data work is in DataFrames; models are providers."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from graniteloom.functions import sqltools
from graniteloom.operators import linking
from graniteloom.operators.answers import EVIDENCE_REFUSALS
from graniteloom.operators.voting import NO_SQL, solve


@dataclass
class ToolResponse:
    """What every tool gives back."""

    success: bool
    answer: str = ""
    error: str = ""
    metadata: dict[str, Any] = field(default_factory=dict)
    context_chunks: list[dict] = field(default_factory=list)


Tool = Callable[[str], ToolResponse]


def call(tool: Tool | None, query: str) -> ToolResponse:
    """A tool's response; an unknown tool or one that raises is a failure, not an exception."""
    if tool is None:
        return ToolResponse(False, error="no such tool")
    try:
        return tool(query)
    except Exception as e:
        return ToolResponse(False, error=str(e))


def sql_tool(spark: SparkSession, candidates: Callable[[str], list[str]], lint=sqltools.lint, limit: int = 1000) -> Tool:
    """A tool that votes among candidate statements and answers with the winner's result."""

    def run(query: str) -> ToolResponse:
        sql = solve(spark, [sqltools.extract_sql(c) for c in candidates(query)], lint)
        if sql == NO_SQL:
            return ToolResponse(False, error="no candidate is valid", metadata={"sql": sql})
        df = spark.sql(sql.rstrip(";"))
        rows = [tuple(r) for r in df.limit(limit).collect()]
        return ToolResponse(True, sqltools.format_results(rows), metadata={"sql": sql, "rows": len(rows)})

    return run


def document_tool(retrieve: Callable[[str], list[dict]], generate: Callable[[str, list[dict]], str], rerank=None, top_k: int = 5) -> Tool:
    """A tool that answers from retrieved chunks, reranked by parent text if a reranker is given; an answer under 10 characters is a failure."""

    def run(query: str) -> ToolResponse:
        chunks = retrieve(query)
        if rerank and chunks:
            try:
                s = rerank.scores(query, [c.get("parent_text") or c.get("child_text") or "" for c in chunks])
                chunks = [c for _, c in sorted(zip(s, chunks), key=lambda x: -x[0])]
            except Exception:  # the order of retrieval stands
                pass
        chunks = chunks[:top_k]
        answer = generate(query, chunks)
        if len(answer.strip()) < 10:
            return ToolResponse(False, error="no answer", context_chunks=chunks)
        return ToolResponse(True, answer, context_chunks=chunks)

    return run


def candidates(fields: set[tuple[str, str]], prompt: Callable[[list[tuple[str, str]]], str], generate: Callable[[str, int], str], n: int = 3, seed: int = 42) -> list[str]:
    """Up to ``n`` statements for one question, each asked for with the fields in another order and with another seed.

    Orders and seeds follow from ``seed`` and the sorted fields alone. An empty answer or a failing call is tried once more with the next seed; a candidate
    that then is still empty is left out.
    """
    rng, out = random.Random(seed), []
    for _ in range(n):
        order = sorted(fields)
        rng.shuffle(order)
        asked, first = prompt(order), rng.randint(0, 10_000)
        for s in (first, first + 1):
            try:
                sql = sqltools.clean_sql(generate(asked, s))
            except Exception:  # as an empty answer
                sql = ""
            if sql:
                out.append(sql)
                break
    return out


def expand(query: str, model=None, n: int = 3) -> list[str]:
    """The question and up to ``n`` rewritings, without case-insensitive repeats; without a model, or if it fails, the question alone."""
    out = [query]
    for i in range(n if model else 0):
        try:
            v = model.generate(f"Rewrite this search query in another way ({i + 1}):\n{query}").strip().split("\n")[0].strip().strip("\"'")
        except Exception:
            break
        if v and v.lower() not in {x.lower() for x in out}:
            out.append(v)
    return out


def parse_plan(text: str) -> list[dict]:
    """The steps of a plan {"plan": [...]} found in a text; anything else gives none."""
    s = sqltools.json_object(text)
    try:
        plan = json.loads(s).get("plan") if s else None
    except (ValueError, AttributeError):
        return []
    return plan if isinstance(plan, list) else []


def plan_with_repairs(model, prompt: str, repairs: int = 2) -> list[dict]:
    """A plan, asked for again with the broken answer up to ``repairs`` times."""
    text = model.generate(prompt)
    for _ in range(repairs):
        if plan := parse_plan(text):
            return plan
        text = model.generate(f"The plan below is not valid JSON of the form {{\"plan\": [...]}}. Give it again, valid.\n{text}")
    return parse_plan(text)


@dataclass
class State:
    """A multi-step question on its way."""

    query: str
    plan: list[dict] = field(default_factory=list)
    scratchpad: list[str] = field(default_factory=list)
    context: list[dict] = field(default_factory=list)
    steps: int = 0
    max_steps: int = 5
    answer: str = ""
    error: str = ""
    trace: list[str] = field(default_factory=list)


def valid_evidence(r: ToolResponse) -> bool:
    return r.success and len(r.answer) >= 20 and not any(p in r.answer.lower() for p in EVIDENCE_REFUSALS)


def _chunk_key(c: dict) -> str:
    import hashlib

    text = c.get("parent_text") or c.get("child_text") or ""
    return c.get("child_id") or "md5:" + hashlib.md5(text.encode()).hexdigest()


def multi_step(query: str, tools: dict[str, Tool], model, max_steps: int = 5, context: str = "") -> State:
    """Planner, executor, critic, then the next step, a rewritten one, or the synthesis.

    Evidence that is missing, short or declines sends its step back rewritten, at the front; no evidence at all, or an answer under 10 characters, is an error.
    """
    s = State(query, max_steps=max_steps)
    s.plan = plan_with_repairs(model, f"Tools: {', '.join(tools)}\n{context}\nPlan the steps for: {query}")
    s.trace.append("plan")
    if not s.plan:
        s.error = "no valid plan"
    while s.plan and not s.error:
        step = s.plan.pop(0)
        r = call(tools.get(step.get("tool", "")), step.get("query", ""))
        s.steps += 1
        s.trace.append(f"execute {step.get('tool')}")
        ok = valid_evidence(r)
        if ok:
            s.scratchpad.append(f"Q: {step.get('query', '')}\nA: {r.answer}")
            have = {_chunk_key(c) for c in s.context}
            for c in r.context_chunks:
                if (k := _chunk_key(c)) not in have:
                    have.add(k)
                    s.context.append(c)
        if s.steps >= s.max_steps:
            break
        if not ok:
            s.trace.append("rewrite")
            s.plan.insert(0, step | {"query": model.generate(f"Rewrite this question so that it can be answered:\n{step.get('query', '')}").strip()})
    s.trace.append("synthesize")
    if not s.scratchpad:
        s.error = s.error or "no evidence for an answer"
        return s
    answer = model.generate("\n\n".join(s.scratchpad) + f"\n\nAnswer: {query}")
    if len(answer or "") < 10:
        s.error = "no adequate answer"
    else:
        s.answer = answer
    return s


@dataclass
class Refinement:
    """What the refinement loop found: the fields and literals of all attempts, and each attempt (variant, iteration, sql)."""

    fields: set[tuple[str, str]] = field(default_factory=set)
    literals: set[str] = field(default_factory=set)
    attempts: list[tuple[str, int, str]] = field(default_factory=list)

    def last_sql(self) -> str | None:
        return self.attempts[-1][2] if self.attempts else None


def refine(spark: SparkSession, question: str, schemas: dict[str, str], model, matches: Callable[[str], list[tuple[str, str]]], columns: dict[str, set[str]] | None = None, most: int = 3) -> Refinement:
    """For each schema text: ask for SQL, read its fields and literals, and while a literal's matching fields are all missing, add them and ask again.

    ``matches`` gives the best fields of a literal; a literal without any is covered. Broken SQL is asked for once more within the same bound.
    """
    out = Refinement()
    for name, text in schemas.items():
        shown: set[tuple[str, str]] = set()
        prompt = f"{text}\n\nQuestion: {question}\nSQL:"
        for i in range(most):
            sql = sqltools.extract_sql(model.generate(prompt))
            out.attempts.append((name, i, sql))
            st = sqltools.analyse(spark, sql, columns)
            if not st.valid:
                prompt = f"{text}\n\nQuestion: {question}\nThis SQL is not valid ({st.error}):\n{sql}\nSQL:"
                continue
            out.fields |= st.fields
            out.literals |= st.literals
            have = {(t.lower(), c.lower()) for t, c in st.fields}
            gaps = {(t, c) for lit in sorted(st.literals) if (m := matches(lit)) and not any((t.lower(), c.lower()) in have for t, c in m) for t, c in m}
            new = gaps - shown
            if not new:
                break
            shown |= new
            text = linking.augment(text, sorted(new))
            prompt = f"{text}\n\nQuestion: {question}\nThis SQL misses fields that hold its values:\n{sql}\nSQL:"
        out.fields |= shown
    return out


@dataclass(frozen=True)
class Request:
    """A question as the service takes it: 1 to 1,000 characters, 1 to 20 results, Korean or English."""

    query: str
    top_k: int = 5
    language: str = "ko"

    def __post_init__(self) -> None:
        if not 1 <= len(self.query) <= 1000:
            raise ValueError("query must have 1 to 1000 characters")
        if not 1 <= self.top_k <= 20:
            raise ValueError("top_k must be 1 to 20")
        if self.language not in ("ko", "en"):
            raise ValueError("language must be ko or en")


def events(answer: str, citations: list[dict], size: int = 50) -> list[dict]:
    """An answer as a stream of events: status, citations, chunks, done; an empty answer is an error."""
    out = [{"type": "status", "content": "generating"}] + [{"type": "citation", "data": c} for c in citations]
    if not answer:
        return [*out, {"type": "error", "data": {"message": "empty answer"}}]
    out += [{"type": "chunk", "content": answer[i : i + size]} for i in range(0, len(answer), size)]
    return [*out, {"type": "done", "data": {"citations": len(citations), "length": len(answer)}}]


def retrieval_rows(df: DataFrame, limit: int) -> list[dict]:
    """The first rows of a ranked result as dictionaries: a question's own few."""
    return [r.asDict() for r in df.orderBy("rank").limit(limit).collect()]
