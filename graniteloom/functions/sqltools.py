"""Small SQL helpers of the driver: identifiers, literals, clean-up of model output, lint, tables, fields and literals of a statement.

Statements are read with Spark's own parser; what it yields is the unresolved plan, so invented columns do no harm.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# Quote characters by dialect, words that open a statement, capitalised words that are no values.
QUOTES = {"sqlite": "`", "mysql": "`", "spark": "`", "postgres": '"', "oracle": '"'}
OPENERS = ("WITH", "SELECT", "INSERT", "UPDATE", "DELETE")
# The patterns of quoted values, numbers outside dates, dates, and capitalised phrases of a question.
QUOTED = r"""["']([^"']+)["']"""
NUMBER = r"(?<!\d)(?<![/-])\b(\d+\.?\d*)\b(?![/-])"
DATES = (r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{2}/\d{2}/\d{4}\b", r"\b\d{4}/\d{2}/\d{2}\b", r"\b\d{2}-\d{2}-\d{4}\b")
CAPITALISED = r"\b([A-Z][a-z]{1,}(?:\s+[A-Z][a-z]{1,})*)\b"
QUESTION_WORDS = ("Show", "List", "Find", "Get", "What", "Which", "Where", "How", "Why", "When", "Who", "Are", "Is", "The")


def identifier(name: str, dialect: str = "sqlite") -> str:
    """A name, part by part, in the dialect's quotes."""
    q = QUOTES.get(dialect, '"')
    return ".".join(q + p.replace(q, q + q) + q for p in name.split(".") if p)


def literal(value: str, numeric: bool) -> str:
    """A value as SQL: bare if the column is numeric and the value a number, else quoted."""
    if numeric:
        value = value.strip()
        try:
            float(value)
            return value
        except ValueError:
            pass
    return "'" + value.replace("'", "''") + "'"


def where_clause(table: str, column: str, value: str, numeric: bool, dialect: str = "sqlite") -> str:
    return f"{identifier(table, dialect)}.{identifier(column, dialect)} = {literal(value, numeric)}"


def question_literals(question: str) -> list[tuple[str, str]]:
    """(value, kind) pairs of a question: quoted, number, date, capitalised phrase; each once by lower-case value and kind."""
    quoted = [m.strip() for m in re.findall(QUOTED, question) if m.strip()]
    numbers = re.findall(NUMBER, question)
    dates = [m for p in DATES for m in re.findall(p, question)]
    low = {q.lower() for q in quoted}
    names = [m for m in re.findall(CAPITALISED, question) if m not in QUESTION_WORDS and len(m) > 2 and m.lower() not in low]
    found = [(v, k) for k, vs in (("quoted", quoted), ("number", numbers), ("date", dates), ("capitalized", names)) for v in vs]
    seen: set[tuple[str, str]] = set()
    return [x for x in found if not ((x[0].lower(), x[1]) in seen or seen.add((x[0].lower(), x[1])))]


def _unfenced(text: str) -> str:
    m = re.search(r"```(?:sql)\s*\n?(.*?)```", text, re.S | re.I) or re.search(r"```\s*\n?(.*?)```", text, re.S)
    return m.group(1) if m else text


def clean_sql(text: str) -> str:
    """A candidate without its fence and final semicolon."""
    return _unfenced(text).strip().rstrip(";").strip()


def extract_sql(text: str) -> str:
    """The statement in a model's answer: a fenced block (sql first), from its earliest opening word, out of quotes, to the first semicolon outside quotes."""
    s = re.sub(r"^\s*(?:sql|query|answer)\s*:\s*", "", _unfenced(text).strip(), flags=re.I)
    for q in ('"', "'", "`"):
        if len(s) > 1 and s[0] == s[-1] == q:
            s = s[1:-1].strip()
    m = re.search(rf"\b(?:{'|'.join(OPENERS)})\b", s, re.I)
    s = s[m.start() :] if m else s
    quote = None
    for i, c in enumerate(s):
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == ";":
            return s[: i + 1].strip()
    return s.strip()


def json_object(text: str) -> str | None:
    """The first JSON object or array in a text, found by its own brackets (those inside strings do not count); None if none closes."""
    text = _unfenced(text) if "```" in text else re.sub(r"```(?:json)?", "", text)
    dec = json.JSONDecoder()
    for i, c in enumerate(text):
        if c in "{[":
            try:
                _, end = dec.raw_decode(text, i)
                return text[i:end]
            except ValueError:
                continue
    return None


# How a result reads as an answer.
NO_ROWS, ONE_VALUE, HEAD, LINE, MORE = "No results found.", "Result: {}", "Found {} results:\n", "{}. {}\n", "... and {} more rows"


def format_results(rows: list) -> str:
    """A result (tuples or dictionaries) as an answer: a single value alone, else its first three rows, numbered, and how many more there are."""
    if not rows:
        return NO_ROWS
    if len(rows) == len(rows[0]) == 1:
        return ONE_VALUE.format(next(iter(rows[0].values() if isinstance(rows[0], dict) else rows[0])))
    shown = [LINE.format(i, r if isinstance(r, dict) else tuple(r)) for i, r in enumerate(rows[:3], 1)]
    return HEAD.format(len(rows)) + "".join(shown) + (MORE.format(len(rows) - 3) if len(rows) > 3 else "")


def with_links(sql: str) -> str:
    """``TABLE@LINK`` as the multi-part name `` `LINK`.`TABLE` ``; quoted text stays."""
    return "".join(p if p[:1] == "'" else re.sub(r"\b([A-Za-z_]\w*)@([A-Za-z_]\w*)", r"`\2`.`\1`", p) for p in re.split(r"('(?:[^']|'')*')", sql))


def without_links(name: str) -> str:
    """The reverse for one name."""
    p = [x.strip("`") for x in name.split(".")]
    return f"{p[1]}@{p[0]}" if len(p) == 2 else name


@dataclass
class Statement:
    """What a statement refers to; names in upper case, linked tables as TABLE@LINK."""

    valid: bool
    error: str = ""
    tables: set[str] = field(default_factory=set)
    fields: set[tuple[str, str]] = field(default_factory=set)
    literals: set[str] = field(default_factory=set)


@dataclass
class Lint:
    valid: bool
    issues: list[str] = field(default_factory=list)


def _parse(spark: SparkSession, sql: str):
    """The unresolved plan; reserved words stay reserved, so ``SELECT FROM WHERE`` fails."""
    key = "spark.sql.ansi.enforceReservedKeywords"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(with_links(sql).strip().rstrip(";"))
    finally:
        spark.conf.set(key, old)


def _first(e: Exception) -> str:
    return next((x for x in str(e).split("\n") if x.strip()), "")[:160]


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _kids(node) -> list:
    return _seq(node.children().toIndexedSeq()) + _seq(node.innerChildren().toIndexedSeq())


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _walk(plan):
    """(plan node, expression) pairs in the plan and in the subqueries of its expressions; plan nodes alone come with None."""
    stack, seen = [plan], 0
    while stack:
        p = stack.pop()
        seen += 1
        yield p, None
        if _name(p) == "UnresolvedWith":
            stack += [t._2() for t in _seq(p.cteRelations().toIndexedSeq())]
        for e in _seq(p.expressions().toIndexedSeq()):
            es = [e]
            while es:
                x = es.pop()
                yield p, x
                es += _seq(x.children().toIndexedSeq())
                if _name(x) in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
                    stack.append(x.plan())
        stack += _seq(p.children().toIndexedSeq())


def _parts(x) -> list[str]:
    return [str(p) for p in _seq(x.nameParts().toIndexedSeq())]


def analyse(spark: SparkSession, sql: str, schema: dict[str, set[str]] | None = None) -> Statement:
    """Tables, physical fields and WHERE literals of a statement.

    Aliases, derived tables and common table expressions resolve to base tables. ``schema`` (table to columns, any case) drops columns that a table
    does not have and places unqualified ones: in one base table, it; in two, both; in more, none. Without schema unqualified columns are placed only
    in a statement with one base table. Scopes are one flat map for the statement.
    """
    try:
        plan = _parse(spark, sql)
    except Exception as e:
        return Statement(False, _first(e))
    known = {t.upper(): {c.upper() for c in cs} for t, cs in (schema or {}).items()}
    ctes, alias, base, derived = set(), {}, set(), set()
    nodes = list(_walk(plan))
    for p, e in nodes:
        if e is None and _name(p) == "UnresolvedWith":
            ctes |= {str(t._1()).upper() for t in _seq(p.cteRelations().toIndexedSeq())}
    up = lambda parts: without_links(".".join(parts)).upper()
    for p, e in nodes:
        if e is not None:
            continue
        if _name(p) == "UnresolvedRelation":
            t = up([str(x) for x in _seq(p.multipartIdentifier().toIndexedSeq())])
            if t not in ctes:
                base.add(t)
                alias.setdefault(t, t)
        elif _name(p) == "SubqueryAlias":
            a = str(p.alias()).upper()
            c = p.child()
            t = up([str(x) for x in _seq(c.multipartIdentifier().toIndexedSeq())]) if _name(c) == "UnresolvedRelation" else None
            if t and t not in ctes:
                alias[a] = t
            else:
                derived.add(a)
    fields: set[tuple[str, str]] = set()
    lits: set[str] = set()
    for p, e in nodes:
        if e is None:
            continue
        if _name(e) == "UnresolvedAttribute":
            parts = [x.upper() for x in _parts(e)]
            col = parts[-1]
            if len(parts) > 1:
                q = up(parts[:-1])
                t = alias.get(q) or alias.get(parts[-2])
                if t and q not in derived and (t not in known or col in known[t]):
                    fields.add((t, col))
            elif known:
                hit = [t for t in base if col in known.get(t, ())]
                if len(hit) <= 2:
                    fields |= {(t, col) for t in hit}
            elif len(base) == 1:
                fields.add((next(iter(base)), col))
        elif _name(e) == "Literal" and _name(p) == "Filter" and e.value() is not None:
            lits.add(str(e.value()))
    return Statement(True, "", base, fields, lits)


def lint(spark: SparkSession, sql: str) -> Lint:
    """Issues of a candidate: syntax; ORDER BY ascending LIMIT 1 without IS NOT NULL on that column; concatenation in the output."""
    try:
        plan = _parse(spark, sql)
    except Exception as e:
        return Lint(False, ["syntax: " + _first(e)])
    issues, nodes = [], list(_walk(plan))
    for p, e in nodes:
        if e is None and _name(p) == "GlobalLimit" and str(p.limitExpr()) == "1":
            s = p.child()
            s = s.child() if _name(s) == "LocalLimit" else s
            if _name(s) == "Sort":
                for o in _seq(s.order().toIndexedSeq()):
                    col = str(o.child().sql()).split(".")[-1].strip("`").upper()
                    if str(o.direction().sql()) == "ASC":
                        held = any(x is not None and _name(q) == "Filter" and _name(x) == "IsNotNull" and str(x.child().sql()).split(".")[-1].strip("`").upper() == col for q, x in nodes)
                        if not held:
                            issues.append(f"ORDER BY {col} ASC LIMIT 1 without IS NOT NULL")
        elif e is not None and _name(p) in ("Project", "Aggregate") and (_name(e) == "Concat" or _name(e) == "UnresolvedFunction" and str(_seq(e.nameParts().toIndexedSeq())[-1]).lower() in ("concat", "concat_ws", "||")):
            issues.append("concatenation in the output")
    return Lint(not issues, issues)


def tables_of(spark: SparkSession, sql: str) -> set[str]:
    return analyse(spark, sql).tables


def fields_and_literals(spark: SparkSession, sql: str, schema: dict[str, set[str]] | None = None) -> tuple[set[tuple[str, str]], set[str]]:
    s = analyse(spark, sql, schema)
    return s.fields, s.literals
