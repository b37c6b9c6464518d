"""Schema linking: fields and tables relevant to a question, and the schema texts made of them. Keys are (table_name, column_name)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

VARIANTS = ("focused_minimal", "focused_maximal", "focused_full", "full_minimal", "full_maximal")
_KEY = ["table_name", "column_name"]


def merge(semantic: DataFrame, lexical: DataFrame, strategy: str = "union", threshold: float | None = None, lexical_threshold: float | None = None) -> DataFrame:
    """(table_name, column_name, semantic_score, lexical_score, selected_by) of scored fields: union, intersection, semantic_only or lexical_only."""
    s = semantic.select(*_KEY, F.col("score").alias("semantic_score"))
    x = lexical.select(*_KEY, F.col("score").alias("lexical_score"))
    s = s if threshold is None else s.where(F.col("semantic_score") >= threshold)
    x = x if lexical_threshold is None else x.where(F.col("lexical_score") >= lexical_threshold)
    how = {"union": "full_outer", "intersection": "inner", "semantic_only": "left", "lexical_only": "right"}
    if strategy not in how:
        raise ValueError(f"unknown strategy {strategy}")
    j = s.join(x, _KEY, how[strategy])
    if strategy == "semantic_only":
        j = j.withColumn("lexical_score", F.lit(None).cast("double"))
    if strategy == "lexical_only":
        j = j.withColumn("semantic_score", F.lit(None).cast("double"))
    both = F.col("semantic_score").isNotNull() & F.col("lexical_score").isNotNull()
    return j.withColumn("selected_by", F.when(both, "both").when(F.col("semantic_score").isNotNull(), "semantic").otherwise("lexical"))


def ordered(fields: DataFrame) -> DataFrame:
    """Focused fields with ``position``: those found both ways first, then semantic, then lexical; by best score, then name. A question's fields are few."""
    prio = F.when(F.col("selected_by") == "both", 3).when(F.col("selected_by") == "semantic", 2).otherwise(1)
    best = F.greatest(F.coalesce("semantic_score", F.lit(0.0)), F.coalesce("lexical_score", F.lit(0.0)))
    return fields.withColumn("position", F.row_number().over(W.Window.orderBy(F.desc(prio), F.desc(best), *_KEY)))


def field_statistics(fields: DataFrame) -> DataFrame:
    """One row: total_fields, semantic_only, lexical_only, both, unique_tables."""
    n = lambda v: F.count(F.when(F.col("selected_by") == v, 1))
    return fields.agg(F.count("*").alias("total_fields"), n("semantic").alias("semantic_only"), n("lexical").alias("lexical_only"), n("both").alias("both"), F.countDistinct("table_name").alias("unique_tables"))


def table_scores(semantic: DataFrame, lexical: DataFrame, threshold: float = 0.2, lexical_threshold: float = 0.3) -> DataFrame:
    """(table_name, semantic_score, matched): the best semantic score and the set of lexically matched columns of each table found either way."""
    s = semantic.where(F.col("score") >= threshold).groupBy("table_name").agg(F.max("score").alias("semantic_score"))
    x = lexical.where(F.col("score") >= lexical_threshold).groupBy("table_name").agg(F.array_sort(F.collect_set("column_name")).alias("matched"))
    return s.join(x, "table_name", "full_outer").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))


def relevant_tables(scores: DataFrame, known: DataFrame, max_tables: int = 5) -> DataFrame:
    """``scores`` of known tables (table_name) with ``position``, best first: semantic score plus 0.1 with a lexical match, found both ways, number of matches, name."""
    s = scores.join(known.select("table_name").distinct(), "table_name", "left_semi")
    lex = F.size("matched") > 0
    base = F.coalesce("semantic_score", F.lit(0.0)) + F.when(lex, 0.1).otherwise(0.0)
    w = W.Window.orderBy(F.desc(F.round(base, 6)), F.desc(F.col("semantic_score").isNotNull() & lex), F.desc(F.size("matched")), "table_name")
    return s.withColumn("position", F.row_number().over(w)).where(F.col("position") <= max_tables)


def shown_columns(profiles: DataFrame, scores: DataFrame, max_columns: int = 50) -> DataFrame:
    """Profiles (with is_pk, is_fk) of scored tables with is_matched, is_first and ``place``: the order of columns in a table summary.

    A table of at most ``max_columns`` shows all in its own order. A larger one shows matched columns, then primary keys, foreign
    keys, the first column, and the rest by distinctness.
    """
    p = profiles.join(scores.select("table_name", "matched"), "table_name")
    t = W.Window.partitionBy("table_name")
    p = p.withColumns({"is_matched": F.array_contains("matched", F.col("column_name")), "is_first": F.col("ordinal") == F.min("ordinal").over(t), "columns": F.count("*").over(t)}).drop("matched")
    tier = F.when(F.col("is_matched"), 1).when(F.col("is_pk"), 2).when(F.col("is_fk"), 3).when(F.col("is_first"), 4).otherwise(5)
    distinct = F.when(tier == 5, F.col("distinct_count") / F.greatest("non_null_count", F.lit(1))).otherwise(F.lit(0.0))
    wide = F.col("columns") > max_columns
    order = [F.when(wide, tier).otherwise(F.lit(0)), F.desc(F.when(wide, distinct).otherwise(F.lit(0.0))), "ordinal"]
    return p.withColumn("place", F.row_number().over(t.orderBy(*order))).where(F.col("place") <= max_columns)


def planner_text(columns: DataFrame, scores: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(table_name, text): table summaries with [*] matched, [K] key and [F] foreign-key marks; descriptions (table_name, column_name or null, description)."""
    d = descriptions.where("column_name is not null").select(*_KEY, F.col("description").alias("about"))
    t = descriptions.where("column_name is null").select("table_name", F.col("description").alias("table_about"))
    mark = F.when(F.col("is_matched"), "[*]").when(F.col("is_pk"), "[K]").when(F.col("is_fk"), "[F]").otherwise("   ")
    line = F.concat(F.lit("  "), mark, F.lit(" "), "column_name", F.lit(" ("), "data_type", F.lit(")"), F.coalesce(F.concat(F.lit(" - "), "about"), F.lit("")))
    c = columns.join(d, _KEY, "left").groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"), F.count("*").alias("n"))
    head = F.concat("table_name", F.when(F.coalesce("semantic_score", F.lit(0.0)) > 0, F.format_string(" (semantic: %.2f)", "semantic_score")).when(F.size("matched") > 0, " (lexical match)").otherwise(""))
    j = c.join(scores.select("table_name", "semantic_score", "matched"), "table_name").join(t, "table_name", "left")
    return j.select("table_name", F.concat_ws("\n", head, F.concat(F.lit("  Description: "), F.coalesce("table_about", F.lit(""))), F.lit(""), F.concat(F.lit("  Columns ("), F.col("n").cast("string"), F.lit(" total):")), "lines").alias("text"))


def profile_kind(variant: str) -> str:
    """Which description a variant shows: minimal or maximal if its name says so, else full."""
    return next((k for k in ("minimal", "maximal", "full") if k in variant), "minimal")


def described(metadata: DataFrame, kind: str) -> Column:
    """The description of (short_description, long_description, sme_description) for a kind."""
    del metadata
    full = F.concat_ws("\n\n", F.when(F.col("sme_description") != "", F.col("sme_description")), F.when(F.col("long_description") != "", F.col("long_description")))
    return {"minimal": F.coalesce("short_description", F.lit("")), "maximal": F.coalesce("long_description", F.lit("")), "full": full}[kind]


def _norm(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def variant_fields(variant: str, metadata: DataFrame, focused: DataFrame | None) -> DataFrame:
    """(table_name, column_name, place, semantic_score, lexical_score): the focused fields in order, or all fields of the metadata, keys lower-cased."""
    if variant.startswith("focused_"):
        if focused is None or focused.isEmpty():
            raise ValueError(f"{variant} needs focused fields")
        return focused.select(*_KEY, F.col("position").alias("place"), "semantic_score", "lexical_score")
    none = F.lit(None).cast("double")
    return metadata.select(_norm("table_name").alias("table_name"), _norm("column_name").alias("column_name"), F.col("ordinal").alias("place"), none.alias("semantic_score"), none.alias("lexical_score")).distinct()


def schema_text(variant: str, fields: DataFrame, metadata: DataFrame, with_scores: bool = False) -> DataFrame:
    """One row (variant, text): tables by name, their fields in place order with the variant's description; unknown fields without one."""
    m = metadata.select(_norm("table_name").alias("kt"), _norm("column_name").alias("kc"), described(metadata, profile_kind(variant)).alias("about")).dropDuplicates(["kt", "kc"])
    f = fields.join(m, (_norm("table_name") == F.col("kt")) & (_norm("column_name") == F.col("kc")), "left")
    score = F.lit("")
    if with_scores and variant.startswith("focused_"):
        parts = F.concat_ws(", ", F.when(F.col("semantic_score").isNotNull(), F.format_string("semantic=%.2f", "semantic_score")), F.when(F.col("lexical_score").isNotNull(), F.format_string("lexical=%.2f", "lexical_score")))
        score = F.when(parts != "", F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise("")
    line = F.concat(F.lit("  - "), "column_name", score, F.when(F.coalesce("about", F.lit("")) != "", F.concat(F.lit(": "), "about")).otherwise(""))
    t = f.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "column_name", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    block = F.concat(F.lit("Table: "), "table_name", F.lit("\n"), "lines", F.lit("\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_name", block.alias("b")))), lambda x: x["b"]), "\n")
    return t.agg(F.concat(F.lit(f"=== Schema ({variant}) ===\n\n"), body).alias("text")).select(F.lit(variant).alias("variant"), "text")


def compact_text(fields: DataFrame, prefix: str = "", opening: str = ": ", closing: str = "") -> DataFrame:
    """One row (text): a line for each table with its columns, both by name. ``# T (a, b)`` with prefix ``# `` and parentheses."""
    t = fields.select(*_KEY).distinct().groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list("column_name")), ", ").alias("c"))
    line = F.concat(F.lit(prefix), "table_name", F.lit(opening), "c", F.lit(closing))
    return t.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_name", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def context_text(fields: DataFrame) -> DataFrame:
    return compact_text(fields, "# ", " (", ")")


def schema_map(metadata: DataFrame) -> DataFrame:
    """(table_name, columns): the set of columns of each table, by name."""
    return metadata.groupBy("table_name").agg(F.array_sort(F.collect_set("column_name")).alias("columns"))


def enrich(metadata: DataFrame, sme: DataFrame) -> DataFrame:
    """Metadata with the expert description of the same table and column, names compared as they stand."""
    s = sme.select(*_KEY, F.col("description").alias("sme_description"), F.col("source").alias("sme_source"))
    return metadata.drop("sme_description", "sme_source").join(s, _KEY, "left")


def csv_first(csv: DataFrame, json: DataFrame) -> DataFrame:
    """Expert descriptions of the CSV files; JSON ones fill the gaps."""
    return csv.unionByName(json.join(csv.select(*_KEY), _KEY, "left_anti"))


def new_fields(fields: DataFrame, already: DataFrame) -> DataFrame:
    """The fields not yet shown."""
    return fields.select(*_KEY).distinct().join(already.select(*_KEY), _KEY, "left_anti")


def all_fields(*parts: DataFrame) -> DataFrame:
    """The union of field sets."""
    out = parts[0].select(*_KEY)
    for p in parts[1:]:
        out = out.unionByName(p.select(*_KEY))
    return out.distinct()


def augment(schema: str, fields: list[tuple[str, str]], descriptions: dict[tuple[str, str], str] | None = None) -> str:
    """A schema text with further fields under their own heading, tables and columns by name; unchanged without any."""
    if not fields:
        return schema
    by: dict[str, list[str]] = {}
    for t, c in sorted(set(fields)):
        about = (descriptions or {}).get((t.lower().strip(), c.lower().strip()), "")
        by.setdefault(t, []).append(f"  - {c}" + (f": {about}" if about else ""))
    lines = [x for t, cs in by.items() for x in (f"Table: {t}", *cs, "")]
    return schema.rstrip("\n") + "\n\n=== Additional fields ===\n\n" + "\n".join(lines)
