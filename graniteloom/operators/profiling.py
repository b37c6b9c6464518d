"""Profiles of columns and tables, and what follows from them: types, patterns, keys, index-worthiness.

A table is read by one aggregate over all its columns and one grouped pass over its unpivoted values, whatever the number of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import window as W

# SQL types that count as numeric or as text by a token of their name, and how dates begin.
NUMERIC_TYPES = ("INT", "INTEGER", "SMALLINT", "BIGINT", "TINYINT", "REAL", "FLOAT", "DOUBLE", "NUMERIC", "DECIMAL")
TEXT_TYPES = ("TEXT", "CHAR", "CLOB", "VARCHAR", "STRING")
DATES = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{4}/\d{2}/\d{2})"


def _name(t: ST.DataType) -> str:
    return t.simpleString().upper()


def _text(c: Column, t: ST.DataType) -> Column:
    """A value as profiles show it; doubles without an exponent, whole ones without a fraction."""
    if isinstance(t, (ST.DoubleType, ST.FloatType)):
        return F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"\.?0+$", "")
    if isinstance(t, (ST.TimestampType, ST.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ordinal, column_name, data_type, value): every scalar cell as text."""
    scalar = [f for f in df.schema.fields if not isinstance(f.dataType, (ST.ArrayType, ST.MapType, ST.StructType))]
    use = [(i, f) for i, f in enumerate(scalar) if columns is None or f.name in columns]
    parts = [F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"), F.lit(_name(f.dataType)).alias("data_type"), _text(F.col(f"`{f.name}`"), f.dataType).alias("value")) for i, f in use]
    return df.select(F.explode(F.array(*parts)).alias("c")).select("c.*")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ordinal, column_name, data_type, value, n), nulls as one row of value null."""
    return cells(df, columns).groupBy("ordinal", "column_name", "data_type", "value").agg(F.count("*").alias("n"))


def pattern(values: Column) -> Column:
    """The common shape of an array of strings of equal length (letters A, digits N), else null."""
    shape = F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(v, r"\p{L}", "A"), r"\p{Nd}", "N"))
    return F.when((F.size(values) > 0) & (F.size(F.array_distinct(shape)) == 1) & (F.size(F.array_distinct(F.transform(values, F.length))) == 1), shape[0])


def column_profiles(df: DataFrame, table_name: str, columns: list[str] | None = None, top_k: int = 10, samples: int = 100, indexed: int = 10_000) -> DataFrame:
    """The profiles of one table; see ``profile_cells``."""
    return profile_cells(cells(df, columns).withColumn("table_name", F.lit(table_name)), top_k, samples, indexed)


def profile_cells(unpivoted: DataFrame, top_k: int = 10, samples: int = 100, indexed: int = 10_000) -> DataFrame:
    """One row per column of (table_name, ordinal, column_name, data_type, value): counts, range, lengths, top values, samples, values for the lexical index, kind and shape.

    Samples are the first ``samples`` distinct values in order. Numeric: over 0.8 of the first 50 samples are numbers; if then any value is none, the
    column counts as text. Dates: over 0.8 of them begin like a date. The shape is over the first 20. Lengths only for text. A table without rows gives no rows.
    """
    by = ["table_name", "ordinal", "column_name", "data_type"]
    # counted once: the exchange below serves all three uses
    v = unpivoted.groupBy(*by, "value").agg(F.count("*").alias("n")).withColumn("num", F.expr("try_cast(value AS double)"))
    has = F.col("value").isNotNull()
    base = v.groupBy(*by).agg(
        F.sum("n").alias("total_records"),
        F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.min("value").alias("smin"),
        F.max("value").alias("smax"),
        F.min("num").alias("nmin"),
        F.max("num").alias("nmax"),
        (F.count(F.when(has & F.col("num").isNull(), 1)) == 0).alias("all_numbers"),
        F.min(F.length("value")).alias("lmin"),
        F.max(F.length("value")).alias("lmax"),
    )
    # both row numbers are cut before the shuffle (window group limit); no task gets all values of a column
    top = W.Window.partitionBy(*by).orderBy(F.desc("n"), "value")
    first = W.Window.partitionBy(*by).orderBy("value")
    often = v.where(has).withColumn("r", F.row_number().over(top)).where(F.col("r") <= indexed).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("r", "value", "n"))).alias("o"))
    some = v.where(has).withColumn("r", F.row_number().over(first)).where(F.col("r") <= samples).groupBy(*by).agg(F.sort_array(F.collect_list("value")).alias("sample_values"))
    j = base.join(often, by, "left").join(some, by, "left")
    none = F.array().cast("array<string>")
    s50 = F.slice("sample_values", 1, 50)
    share = lambda f: F.size(F.filter(s50, f)) / F.size(s50)
    looks = F.coalesce(share(lambda x: x.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")) > 0.8, F.lit(False))
    numeric = looks & F.col("all_numbers")
    plain = lambda c: F.regexp_replace(F.format_string("%.6f", F.col(c)), r"\.?0+$", "")
    o = F.coalesce("o", F.array().cast("array<struct<r:int,value:string,n:bigint>>"))
    return j.select(
        "table_name",
        "column_name",
        "data_type",
        "ordinal",
        "total_records",
        "null_count",
        (F.col("total_records") - F.col("null_count")).alias("non_null_count"),
        "distinct_count",
        F.when(~numeric, F.col("lmin")).alias("min_length"),
        F.when(~numeric, F.col("lmax")).alias("max_length"),
        F.when(numeric, plain("nmin")).otherwise(F.col("smin")).alias("min_value"),
        F.when(numeric, plain("nmax")).otherwise(F.col("smax")).alias("max_value"),
        F.transform(F.slice(o, 1, top_k), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("cnt"))).alias("top_k_values"),
        F.coalesce("sample_values", none).alias("sample_values"),
        F.transform(o, lambda x: x["value"]).alias("indexed_values"),
        numeric.alias("is_numeric"),
        F.coalesce(share(lambda x: x.rlike(DATES)) > 0.8, F.lit(False)).alias("is_date_like"),
        pattern(F.slice("sample_values", 1, 20)).alias("common_pattern"),
    )


def profile_tables(tables: dict[str, DataFrame], **how) -> DataFrame:
    """The column profiles of several tables, in one pass over the cells of all."""
    out = None
    for name, df in tables.items():
        c = cells(df).withColumn("table_name", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return profile_cells(out, **how)


def profile_new(spark: SparkSession, tables: dict[str, DataFrame], path: str, **how) -> DataFrame:
    """Profiles by checkpoint: columns already stored under ``path`` are not profiled again; new ones are added to it."""
    try:
        done = spark.read.parquet(path)
        known = {(r[0], r[1]) for r in done.select("table_name", "column_name").collect()}  # schema-sized
    except Exception:
        known = set()
    for name, df in tables.items():
        scalar = [f.name for f in df.schema.fields if not isinstance(f.dataType, (ST.ArrayType, ST.MapType, ST.StructType))]
        todo = [c for c in scalar if (name, c) not in known]
        if todo:
            column_profiles(df, name, todo, **how).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def key_candidates(profiles: DataFrame) -> DataFrame:
    """Profiles with is_pk (unique, no nulls, a name with id or key, or pk) and is_fk (no pk; a name that ends in _id, holds fk or begins with ref_)."""
    n = F.lower("column_name")
    unique = (F.col("distinct_count") == F.col("non_null_count")) & (F.col("null_count") == 0)
    pk = unique & (n.contains("id") | n.contains("key") | (n == "pk"))
    fk = ~pk & (n.endswith("_id") | n.contains("fk") | n.startswith("ref_"))
    return profiles.withColumns({"is_pk": pk, "is_fk": fk})


def table_profiles(profiles: DataFrame) -> DataFrame:
    """(table_name, total_records, total_columns, first_column, primary_keys, foreign_keys) in column order."""
    k = key_candidates(profiles)
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c), F.struct("ordinal", "column_name")))), lambda x: x["column_name"])
    return k.groupBy("table_name").agg(F.min_by("total_records", "ordinal").alias("total_records"), F.count("*").alias("total_columns"), F.min_by("column_name", "ordinal").alias("first_column"), names("is_pk").alias("primary_keys"), names("is_fk").alias("foreign_keys"))


def index_worthy(skip_constants: bool = True, skip_ids: bool = False) -> Column:
    """Whether a profiled column goes into the lexical index: it has values, is not one value over 20 rows, and, if asked, is no surrogate id."""
    ok = F.col("distinct_count") > 0
    if skip_constants:
        ok = ok & ~((F.col("distinct_count") == 1) & (F.col("total_records") > 20))
    if skip_ids:
        n = F.lower("column_name")
        surrogate = F.col("is_numeric") & (F.col("distinct_count") >= 0.9 * F.col("total_records")) & (F.col("total_records") >= 1000) & (n.endswith("id") | n.startswith("id_"))
        ok = ok & ~surrogate
    return ok


def numeric_column() -> Column:
    """Declared numeric by a whole token of its type, or observed so and not declared as text."""
    toks = F.regexp_extract_all(F.upper(F.coalesce("data_type", F.lit(""))), F.lit("[A-Z]+"), F.lit(0))
    declared = F.arrays_overlap(toks, F.array(*map(F.lit, NUMERIC_TYPES)))
    return declared | (F.col("is_numeric") & ~F.arrays_overlap(toks, F.array(*map(F.lit, TEXT_TYPES))))


def describe(profiles: DataFrame) -> DataFrame:
    """(table_name, column_name, context): a profile as text, the offline description of a column."""
    k = key_candidates(profiles)
    pct = F.format_string("%.1f", 100.0 * F.col("null_count") / F.greatest("total_records", F.lit(1)))
    top = F.array_join(F.transform(F.slice("top_k_values", 1, 5), lambda t: F.concat(t["value"], F.lit(" ("), t["cnt"].cast("string"), F.lit(")"))), ", ")
    line = F.concat_ws(
        "\n",
        F.concat(F.lit("Column: "), "table_name", F.lit("."), "column_name"),
        F.concat(F.lit("Type: "), "data_type"),
        F.concat(F.lit("Records: "), F.col("total_records").cast("string"), F.lit(" (NULL: "), pct, F.lit("%)")),
        F.concat(F.lit("Distinct: "), F.col("distinct_count").cast("string")),
        F.when(F.col("is_pk"), F.lit("Key: likely primary key")).when(F.col("is_fk"), F.lit("Key: likely foreign key")),
        F.concat(F.lit("Range: "), "min_value", F.lit(" to "), "max_value"),
        F.concat(F.lit("Length: "), F.col("min_length").cast("string"), F.lit(" to "), F.col("max_length").cast("string")),
        F.concat(F.lit("Pattern: "), "common_pattern"),
        F.when(F.size("top_k_values") > 0, F.concat(F.lit("Top values: "), top)),
    )
    return k.select("table_name", "column_name", line.alias("context"))
