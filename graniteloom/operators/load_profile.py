"""Column quality by load: profiles, dominant value masks and departures from an accepted profile.

Every column of a table is unpivoted once into (load, column, value). Values are generalised to a
character-class mask (ASCII digit N, ASCII letter A, all else as it stands). All grouping keys end in a value or a mask,
so a load or a column that holds a third of all rows is combined map-side and spread by value.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graniteloom.runtime import written

_LETTERS, _DIGITS = string.ascii_letters, string.digits


@dataclass(frozen=True)
class Thresholds:
    """Limits of ``departures``; the defaults are the ones of the stated problem."""

    null_rate: float = 0.05
    distinct_upto: int = 50
    distinct_share: float = 0.5
    range_columns: tuple[str, ...] = ("item_number", "prod_order_number", "status_d")
    range_share: float = 0.01
    pattern_share: float = 0.02
    distribution_upto: int = 10
    distribution: float = 0.2


def mask(c: Column) -> Column:
    """The character-class mask of a string column."""
    return F.translate(c, _DIGITS + _LETTERS, "N" * len(_DIGITS) + "A" * len(_LETTERS))


def missing(c: Column) -> Column:
    """Null, empty, or only spaces."""
    return c.isNull() | (F.trim(c) == "")


def _profiled(df: DataFrame, load: str, columns: list[str] | None) -> list[str]:
    return [c for c in (columns or df.columns) if c != load]


def unpivot(df: DataFrame, load: str, columns: list[str] | None = None) -> DataFrame:
    """(load, column_name, value): one row for each value, as string; a null load stays a load of its own."""
    cols = _profiled(df, load, columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    return df.select(F.col(f"`{load}`").cast("string").alias("load"), F.explode(cells).alias("c")).select("load", "c.column_name", "c.value")


def value_counts(df: DataFrame, load: str, columns: list[str] | None = None) -> DataFrame:
    """(load, column_name, value, n): missing values are one row with a null value."""
    u = unpivot(df, load, columns)
    return u.withColumn("value", F.when(~missing(F.col("value")), F.col("value"))).groupBy("load", "column_name", "value").agg(F.count("*").alias("n"))


def mask_counts(df: DataFrame, load: str, columns: list[str] | None = None) -> DataFrame:
    """(load, column_name, mask, n) over the values that are not missing."""
    u = unpivot(df, load, columns).where(~missing(F.col("value")))
    return u.groupBy("load", "column_name", mask(F.col("value")).alias("mask")).agg(F.count("*").alias("n"))


def profile(df: DataFrame, load: str, columns: list[str] | None = None, top_k: int = 10, rare_share: float = 0.01) -> DataFrame:
    """One row per load and column: counts, range, ``top_k`` values, dominant mask and its rare rivals.

    ``top_k_values`` orders by count, then value. ``common_pattern`` is the most frequent mask (ties: the smallest) and
    ``pattern_share`` its share; ``rare_masks`` and ``rare_mask_rows`` count masks below ``rare_share``. A column whose values are all missing has null
    range, pattern and an empty top list. An empty table gives no rows. Columns of any type are compared as strings.
    """
    # one scan: the counts by value serve every part of the profile
    v = written(value_counts(df, load, columns).withColumn("mask", mask(F.col("value"))), "values")
    by = ["load", "column_name"]
    sums = v.groupBy(*by).agg(
        F.sum("n").alias("total_records"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
    )
    # row_number <= k is cut before the shuffle (window group limit), so no task sees all values of one column
    w = W.Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("value"))
    top = (
        v.where(F.col("value").isNotNull())
        .withColumn("r", F.row_number().over(w))
        .where(F.col("r") <= top_k)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("r", "value", "n"))).alias("t"))
        .select(*by, F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("cnt"))).alias("top_k_values"))
    )
    m = v.where(F.col("mask").isNotNull()).groupBy(*by, "mask").agg(F.sum("n").alias("n"))
    tot = _renamed(sums.select(*by, (F.col("total_records") - F.col("null_count")).alias("non_null")))
    m = m.join(tot, _same()).drop("_load", "_column")
    pats = m.groupBy(*by).agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("mask"))).alias("best"),
        F.max(F.col("n") / F.col("non_null")).alias("pattern_share"),
        F.count(F.when(F.col("n") < rare_share * F.col("non_null"), 1)).alias("rare_masks"),
        F.coalesce(F.sum(F.when(F.col("n") < rare_share * F.col("non_null"), F.col("n"))), F.lit(0)).alias("rare_mask_rows"),
    )
    out = sums.join(_renamed(top), _same(), "left").drop("_load", "_column")
    out = out.join(_renamed(pats), _same(), "left").drop("_load", "_column")
    return out.select(
        F.col("load").alias(load),
        "column_name",
        "total_records",
        "null_count",
        (F.col("total_records") - F.col("null_count")).alias("non_null_count"),
        "distinct_count",
        "min_length",
        "max_length",
        "min_value",
        "max_value",
        F.coalesce("top_k_values", F.array().cast("array<struct<value:string,cnt:bigint>>")).alias("top_k_values"),
        F.col("best")["mask"].alias("common_pattern"),
        "pattern_share",
        F.coalesce("rare_masks", F.lit(0)).alias("rare_masks"),
        F.coalesce("rare_mask_rows", F.lit(0)).alias("rare_mask_rows"),
    )


def rare_masks(df: DataFrame, load: str, columns: list[str] | None = None, rare_share: float = 0.01) -> DataFrame:
    """(load, column_name, mask, mask_rows, share, value, n): the values whose mask holds less than ``rare_share`` of its load and column.

    One row per value, so a violation can be looked up; ``n`` counts the rows of the value, ``mask_rows`` those of its mask and
    ``share`` is the mask's. Missing values have no mask. These are the masks that ``profile`` counts as ``rare_masks``.
    """
    v = value_counts(df, load, columns).where(F.col("value").isNotNull()).withColumn("mask", mask(F.col("value")))
    v = written(v, "values")
    m = v.groupBy("load", "column_name", "mask").agg(F.sum("n").alias("mask_rows"))
    tot = _renamed(m.groupBy("load", "column_name").agg(F.sum("mask_rows").alias("non_null")))
    rare = m.join(tot, _same()).where(F.col("mask_rows") < rare_share * F.col("non_null"))
    rare = rare.select(F.col("load").alias("_load"), F.col("column_name").alias("_column"), F.col("mask").alias("_mask"), "mask_rows", (F.col("mask_rows") / F.col("non_null")).alias("share"))
    out = v.join(rare, _same() & (F.col("mask") == F.col("_mask")))
    return out.select(F.col("load").alias(load), "column_name", "mask", "mask_rows", "share", "value", "n")


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"load": "_load", "column_name": "_column"})


def _same() -> Column:
    return F.col("load").eqNullSafe(F.col("_load")) & (F.col("column_name") == F.col("_column"))


def mask_divergence(df: DataFrame, load: str, columns: list[str] | None = None) -> DataFrame:
    """(load, previous_load, column_name, divergence): half the sum of mask-share differences to the load before.

    Loads are compared in string order; the first load and loads in which a column has no values give no row for it.
    """
    m = written(mask_counts(df, load, columns).where(F.col("load").isNotNull()), "masks")
    loads = df.select(F.col(f"`{load}`").cast("string").alias("load")).where(F.col("load").isNotNull()).groupBy("load").count()
    # one row per load: loads are batches, far fewer than rows
    order = loads.select("load", F.lag("load").over(W.Window.orderBy("load")).alias("prev")).where(F.col("prev").isNotNull())
    tot = m.groupBy("load", "column_name").agg(F.sum("n").alias("t"))
    s = m.join(tot, ["load", "column_name"]).select("load", "column_name", "mask", (F.col("n") / F.col("t")).alias("share"))
    now = s.join(order, "load").select(F.col("load"), F.col("prev"), "column_name", "mask", "share", F.lit(0.0).alias("before"))
    old = s.join(order, s["load"] == order["prev"]).select(order["load"], "prev", "column_name", "mask", F.lit(0.0).alias("share"), F.col("share").alias("before"))
    both = now.unionByName(old).groupBy("load", "prev", "column_name", "mask").agg(F.sum("share").alias("a"), F.sum("before").alias("b"))
    g = both.groupBy("load", "prev", "column_name").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), (F.sum(F.abs(F.col("a") - F.col("b"))) / 2).alias("d"))
    return g.where((F.col("sa") > 0) & (F.col("sb") > 0)).select(F.col("load").alias(load), F.col("prev").alias("previous_load"), "column_name", F.round("d", 6).alias("divergence"))


def departures(df: DataFrame, accepted: DataFrame, load: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """(load, column_name, finding): where a load departs from the ``accepted`` profile (one row per column).

    Findings are null_rate, distinct, range, pattern and distribution, as ``Thresholds`` bounds them. Columns absent from either side give
    no finding. Shares over no values are 0, so a column without values can only depart in null_rate and distinct.
    ``accepted`` is schema-sized (a row for each column of ``df``), so it is read by the driver and becomes part of the plan.

    One unpivot and one aggregation serve all findings: its key is the mask, plus the value only in columns for
    which the accepted profile counts few values.
    """
    have = {c.lower(): c for c in df.columns if c != load}
    want = [r.asDict(recursive=True) for r in accepted.where(F.lower("column_name").isin(list(have))).collect()]
    want = [r | {"column_name": have[r["column_name"].lower()]} for r in want]
    spark = df.sparkSession
    empty = spark.createDataFrame([], f"`{load}` string, column_name string, finding string")
    if not want:
        return empty
    cols = [r["column_name"] for r in want]
    few = [r["column_name"] for r in want if (r["distinct_count"] or 0) <= max(limits.distinct_upto, limits.distribution_upto)]
    spans = {r["column_name"]: (int(r["min_value"]), int(r["max_value"])) for r in want if r["column_name"] in limits.range_columns and str(r["min_value"]).isascii() and str(r["min_value"]).isdigit() and str(r["max_value"]).isascii() and str(r["max_value"]).isdigit()}

    def cell(c: str) -> Column:
        v = F.col(f"`{c}`").cast("string")
        if c in spans:
            lo, hi = spans[c]
            num = v.rlike("^[0-9]+$")
            # compared as digit strings without leading zeros: no overflow for numbers of any length
            bare = F.regexp_replace(v, "^0+(?=[0-9])", "")

            def below(a: Column, b: str) -> Column:
                return (F.length(a) < len(b)) | ((F.length(a) == len(b)) & (a < F.lit(b)))

            out = below(bare, str(lo)) | (~below(bare, str(hi)) & (bare != F.lit(str(hi))))
            digit = F.when(num, F.when(out, F.lit(2)).otherwise(F.lit(1))).otherwise(F.lit(0))
        else:
            digit = F.lit(0)
        return F.struct(F.lit(c).alias("column_name"), v.alias("v"), (v if c in few else F.lit(None).cast("string")).alias("kept"), digit.cast("int").alias("digit"))

    u = df.select(F.col(f"`{load}`").cast("string").alias("load"), F.explode(F.array(*[cell(c) for c in cols])).alias("c")).select("load", "c.*")
    gone = missing(F.col("v"))
    g = u.groupBy("load", "column_name", F.when(~gone, mask(F.col("v"))).alias("mask"), F.when(~gone, F.col("kept")).alias("kept"), F.when(~gone, F.col("digit")).otherwise(F.lit(0)).alias("digit")).agg(F.count("*").alias("n"))

    # a few thousand rows for a load; read by both branches below, so the table itself is scanned once
    g = written(g, "cells")
    by_col = F.create_map(*[x for r in want for x in (F.lit(r["column_name"]), F.lit(r["common_pattern"]))])
    pattern = F.element_at(by_col, F.col("column_name"))
    shares = {(r["column_name"], t["value"]): t["cnt"] / r["non_null_count"] for r in want if (r["distinct_count"] or 0) <= limits.distribution_upto and r["non_null_count"] for t in (r["top_k_values"] or [])}
    # values of the accepted profile join as rows (at most distribution_upto for each column)
    known = spark.createDataFrame([(c, v, float(s)) for (c, v), s in shares.items()] or [("", "", 0.0)], "column_name string, kept string, share double")

    there = F.col("mask").isNotNull()
    sums = g.groupBy("load", "column_name").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("present"),
        F.coalesce(F.sum(F.when(there & (F.col("mask") == pattern), F.col("n"))), F.lit(0)).alias("fits"),
        F.coalesce(F.sum(F.when(F.col("digit") > 0, F.col("n"))), F.lit(0)).alias("digits"),
        F.coalesce(F.sum(F.when(F.col("digit") == 2, F.col("n"))), F.lit(0)).alias("outside"),
        F.count("kept").alias("values"),  # a value has one mask and one digit class: keys are distinct values
    )
    vals = g.where(F.col("kept").isNotNull()).select("load", "column_name", "kept", "n")
    part = vals.join(known, ["column_name", "kept"], "left").join(sums.select(F.col("load").alias("l2"), F.col("column_name").alias("c2"), "present"), F.col("load").eqNullSafe(F.col("l2")) & (F.col("column_name") == F.col("c2")))
    # sum |a - b| over either side = (1 - profile mass seen) + sum over seen values
    dist = part.groupBy("load", "column_name").agg(F.sum(F.abs(F.col("n") / F.col("present") - F.coalesce("share", F.lit(0.0)))).alias("seen"), F.sum(F.coalesce("share", F.lit(0.0))).alias("mass"))
    d2 = dist.select(F.col("load").alias("l3"), F.col("column_name").alias("c3"), "seen", "mass")
    s = sums.join(d2, F.col("load").eqNullSafe(F.col("l3")) & (F.col("column_name") == F.col("c3")), "left")

    def const(f) -> Column:
        return F.element_at(F.create_map(*[x for r in want for x in (F.lit(r["column_name"]), F.lit(f(r)).cast("double"))]), F.col("column_name"))

    rate = const(lambda r: (r["null_count"] or 0) / r["total_records"] if r["total_records"] else 0.0)
    dc = const(lambda r: r["distinct_count"] if r["distinct_count"] is not None else -1)
    all_mass = const(lambda r: sum(v for (c, _), v in shares.items() if c == r["column_name"]))
    present = F.col("present")
    diff = (F.coalesce("seen", F.lit(0.0)) + all_mass - F.coalesce("mass", F.lit(0.0))) / 2
    tests = {
        "null_rate": (F.col("total") - present) / F.col("total") - rate > limits.null_rate,
        "distinct": (dc >= 0) & (dc <= limits.distinct_upto) & (F.abs(F.col("values") - dc) > limits.distinct_share * dc),
        "range": F.col("column_name").isin(list(spans) or [""]) & (F.col("outside") > limits.range_share * F.col("digits")),
        "pattern": pattern.isNotNull() & (present - F.col("fits") > limits.pattern_share * present),
        "distribution": (dc >= 0) & (dc <= limits.distribution_upto) & (present > 0) & (F.round(diff, 12) > limits.distribution),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return s.select(F.col("load").alias(load), "column_name", F.explode(found).alias("finding"))
