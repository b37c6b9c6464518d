"""Column quality by load against a plain version, with hard rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from graniteloom.operators import load_profile as L

ROWS = [
    ("d1", "A1", "5", None),
    ("d1", "A2", "7", ""),
    ("d1", "A1", "12", "  "),
    ("d1", "b-3", "99999999999999999999", "x"),
    ("d1", "A1", "007", "x"),
    ("d2", "A1", "5", "x"),
    ("d2", None, "50", "é9"),
    ("d2", "A1", "5", "x"),
    (None, "A1", "6", "x"),
]
ACCEPTED = [("a", 100, 10, 90, 2, "A1", "A9", [("A1", 60), ("A2", 30)], "AN"), ("item_number", 100, 0, 100, 60, "1", "20", [("5", 3)], None), ("load", 100, 50, 50, 1, "x", "x", [("x", 50)], "A"), ("gone", 1, 0, 1, 1, "x", "x", [("x", 1)], "A")]


def plain_mask(v):
    return "".join("N" if c in "0123456789" else "A" if c.isascii() and c.isalpha() else c for c in v)


@pytest.fixture(scope="module")
def table(spark):
    # a column called load and one called value clash with names used inside
    return spark.createDataFrame(ROWS, "day string, a string, item_number string, load string").withColumn("value", F.lit(1))


@pytest.fixture(scope="module")
def accepted(spark):
    return spark.createDataFrame(ACCEPTED, "column_name string, total_records bigint, null_count bigint, non_null_count bigint, distinct_count bigint, min_value string, max_value string, top_k_values array<struct<value:string,cnt:bigint>>, common_pattern string")


def expected():
    out = set()
    for day in ("d1", "d2", None):
        rows = [r for r in ROWS if r[0] == day]
        for name, total, null, non, dc, lo, hi, top, pat in ACCEPTED:
            if name == "gone":
                continue
            vs = [r[{"a": 1, "item_number": 2, "load": 3}[name]] for r in rows]
            ok = [v for v in vs if v is not None and v.strip(" ")]
            if (len(vs) - len(ok)) / len(vs) - null / total > 0.05:
                out.add((day, name, "null_rate"))
            if dc <= 50 and abs(len(set(ok)) - dc) > dc / 2:
                out.add((day, name, "distinct"))
            d = [int(v) for v in ok if v.isascii() and v.isdigit()]
            if name == "item_number" and d and sum(not int(lo) <= x <= int(hi) for x in d) / len(d) > 0.01:
                out.add((day, name, "range"))
            if pat and ok and sum(plain_mask(v) != pat for v in ok) / len(ok) > 0.02:
                out.add((day, name, "pattern"))
            if dc <= 10 and ok:
                c, t = Counter(ok), dict(top)
                if sum(abs(c[k] / len(ok) - t.get(k, 0) / non) for k in {*c, *t}) / 2 > 0.2:
                    out.add((day, name, "distribution"))
    return out


def test_departures(table, accepted):
    assert set(map(tuple, L.departures(table, accepted, "day").collect())) == expected()


def test_departures_of_nothing(table, accepted):
    assert L.departures(table.limit(0), accepted, "day").count() == 0
    assert L.departures(table, accepted.limit(0), "day").columns == ["day", "column_name", "finding"]


def test_profile(table):
    p = {(r["day"], r["column_name"]): r for r in L.profile(table, "day").collect()}
    assert len(p) == 3 * 4
    r = p["d1", "load"]
    assert (r["total_records"], r["null_count"], r["distinct_count"], r["common_pattern"]) == (5, 3, 1, "A")
    assert [tuple(x) for x in p["d1", "a"]["top_k_values"]] == [("A1", 3), ("A2", 1), ("b-3", 1)]
    assert p["d1", "a"]["common_pattern"] == "AN"
    assert p[None, "item_number"]["min_value"] == "6"
    assert L.profile(table.limit(0), "day").count() == 0


def test_profile_of_missing_values(spark):
    r = L.profile(spark.createDataFrame([("d", None), ("d", " ")], "day string, v string"), "day").first()
    assert (r["null_count"], r["distinct_count"], r["min_value"], r["top_k_values"], r["common_pattern"]) == (2, 0, None, [], None)


def test_divergence(table):
    d = {(r["day"], r["column_name"]): r["divergence"] for r in L.mask_divergence(table, "day").collect()}
    assert d["d2", "a"] == pytest.approx(0.2) and d["d2", "value"] == 0.0


def test_hot_load(spark):
    """A load and a value that hold nearly all rows."""
    df = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, "d2").otherwise("d1").alias("day"), F.lit("A1").alias("a"))
    r = {x["day"]: x for x in L.profile(df, "day").collect()}
    assert (r["d1"]["total_records"], r["d1"]["distinct_count"], r["d2"]["total_records"]) == (19_600, 1, 400)


def test_rare_masks(table):
    """Each value of a rare mask by name, a null load included; the sums are those of the profile."""
    got = {(r["day"], r["column_name"], r["mask"], r["mask_rows"], round(r["share"], 9), r["value"], r["n"]) for r in L.rare_masks(table, "day", rare_share=0.3).collect()}
    want = set()
    for day in ("d1", "d2", None):
        for i, name in enumerate(("a", "item_number", "load"), 1):
            vs = [r[i] for r in ROWS if r[0] == day and r[i] is not None and r[i].strip(" ")]
            masks = Counter(map(plain_mask, vs))
            want |= {(day, name, plain_mask(v), masks[plain_mask(v)], round(masks[plain_mask(v)] / len(vs), 9), v, n) for v, n in Counter(vs).items() if masks[plain_mask(v)] < 0.3 * len(vs)}
    assert got == want and want
    p = {(r["day"], r["column_name"]): r for r in L.profile(table, "day", rare_share=0.3).collect()}
    for key, r in p.items():
        mine = [g for g in got if g[:2] == key]
        assert r["rare_masks"] == len({g[2] for g in mine}) and r["rare_mask_rows"] == sum(g[6] for g in mine)
