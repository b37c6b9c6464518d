"""Every core query against its DuckDB oracle on the smallest tables; those without one must run."""

import pytest

from graniteloom.plans import registry
from tests.compare import connection, duck_rows, spark_rows

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = spark_rows(df)
    if name in ORACLES:
        assert got == duck_rows(con, ORACLES[name], df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_profiles_cover_the_equipment_history(spark, sf):
    """Every column of the main equipment table is profiled and indexed, so a literal can meet its values."""
    from graniteloom.operators import lexical
    from graniteloom.plans import profiles
    from graniteloom.runtime import table

    df = table(spark, sf, "eqp_mode_gen_hist")
    got = [r["column_name"] for r in profiles.profiles(spark, sf).where("table_name = 'eqp_mode_gen_hist'").orderBy("ordinal").collect()]
    assert got == df.columns
    lot = df.where("trim(lot_id) <> ''").agg({"lot_id": "min"}).first()[0]
    hits = lexical.matches(spark.createDataFrame([(lot,)], "literal string"), lexical.index_values(profiles.profiles(spark, sf)), threshold=0.99).collect()
    assert ("eqp_mode_gen_hist", "lot_id") in {(r["table_name"], r["column_name"]) for r in hits}
