"""Databases as catalogs of tables: describe, sample, count, run SQL with parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str
    nullable: bool
    primary_key: bool = False
    foreign_key: str | None = None


@dataclass(frozen=True)
class TableInfo:
    name: str
    columns: list[ColumnInfo]
    row_count: int | None = None


@dataclass
class Database:
    """Named tables of one session. Keys are not in a Parquet schema, so they are given: primary (table to columns), foreign ((table, column) to ``table.column``)."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    primary: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: dict[tuple[str, str], str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def _get(self, name: str) -> tuple[str, DataFrame]:
        for n, df in self.tables.items():
            if n.lower() == name.lower():
                return n, df
        raise ValueError(f"no table {name}")

    def table_names(self) -> list[str]:
        return sorted(self.tables)

    def describe(self, name: str, count: bool = True, upper: bool = False) -> TableInfo:
        """Columns with keys and, if asked, the row count; ``upper`` gives names as an upper-casing catalog does."""
        n, df = self._get(name)
        up = str.upper if upper else str
        pk = {c.lower() for c in self.primary.get(n, ())}
        fk = {c.lower(): t for (tab, c), t in self.foreign.items() if tab.lower() == n.lower()}
        cols = [ColumnInfo(up(f.name), f.dataType.simpleString(), f.nullable, f.name.lower() in pk, fk.get(f.name.lower())) for f in df.schema.fields]
        return TableInfo(up(n), cols, df.count() if count else None)

    def sample(self, name: str, column: str, limit: int = 10) -> DataFrame:
        """(value): ``limit`` distinct non-null values in order."""
        _, df = self._get(name)
        return df.select(F.col(f"`{column}`").alias("value")).where("value is not null").distinct().orderBy("value").limit(limit)

    def row_count(self, name: str) -> DataFrame:
        return self._get(name)[1].agg(F.count("*").alias("row_count"))

    def run(self, sql: str, **parameters) -> DataFrame:
        """A statement with named parameters (``:name``)."""
        return self.spark.sql(sql, args=parameters) if parameters else self.spark.sql(sql)

    def rows(self, sql: str, limit: int = 1000, **parameters) -> list[dict]:
        """The first ``limit`` rows as dictionaries, for showing."""
        return [r.asDict() for r in self.run(sql, **parameters).limit(limit).collect()]


def parquet(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The Parquet tables of a folder; names of a local folder can be found, those of a remote one are given."""
    names = names or sorted(p.name[: -len(".parquet")] for p in Path(folder).iterdir() if p.name.endswith(".parquet"))
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def jdbc(spark: SparkSession, url: str, names: list[str], partition: dict[str, tuple[str, int, int, int]] | None = None, **options: str) -> dict[str, DataFrame]:
    """JDBC tables; ``partition`` (table to column, low, high, number) reads one in parallel ranges."""
    out = {}
    for n in names:
        r = spark.read.format("jdbc").option("url", url).option("dbtable", n).options(**options)
        if partition and n in partition:
            c, lo, hi, k = partition[n]
            r = r.option("partitionColumn", c).option("lowerBound", lo).option("upperBound", hi).option("numPartitions", k)
        out[n] = r.load()
    return out


def connect(spark: SparkSession, where: str, kind: str = "parquet", **options) -> Database:
    """A database by kind: parquet (a folder) or jdbc (a url with ``names``); any other kind is an error."""
    if kind == "parquet":
        return Database(spark, parquet(spark, where, options.get("names")))
    if kind == "jdbc":
        return Database(spark, jdbc(spark, where, **options))
    raise ValueError(f"unknown kind of database: {kind}")
