"""Expert descriptions of columns: CSV files, one for each table, and a JSON catalog."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.operators.linking import csv_first

_FIELDS = ("column_name", "original_column_name", "column_description", "value_description")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) of CSV files to (table_name, column_name, description), each file by its own header."""
    for batch in batches:
        out: dict[tuple[str, str], str] = {}
        for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                text = body.decode("utf-8-sig")
            except UnicodeDecodeError:
                continue
            table = path.rsplit("/", 1)[-1].removesuffix(".csv")
            for row in csv.DictReader(io.StringIO(text, newline="")):
                name, original, about, values = ((row.get(c) or "").strip() for c in _FIELDS)
                full = ". ".join(x for x in (about, values) if x)
                if (name or original) and full:
                    out[table, name or original] = full
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out]), pa.array([k[1] for k in out]), pa.array(list(out.values()))], ["table_name", "column_name", "description"])


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, column_name, description, source) of ``path/*.csv``; the file name is the table.

    The column is column_name, else original_column_name; the description joins column_description and value_description. Rows without either are left out,
    of a column that stands twice in a file the last row counts, files that are not UTF-8 give none. Columns may stand in another order in each file.
    """
    files = spark.read.format("binaryFile").load(f"{path}/*.csv").select("path", "content")
    return files.mapInArrow(_described, "table_name string, column_name string, description string").withColumn("source", F.lit("csv"))


def from_json(spark: SparkSession, path: str, db: str) -> DataFrame:
    """The same of a JSON array of databases (db_id, table_names_original, column_names_original, column_descriptions by column number); the star column and unknown tables are left out."""
    schema = "db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_descriptions map<string,string>"
    r = spark.read.schema(schema).option("multiLine", True).json(path).where(F.col("db_id") == db)
    c = r.select("table_names_original", "column_descriptions", F.posexplode("column_names_original").alias("i", "c"))
    at = F.col("c")[0].cast("int")
    c = c.where((at >= 0) & (at < F.size("table_names_original")))
    about = F.trim(F.coalesce(F.try_element_at("column_descriptions", F.col("i").cast("string")), F.lit("")))
    return c.select(F.get("table_names_original", at).alias("table_name"), F.col("c")[1].alias("column_name"), about.alias("description"), F.lit("json").alias("source")).where("description <> ''")


def load(spark: SparkSession, csv_path: str | None, json_path: str | None, db: str) -> DataFrame:
    """CSV descriptions, gaps filled from JSON; a source that is not there gives none."""
    parts = []
    for f in ((lambda: from_csv(spark, csv_path)) if csv_path else None, (lambda: from_json(spark, json_path, db)) if json_path else None):
        try:
            parts.append(f() if f else None)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            parts.append(None)
    empty = spark.createDataFrame([], "table_name string, column_name string, description string, source string")
    return csv_first(parts[0] if parts[0] is not None else empty, parts[1] if parts[1] is not None else empty)


def of_field(descriptions: DataFrame, table: str, column: str) -> DataFrame:
    return descriptions.where((F.col("table_name") == table) & (F.col("column_name") == column))
