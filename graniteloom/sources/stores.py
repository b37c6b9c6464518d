"""Parquet stores: keyed upserts, job log, description cache, vector and example stores, JSON-lines log."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a store's finished versions. A version is a folder ``path/v<number>``; Spark's _SUCCESS file, written last, makes it count."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    return sorted(n for n in found if fs.exists(_fs(spark, f"{path}/v{n}/_SUCCESS")[0]))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store's newest version; a store that is not there raises FileNotFoundError."""
    v = versions(spark, path)
    if not v:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{v[-1]}")


def replace(spark: SparkSession, path: str, rows: DataFrame, version: int | None = None) -> DataFrame:
    """Write ``rows`` (which may come from the store itself) as its next version: readers see the old state or the new one, at any time, and nothing is renamed.

    The version before is kept for those who still read it, older ones go.
    """
    v = versions(spark, path)
    n = version if version is not None else v[-1] + 1 if v else 1
    rows.write.mode("overwrite").parquet(f"{path}/v{n}")
    for old in v[:-1]:
        drop_store(spark, f"{path}/v{old}")
    return spark.read.parquet(f"{path}/v{n}")


def upserted(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` by key; columns in ``keep`` stay as they were where the key is known. Keys are unique on either side."""
    o = old.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in keep], F.lit(True).alias("_known"))
    n = new.join(o, new[key] == F.col("_k"), "left")
    n = n.select(*[F.when(F.col("_known"), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in new.columns])
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(n)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Upsert into a Parquet store, which is made if absent; the new state replaces the old one whole, as a version of its own."""
    return replace(spark, path, upserted(read_store(spark, path), new, key, keep) if versions(spark, path) else new)


def truncate(spark: SparkSession, *paths: str) -> None:
    """Empty stores, children before their parents; the schema stays."""
    for p in paths:
        if versions(spark, p):
            replace(spark, p, read_store(spark, p).limit(0))


def ingestion_status(errors: Column, children: Column) -> Column:
    """completed without errors; partial if children came of it; else failed."""
    return F.when(F.coalesce(F.size(errors), F.lit(0)) <= 0, "completed").when(children > 0, "partial").otherwise("failed")


def log_job(spark: SparkSession, path: str, job_id: str, source_file: str, status: str, at: str, error: str | None = None, **totals: int) -> None:
    """Append a job's state (started, completed, partial, failed)."""
    row = [(job_id, source_file, status, at, error, totals.get("parents"), totals.get("children"))]
    spark.createDataFrame(row, "job_id string, source_file string, status string, at string, error_message string, total_parents int, total_children int").coalesce(1).write.mode("append").parquet(path)


def latest_jobs(log: DataFrame) -> DataFrame:
    """One row per job: its latest state."""
    cols = [c for c in log.columns if c != "job_id"]
    return log.groupBy("job_id").agg(F.max_by(F.struct(*cols), "at").alias("r")).select("job_id", "r.*")


def cache_key(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``cache_key``: the md5 of the columns as canonical JSON, by name."""
    return df.withColumn("cache_key", F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})))


def cached(df: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, missing) of rows with a cache_key: known ones come with the cached ``description``."""
    return df.join(cache.select("cache_key", "description"), "cache_key"), df.join(cache.select("cache_key"), "cache_key", "left_anti")


def save_vectors(df: DataFrame, path: str, model: str, dim: int) -> None:
    """A vector store with its model and dimension beside it."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/vectors")
    spark.createDataFrame([(model, dim)], "model string, dim int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_vectors(spark: SparkSession, path: str, model: str, dim: int) -> DataFrame | None:
    """The store if it is there and of this model and dimension, else None."""
    try:
        about = spark.read.parquet(f"{path}/about").first()
        return spark.read.parquet(f"{path}/vectors") if about and (about["model"], about["dim"]) == (model, dim) else None
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def drop_store(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


LOG_SCHEMA = "timestamp timestamp, type string, query string, scores map<string,double>, selected_path string, reasoning string, path string, success boolean, answer_length int, has_error boolean, message string, context map<string,string>, tool_name string, latency_ms double"


def field_of(obj: Any, name: str, default: Any = None) -> Any:
    """An attribute or dictionary entry, else the default."""
    if obj is None:
        return default
    if isinstance(obj, dict):
        return obj.get(name, default)
    return getattr(obj, name, default)


def result_entry(timestamp: str, query: str, path: str, result: Any) -> dict:
    """A result event; ``has_error`` is set by any error that is not None, an empty one too."""
    answer = field_of(result, "answer", "") or ""
    return {"timestamp": timestamp, "type": "result", "query": query, "path": path, "success": field_of(result, "success", True), "answer_length": len(answer), "has_error": field_of(result, "error") is not None}


def append_entry(folder: str, entry: dict) -> str:
    """Append one event to the day's JSON-lines file of a local folder."""
    os.makedirs(folder, exist_ok=True)
    name = os.path.join(folder, f"router_{entry['timestamp'][:10].replace('-', '')}.jsonl")
    with open(name, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, ensure_ascii=False) + "\n")
    return name


def append_entries(df: DataFrame, path: str) -> None:
    """Append events in bulk, a folder for each day."""
    df.withColumn("day", F.date_format("timestamp", "yyyyMMdd")).write.mode("append").partitionBy("day").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def path_statistics(log: DataFrame) -> DataFrame:
    """(path, decisions, results, successes, errors): what the log says of each path."""
    d = log.where("type = 'routing_decision'").groupBy(F.col("selected_path").alias("path")).agg(F.count("*").alias("decisions"))
    r = log.where("type = 'result'").groupBy("path").agg(F.count("*").alias("results"), F.sum(F.col("success").cast("bigint")).alias("successes"), F.sum(F.col("has_error").cast("bigint")).alias("errors"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.join(r, "path", "full_outer").select("path", z("decisions"), z("results"), z("successes"), z("errors"))
