"""Session set-up and shared scratch tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def session(app: str = "graniteloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the cluster names it.

    Where that setting is absent a local master (tests, a laptop) makes and sets a local folder; any other raises ValueError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graniteloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder; what is written there is dropped when the driver ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(drop_written)
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, columns stay prunable.

    The files survive the loss of an executor and are dropped by ``freed`` or when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone by now; then remove what is local
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path[len("file://") :], ignore_errors=True)


def freed(*tables: DataFrame) -> None:
    """Remove scratch tables that ``written`` gave and no later table reads."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            _written[:] = [x for x in _written if x[1] != path]
            _remove(t.sparkSession, path)


def drop_written() -> None:
    """Remove every scratch table this driver wrote."""
    while _written:
        _remove(*_written.pop())


def latest(df: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order`` (ties: the greatest whole row)."""
    rest = [c for c in df.columns if c != key]
    if order:
        rest = [order, *[c for c in rest if c != order]]
    return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def package_root() -> str:
    return os.path.dirname(os.path.abspath(__file__))
