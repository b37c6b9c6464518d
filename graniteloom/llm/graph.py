"""Connected components of an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteloom.runtime import written

#: Edge lists up to this many (counted) rows are solved by one task; it holds some 10 MB. Longer ones take the distributed rounds.
ONE_TASK_EDGES = 50_000


def connected_components(edges: DataFrame, a: str, b: str, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component): each node of the undirected edges with the least node it can reach.

    Null ends are left out; self-edges make a node of its own component; repeated edges count once; no edges, no rows.
    Long edge lists alternate large-star and small-star rounds (Kiveris et al., 2014): log-many shuffles by node,
    each cut by a written table, with no task or driver holding a component.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = written(e.distinct(), "edges")
    kind = e.schema["u"].dataType
    n = e.count()
    if n <= one_task_edges:
        return e.coalesce(1).mapInArrow(_union_find, f"node {kind.simpleString()}, component {kind.simpleString()}")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = e.where("u != v")
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v"), F.col("m")).union(low.select(F.col("u").alias("v"), "m")).where("v != m").distinct()
        links = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ru, rv = root(up.setdefault(u, u)), root(up.setdefault(v, v))
            if ru != rv:
                up[max(ru, rv)] = min(ru, rv)
    if up:
        keys = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array([root(k) for k in keys], kind)], ["node", "component"])
