"""The k most similar vectors of every vector by a forest of random-projection trees.

All trees of the forest split by medians along random directions, one direction for each tree and level, learnt on a bounded sample. Every vector
is filed in one leaf of each tree. Every vector also searches the forest: all trees share one priority queue of unopened branches, ordered by the
distance to the split planes crossed, and the best leaves are opened. Leaf candidates are then ranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graniteloom.llm.words import mix
from graniteloom.runtime import written


@dataclass(frozen=True)
class Forest:
    """``sample`` bounds the vectors that splits are learnt on; a node with fewer than ``least`` of them splits at its level's median."""

    trees: int = 4
    leaf: int = 192
    probes: int = 16
    sample: int = 16_384
    least: int = 8
    seed: int = 7
    digits: int = 6


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _packed(m: np.ndarray) -> pa.Array:
    """Vectors as bytes: rows move through exchanges without being taken apart."""
    return pa.array([r.tobytes() for r in m], pa.binary())


def _matrix(col: pa.Array, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _usable(batches: Iterator[pa.RecordBatch], dim: int, kind: str) -> Iterator[pa.RecordBatch]:
    """(id, k1, k2, v): vectors of ``dim`` finite numbers that are not all 0, with a key of their direction."""
    import xxhash

    for batch in batches:
        ids, vs = batch.column(0), batch.column(1)
        at, rows = [], []
        for i, v in enumerate(vs):
            if ids[i].is_valid and v.is_valid and len(v) == dim and v.values.null_count == 0:
                at.append(i)
        if not at:
            continue
        part = vs.take(pa.array(at))
        m = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        m = m[ok]
        if not len(m):
            continue
        # scaled first, so that squares neither overflow nor vanish; -0.0 becomes 0.0
        r = np.round(unit(m / np.abs(m).max(axis=1, keepdims=True)), 5) + 0.0
        rows = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in r]
        k1 = pa.array(np.array([k & (2**64 - 1) for k in rows], np.uint64).view(np.int64))
        k2 = pa.array(np.array([k >> 64 for k in rows], np.uint64).view(np.int64))
        keep = pa.array(np.array(at)[ok])
        yield pa.RecordBatch.from_arrays([ids.take(keep), k1, k2, _packed(m.astype(kind))], ["id", "k1", "k2", "v"])


class _Trees:
    """Directions [dim, trees * depth] and, for each tree, the split of each node in level order."""

    def __init__(self, sample: np.ndarray, dim: int, count: int, how: Forest) -> None:
        self.depth = max(0, ceil(log2(max(1, count) / how.leaf)))
        self.trees = how.trees
        rng = np.random.default_rng(how.seed)
        self.ways = rng.standard_normal((dim, self.trees * max(1, self.depth)))
        p = sample @ self.ways
        self.splits: list[list[np.ndarray]] = []
        for t in range(self.trees):
            levels, node = [], np.zeros(len(p), np.int64)
            for d in range(self.depth):
                x = p[:, t * self.depth + d]
                # deeper nodes than the sample can fill all split at the level's median: no table grows past the sample
                if len(p) < (how.least << d):
                    levels.append(np.array([np.median(x) if len(x) else 0.0]))
                else:
                    s = np.full(1 << d, np.median(x))
                    order = np.lexsort((x, node))
                    starts = np.searchsorted(node[order], np.arange((1 << d) + 1))
                    n = np.diff(starts)
                    full = n >= how.least
                    s[full] = x[order][(starts[:-1] + n // 2)[full]]
                    levels.append(s)
                node = node * 2 + (x >= levels[-1][node if len(levels[-1]) > 1 else np.zeros_like(node)])
            self.splits.append(levels)
        # leaves that the sample says to be overfull are worked on in blocks: at most as many as the sample has vectors
        found, n = np.unique(self.leaves(sample), return_counts=True) if len(sample) else (np.empty(0, np.int64), np.empty(0))
        size = n * (count / max(1, len(sample)))
        over = size > 4 * how.leaf
        self.full, self.blocks = found[over], np.ceil(size[over] / (4 * how.leaf)).astype(np.int64)

    def blocks_of(self, leaf: np.ndarray) -> np.ndarray:
        """In how many blocks the vectors of each leaf are worked on."""
        out = np.ones(len(leaf), np.int64)
        if len(self.full):
            at = np.minimum(np.searchsorted(self.full, leaf), len(self.full) - 1)
            hit = self.full[at] == leaf
            out[hit] = self.blocks[at[hit]]
        return out

    def margin(self, p: np.ndarray, t: np.ndarray, d: np.ndarray, node: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.empty(len(t))
        for tree in range(self.trees):
            for level in range(self.depth):
                at = np.nonzero((t == tree) & (d == level))[0]
                if len(at):
                    s = self.splits[tree][level]
                    out[at] = p[row[at], tree * self.depth + level] - (s[node[at]] if len(s) > 1 else s[0])
        return out

    def leaves(self, u: np.ndarray) -> np.ndarray:
        """[n, trees]: the leaf of each vector, numbered over the forest."""
        p = u @ self.ways
        out = np.empty((len(u), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(u), np.int64)
            for d in range(self.depth):
                s = self.splits[t][d]
                node = node * 2 + (p[:, t * self.depth + d] >= (s[node] if len(s) > 1 else s[0]))
            out[:, t] = (t << self.depth) + node
        return out

    def search(self, u: np.ndarray, probes: int) -> np.ndarray:
        """[n, probes]: the leaves that a queue shared by all trees opens first; -1 where the forest has fewer.

        All searches advance together: each round every search takes its best open branch and follows it to a leaf, leaving the
        branches it did not take in its queue with the largest distance crossed so far.
        """
        n, p = len(u), u @ self.ways
        probes = min(probes, self.trees << self.depth)
        cap = self.trees + probes * self.depth
        cost = np.full((n, cap), np.inf)
        tree, level, node = (np.zeros((n, cap), np.int32) for _ in range(3))
        cost[:, : self.trees] = np.linspace(0, 1e-12, self.trees)
        tree[:, : self.trees] = np.arange(self.trees)
        used = self.trees
        out = np.full((n, probes), -1, np.int64)
        rows = np.arange(n)
        for k in range(probes):
            best = cost.argmin(axis=1)
            c = cost[rows, best]
            live = np.isfinite(c)
            t, d, x = tree[rows, best], level[rows, best].astype(np.int64), node[rows, best].astype(np.int64)
            cost[rows, best] = np.inf
            for depth in range(self.depth):
                go = np.nonzero(live & (d == depth))[0]
                if not len(go):
                    continue
                m = self.margin(p, t[go], d[go], x[go], go)
                right = m >= 0
                cost[go, used + depth] = np.maximum(c[go], np.abs(m))
                tree[go, used + depth] = t[go]
                level[go, used + depth] = depth + 1
                node[go, used + depth] = x[go] * 2 + ~right
                x[go] = x[go] * 2 + right
                d[go] += 1
            used += self.depth
            out[live, k] = (t[live].astype(np.int64) << self.depth) + x[live]
        return out


def _file(batches: Iterator[pa.RecordBatch], dim: int, kind: str, trees: _Trees, probes: int) -> Iterator[pa.RecordBatch]:
    """(id, query, v) to (leaf, kind, id, v): kind 0 files a vector, kind 1 asks with it."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            u = unit(_matrix(part.column(2), kind, dim))
            n = len(u)
            leaf = trees.leaves(u)
            asks = part.column(1).to_numpy(zero_copy_only=False)
            found = trees.search(u[asks], probes)
            q = np.nonzero(asks)[0]
            # a vector goes to one block of its leaf, a question to all of them
            rows, leaves = np.repeat(np.arange(n), leaf.shape[1]), leaf.ravel()
            ids = part.column(0).to_numpy(zero_copy_only=False)[rows]
            block = (mix(ids.astype(np.uint64)) % trees.blocks_of(leaves).astype(np.uint64)).astype(np.int64)
            ask_rows, ask = np.repeat(q, found.shape[1]), found.ravel()
            each = trees.blocks_of(ask)
            first = np.cumsum(each) - each
            ask_block = np.arange(each.sum()) - np.repeat(first, each)
            ask_rows, ask = np.repeat(ask_rows, each), np.repeat(ask, each)
            role = np.concatenate([np.zeros(len(rows), np.int32), np.ones(len(ask), np.int32)])
            rows, block, leaves = np.concatenate([rows, ask_rows]), np.concatenate([block, ask_block]), np.concatenate([leaves, ask])
            leaves = np.where(leaves >= 0, leaves | (block << 40), -1)
            ok = leaves >= 0
            take = pa.array(rows[ok])
            yield pa.RecordBatch.from_arrays([pa.array(leaves[ok]), pa.array(role[ok]), part.column(0).take(take), part.column(2).take(take)], ["leaf", "kind", "id", "v"])


def best(cos: np.ndarray, ids: np.ndarray, k: int, digits: int) -> np.ndarray:
    """[rows, k]: positions of the k greatest rounded cosines of each row (ties: smaller id); ids ascend."""
    r = np.round(cos, digits)
    k = min(k, r.shape[1])
    if r.shape[1] > 4 * k:
        # all that reach the k-th greatest value are kept, so that ties are settled by id
        edge = -np.partition(-r, k - 1, axis=1)[:, k - 1 : k]
        out = np.empty((len(r), k), np.int64)
        for i in range(len(r)):
            at = np.nonzero(r[i] >= edge[i])[0]
            out[i] = at[np.argsort(-r[i, at], kind="stable")[:k]]
        return out
    return np.argsort(-r, axis=1, kind="stable")[:, :k]


def _rank(batches: Iterator[pa.RecordBatch], dim: int, kind: str, k: int, digits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leaf, kind, id): the k best vectors of a leaf for each vector that asks there."""
    leaf, held, ids, block, names = None, [], [], None, None
    for batch in batches:
        lv = batch.column(0).to_numpy()
        kd = batch.column(1).to_numpy()
        iv = batch.column(2).to_numpy(zero_copy_only=False)
        u = unit(_matrix(batch.column(3), kind, dim))
        cut = np.nonzero(np.append(True, (lv[1:] != lv[:-1]) | (kd[1:] != kd[:-1])))[0]
        qs, ns, cs = [], [], []
        for a, b in zip(cut, np.append(cut[1:], len(lv))):
            if lv[a] != leaf:
                leaf, held, ids, block = lv[a], [], [], None
            if kd[a] == 0:
                held.append(u[a:b])
                ids.append(iv[a:b])
                block = None
            elif held:
                if block is None:
                    block, names = np.concatenate(held), np.concatenate(ids)
                    order = np.argsort(names, kind="stable")
                    block, names = block[order], names[order]
                for x in range(a, b, 512):
                    y = min(b, x + 512)
                    cos = u[x:y] @ block.T
                    top = best(cos, names, k, digits)
                    qs.append(np.repeat(iv[x:y], top.shape[1]))
                    ns.append(names[top].ravel())
                    cs.append(np.round(np.take_along_axis(cos, top, 1), digits).ravel())
        if qs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qs)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(cs))], ["q", "n", "cosine"])


def nearest(vectors: DataFrame, key: str, vector: str, k: int = 5, dim: int = 64, how: Forest = Forest()) -> DataFrame:
    """(id, neighbour, cosine, rank): the ``k`` nearest other vectors of every usable vector, found with a small loss.

    Cosines are rounded to ``digits`` before ranking, ties go to the smaller id (a bigint, unique among usable rows; a repeated row counts
    once). Null ids and vectors that are null, not ``dim`` long, all 0, or hold a null, NaN or infinity take no part.
    Vectors of one direction (unit vectors equal to 5 decimals) are searched once, and only their k + 1 smallest ids can be
    neighbours of anything, so many copies are neither searched nor filed many times. With fewer vectors than a leaf holds the search is exact.
    """
    use = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("v"))
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    use = use.mapInArrow(partial(_usable, dim=dim, kind=kind), "id long, k1 long, k2 long, v binary")
    use = written(use.dropDuplicates(["id"]), "vectors")
    count = use.count()
    # a bounded sample in the order of a hash: the driver learns the splits on it
    few = min(1.0, 1.2 * how.sample / max(1, count))
    picked = use.where(F.pmod(F.xxhash64("id", F.lit(how.seed)), F.lit(1 << 20)) < int(few * (1 << 20))).limit(how.sample).select("v")
    sample = np.frombuffer(b"".join(bytes(r[0]) for r in picked.collect()), kind).reshape(-1, dim).astype(np.float64)
    trees = _Trees(unit(sample), dim, count, how)
    # rank <= k + 1 is cut before the shuffle, so copies do not meet in one task
    w = W.Window.partitionBy("k1", "k2").orderBy("id")
    items = use.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    items = written(items.select("id", (F.col("r") == 1).alias("ask"), "v", "k1", "k2"), "directions")
    filed = items.select("id", "ask", "v").mapInArrow(partial(_file, dim=dim, kind=kind, trees=trees, probes=how.probes), "leaf long, kind int, id long, v binary")
    ranked = filed.repartition("leaf").sortWithinPartitions("leaf", "kind", "id").mapInArrow(partial(_rank, dim=dim, kind=kind, k=k + 1, digits=how.digits), "q long, n long, cosine double")
    one = ranked.groupBy("q", "n").agg(F.max("cosine").alias("cosine"))
    lists = one.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("neg"), F.col("n")))), 1, k + 1).alias("near"))
    asked = items.where("ask").select(F.col("id").alias("q"), "k1", "k2")
    lists = lists.join(asked, "q").select("k1", "k2", "near")
    mine = use.select("id", "k1", "k2").join(lists, ["k1", "k2"])
    mine = mine.select("id", F.slice(F.filter("near", lambda x: x["n"] != F.col("id")), 1, k).alias("near"))
    out = mine.select("id", F.posexplode("near").alias("p", "x"))
    return out.select("id", F.col("x.n").alias("neighbour"), (-F.col("x.neg")).alias("cosine"), (F.col("p") + 1).alias("rank"))
