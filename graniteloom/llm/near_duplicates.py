"""Near-duplicate records by one-permutation hashing with optimal densification.

Texts become sets of word runs. One hash permutation is cut into bins; empty bins borrow from a bin that a
universal hash picks (Shrivastava, 2017). Bins are read in bands; texts that share a band's key stand in one bucket. All pairs of a bucket are compared by
sketch, large buckets in pairs of salted blocks; what passes is a candidate, and exact Jaccard verifies every candidate. Two centres that a hash picks
in each bucket give star-shaped edges: texts with a common verified centre are compared too, should they share no bucket; each text goes by few centres, so that these
pairs stay in the order of a family's own. Keys that only one class has are sifted out before rows move. Exact copies (equal sets) are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graniteloom.llm.graph import connected_components
from graniteloom.llm.sieve import sieve, sifted
from graniteloom.llm.words import U, WordHashes, mix, runs, words
from graniteloom.runtime import freed, written


@dataclass(frozen=True)
class Similarity:
    """Five-word runs and 0.8 unless stated otherwise. ``bands * rows`` is the number of bins.

    A pair of similarity s shares a bucket with probability 1 - (1 - s ** rows) ** bands: at the defaults 0.9999999 for 0.8; with 48 x 4 0.9987 for 0.6.
    """

    run: int = 5
    threshold: float = 0.8
    min_words: int = 1
    bands: int = 32
    rows: int = 4


SKETCH = 3  # 64-bit words of each of two bit planes
#: A text is compared over at most this many of the centres it is verified to be similar to: those of the least hash, which similar texts choose alike.
HUBS = 3
#: Classes a task remembers to have given, so that a copy's set is written once for each task; beyond it starts anew.
SEEN = 500_000
#: Buckets of more texts are cut into blocks of about this many, and every two blocks meet under a key of their own.
BLOCK = 1000


def _densified(doc: np.ndarray, h: np.ndarray, n: int, bins: int) -> np.ndarray:
    top = np.iinfo(np.uint64).max
    g = mix(h ^ U(0x5BD1E9955BD1E995))
    where = ((g >> U(32)) * U(bins)) >> U(32)
    sig = np.full(n * bins, top, np.uint64)
    np.minimum.at(sig, doc * bins + where.astype(np.int64), g)
    sig = sig.reshape(n, bins)
    first = sig.copy()
    r, c = np.nonzero(sig == top)
    t = 1
    while len(r):
        with np.errstate(over="ignore"):
            pick = ((mix(np.arange(bins, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(t)) >> U(32)) * U(bins)) >> U(32)
        v = first[r, pick.astype(np.int64)[c]]
        sig[r, c] = v
        left = v == top
        r, c = r[left], c[left]
        t += 1
    return sig


def sketch(sig: np.ndarray) -> np.ndarray:
    """[n, 2, SKETCH]: two bits of each of the first 64 * SKETCH bins, as words of one bit plane each."""
    few = sig[:, : 64 * SKETCH]
    if few.shape[1] < 64 * SKETCH:
        few = np.tile(few, (1, -(-64 * SKETCH // few.shape[1])))[:, : 64 * SKETCH]
    planes = [np.packbits(((few >> U(p)) & U(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64) for p in (7, 13)]
    return np.stack(planes, axis=1)


def _shingled(texts: list[str | None], hashes: WordHashes, how: Similarity) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """(places, sets, c1, c2) of the texts long enough: their sets of run hashes, and the two numbers of their class."""
    keep, sets = [], []
    for i, t in enumerate(texts):
        ws = words(t) if t is not None else []
        if len(ws) >= max(how.min_words, how.run):
            keep.append(i)
            sets.append(np.unique(runs(hashes(ws), how.run)))
    if not keep:
        return keep, sets, np.empty(0, np.int64), np.empty(0, np.int64)
    h, at = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    with np.errstate(over="ignore"):
        c1 = np.add.reduceat(mix(h), at).view(np.int64)
    return keep, sets, c1, np.bitwise_xor.reduceat(mix(h ^ U(0xA5A5A5A5A5A5A5A5)), at).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], how: Similarity) -> Iterator[pa.RecordBatch]:
    hashes, seen = WordHashes(), set()
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            keep, sets, c1, c2 = _shingled(part.column(1).to_pylist(), hashes, how)
            if not keep:
                continue
            n, sizes = len(keep), np.array([len(s) for s in sets])
            # a class that this task has had gives its members only
            new = []
            for j, k in enumerate(zip(c1.tolist(), c2.tolist())):
                if k not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(k)
                    new.append(j)
            isnew = np.zeros(n, bool)
            isnew[new] = True
            keys = np.zeros((0, how.bands), np.int64)
            bits = np.zeros((n, 2, SKETCH), np.int64)
            if new:
                sig = _densified(np.repeat(np.arange(len(new)), sizes[new]), np.concatenate([sets[j] for j in new]), len(new), how.bands * how.rows).reshape(len(new), how.bands, how.rows)
                k = np.broadcast_to(np.arange(how.bands, dtype=np.uint64), (len(new), how.bands)).copy()
                with np.errstate(over="ignore"):
                    for r in range(how.rows):
                        k = mix(k * U(0x9E3779B97F4A7C15) + sig[:, :, r])
                keys = k.view(np.int64)
                bits[new] = sketch(sig.reshape(len(new), -1))
            full = np.zeros(n + 1, np.int32)
            full[1:] = np.cumsum(np.where(isnew, how.bands, 0))
            bands = pa.ListArray.from_arrays(pa.array(full), pa.array(keys.ravel()))
            cols = {"id": part.column(0).take(pa.array(keep)), "c1": pa.array(c1), "c2": pa.array(c2), "n": pa.array(sizes.astype(np.int32)), "bands": bands}
            cols |= {f"s{i}{j}": pa.array(np.ascontiguousarray(bits[:, i, j])) for i in range(2) for j in range(SKETCH)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _sets(batches: Iterator[pa.RecordBatch], how: Similarity) -> Iterator[pa.RecordBatch]:
    """Texts to (c1, c2, shingles)."""
    hashes = WordHashes()
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            _, sets, c1, c2 = _shingled(batch.slice(start, 1000).column(0).to_pylist(), hashes, how)
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["c1", "c2", "shingles"])


_PLANES = [f"s{i}{j}" for i in range(2) for j in range(SKETCH)]


def signatures(docs: DataFrame, key: str, text: str, how: Similarity) -> DataFrame:
    """(id, c1, c2, n, bands, planes) of the texts long enough; c1, c2 name the class of texts with equal sets of n runs. Bands are empty where a task had the class before."""
    kind = docs.schema[key].dataType.simpleString()
    return _texts(docs, key, text).mapInArrow(partial(_signatures, how=how), f"id {kind}, c1 long, c2 long, n int, bands array<long>, " + ", ".join(f"{c} long" for c in _PLANES))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t")).where("id is not null and t is not null")


def _named(c1: str, c2: str) -> Column:
    """The name of a class: its two numbers as 16 bytes."""
    return F.unhex(F.concat(F.lpad(F.hex(c1), 16, "0"), F.lpad(F.hex(c2), 16, "0")))


def _alike(how: Similarity) -> Column:
    """Whether the sketches of x and y leave a similarity of the threshold possible.

    Two bits of each bin tell most chance meetings apart before whole sets are moved: a pair at the threshold agrees in (1 + 3 t) / 4
    of the bins, and passes unless it falls 5 standard deviations (of as many draws as the smaller set has runs) below.
    """
    differ = [F.col(f"x_s0{j}").bitwiseXOR(F.col(f"y_s0{j}")).bitwiseOR(F.col(f"x_s1{j}").bitwiseXOR(F.col(f"y_s1{j}"))) for j in range(SKETCH)]
    agree = sum((F.bit_count(F.bitwise_not(x)) for x in differ[1:]), F.bit_count(F.bitwise_not(differ[0])))
    mean = (1 + 3 * how.threshold) / 4
    draws = F.least("x_n", "y_n", F.lit(64 * SKETCH)).cast("double")
    short, long = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    return (short >= how.threshold * long - 1e-9) & (agree >= 64 * SKETCH * (mean - 5 * F.sqrt(F.lit(mean * (1 - mean)) / draws)))


def _verified(edges: DataFrame, texts: DataFrame, members: DataFrame, how: Similarity) -> DataFrame:
    """Of the written class edges (a, b, ...) those with a Jaccard similarity of at least ``threshold``, with it; other columns are kept.

    Sets are made anew from one text of each class that stands in an edge, so that the sets of all texts are neither kept nor moved.
    """
    more, threshold = [c for c in edges.columns if c not in ("a", "b")], how.threshold
    ends = edges.select(F.explode(F.array("a", "b")).alias("c"))
    ends = sieve(ends, "c")
    one = sifted(members, "c", ends).groupBy("c").agg(F.min("id").alias("id"))
    sets = sifted(texts, "id", sieve(one, "id")).select("t").mapInArrow(partial(_sets, how=how), "c1 long, c2 long, shingles array<long>").select(_named("c1", "c2").alias("c"), "shingles")
    sets = sifted(sets, "c", ends)
    j = edges.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb")), "b")
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    j = j.where(small >= threshold * large - 1e-9)
    both = F.size(F.array_intersect("sa", "sb"))
    j = j.select("a", "b", *more, both.alias("i"), (F.size("sa") + F.size("sb")).alias("s"))
    # i / (s - i) >= threshold with a margin for the rounding of threshold itself
    return j.where(F.col("i") >= threshold * (F.col("s") - F.col("i")) - 1e-9).select("a", "b", *more, (F.col("i") / (F.col("s") - F.col("i"))).alias("similarity")).distinct()


def _mates(sig: DataFrame) -> DataFrame:
    """(k, c1, c2, n, planes, centre, block, blocks): the members of every bucket that two classes share, cut into blocks, two of them centres."""
    b = sig.where(F.size("bands") > 0).select("c1", F.explode("bands").alias("k"))
    # c1 stands for the class here: should two classes share it, the join with the sketches brings both
    twice = written(b.groupBy("k").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo != hi").select("k"), "keys")
    b = written(sifted(b, "k", sieve(twice, "k")).join(twice, "k", "left_semi").distinct(), "buckets")
    freed(twice)
    order = F.struct(F.xxhash64("k", "c1").alias("o"), "c1")
    of = b.groupBy("k").agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    of = of.select("k", F.col("lo.c1").alias("lo"), F.col("hi.c1").alias("hi"), "blocks")
    m = b.join(of, "k").select("k", "c1", F.expr("c1 = lo or c1 = hi").alias("centre"), "blocks", F.pmod(F.xxhash64("c1"), "blocks").cast("int").alias("block"))
    out = written(m.join(_sketches(sig, b.select("c1")), "c1"), "mates")
    freed(b)
    return out


def _sketches(sig: DataFrame, of: DataFrame) -> DataFrame:
    """(c1, c2, n, planes) of each class whose c1 stands in ``of`` (and of some others)."""
    return sifted(sig.where(F.size("bands") > 0), "c1", sieve(of, "c1")).select("c1", "c2", "n", *_PLANES).distinct()


def _meetings(mates: DataFrame, how: Similarity) -> DataFrame:
    """(a, b, ca, cb): the pairs of classes in a bucket that their sketches do not tell apart; ca, cb mark an end that is a centre there."""
    # every two blocks of a bucket meet once, a block with itself too
    keep = lambda p: [F.col(c).alias(p + c) for c in ("c1", "c2", "n", "centre", *_PLANES)]
    x = mates.select("k", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), *keep("x_"))
    y = mates.select("k", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), *keep("y_"))
    meet = x.join(y, ["k", "i", "j"]).where("i < j or x_c1 < y_c1 or (x_c1 = y_c1 and x_c2 < y_c2)").where(_alike(how))
    cls = lambda p: F.struct(F.col(p + "c1").alias("c1"), F.col(p + "c2").alias("c2"))
    first = cls("x_") < cls("y_")
    pair = meet.select(F.least(cls("x_"), cls("y_")).alias("u"), F.greatest(cls("x_"), cls("y_")).alias("v"), F.when(first, F.col("x_centre")).otherwise(F.col("y_centre")).alias("ca"), F.when(first, F.col("y_centre")).otherwise(F.col("x_centre")).alias("cb"))
    pair = pair.groupBy("u.c1", "u.c2", F.col("v.c1").alias("d1"), F.col("v.c2").alias("d2")).agg(F.bool_or("ca").alias("ca"), F.bool_or("cb").alias("cb"))
    return pair.select(_named("c1", "c2").alias("a"), _named("d1", "d2").alias("b"), "ca", "cb")


def _over_hubs(edges: DataFrame, sig: DataFrame, how: Similarity) -> DataFrame:
    """(a, b), a < b: the pairs of classes with a common verified centre that no bucket has brought together, and that their sketches do not tell apart.

    Over centres only, and of those HUBS for each class, as all edges of a family would give cubes of paths.
    """
    arm = edges.where("cb").select(F.col("a").alias("c"), F.col("b").alias("m")).union(edges.where("ca").select(F.col("b").alias("c"), F.col("a").alias("m")))
    w = W.Window.partitionBy("c").orderBy(F.xxhash64("m"), "m")
    arm = arm.withColumn("r", F.row_number().over(w)).where(F.col("r") <= HUBS).select("c", "m")
    sk = sifted(sig.where(F.size("bands") > 0).withColumn("c", _named("c1", "c2")), "c", sieve(arm, "c")).select("c", "n", *_PLANES).distinct()
    arm = written(arm.join(sk, "c"), "arms")
    side = lambda p: arm.select("m", *[F.col(c).alias(p + c) for c in ("c", "n", *_PLANES)])
    two = side("x_").join(side("y_"), "m").where("x_c < y_c").where(_alike(how)).select(F.col("x_c").alias("a"), F.col("y_c").alias("b")).distinct()
    # the ends of an edge come in either order: by number there, by name here
    had = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    out = written(two.join(had, ["a", "b"], "left_anti"), "candidates")
    freed(arm)
    return out


def similar_classes(docs: DataFrame, key: str, text: str, how: Similarity = Similarity()) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (id, c) for each text long enough, pairs (a, b, similarity) of classes, each once.

    Rows with a null id or text and texts under ``min_words`` words (or shorter than one run) are in no class.
    A repeated row counts once. An empty table gives two empty results.
    """
    sig = written(signatures(docs, key, text, how), "signatures")
    members = written(sig.select("id", _named("c1", "c2").alias("c")).distinct(), "members")
    texts = _texts(docs, key, text)
    mates = _mates(sig)
    pair = written(_meetings(mates, how), "candidates")
    freed(mates)
    one = written(_verified(pair, texts, members, how), "edges")
    freed(pair)
    two = _over_hubs(one, sig, how)
    pairs = written(one.drop("ca", "cb").unionByName(_verified(two, texts, members, how)), "pairs")
    freed(sig, one, two)
    return members, pairs


def near_duplicates(docs: DataFrame, key: str, text: str, how: Similarity = Similarity()) -> DataFrame:
    """(id, class_id, group_id, links): one row per text long enough.

    ``class_id`` is the least id with the same set of runs, ``group_id`` the least id reachable over similar texts, ``links`` the
    number of similar texts with another set. Copies share one row's links, so no group is expanded into pairs.
    """
    members, pairs = similar_classes(docs, key, text, how)
    rep = members.groupBy("c").agg(F.min("id").alias("class_id"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    comp = connected_components(pairs, "a", "b").withColumnRenamed("node", "c")
    first = comp.join(rep, "c").groupBy("component").agg(F.min("class_id").alias("group_id"))
    comp = comp.join(first, "component").select("c", "group_id")
    cls = rep.join(ends, "c", "left").join(comp, "c", "left")
    return members.join(cls, "c").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def pairs_between(members: DataFrame, pairs: DataFrame, origin: DataFrame) -> DataFrame:
    """(child_a, child_b): ids of similar or equal classes whose ``origin`` (id, origin) differs; ids without one give none."""
    shared = members.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select(F.col("c").alias("a"), F.col("c").alias("b"))
    links = pairs.select("a", "b").union(shared)
    used = links.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    m = members.join(used, "c", "left_semi").join(origin.where("origin is not null"), "id")
    x = m.select(F.col("c").alias("a"), F.col("id").alias("i"), F.col("origin").alias("oi"))
    y = m.select(F.col("c").alias("b"), F.col("id").alias("j"), F.col("origin").alias("oj"))
    p = links.join(x, "a").join(y, "b").where("oi != oj and i != j")
    return p.select(F.least("i", "j").alias("child_a"), F.greatest("i", "j").alias("child_b")).distinct()
