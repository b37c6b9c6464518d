"""Mixing sources to target weights by pivotal dependent rounding.

Every record of a source should stand x = share * total / size of its source times in the mixture. The whole part is certain; the fraction is rounded so
that the source's size stays put: two undecided records exchange probability, weighted by their sizes, until one of them is 0 or 1.
Records meet in groups by a hash of their ids; the one undecided record that a group is left with goes up a reduction tree of groups. A source's
size is off its target by less than one record, and each record's expected copies are exactly x.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteloom.runtime import written

_ROW = "id long, source string, n_tokens long, p double, final boolean"
FAN_IN = 4096  # undecided records of a source that one group of the tree takes


def pair(a: tuple, b: tuple, seed: int) -> tuple[tuple, tuple]:
    """Move mass between two (id, size, p) until one p is 0 or 1; sizes times p keep their sum, each p its expectation."""
    import xxhash

    (i, w, p), (j, v, q) = a, b
    up, down = min((1 - p) * w, q * v), min(p * w, (1 - q) * v)
    if xxhash.xxh3_64_intdigest(f"{seed} {i} {j}") / 2**64 * (up + down) < down:
        p, q = (1.0 if up == (1 - p) * w else p + up / w), (0.0 if up == q * v else q - up / v)
    else:
        p, q = (0.0 if down == p * w else p - down / w), (1.0 if down == (1 - q) * v else q + down / v)
    near = lambda x: 0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else x
    return (i, w, near(p)), (j, v, near(q))


def _round(batches: Iterator[pa.RecordBatch], seed: int, last: bool) -> Iterator[pa.RecordBatch]:
    import xxhash

    key, open_ = None, None

    def rows(out: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "source", "n_tokens", "p", "final"])

    def end() -> list:
        # at the root the last undecided record of a source is drawn by its probability
        if open_ is None:
            return []
        i, w, p = open_
        return [(i, key[0], w, float(xxhash.xxh3_64_intdigest(f"{seed} {i}") / 2**64 < p) if last else p, last)]

    for batch in batches:
        out = []
        for i, s, bucket, w, p in zip(*(c.to_pylist() for c in batch.columns)):
            if (s, bucket) != key:
                out += end()
                key, open_ = (s, bucket), None
            new = (i, w, p)
            if 0 < p < 1 and open_ is not None:
                old, new = pair(open_, new, seed)
                open_ = None
                if 0 < old[2] < 1:
                    open_ = old
                else:
                    out.append((old[0], s, old[1], old[2], True))
            if 0 < new[2] < 1:
                open_ = new
            else:
                out.append((new[0], s, new[1], new[2], True))
        if out:
            yield rows(out)
    if out := end():
        yield rows(out)


def copies(sizes: DataFrame, key: str, source: str, size: str, weights: DataFrame, total: float | None = None, seed: int = 11) -> DataFrame:
    """(id, source, n_tokens, copies): how often each record of a weighted source stands in the mixture, 0 included.

    ``weights`` has source, target_share and max_repeats, one row for each source (it is read by the driver). ``total`` defaults to the largest at which
    every source that has a size can reach its share within its repeats. With a larger one, sources give at most max_repeats of each
    record and fall short. Records with a null id, null source, a source without a positive weight, or size 0 or null take no part; a repeated id counts once. Sources without records
    cannot be reached and leave the default total alone. Nothing to mix gives no rows.
    """
    spark = sizes.sparkSession
    want = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in weights.select("source", "target_share", "max_repeats").collect() if r["source"] is not None and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    use = sizes.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{source}`").alias("source"), F.col(f"`{size}`").cast("long").alias("n_tokens"))
    use = use.where(F.col("id").isNotNull() & F.col("source").isin(list(want)) & (F.col("n_tokens") > 0))
    use = written(use.groupBy("id").agg(F.min(F.struct("source", "n_tokens")).alias("r")).select("id", "r.*"), "sizes")
    have = {r["source"]: (int(r["t"]), r["n"]) for r in use.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    if not have:
        return spark.createDataFrame([], "id long, source string, n_tokens long, copies int")
    if total is None:
        total = min(want[s][1] * t / want[s][0] for s, (t, _) in have.items())
    x = {s: min(want[s][0] * total / t, float(want[s][1])) for s, (t, _) in have.items()}
    # an x within rounding of a whole number is that number
    x = {s: float(round(v)) if abs(v - round(v)) < 1e-9 else v for s, v in x.items()}
    pick = lambda f: F.element_at(F.create_map(*[y for s, v in x.items() for y in (F.lit(s), F.lit(f(v)))]), F.col("source"))
    left = use.select("id", "source", "n_tokens", pick(lambda v: v - int(v)).cast("double").alias("p"))
    done, level, most = None, 0, max(n for _, n in have.values())
    while True:
        # groups go by a hash of the id, so that the outcome depends on the seed alone and not on how rows are spread over tasks
        groups = -(-most // FAN_IN)
        spread = left.select("id", "source", F.pmod(F.xxhash64("id", F.lit(seed + level)), F.lit(groups)).alias("bucket"), "n_tokens", "p")
        spread = spread.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "id")
        step = written(spread.mapInArrow(partial(_round, seed=seed + level, last=groups == 1), _ROW), "rounded")
        done = step.where("final") if done is None else done.unionByName(step.where("final"))
        if groups == 1:
            break
        left, most, level = step.where("not final").select("id", "source", "n_tokens", "p"), groups, level + 1
    return done.select("id", "source", "n_tokens", (pick(int) + F.col("p").cast("int")).cast("int").alias("copies"))


def shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, records, used, most, tokens, share): what each weighted source came to."""
    got = mixed.groupBy("source").agg(F.count("*").alias("records"), F.count(F.when(F.col("copies") > 0, 1)).alias("used"), F.max("copies").alias("most"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    total = got.agg(F.sum("tokens").alias("total"))
    out = weights.select("source", "target_share", "max_repeats").join(got, "source", "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("source", "target_share", "max_repeats", zero("records"), zero("used"), zero("most"), zero("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("share"))
