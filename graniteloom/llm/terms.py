"""Frequency of every distinct term by a vertical layout.

Records stay where they are read and are numbered within their task, so numbers are dense; only ids that may stand in several rows are brought together first. Each term of a task gets compressed bitmaps of record
numbers (one for each 65,536 numbers: sorted 16-bit values while they are few, 8,192 bytes of bits beyond) with a parallel occurrence counter. Bitmaps of one
term and block are merged by union; document frequency is read from their cardinality.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniteloom.llm.sieve import marked, sieve

BLOCK = 1 << 16
SPARSE = 4096  # a sorted list of 16-bit values is no larger than the bits up to here
FLUSH = 2_000_000  # postings a task holds before it writes bitmaps


def normal(term: str) -> str:
    """NFKC, without outer spaces, lower case."""
    return unicodedata.normalize("NFKC", term).strip().lower()


def _pack(low: np.ndarray, at: np.ndarray) -> pa.Array:
    """Bitmaps of the runs of sorted 16-bit values that begin at ``at``."""
    ends = np.append(at[1:], len(low))
    if (ends - at <= SPARSE).all():
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.append(at, len(low)) * 2).astype(np.int32).tobytes()), pa.py_buffer(low.astype("<u2").tobytes())])
    return pa.array([_one(low[a:b]) for a, b in zip(at, ends)], pa.binary())


def _one(low: np.ndarray) -> bytes:
    if len(low) <= SPARSE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def members(bitmap: bytes) -> np.ndarray:
    """The sorted numbers in a bitmap."""
    if len(bitmap) == BLOCK // 8:
        return np.nonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))[0]
    return np.frombuffer(bitmap, "<u2").astype(np.int64)


def union(bitmaps: list[bytes]) -> bytes:
    """The union of bitmaps of one block."""
    if len(bitmaps) == 1:
        return bitmaps[0]
    return _one(np.unique(np.concatenate([members(b) for b in bitmaps])))


def cardinality(bitmap: bytes) -> int:
    if len(bitmap) == BLOCK // 8:
        return int(np.unpackbits(np.frombuffer(bitmap, np.uint8)).sum())
    return len(bitmap) // 2


def _build(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, terms, counts), those of one id in a row, newest first, to (term, task, block, bitmap, occurrences); ``side`` tells the tasks of two calls apart."""
    from pyspark import TaskContext

    task = 2 * TaskContext.get().partitionId() + side
    code: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, number, last = 0, -1, None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        t, d, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((d, t))
        t, d, n = t[order], d[order], n[order]
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])  # spellings of one term in one record
        at = np.nonzero(first)[0]
        t, d, n = t[at], d[at], np.add.reduceat(n, at)
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (d[1:] // BLOCK != d[:-1] // BLOCK)
        at = np.nonzero(new)[0]
        names = list(code)
        occ = np.add.reduceat(n, at)
        low = d % BLOCK
        for a in range(0, len(at), 50_000):
            part = at[a : a + 50_000]
            stop = at[a + 50_000] if a + 50_000 < len(at) else len(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in t[part]], pa.string()), pa.array(np.full(len(part), task, np.int32)), pa.array((d[part] // BLOCK).astype(np.int32)), _pack(low[part[0] : stop], part - part[0]), pa.array(occ[a : a + 50_000])],
                ["term", "task", "block", "bitmap", "occurrences"],
            )
        held, size = [], 0
        code.clear()

    for batch in batches:
        ids, terms, counts = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
        # Python sees each distinct spelling of a batch once
        coded, num = terms.flatten().dictionary_encode(), counts.flatten()
        num = num.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        lens = np.diff(terms.offsets.to_numpy())
        new = np.ones(len(ids), bool)
        for i, x in enumerate(ids):
            new[i] = x != last
            last = x
        numbers = number + np.cumsum(new)
        number = int(numbers[-1]) if len(ids) else number
        of = np.fromiter((code.setdefault(normal(s), len(code)) for s in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        t = of[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
        # an older row of a record adds its terms to the bitmap, but no occurrences
        n = num * np.repeat(new, lens)
        held.append((t, np.repeat(numbers, lens), n))
        size += len(t)
        if size >= FLUSH:
            yield from flush()
    if size:
        yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of neighbours with equal (term, task, block)."""
    key, maps, occ = None, [], 0
    for batch in batches:
        out: list[tuple] = []
        for *k, m, o in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if key is not None:
                    u = union(maps)
                    out.append((*key, u, occ, cardinality(u)))
                key, maps, occ = k, [], 0
            maps.append(m)
            occ += o
            if len(maps) > 64:
                maps = [union(maps)]
        if out:
            yield _rows(out)
    if key is not None:
        u = union(maps)
        yield _rows([(*key, u, occ, cardinality(u))])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    t = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), t)], ["term", "task", "block", "bitmap", "occurrences", "cardinality"])


def postings(index: DataFrame, key: str, frequencies: str, newest: Column | None = None) -> DataFrame:
    """(term, task, block, bitmap, occurrences, cardinality) of a table of term-frequency maps.

    A record is an id; its rows' terms are united, its occurrences are those of the row with the greatest ``newest``.
    Rows with a null id or map give nothing; null counts are 0; spellings that normalise alike add up. Terms that normalise to "" stay a term.
    """
    rows = index.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{frequencies}`").isNotNull())
    rows = rows.select(F.col(f"`{key}`").cast("string").alias("id"), (newest if newest is not None else F.lit(None)).alias("newest"), F.map_keys(frequencies).alias("terms"), F.map_values(frequencies).cast("array<bigint>").alias("counts"))
    again = index.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    rows = marked(rows, "id", sieve(again, "id"), "again")
    once = rows.where(~F.col("again")).select("id", "terms", "counts")
    more = rows.where("again").repartition("id").sortWithinPartitions("id", F.desc_nulls_last("newest")).select("id", "terms", "counts")
    built = [x.mapInArrow(partial(_build, side=i), "term string, task int, block int, bitmap binary, occurrences long") for i, x in enumerate((once, more))]
    built = built[0].union(built[1])
    spread = built.repartition("term", "task", "block").sortWithinPartitions("term", "task", "block")
    return spread.mapInArrow(_merge, "term string, task int, block int, bitmap binary, occurrences long, cardinality long")


def term_counts(index: DataFrame, key: str, frequencies: str, newest: Column | None = None, rare: int = 1, common: float = 0.2) -> DataFrame:
    """(term, frequency, df, mark): mark is rare (df at most ``rare``), common (df above ``common`` of the records) or null.

    The share is of all distinct non-null ids, those with empty or null maps included. A term both rare and common is
    marked rare. An empty table gives no rows.
    """
    n = index.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`")).distinct().count()
    t = postings(index, key, frequencies, newest).groupBy("term").agg(F.sum("occurrences").alias("frequency"), F.sum("cardinality").alias("df"))
    mark = F.when(F.col("df") <= rare, "rare").when(F.col("df") > F.lit(common) * F.lit(n), "common")
    return t.withColumn("mark", mark)
