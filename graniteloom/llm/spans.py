"""Long exact spans shared between records by Rabin-Karp window hashes.

A token is a character. Windows of ``length`` characters that stand in two records are what is sought, and every such window holds,
among its inner windows of half that length, the one whose hash is least: an anchor that both records choose alike (Schleimer et al., 2003). So a first pass hashes every
half window and counts anchors only; a second hashes every full window whose anchor repeats, and Spark counts these. Nothing
that is shared can be missed; texts without a repeated anchor are not moved. Repeated windows merge into maximal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graniteloom.llm.sieve import sieve, sifted
from graniteloom.llm.words import U, mix
from graniteloom.runtime import freed, written

CHUNK = 1 << 20  # characters hashed at a time; below 2 ** 24, as positions share a word with hash bits
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so invertible modulo 2 ** 64


def window_hashes(codes: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2 ** 64 of all windows of ``k`` codes, by prefix sums."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = np.full(n, U(base)), np.full(n - k + 1, U(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + U(base)) * np.multiply.accumulate(up), out=s[1:])
        return mix((s[k:] - s[: n - k + 1]) * np.multiply.accumulate(down))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of ``w`` values (van Herk)."""
    n = len(v)
    if n < w:
        return np.empty(0, v.dtype)
    m = -(-n // w) * w
    p = np.full(m, np.iinfo(v.dtype).max, v.dtype)
    p[:n] = v
    b = p.reshape(-1, w)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


_LOW = U((1 << 24) - 1)


def _least(h: np.ndarray, length: int) -> np.ndarray:
    """Of each full window the least half-window hash (its upper bits) with its position in the lower bits."""
    return sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), length - length // 2 + 1)


def _own_anchor(codes: np.ndarray, length: int) -> np.ndarray:
    return (_least(window_hashes(codes, length // 2, _B1), length) & _LOW).astype(np.int64)


def anchors(codes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of texts that lie end to end, text i beginning at ``starts[i]``."""
    h = window_hashes(codes, length // 2, _B1)
    least = _least(h, length)
    # full windows that begin within ``length`` of their text's end reach into the next one
    ends = np.append(starts[1:], len(codes))
    ok = np.ones(len(least), bool)
    for e in ends:
        ok[max(0, e - length + 1) : e] = False
    pos = np.unique(least[ok] & _LOW).astype(np.int64)
    return pos, h[pos]


def _chunks(ids: list, texts: list, length: int) -> Iterator[tuple[list, list, list]]:
    """(ids, offsets, texts) of about CHUNK characters; longer texts come in parts that overlap by ``length`` - 1."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for i, t in zip(ids, texts):
        if i is None or t is None or len(t) < length:
            continue
        for a in range(0, max(1, len(t) - length + 1), CHUNK - length + 1):
            part = t[a : a + CHUNK]
            if size + len(part) > CHUNK and held[0]:
                yield held
                held, size = ([], [], []), 0
            for x, y in zip(held, (i, a, part)):
                x.append(y)
            size += len(part)
    if held[0]:
        yield held


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), starts


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, offs, texts in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), length):
            codes, starts = _codes(texts)
            pos, h = anchors(codes, starts, length)
            t = np.searchsorted(starts, pos, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[t]), pa.array(np.array(offs, np.int64)[t] + pos - starts[t]), pa.array(h.view(np.int64))], ["doc", "pos", "h"])


def _window_rows(batches: Iterator[pa.RecordBatch], length: int, places: bool) -> Iterator[pa.RecordBatch]:
    """(doc, text, repeated anchors) to (doc, pos, h1, h2, first): the full windows whose anchor repeats; without ``places`` to (doc, h1, h2) of first rows."""
    for batch in batches:
        for i, t, near in zip(*(c.to_pylist() for c in batch.columns)):
            had = np.empty(0, np.uint64)  # windows in earlier parts of this text
            for a in range(0, max(1, len(t) - length + 1), CHUNK - length + 1):
                codes, _ = _codes([t[a : a + CHUNK]])
                at = np.asarray(near, np.int64) - a
                shared = np.zeros(len(codes), bool)
                shared[at[(at >= 0) & (at < len(codes))]] = True
                # a window can only repeat if its own least half window does
                pos = np.nonzero(shared[_own_anchor(codes, length)])[0]
                if not len(pos):
                    continue
                h1, h2 = window_hashes(codes, length, _B1)[pos], window_hashes(codes, length, _B2)[pos]
                first = np.zeros(len(pos), bool)
                first[np.unique(h1, return_index=True)[1]] = True
                if len(t) > CHUNK:
                    first &= ~np.isin(h1, had)
                    had = np.union1d(had, h1)
                if places:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), i)), pa.array(pos + a), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(first)], ["doc", "pos", "h1", "h2", "first"])
                elif first.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(first.sum()), i)), pa.array(h1[first].view(np.int64)), pa.array(h2[first].view(np.int64))], ["doc", "h1", "h2"])


def _suspects(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(doc, t, near): the texts in which an anchor stands that another record has too, with the places of such anchors.

    Anchors, and then texts, that certainly have no partner are sifted out before they would be moved.
    """
    use = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("t")).where((F.length("t") >= length) & F.col("doc").isNotNull())
    a = written(use.mapInArrow(partial(_anchor_rows, length=length), "doc long, pos long, h long"), "anchors")
    twice = a.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h")
    twice = written(twice, "twice")
    near = sifted(a, "h", sieve(twice, "h")).join(twice, "h", "left_semi").groupBy("doc").agg(F.collect_set("pos").alias("near"))
    near = written(near, "near")
    freed(a, twice)
    return sifted(use, "doc", sieve(near, "doc")).join(near, "doc").groupBy("doc").agg(F.max("t").alias("t"), F.first("near").alias("near"))


def windows(docs: DataFrame, key: str, text: str, length: int = 300, places: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows (doc, pos, h1, h2, first) of windows that may repeat; groups (h1, h2, docs, x1, x2) of those in two records or more.

    ``first`` marks a window's first place in its record; x1 and x2 sum up the set of records. Ids are bigint; rows with a null id or text and
    texts under ``length`` characters take no part; a repeated id counts once (its greatest text). Without ``places`` rows are (doc, h1, h2) of first places
    only, and groups go by h1 alone: whoever joins rows by a group has to compare h2.
    """
    kind = "doc long, pos long, h1 long, h2 long, first boolean" if places else "doc long, h1 long, h2 long"
    rows = written(_suspects(docs, key, text, length).mapInArrow(partial(_window_rows, length=length, places=places), kind), "windows")
    # a record has one first row for each window: counting rows counts records
    g = rows.where("first").groupBy("h1", "h2") if places else rows.groupBy("h1")
    g = g.agg(F.count("*").alias("docs"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("x1"), F.bit_xor(F.xxhash64("doc", F.lit(2))).alias("x2"))
    return rows, written(g.where("docs > 1"), "groups")


def sharers(docs: DataFrame, key: str, text: str, length: int = 300) -> DataFrame:
    """(h1, h2, doc): for each different set of records that share a window, one window of theirs with each record that has it.

    As many rows as records in these sets, where their pairs would be a square of it: the form for passages that stand in many records.
    """
    rows, groups = windows(docs, key, text, length, places=False)
    # windows that stand in the same records tell the same: one of them speaks for all
    speak = written(groups.groupBy("docs", "x1", "x2").agg(F.min("h1").alias("h1")).select("h1"), "speakers")
    freed(groups)
    return sifted(rows, "h1", sieve(speak, "h1")).join(speak, "h1", "left_semi").select("h1", "h2", "doc")


def shared_pairs(docs: DataFrame, key: str, text: str, length: int = 300) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: the records that share a passage of at least ``length`` characters."""
    w = sharers(docs, key, text, length)
    p = w.withColumnRenamed("doc", "doc_a").join(w.withColumnRenamed("doc", "doc_b"), ["h1", "h2"]).where("doc_a < doc_b")
    return p.select("doc_a", "doc_b").distinct()


def shared_spans(docs: DataFrame, key: str, text: str, length: int = 300) -> DataFrame:
    """(doc, start, stop): the maximal intervals [start, stop) of each record that windows found elsewhere cover."""
    rows, groups = windows(docs, key, text, length)
    r = rows.join(groups.select("h1", "h2"), ["h1", "h2"], "left_semi").select("doc", "pos").distinct()
    w = W.Window.partitionBy("doc").orderBy("pos")
    r = r.withColumn("new", (F.col("pos") - F.lag("pos").over(w) > length).cast("int"))
    r = r.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(w))
    return r.groupBy("doc", "run").agg(F.min("pos").alias("start"), (F.max("pos") + length).alias("stop")).select("doc", "start", "stop")


def shares(docs: DataFrame, key: str, text: str, length: int = 300) -> DataFrame:
    """(doc, chars, shared_chars, share) for every row with an id: how much of it is found elsewhere; null texts have 0 characters and share 0."""
    s = shared_spans(docs, key, text, length).groupBy("doc").agg(F.sum(F.col("stop") - F.col("start")).alias("shared_chars"))
    d = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).alias("chars")).where("doc is not null").groupBy("doc").agg(F.max("chars").alias("chars"))
    share = F.when(F.col("chars") > 0, F.round(F.coalesce("shared_chars", F.lit(0)) / F.col("chars"), 6)).otherwise(F.lit(0.0))
    return d.join(s, "doc", "left").select("doc", "chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), share.alias("share"))
