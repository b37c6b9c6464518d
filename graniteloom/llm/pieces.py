"""Splitting oversized texts at natural boundaries, range by range.

A text is cut into ranges of fixed length with a halo of one character on either side. Workers detect words, line ends, and sentence ends in their ranges; the
compact boundary tables of a text are stitched in order, a prefix sum over word counts places every boundary, and a plan of pieces is made on
these counts alone. Pieces are then emitted by offset from the ranges they overlap. Giant files are read range by range, and no worker loads one whole; a text that comes
as one value of a table is held once, when it is cut into ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.runtime import latest, written

RANGE = 1 << 16
#: The characters that str.isspace() holds for.
SPACES = [c for c in range(0x3001) if chr(c).isspace()]


@dataclass(frozen=True)
class Limits:
    words: int = 400
    overlap: int = 50
    range_chars: int = RANGE


def _ranges(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(id, table, text) to (id, table, no, before, body, after)."""
    for batch in batches:
        rows = []
        for i, tab, t in zip(*(c.to_pylist() for c in batch.columns)):
            for no, a in enumerate(range(0, len(t), size)):
                rows.append((i, tab, no, t[a - 1] if a else "", t[a : a + size], t[a + size : a + size + 1]))
        for a in range(0, len(rows), 500):
            kinds = (batch.schema.field(0).type, pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 500]), kinds)], ["id", "tab", "no", "before", "body", "after"])


def _space(codes: np.ndarray) -> np.ndarray:
    known = np.zeros(0x3002, bool)
    known[SPACES] = True
    return known[np.minimum(codes, 0x3001)]


def word_starts(before: str, body: str) -> np.ndarray:
    """Offsets in ``body`` at which a word begins; ``before`` is the character in front of it."""
    codes = np.frombuffer((before + body).encode("utf-32-le"), np.uint32)
    sp = _space(codes)
    if not before:
        sp = np.append(True, sp)
    return np.nonzero(sp[:-1] & ~sp[1:])[0]


def boundaries(before: str, body: str, after: str) -> tuple[list[int], list[int]]:
    """(words, kinds): words of the stretches that boundaries end, with kind 1 line, 2 sentence; a last stretch of kind 0 ends the range."""
    codes = np.frombuffer((body + (after or " ")).encode("utf-32-le"), np.uint32)
    sp = _space(codes)
    line = codes[:-1] == 10
    stop = np.isin(codes[:-1], [ord(c) for c in ".!?"]) & sp[1:]
    at = np.nonzero(line | stop)[0]
    seen = np.searchsorted(word_starts(before, body), np.append(at, len(body)), "right")
    return np.diff(np.append(0, seen)).tolist(), np.append(np.where(line[at], 1, 2), 0).tolist()


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, k = zip(*(boundaries(*r) for r in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5))))) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.list_(pa.int32())), pa.array(k, pa.list_(pa.int32()))], ["id", "tab", "no", "words", "kinds"])


def stitched(words: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, sentence, paragraph): word counts in front of each boundary of a kind, from the tables of all ranges in order."""
    total = np.cumsum(words)
    lines = np.append(total[kinds == 1], total[-1] if len(total) else 0)
    # a blank line adds no word to the line end before it; a paragraph ends there if it has begun
    own = np.diff(np.append(0, lines))
    para = np.append(lines[:-1][own[1:] == 0], lines[-1])
    return np.unique(lines), np.unique(total[kinds == 2]), np.unique(para)


def _most(cuts: np.ndarray, total: int) -> int:
    return int(np.diff(np.unique(np.concatenate([[0], cuts, [total]]))).max(initial=0))


def boundary(words: np.ndarray, kinds: np.ndarray, table: bool, limit: int) -> str | None:
    """The coarsest boundary at which every unit is within the limit; None where the text itself is."""
    total = int(words.sum())
    if total <= limit:
        return None
    lines, sentences, paras = stitched(words, kinds)
    if table:
        return "row" if _most(lines, total) <= limit else "word"
    if _most(paras, total) <= limit:
        return "paragraph"
    return "sentence" if _most(np.union1d(sentences, paras), total) <= limit else "word"


def plan(words: np.ndarray, kinds: np.ndarray, table: bool, how: Limits) -> list[tuple[int, int, str]]:
    """Pieces as word intervals [first, last) with the boundary each is cut at.

    The next cut is the last paragraph end within the limit, else the last sentence end, else the limit itself (tables: row ends, else the
    limit). Text pieces begin at the earliest sentence or paragraph end among the last ``overlap`` words before
    the cut, or exactly ``overlap`` words before one that divides a sentence; table pieces do not overlap.
    """
    total = int(words.sum())
    if total == 0:
        return []
    lines, sentences, paras = stitched(words, kinds)
    ladder = [("row", lines)] if table else [("paragraph", paras), ("sentence", np.union1d(sentences, paras))]
    out, first, done = [], 0, 0
    while done < total:
        end, name = min(first + how.words, total), "end"
        if first + how.words < total:
            end, name = first + how.words, "word"
            for kind, cuts in ladder:
                i = np.searchsorted(cuts, first + how.words, "right") - 1
                # a cut must bring words that no earlier piece has
                if i >= 0 and cuts[i] > done:
                    end, name = int(cuts[i]), kind
                    break
            else:
                if first < done:
                    # nothing natural within reach: do without the overlap before a unit is divided
                    nxt = next((int(c[j]) for _, c in reversed(ladder) if (j := np.searchsorted(c, done, "right")) < len(c)), total)
                    if nxt - done <= how.words < nxt - first:
                        first = max(first, nxt - how.words)
                        end, name = nxt, ladder[-1][0]
        out.append((first, end, name))
        done = first = end
        if not table and done < total and how.overlap:
            low = max(out[-1][0] + 1, end - how.overlap)
            if name == "word":
                first = low
            else:
                cuts = ladder[-1][1]
                i = np.searchsorted(cuts, low)
                first = int(cuts[i]) if i < len(cuts) and cuts[i] < end else end
    return out


def _tables(r: dict | None) -> tuple[np.ndarray, np.ndarray]:
    parts = sorted(r, key=lambda x: x["no"])
    return np.concatenate([np.asarray(x["words"], np.int64) for x in parts]), np.concatenate([np.asarray(x["kinds"], np.int64) for x in parts])


def _classify(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b = [boundary(*_tables(r), tab, limit) for tab, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(b, pa.string())], ["id", "boundary"])


def _plan(batches: Iterator[pa.RecordBatch], how: Limits) -> Iterator[pa.RecordBatch]:
    """(id, table, tables) to (id, no, before, piece, first, last, cut): the ranges that each piece overlaps, with the words in front of them."""
    for batch in batches:
        ids, out = batch.column(0), []
        for i, (tab, r) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            w, k = _tables(r)
            if w.sum() <= how.words:
                continue
            edge = np.append(0, np.cumsum([sum(x["words"]) for x in sorted(r, key=lambda x: x["no"])]))
            for p, (a, b, cut) in enumerate(plan(w, k, tab, how)):
                # the piece's last word may run on into the next range
                lo = max(0, int(np.searchsorted(edge, a, "right")) - 1)
                hi = min(len(edge) - 2, int(np.searchsorted(edge, b, "left")))
                out += [(i, n, int(edge[n]), p, a, b, cut) for n in range(lo, hi + 1)]
        if out:
            c = list(zip(*out))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(c[0]))] + [pa.array(x, k) for x, k in zip(c[1:], (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["id", "no", "lead", "piece", "first", "last", "cut"])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = []
        for before, body, lead, a, b in zip(*(batch.column(c).to_pylist() for c in ("before", "body", "lead", "first", "last"))):
            s = word_starts(before, body)
            x = 0 if a < lead else int(s[a - lead]) if a - lead < len(s) else len(body)
            y = int(s[b - lead]) if b >= lead and b - lead < len(s) else len(body) if b >= lead else 0
            text.append(body[x:y])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("piece"), batch.column("no"), batch.column("first"), batch.column("last"), batch.column("cut"), pa.array(text, pa.string())], ["id", "piece", "no", "first", "last", "cut", "part"])


def _long(docs: DataFrame, key: str, text: str, table: str | None, newest: str | None, how: Limits) -> DataFrame:
    tab = F.coalesce(F.col(f"`{table}`"), F.lit(False)) if table else F.lit(False)
    use = docs.select(F.col(f"`{key}`").alias("id"), tab.alias("tab"), F.col(f"`{text}`").alias("t"), (F.col(f"`{newest}`") if newest else F.lit(None)).alias("u"))
    # words + 1 words take at least 2 * words + 1 characters
    use = use.where(F.col("id").isNotNull() & (F.length("t") > 2 * how.words))
    use = latest(use, "id", "u").drop("u")
    kind = docs.schema[key].dataType.simpleString()
    return use.mapInArrow(partial(_ranges, size=how.range_chars), f"id {kind}, tab boolean, no int, before string, body string, after string")


def _read_ranges(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(id, tab, no, bytes) to (id, tab, no, before, body, after), read from the file ``id``: a character belongs to the range its first byte stands in."""
    from pyarrow import fs

    for batch in batches:
        for path, tab, no, total in zip(*(c.to_pylist() for c in batch.columns)):
            where, name = fs.FileSystem.from_uri(path)
            a, b = no * size, min((no + 1) * size, total)
            with where.open_input_file(name) as f:
                # a halo of two characters' bytes on either side holds one whole character
                low, high = max(0, a - 8), min(total, b + 8)
                raw = f.read_at(high - low, low)
            start, stop = _boundary_at(raw, a - low), _boundary_at(raw, b - low)
            before, body, after = raw[:start].decode("utf-8", "replace")[-1:], raw[start:stop].decode("utf-8", "replace"), raw[stop:].decode("utf-8", "replace")[:1]
            kinds = (pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, tab, no, before, body, after), kinds)], ["id", "tab", "no", "before", "body", "after"])


def _boundary_at(raw: bytes, at: int) -> int:
    """The first place from ``at`` on where a UTF-8 character begins."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def file_ranges(spark: SparkSession, paths: list[str], tables: bool = False, how: Limits = Limits()) -> DataFrame:
    """(id, tab, no, before, body, after): UTF-8 files in ranges of ``range_chars`` bytes, each read by itself; ``id`` is the file's full path.

    The driver sees names and sizes only. Paths are such that pyarrow can open them on every executor (file:, hdfs:, s3:). Bytes that are no UTF-8 become
    U+FFFD; an empty file gives no range; a missing one is an error.
    """
    rows = []
    for p in paths:
        hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        st = hp.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hp)
        # file:/a is written file:///a where Python reads it
        name = st.getPath().toString()
        rows.append((name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name, tables, st.getLen()))
    files = spark.createDataFrame(rows, "id string, tab boolean, bytes long").where("bytes > 0")
    files = files.select("id", "tab", F.explode(F.sequence(F.lit(0), F.expr(f"int((bytes - 1) div {how.range_chars})"))).alias("no"), "bytes")
    return files.repartition("id", "no").mapInArrow(partial(_read_ranges, size=how.range_chars), "id string, tab boolean, no int, before string, body string, after string")


def split_files(spark: SparkSession, paths: list[str], tables: bool = False, how: Limits = Limits()) -> DataFrame:
    """The pieces (as ``split`` gives them) of UTF-8 files of more than ``words`` words: ranges are read where they are needed, no file is loaded whole.

    One task holds the boundary table of a file, some 8 bytes for each line or sentence.
    """
    return _pieces(file_ranges(spark, paths, tables, how), how)


def oversized_files(spark: SparkSession, paths: list[str], tables: bool = False, how: Limits = Limits()) -> DataFrame:
    """(id, boundary) of the files with more than ``words`` words, as ``oversized`` gives it."""
    t = _boundary_tables(file_ranges(spark, paths, tables, how))
    return t.mapInArrow(partial(_classify, limit=how.words), "id string, boundary string").where("boundary is not null")


def _boundary_tables(ranges: DataFrame) -> DataFrame:
    kind = ranges.schema["id"].dataType.simpleString()
    t = ranges.mapInArrow(_detect, f"id {kind}, tab boolean, no int, words array<int>, kinds array<int>")
    return t.groupBy("id").agg(F.first("tab").alias("tab"), F.collect_list(F.struct("no", "words", "kinds")).alias("r"))


def oversized(docs: DataFrame, key: str, text: str, table: str | None = None, newest: str | None = None, how: Limits = Limits()) -> DataFrame:
    """(id, boundary) of each text with more than ``words`` words (runs of non-space characters).

    ``table`` names a boolean column: row if every line is within the limit, else word. Otherwise paragraph, sentence or word, the
    coarsest that keeps every unit within it. Rows with a null id or text give nothing; of a repeated id the row with the greatest ``newest`` counts.
    """
    kind = docs.schema[key].dataType.simpleString()
    t = _boundary_tables(_long(docs, key, text, table, newest, how))
    return t.mapInArrow(partial(_classify, limit=how.words), f"id {kind}, boundary string").where("boundary is not null")


def split(docs: DataFrame, key: str, text: str, table: str | None = None, newest: str | None = None, how: Limits = Limits()) -> DataFrame:
    """(id, piece, cut, first_word, token_count, piece_text) of the oversized texts; ``piece`` counts from 0, ``cut`` is where it ends.

    Every word stands in a piece, in order, and no piece has more than ``words`` words; white space within a piece is kept, around it dropped.
    """
    return _pieces(written(_long(docs, key, text, table, newest, how), "ranges"), how)


def _pieces(ranges: DataFrame, how: Limits) -> DataFrame:
    kind = ranges.schema["id"].dataType.simpleString()
    p = _boundary_tables(ranges).mapInArrow(partial(_plan, how=how), f"id {kind}, no int, lead long, piece int, first long, last long, cut string")
    j = p.join(ranges.select("id", "no", "before", "body"), ["id", "no"])
    e = j.mapInArrow(_emit, f"id {kind}, piece int, no int, first long, last long, cut string, part string")
    g = e.groupBy("id", "piece").agg(F.first("first").alias("first"), F.first("last").alias("last"), F.first("cut").alias("cut"), F.sort_array(F.collect_list(F.struct("no", "part"))).alias("x"))
    whole = F.array_join(F.transform("x", lambda y: y["part"]), "")
    return g.select("id", "piece", "cut", F.col("first").alias("first_word"), (F.col("last") - F.col("first")).cast("int").alias("token_count"), F.regexp_replace(whole, r"(?U)\s+\z", "").alias("piece_text"))
