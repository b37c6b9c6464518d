"""Noise in text read from scanned pages: running headers, page numbers, divided words, misread characters.

Running lines and page numbers are decided by how often a file repeats a line at the edges of its pages and by how printed numbers follow
the pages. Words come from a lexicon of corpus frequencies. A symmetric-delete index over the lexicon (one character, or one pair that scanners confuse, taken out of either word)
gives candidates for each rare word; an edit distance that weighs confusion pairs accepts them, and bigram context picks among several.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graniteloom.runtime import latest, written


@dataclass(frozen=True)
class Scan:
    """``edge`` lines at either end of a page can be running lines; ``pages`` of a file must agree on one, and on its page numbers.

    A word is misread if a candidate one confusion away is at least ``ratio`` times as frequent and stands ``least`` times in the corpus.
    """

    edge: int = 3
    pages: int = 2
    ratio: float = 10.0
    least: int = 5


# What a scanner makes of characters, (true, seen), lower case.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("l", "1"), ("l", "|"), ("l", "i"), ("i", "l"), ("i", "1"), ("i", "|"), ("o", "0"), ("s", "5"), ("a", "@"), ("b", "6"), ("g", "9"), ("z", "2"), ("b", "8"), ("t", "+"),
    ("m", "rn"), ("h", "li"), ("u", "ii"), ("d", "cl"), ("w", "vv"), ("n", "ri"), ("k", "lc"),
    ("rn", "m"), ("li", "h"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("fi", "ﬁ"), ("fl", "ﬂ"),
    ("ä", "a¨"), ("ö", "o¨"), ("ü", "u¨"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("ü", "ii"), ("ß", "b"), ("ß", "fs"),
)
# Marks of a divided word at a line end.
MARKS = "-\u00ac\u00ad\u2010\u2011"
# The words around a page number.
BEFORE_NUMBER, AFTER_NUMBER = ("page", "p.", "blatt", "seite", "s."), ("쪽", "페이지")

_SEEN_PAIRS = tuple(b for _, b in CONFUSIONS if len(b) == 2)
_TRUE_PAIRS = tuple(a for a, _ in CONFUSIONS if len(a) == 2)
_DIGITS = str.maketrans("OoIl|SsBZ", "001115582")
_NUM = r"[0-9OoIl|SsBZ]{1,5}"
_NUMBER = re.compile(rf"(?:(?P<dash>[-–—])\s*(?P<a>{_NUM})\s*[-–—]|\[\s*(?P<b>{_NUM})\s*\]|(?:{'|'.join(map(re.escape, BEFORE_NUMBER))})\s*(?P<c>{_NUM})(?:\s*(?:/|of|von)\s*{_NUM})?|(?P<d>{_NUM})\s*/\s*{_NUM}|(?P<e>{_NUM})\s*(?:{'|'.join(AFTER_NUMBER)})|(?P<f>{_NUM}))", re.I)
_TRAIL = re.compile(rf"^(?:{_NUM}\s{{2,}})?(.*?)(?:\s{{2,}}{_NUM})?$", re.S)
_TOKEN = re.compile(r"(?:[^\W_]|[|@\u00a8\u0300-\u036f])+")
_LETTERS = re.compile(r"[^\W\d_]+")
_HYPHENATED = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
# the mark comes first, so that the search jumps from mark to mark
_DIVIDED = re.compile(rf"[{MARKS}](?<=[^\W\d_].)[^\S\n]*\n[^\S\n]*(?=[^\W\d_])")
_END = re.compile(rf"([^\W\d_]+)([{MARKS}])\s*$")
_BEGIN = re.compile(r"\s*([^\W\d_|@¨](?:[^\W_]|[|@¨])*)")
_JAMO = re.compile(r"[ㄱ-ㅣ]")
_STICK = "|Iil1"


def number(line: str) -> tuple[int | None, bool]:
    """(printed page number, whether it is dressed up) of a line that gives nothing else."""
    m = _NUMBER.fullmatch(line.strip())
    if not m:
        return None, False
    kind, text = next((k, v) for k, v in m.groupdict().items() if v and k != "dash")
    if kind == "f" and not text[0].isdigit():
        return None, False
    digits = text.translate(_DIGITS)
    return (int(digits) if digits.isdigit() else None), kind != "f"


def skeleton(line: str) -> str:
    """A running line reduced so that common misreadings of it are equal; a page number set apart by spaces is left out."""
    s = _TRAIL.match(line.strip()).group(1).lower()
    out = []
    n = len(s)
    for i, c in enumerate(s):
        o = ord(c)
        if 0xAC00 <= o <= 0xD7A3:
            out.append(chr(0x1100 + (o - 0xAC00) // 588))
        elif 0x3131 <= o <= 0x314E:
            # a consonant opens a syllable only in front of a vowel or a stroke; else it is the end of the one before
            if i + 1 < n and (0x314F <= ord(s[i + 1]) <= 0x3163 or s[i + 1] in _STICK):
                lead = unicodedata.normalize("NFKC", c)
                out.append(lead if "ᄀ" <= lead <= "ᄒ" else c)
        elif 0x314F <= o <= 0x3163 or (c in _STICK and i and 0x3131 <= ord(s[i - 1]) <= 0x314E):
            continue
        else:
            out.append(c)
    s = unicodedata.normalize("NFKD", "".join(out))
    s = "".join(c for c in s if not unicodedata.combining(c) and c != "¨" and not c.isspace())
    # letters become the pairs they are taken for, never the other way round: so overlapping pairs cannot be read in two ways
    for a, b in (("m", "rn"), ("d", "cl"), ("h", "li"), ("w", "vv"), ("u", "ii"), ("k", "lc"), ("n", "ri")):
        s = s.replace(a, b)
    return s.translate(str.maketrans("el1|05@689ß2", "ciiiosabbgbz"))


def body_lines(text: str) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]


def _edges(batches: Iterator[pa.RecordBatch], edge: int) -> Iterator[pa.RecordBatch]:
    """(id, file, page, place, text) to the lines at the edges: (id, file, page, place, line_no, key, printed, dressed)."""
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            ls = body_lines(row[4])
            full = [i for i, x in enumerate(ls) if x.strip()]
            for i in sorted({*full[:edge], *full[-edge:]}):
                printed, dressed = number(ls[i])
                out.append((*row[:4], i + 1, skeleton(ls[i]), printed, dressed))
        if out:
            kinds = [batch.schema.field(i).type for i in range(4)] + [pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "file", "page", "place", "line_no", "key", "printed", "dressed"])


def running(pages: DataFrame, how: Scan) -> DataFrame:
    """(id, line_no, kind) of header and page_no lines of pages (id, file, page, place, text)."""
    kind = pages.schema["id"].dataType.simpleString()
    e = written(pages.mapInArrow(partial(_edges, edge=how.edge), f"id {kind}, file string, page long, place long, line_no long, key string, printed long, dressed boolean"), "edges")
    no = e.where("printed is not null")
    # the distance between printed and counted pages that most pages of the file have, by either count
    for c in ("page", "place"):
        by = no.where(F.col(c).isNotNull()).select("file", "id", (F.col("printed") - F.col(c)).alias("off")).distinct().groupBy("file", "off").agg(F.count("*").alias("n")).where(F.col("n") >= how.pages)
        best = by.groupBy("file").agg(F.max(F.struct("n", (-F.col("off")).alias("o"))).alias("b")).select("file", (-F.col("b.o")).alias(f"{c}_off"))
        no = no.join(best, "file", "left")
    fits = F.coalesce(F.col("printed") - F.col("page") == F.col("page_off"), F.lit(False)) | F.coalesce(F.col("printed") - F.col("place") == F.col("place_off"), F.lit(False))
    none = F.col("page_off").isNull() & F.col("place_off").isNull()
    page_no = no.where(fits | (F.col("dressed") & none)).select("id", "line_no")
    # running lines: the same key at the edges of several pages
    lines = e.where(F.col("printed").isNull() & (F.length("key") >= 3))
    keys = lines.select("file", "key", "id").distinct().groupBy("file", "key").agg(F.count("*").alias("n")).where(F.col("n") >= how.pages)
    header = lines.join(keys, ["file", "key"], "left_semi").select("id", "line_no")
    return header.withColumn("kind", F.lit("header")).unionByName(page_no.withColumn("kind", F.lit("page_no"))).distinct()


def _count_words(batches: Iterator[pa.RecordBatch], limit: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Texts to (word, n): words of letters and hyphenated compounds; words divided at line ends count as one."""
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for t in batch.column(0).to_pylist():
            t = _DIVIDED.sub("", t).lower()
            ws = _HYPHENATED.findall(t)
            seen.update(ws)
            if "-" in t:
                # a compound's parts count as well
                seen.update(p for w in ws if "-" in w for p in w.split("-"))
        if len(seen) > limit:
            yield flush()
            seen.clear()
    if seen:
        yield flush()


def lexicon(texts: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each word stands in all texts. A repeated row counts again; null texts count nothing."""
    use = texts.select(F.col(f"`{text}`").alias("t")).where("t is not null")
    return use.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def odd(word: str) -> int | None:
    """Where a word (lower-case letters as they stand) has a character that no word has; None if nowhere."""
    for i, c in enumerate(word):
        p, q = word[i - 1 : i], word[i + 1 : i + 2]
        if c in "|@¨ﬁﬂ" and (p.isalpha() or q.isalpha()):
            return i
        if "ㄱ" <= c <= "ㅣ" and len(word) > 1:
            return i
        if c in "015" and p.islower() and q.islower() and p.isascii() and q.isascii():
            return i
    return None


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, skip) to the words of the body: (id, line_no, next_no, prev, word, left, mark, odd).

    ``left`` is the number of characters in front of a division, with ``mark`` its mark; a last line's open division has next_no null.
    """
    for batch in batches:
        ids, out = batch.column(0), []
        for r, (t, skip) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            ls, gone = body_lines(t), set(skip or ())
            use = [i for i in range(len(ls)) if i + 1 not in gone]
            rest, prev = 0, ""
            for j, i in enumerate(use):
                line = ls[i]
                end, nxt = _END.search(line), use[j + 1] if j + 1 < len(use) else None
                begin = None
                if end:
                    begin = _BEGIN.match(ls[nxt]) if nxt is not None else None
                    # a mark in front of a blank line or of no letter divides nothing
                    if nxt is not None and not begin:
                        end = None
                stop = end.start(2) if end else len(line)
                for m in _TOKEN.finditer(line, rest, stop):
                    w = m.group()
                    if not any(c.isalpha() for c in w):
                        continue
                    if end and m.end() == stop:
                        if begin:
                            whole = w + begin.group(1)
                            out.append((r, i + 1, nxt + 1, prev, whole.lower(), len(w), end.group(2), odd(whole)))
                            prev = whole.lower()
                        else:
                            out.append((r, i + 1, None, prev, w.lower(), len(w), end.group(2), odd(w)))
                            prev = ""
                        continue
                    out.append((r, i + 1, i + 1, prev, w.lower(), len(w), None, odd(w)))
                    prev = w.lower()
                rest = begin.end() if end and begin else 0
        if out:
            c = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(c[0]))] + [pa.array(x, k) for x, k in zip(c[1:], kinds)], ["id", "line_no", "next_no", "prev", "word", "left", "mark", "odd"])


def deletes(word: str, pairs: tuple[str, ...]) -> set[str]:
    """A word without one character, or without one of ``pairs``; a Hangul syllable come apart (a letter beside a stroke or another part) counts as a pair."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + word[i + 2 :] for i in range(len(word) - 1) if word[i : i + 2] in pairs or _JAMO.match(word[i + 1]) or (_JAMO.match(word[i]) and word[i + 1] in _STICK)}
    return out


def _index(batches: Iterator[pa.RecordBatch], pairs: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(word, n) to (key, word, n): the delete keys of each word."""
    for batch in batches:
        keys, at = [], []
        for i, w in enumerate(batch.column(0).to_pylist()):
            d = deletes(w, pairs)
            keys += d
            at += [i] * len(d)
        take = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0).take(take), batch.column(1).take(take)], ["key", "word", "n"])


_PLAIN: dict[str, list[str]] = {}


def distance(seen: str, true: str) -> float:
    """Weighted edit distance: 0.5 for a confusion pair, 0.5 for a syllable broken into letters, 1 for any other edit."""
    if not _PLAIN:
        for a, b in CONFUSIONS:
            _PLAIN.setdefault(b, []).append(a)
    n, m = len(seen), len(true)
    inf = float(n + m)
    cost = [[inf] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            c = cost[i][j]
            if c == inf and (i or j):
                continue
            if i < n and j < m:
                step = 0.0 if seen[i] == true[j] else 1.0
                cost[i + 1][j + 1] = min(cost[i + 1][j + 1], c + step)
            if i < n:
                cost[i + 1][j] = min(cost[i + 1][j], c + 1)
            if j < m:
                cost[i][j + 1] = min(cost[i][j + 1], c + 1)
            for k in (1, 2):
                if i + k <= n:
                    s = seen[i : i + k]
                    for a in _PLAIN.get(s, ()):
                        if true.startswith(a, j):
                            cost[i + k][j + len(a)] = min(cost[i + k][j + len(a)], c + 0.5)
                    if k == 2 and j < m and broken(s, true[j]):
                        cost[i + 2][j + 1] = min(cost[i + 2][j + 1], c + 0.5)
    return cost[n][m]


def broken(pair: str, syllable: str) -> bool:
    """Whether two characters can be one Hangul syllable come apart: its first letter and a stroke, or the open syllable and its last letter."""
    o = ord(syllable) - 0xAC00
    if not 0 <= o < 11172:
        return False
    lead, tail = unicodedata.normalize("NFKC", pair[0]), unicodedata.normalize("NFKC", pair[1])
    if _JAMO.match(pair[0]):
        return lead == chr(0x1100 + o // 588) and (pair[1] in _STICK or bool(_JAMO.match(pair[1])))
    return bool(_JAMO.match(pair[1])) and ord(pair[0]) - 0xAC00 == o - o % 28 and unicodedata.normalize("NFKD", syllable)[-1:] == _TAIL.get(tail, "")


#: Hangul consonants that can end a syllable, as its first letter and as its last.
_TAIL = {chr(c): unicodedata.lookup(unicodedata.name(chr(c)).replace("CHOSEONG", "JONGSEONG")) for c in range(0x1100, 0x1113) if unicodedata.name(chr(c)).split()[-1] not in ("SSANGTIKEUT", "SSANGPIEUP", "SSANGCIEUC")}
_TAIL |= {chr(c): chr(c) for c in range(0x11A8, 0x11C3)}  # clusters have no first-letter form


def composed(word: str) -> str:
    """A word whose open syllables take up a consonant that stands after them alone: what needs no lexicon to repair."""
    out: list[str] = []
    for i, c in enumerate(word):
        tail = _TAIL.get(unicodedata.normalize("NFKC", c)) if _JAMO.match(c) else None
        o = ord(out[-1][-1]) - 0xAC00 if out else -1
        opens = i + 1 < len(word) and (word[i + 1] in _STICK or 0x314F <= ord(word[i + 1]) <= 0x3163)
        if tail and 0 <= o < 11172 and o % 28 == 0 and not opens:
            out[-1] = chr(0xAC00 + o + ord(tail) - 0x11A7)
        else:
            out.append(c)
    return "".join(out)


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, candidate, n) with the weighted distance and the place of the first difference, for candidates one confusion away."""
    for batch in batches:
        keep, ds, at = [], [], []
        for i, (w, c) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            d = distance(w, c)
            if 0 < d <= 0.5:
                keep.append(i)
                ds.append(d)
                at.append(next((k for k, (x, y) in enumerate(zip(w, c)) if x != y), min(len(w), len(c))))
        if keep:
            b = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ds), pa.array(at, pa.int32())], ["word", "candidate", "n", "distance", "at"])


def candidates(words: DataFrame, lex: DataFrame, how: Scan) -> DataFrame:
    """(word, candidate, n, distance, at) of distinct words and the lexicon words they may be misreadings of."""
    own = words.select("word").distinct().join(lex.withColumnRenamed("n", "own"), "word", "left").select("word", F.coalesce("own", F.lit(0)).alias("n"))
    keys = "key string, word string, n long"
    # a frequent word is no misreading: nothing is ratio times as frequent as it
    top = lex.agg(F.max("n")).first()[0] or 0
    seen = own.where(F.col("n") * how.ratio <= top).mapInArrow(partial(_index, pairs=_SEEN_PAIRS), keys)
    true = lex.where((F.col("n") >= how.least) & ~F.col("word").contains("-")).mapInArrow(partial(_index, pairs=_TRUE_PAIRS), keys)
    j = seen.join(true.select("key", F.col("word").alias("candidate"), F.col("n").alias("cn")), "key").where((F.col("word") != F.col("candidate")) & (F.col("cn") >= how.ratio * F.col("n")))
    return j.select("word", "candidate", F.col("cn").alias("n")).distinct().mapInArrow(_weigh, "word string, candidate string, n long, distance double, at int")


def _pages(docs: DataFrame, key: str, text: str, file: str, page: str, place: str | None, newest: str | None, scanned: Column) -> DataFrame:
    use = docs.where(scanned & F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    use = use.select(F.col(f"`{key}`").alias("id"), F.col(f"`{file}`").alias("file"), F.col(f"`{page}`").cast("long").alias("page"), (F.col(f"`{place}`").cast("long") if place else F.lit(None).cast("long")).alias("place"), F.col(f"`{text}`").alias("text"), (F.col(f"`{newest}`") if newest else F.lit(None)).alias("u"))
    return latest(use, "id", "u").drop("u")


def analyse(docs: DataFrame, key: str, text: str, file: str, page: str, scanned: Column, place: str | None = None, newest: str | None = None, how: Scan = Scan()) -> dict[str, DataFrame]:
    """The findings on the pages for which ``scanned`` holds, as tables.

    pages (id, file, page, place, text); marks (id, line_no, kind) of header and page_no; divisions (id, line_no, next_no, joined, mark, whole): ``whole`` is
    false where the mark belongs to a compound; misread (id, line_no, word, prev, at); fixes (word, candidate, n, distance).
    Rows with a null id, text or file take no part; of a repeated id the row with the greatest ``newest`` counts. A null page number only leaves
    ``place`` (the order of pages in their file) to follow. Lines end with ``\\n``, with or without ``\\r`` before it.
    """
    pages = written(_pages(docs, key, text, file, page, place, newest, scanned), "pages")
    marks = written(running(pages.where("file is not null"), how), "marks")
    skip = marks.groupBy("id").agg(F.collect_set("line_no").alias("skip"))
    kind = pages.schema["id"].dataType.simpleString()
    body = pages.select("id", "text").join(skip, "id", "left").select("id", "text", "skip")
    words = written(body.mapInArrow(_words, f"id {kind}, line_no long, next_no long, prev string, word string, left int, mark string, odd int"), "words")
    lex = written(lexicon(docs, text), "lexicon")
    # divisions: a plain hyphen stays where the compound is more frequent than the joined word
    div = words.where("mark is not null")
    hy = F.when((F.col("mark") == "-") & F.col("next_no").isNotNull(), F.concat(F.expr("substring(word, 1, left)"), F.lit("-"), F.expr("substring(word, left + 1)")))
    div = div.withColumn("compound", hy)
    div = div.join(lex.select(F.col("word"), F.col("n").alias("joined_n")), "word", "left")
    div = div.join(lex.select(F.col("word").alias("compound"), F.col("n").alias("compound_n")), "compound", "left")
    whole = F.coalesce("compound_n", F.lit(0)) <= F.coalesce("joined_n", F.lit(0))
    div = written(div.select("id", "line_no", "next_no", "word", "left", "mark", whole.alias("whole"), "prev", "odd"), "divisions")
    # misread: an impossible character, or a confusion away from a far more frequent word; parts of compounds are words of their own
    plain = words.where("mark is null").select("id", "line_no", "next_no", "word", "left", "prev", "odd")
    joined = div.where("whole and next_no is not null").select("id", "line_no", "next_no", "word", "left", "prev", "odd")
    parts = div.where("not whole").select("id", F.explode(F.array(F.struct("line_no", F.expr("substring(word, 1, left)").alias("word")), F.struct(F.col("next_no").alias("line_no"), F.expr("substring(word, left + 1)").alias("word")))).alias("x"))
    parts = parts.select("id", "x.line_no", F.col("x.line_no").alias("next_no"), "x.word", F.length("x.word").alias("left"), F.lit("").alias("prev"), F.lit(None).cast("int").alias("odd"))
    open_ = div.where("whole and next_no is null and odd is not null").select("id", "line_no", F.col("line_no").alias("next_no"), "word", "left", "prev", "odd")
    every = plain.unionByName(joined).unionByName(parts).unionByName(open_)
    cand = written(candidates(every.where("length(word) >= 3"), lex, how), "candidates")
    first = cand.groupBy("word").agg(F.min("at").alias("at"))
    hit = every.join(first, "word", "left").where("odd is not null or at is not null")
    at = F.coalesce("odd", "at")
    misread = hit.select("id", F.when(at < F.col("left"), F.col("line_no")).otherwise(F.col("next_no")).alias("line_no"), "word", "prev", at.alias("at"))
    return {"pages": pages, "marks": marks, "divisions": div, "misread": misread, "fixes": cand, "lexicon": lex}


def findings(docs: DataFrame, key: str, text: str, file: str, page: str, scanned: Column, place: str | None = None, newest: str | None = None, how: Scan = Scan()) -> DataFrame:
    """(id, line_no, kind): header and page_no lines, and of the others those with a divided word (hyphen) or a misread one (char)."""
    a = analyse(docs, key, text, file, page, scanned, place, newest, how)
    hy = a["divisions"].where("whole").select("id", "line_no", F.lit("hyphen").alias("kind"))
    ch = a["misread"].select("id", "line_no", F.lit("char").alias("kind"))
    return a["marks"].unionByName(hy).unionByName(ch).distinct()


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for t in batch.column(0).to_pylist():
            ws = _LETTERS.findall(_DIVIDED.sub("", t).lower())
            seen.update(zip(ws, ws[1:]))
        if seen:
            a, b = zip(*seen)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(seen.values()), pa.int64())], ["prev", "word", "n"])


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t, skip, div, fix in zip(*(batch.column(c).to_pylist() for c in ("text", "skip", "divided", "fixed"))):
            gone, whole = set(skip or ()), {d["line_no"]: d["whole"] for d in div or ()}
            swap = {f["word"]: f["candidate"] for f in fix or ()}
            text, glue = [], True
            for i, line in enumerate(body_lines(t), 1):
                if i in gone:
                    continue
                if not line.strip():
                    text.append("\n\n")
                    glue = True
                    continue
                if not glue:
                    text.append(" ")
                cut = line.strip()
                if i in whole:
                    cut = cut[:-1] if whole[i] else cut
                text.append(cut)
                glue = i in whole
            s = re.sub(r"\n{3,}", "\n\n", "".join(text).strip())
            out.append(_TOKEN.sub(lambda m: _cased(m.group(), swap), s) if swap or _JAMO.search(s) else s)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("file"), batch.column("page"), pa.array(out, pa.string())], ["id", "file", "page", "text"])


def _cased(word: str, swap: dict[str, str]) -> str:
    new = swap.get(word.lower())
    if new is None:
        return composed(word) if _JAMO.search(word) else word
    return new.upper() if word.isupper() else new[:1].upper() + new[1:] if word[:1].isupper() else new


def repair(docs: DataFrame, key: str, text: str, file: str, page: str, scanned: Column, place: str | None = None, newest: str | None = None, how: Scan = Scan()) -> DataFrame:
    """(id, file, page, text): each scanned page as continuous paragraphs, without running lines and page numbers.

    Divided words are joined, misread words take their best candidate: the nearest, then the one that follows the word before most often in the corpus,
    then the most frequent. A misread word without a candidate stays as it is.
    """
    a = analyse(docs, key, text, file, page, scanned, place, newest, how)
    use = a["misread"].select("id", "word", "prev").distinct().join(a["fixes"], "word")
    big = docs.select(F.col(f"`{text}`").alias("t")).where("t is not null").mapInArrow(_bigrams, "prev string, word string, n long")
    asked = use.select("prev", F.col("candidate").alias("word")).distinct()
    big = big.join(asked, ["prev", "word"], "left_semi").groupBy("prev", "word").agg(F.sum("n").alias("together"))
    use = use.join(big.withColumnRenamed("word", "candidate"), ["prev", "candidate"], "left")
    w = W.Window.partitionBy("id", "word").orderBy("distance", F.desc(F.coalesce("together", F.lit(0))), F.desc("n"), "candidate")
    fix = use.withColumn("r", F.row_number().over(w)).where("r = 1").groupBy("id").agg(F.collect_list(F.struct("word", "candidate")).alias("fixed"))
    skip = a["marks"].groupBy("id").agg(F.collect_set("line_no").alias("skip"))
    div = a["divisions"].groupBy("id").agg(F.collect_list(F.struct("line_no", "whole")).alias("divided"))
    j = a["pages"].join(skip, "id", "left").join(div, "id", "left").join(fix, "id", "left")
    kind = a["pages"].schema["id"].dataType.simpleString()
    return j.mapInArrow(_paragraphs, f"id {kind}, file string, page long, text string")
