"""The training-data operators against plain versions on small, hard tables: nulls, empties, ties, repeats, clashing columns."""

import itertools
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graniteloom.llm import boilerplate, graph, mixture, near_duplicates, neighbours, pieces, scans, spans, terms, tokens
from graniteloom.llm.near_duplicates import Similarity

# connected components


@pytest.mark.parametrize("limit", [0, 10_000])
def test_components(spark, limit):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(500, 500), (None, 1)]
    want = {}
    for a, b in edges:
        if a is not None:
            ca, cb = want.setdefault(a, {a}), want.setdefault(b, {b})
            if ca is not cb:
                ca |= cb
                for x in cb:
                    want[x] = ca
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y", limit).collect()))
    assert got == {k: min(v) for k, v in want.items()}


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "x string, y string"), "x", "y").count() == 0


# 1 boilerplate


def plain_lines(rows, least):
    sup, at = defaultdict(set), []
    for d, t, f in rows:
        if None in (d, t, f):
            continue
        for i, line in enumerate(t.split("\n"), 1):
            k = "".join(c for c in line if unicodedata.category(c)[0] == "L").lower()
            if k:
                sup[f, k].add(d)
                at.append((d, i, (f, k)))
    return {(d, i) for d, i, k in at if len(sup[k]) >= least}


def test_boilerplate(spark):
    rows = [(f"d{i}", f"Home > Site {i}\r\nown line {'abcdefghij'[i]}\n\nShare this!\nAll rights reserved 20{i:02}", "f") for i in range(10)]
    rows += [("e1", "Home > Site\nx", "g"), ("e2", None, "f"), ("e3", "", "f"), (None, "Share this!", "f"), ("e4", "Share this!\nShare this!\n12345\n" + "long " * 50_000, "f"), ("e5", "Share this!", None)]
    df = spark.createDataFrame(rows, "doc string, text string, site string").withColumn("block", F.lit(1)).withColumn("node", F.lit("x"))
    occ, members = boilerplate.blocks(df, "doc", "text", "site", 8)
    assert {(r["doc"], r["line_no"]) for r in occ.collect()} == plain_lines(rows, 8)
    # the three lines of the page foot and head follow each other only in part: own lines stand between
    assert members.select("block").distinct().count() == 2
    s = {r["doc"]: r for r in boilerplate.strip(df, "doc", "text", "site", 8).collect()}
    assert s["d3"]["text"] == "own line d\n" and s["d3"]["removed_lines"] == 3 and s["e1"]["removed_lines"] == 0 and s["e2"]["text"] is None and s["e4"]["text"].startswith("12345\nlong ")
    assert boilerplate.strip(df.limit(0), "doc", "text", "site").count() == 0


def test_hot_site(spark):
    """One site holds all rows; its line stands in each."""
    df = spark.range(3000).select(F.col("id").cast("string").alias("d"), F.concat(F.lit("Footer\nown "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("t"), F.lit("s").alias("f"))
    occ, _ = boilerplate.blocks(df, "d", "t", "f")
    assert occ.count() == 3000


# 3 near-duplicates


def test_near_duplicates(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(60):
        base = [r.choice(vocab) for _ in range(r.randrange(40, 120))]
        for k in range(r.randrange(1, 6)):
            t = list(base)
            for _ in range(k * 3):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((f"{g}-{k}", " ".join(t)))
    rows += [("copy", rows[0][1].upper()), ("short", "one two"), ("none", None), ("empty", ""), rows[0], ("big", " ".join(vocab * 5))]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= 30:
            sets[i] = set(zip(w, w[1:], w[2:]))
    want = {tuple(sorted(p)) for p in itertools.combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) >= 0.6 * len(sets[p[0]] | sets[p[1]])}
    df = spark.createDataFrame(rows, "id string, t string").withColumn("c", F.lit(1))
    how = Similarity(3, 0.6, 30, 48, 4)
    m, p = near_duplicates.similar_classes(df, "id", "t", how)
    origin = spark.createDataFrame([(i, i) for i in sets], "id string, origin string")
    assert {tuple(x) for x in near_duplicates.pairs_between(m, p, origin).collect()} == want
    g = {x["id"]: x for x in near_duplicates.near_duplicates(df, "id", "t", how).collect()}
    assert set(g) == set(sets) and g["copy"]["class_id"] == "0-0" and g["copy"]["links"] == g["0-0"]["links"]
    for a, b in want:
        assert g[a]["group_id"] == g[b]["group_id"]
    same = origin.withColumn("origin", F.lit("one"))
    assert near_duplicates.pairs_between(m, p, same).count() == 0
    assert near_duplicates.near_duplicates(df.limit(0), "id", "t").count() == 0


def test_hot_class(spark):
    """A third of all rows are copies: one class, no pairs among them."""
    text = " ".join(f"t{i}" for i in range(50))
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(text)).otherwise(F.concat_ws(" ", *[F.concat(F.col("id").cast("string"), F.lit(f"x{i}")) for i in range(40)])).alias("t"))
    g = near_duplicates.near_duplicates(df, "id", "t")
    assert g.where("class_id = 0").count() == 1000 and g.agg(F.sum("links")).first()[0] == 0 and g.count() == 3000


def test_large_family(spark, monkeypatch):
    """1,000 edited copies of one text, many near the threshold: each similar pair that shares a bucket is found, whole buckets or cut into blocks."""
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    base = [r.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(1000):
        t = list(base)
        for _ in range(r.randrange(3, 9)):
            t[r.randrange(len(t))] = r.choice(vocab)
        rows.append((i, " ".join(t)))
    sets = [set(zip(w, w[1:], w[2:])) for w in (t.split() for _, t in rows)]
    want = {p for p in itertools.combinations(range(len(rows)), 2) if len(sets[p[0]] & sets[p[1]]) >= 0.6 * len(sets[p[0]] | sets[p[1]])}
    df = spark.createDataFrame(rows, "id long, t string")
    how = Similarity(3, 0.6, 30, 48, 4)
    keys = {x["id"]: set(x["bands"]) for x in near_duplicates.signatures(df, "id", "t", how).select("id", "bands").collect()}
    meet = {p for p in want if keys[p[0]] & keys[p[1]]}
    assert len(want) > 3000 and len(meet) >= 0.998 * len(want)
    origin = spark.createDataFrame([(i, str(i)) for i, _ in rows], "id long, origin string")
    for block in (near_duplicates.BLOCK, 50):
        monkeypatch.setattr(near_duplicates, "BLOCK", block)
        got = {tuple(x) for x in near_duplicates.pairs_between(*near_duplicates.similar_classes(df, "id", "t", how), origin).collect()}
        assert meet <= got <= want, (len(meet), len(meet - got), len(want), len(got - want))


# 4 terms


def test_terms(spark):
    rows = [("a", {"Café ": 2, "CAFÉ": 1, "x": None}, 1), ("a", {"café": 9, "y": 1}, 2), ("b", {"ｙ": 3}, 1), ("c", {}, 1), ("d", None, 1), (None, {"z": 1}, 1), ("e", {" ": 1}, 1)]
    df = spark.createDataFrame(rows, "k string, f map<string,int>, u int").withColumn("term", F.lit(1))
    got = {r["term"]: (r["frequency"], r["df"], r["mark"]) for r in terms.term_counts(df, "k", "f", F.col("u"), common=0.3).collect()}
    assert got == {"café": (9, 1, "rare"), "x": (0, 1, "rare"), "y": (4, 2, "common"), "": (1, 1, "rare")}
    assert terms.term_counts(df.limit(0), "k", "f").count() == 0


def test_bitmaps():
    r = np.random.default_rng(1)
    few, many = np.unique(r.integers(0, 65536, 50)), np.unique(r.integers(0, 65536, 9000))
    a, b = terms._one(few), terms._one(many)
    assert len(a) == 2 * len(few) and len(b) == 8192 and terms.members(b).tolist() == many.tolist()
    u = terms.union([a, b])
    assert terms.cardinality(u) == len(np.union1d(few, many)) and terms.union([a]) == a


def test_many_postings(spark, monkeypatch):
    """More records than one block holds, with flushes between."""
    monkeypatch.setattr(terms, "FLUSH", 5000)
    df = spark.range(70_000).select(F.col("id").cast("string").alias("k"), F.create_map(F.lit("all"), F.lit(1), F.concat(F.lit("m"), (F.col("id") % 7).cast("string")), F.lit(2)).alias("f")).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["term"]: (r["frequency"], r["df"]) for r in terms.term_counts(df, "k", "f").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got["all"] == (70_000, 70_000) and got["m3"] == (20_000, 10_000)


# 5 neighbours


def test_neighbours(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((20, 8))
    m = (centres[r.integers(0, 20, 800)] + 0.2 * r.standard_normal((800, 8))).astype(np.float32)
    m[700:760] = m[0] * np.linspace(1, 3, 60, dtype=np.float32)[:, None]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 8), (902, [1.0] * 7), (903, [float("nan")] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<float>").withColumn("leaf", F.lit(1))
    u = neighbours.unit(m.astype(float))
    cos = np.round(u @ u.T, 6)
    np.fill_diagonal(cos, -9)
    want = {i: np.argsort(-cos[i], kind="stable")[:5].tolist() for i in range(800)}
    got = defaultdict(dict)
    for x in neighbours.nearest(df, "id", "v", 5, 8, neighbours.Forest(leaf=40, sample=500)).collect():
        got[x["id"]][x["rank"]] = x["neighbour"]
    hit = sum(len(set(want[i]) & set(got[i].values())) for i in range(800)) / 4000
    assert set(got) == set(range(800)) and hit > 0.95
    assert [got[750][k] for k in range(1, 6)] == want[750]
    exact = defaultdict(dict)
    for x in neighbours.nearest(df, "id", "v", 5, 8, neighbours.Forest(leaf=5000)).collect():
        exact[x["id"]][x["rank"]] = x["neighbour"]
    assert sum(len(set(want[i]) & set(exact[i].values())) for i in range(800)) / 4000 > 0.999
    assert neighbours.nearest(df.where("id is null"), "id", "v", 5, 8).count() == 0
    assert neighbours.nearest(df.where("id = 1"), "id", "v", 5, 8).count() == 0


# 6 pieces


def texts_to_split():
    r = random.Random(4)
    out = {"short": ("a b c", False), "blank": (" \n ", False), "words": (" ".join(f"w{i}" for i in range(95)), False)}
    for k in range(25):
        paras = [" ".join("".join(r.choice("abc") for _ in range(4)) + r.choice(["", "", "", ".", "!", "?"]) for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(3, 9))]
        out[f"t{k}"] = (r.choice(["\n\n", "\n \t\n", "\n"]).join(paras) + r.choice(["", "\n", "  "]), False)
        out[f"r{k}"] = ("\n".join("| " + " ".join("x" * r.randrange(1, 9)) + " |" for _ in range(r.randrange(5, 20))), True)
    out["wide"] = ("| h |\n| " + "x " * 50 + "|\n| y |", True)
    return out


def plain_boundary(t, table, limit):
    n = lambda s: len(s.split())
    if n(t) <= limit:
        return None
    lines = t.split("\n")
    if table:
        return "row" if max(map(n, lines)) <= limit else "word"
    paras = [[]]
    for x in lines:
        if x.strip():
            paras[-1].append(x)
        else:
            paras.append([])
    paras = ["\n".join(p) for p in paras]
    if max(map(n, paras)) <= limit:
        return "paragraph"
    return "sentence" if max(n(s) for p in paras for s in re.split(r"(?<=[.!?])(?=\s)", p)) <= limit else "word"


@pytest.mark.parametrize("size", [7, 64, 1 << 16])
def test_pieces(spark, size):
    src = texts_to_split()
    rows = [(k, t, tab) for k, (t, tab) in src.items()] + [("null", None, False), (None, "a " * 90, False), ("t1", src["t1"][0], False)]
    df = spark.createDataFrame(rows, "id string, body string, tab boolean").withColumn("no", F.lit(1))
    how = pieces.Limits(40, 5, size)
    got = dict(map(tuple, pieces.oversized(df, "id", "body", "tab", None, how).collect()))
    assert got == {k: b for k, (t, tab) in src.items() if (b := plain_boundary(t, tab, 40))}
    by = defaultdict(list)
    for x in pieces.split(df, "id", "body", "tab", None, how).orderBy("piece").collect():
        by[x["id"]].append(x)
    assert set(by) == set(got)
    for k, ps in by.items():
        t, tab = src[k]
        w, done = t.split(), 0
        for x in ps:
            a, b = x["first_word"], x["first_word"] + x["token_count"]
            assert 0 < x["token_count"] <= 40 and x["piece_text"].split() == w[a:b] and x["piece_text"] in t
            assert a <= done < b and done - a <= (0 if tab else 5)
            done = b
        assert done == len(w)
        if tab and got[k] == "row":
            assert all(x["piece_text"].startswith("|") and x["piece_text"].endswith("|") for x in ps)
    assert pieces.split(df.limit(0), "id", "body").count() == 0


@pytest.mark.parametrize("size", [5, 64, 4096])
def test_giant_files(spark, tmp_path, size):
    """Files read by byte ranges give the pieces of their texts, wherever a range cuts a character."""
    texts = {k: t for k, (t, tab) in texts_to_split().items() if not tab}
    texts |= {"wide": "가나 다라。 😀😀 é" * 40 + "\n\n" + "ß. Ä b\n" * 30, "few": "one two", "empty": ""}
    how = pieces.Limits(12, 3, size)
    paths = []
    for n, t in texts.items():
        (tmp_path / n).write_bytes(t.encode("utf-8"))
        paths.append(str(tmp_path / n))
    docs = spark.createDataFrame(list(texts.items()), "id string, t string")
    plain = lambda df: sorted((r["id"].rsplit("/", 1)[-1], r["piece"], r["cut"], r["token_count"], r["piece_text"]) for r in df.collect())
    assert plain(pieces.split_files(spark, paths, how=how)) == plain(pieces.split(docs, "id", "t", how=how))
    assert {r["id"].rsplit("/", 1)[-1]: r["boundary"] for r in pieces.oversized_files(spark, paths, how=how).collect()} == {r["id"]: r["boundary"] for r in pieces.oversized(docs, "id", "t", how=how).collect()}


# 7 scans

PAGE = "Setup Card for the Old Lathe{n}\n{w} the night crew starts the low-\nspeed lathe of {w} and the mainte-\nnance team waits{e}. The equipment is old.\n\n{x}\nForm 12-X\n- {p} -"


def scan_rows():
    base = "the night crew starts the low-speed lathe and the maintenance team waits the equipment is old " * 40
    rows = [("clean", base, "web.html", 1, 1, 1)]
    for i in range(1, 5):
        rows.append((f"p{i}", PAGE.format(w="zero one two three four".split()[i], n="" if i % 2 else f"    {i + 10}", e=" for equipmcnt" if i == 2 else "", x="36298" if i == 3 else "E26" + str(i) + "3", p=i + 10), "scan_1.pdf", None if i == 4 else i, i, 1))
    rows.append(("p5", PAGE.format(w="five", n="", e="", x="9 rec0rds of 한ㄱㅜ말 and 나ㅁ은", p="l5").replace("Setup", "5etup").replace("Lathe", "LATHE", 1), "scan_1.pdf", 5, 5, 1))
    rows += [("p5", "older row", "scan_1.pdf", 5, 5, 0), ("q", "", "scan_2.pdf", 1, 1, 1), ("r", None, "scan_2.pdf", 1, 1, 1), (None, "x", "scan_2.pdf", 1, 1, 1)]
    return rows


def test_scans(spark):
    df = spark.createDataFrame(scan_rows(), "k string, body string, file string, page int, place int, u int").withColumn("id", F.lit(0)).withColumn("line_no", F.lit(0))
    arg = (df, "k", "body", "file", "page", F.col("file").startswith("scan_"), "place", "u")
    got = {tuple(r) for r in scans.findings(*arg).collect()}
    want = {(f"p{i}", n, k) for i in range(1, 6) for n, k in ((1, "header"), (3, "hyphen"), (7, "header"), (8, "page_no"))}
    assert got == want | {("p2", 4, "char"), ("p5", 6, "char")}
    t = {r["id"]: r["text"] for r in scans.repair(*arg).collect()}
    assert t["p1"] == "one the night crew starts the low-speed lathe of one and the maintenance team waits. The equipment is old.\n\nE2613"
    assert "waits for equipment." in t["p2"] and "36298" in t["p3"] and t["q"] == "" and set(t) == {"p1", "p2", "p3", "p4", "p5", "q"}
    assert scans.findings(df.limit(0), *arg[1:]).count() == 0


def test_scan_pieces():
    assert scans.number("— 2I —") == (21, True) and scans.number("43쪽") == (43, True) and scans.number("62 / 96") == (62, True) and scans.number("E26") == (None, False) and scans.number("17") == (17, False)
    assert scans.skeleton("Test Bencli of the Macliine") == scans.skeleton("TEST BENCH OF THE MACHINE    12") and scans.skeleton("오ㄴ문로 지ㅊ1서") == scans.skeleton("온문로 지침서")
    assert scans.distance("nurnber", "number") == 0.5 and scans.distance("tiirned", "turned") == 0.5 and scans.distance("cat", "dog") == 3 and scans.broken("오ㄴ"[0] + "ㄴ", "온") and scans.broken("ㅊ1", "침")
    assert scans.composed("세저ㅇ하고") == "세정하고" and scans.composed("ㅊ1서") == "ㅊ1서" and scans.composed("과ㄴ리") == "관리" and "세하고" in scans.deletes("세저ㅇ하고", ()) & scans.deletes("세정하고", ())
    assert scans.odd("rec0rd") == 3 and scans.odd("C3604") is None and scans.odd("3회") is None


# 8 tokens

HARD = ["", None, "plain text", "한국어 텍스트 😀 <|endoftext|> ǘ", "  \t\n\r\n", "a" * 20_000, "\u0000 x"]


def test_tokens(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(HARD)) + [(0, ""), (None, "x")], "id long, text string").withColumn("ids", F.lit(1))
    rows = tokens.encode(df, "id", "text").collect()
    assert len(rows) == len(HARD) + 2
    got = {r["id"]: r["ids"] for r in rows}
    assert all(got[i] == (other.encode_ordinary(t) if t else []) for i, t in enumerate(HARD))
    back = {r["id"]: r["text"] for r in tokens.decode(tokens.encode(df, "id", "text"), "id", "ids").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(HARD))
    s = {r["id"]: r for r in tokens.encode_spans(df, "id", "text").collect()}[3]
    assert len(s["ids"]) == len(s["starts"]) == len(s["ends"]) and "".join(dict.fromkeys(HARD[3][a:b] for a, b in zip(s["starts"], s["ends"]))) != ""
    assert {r["id"]: r["n_tokens"] for r in tokens.count(df, "id", "text").collect()}[5] == len(got[5])
    assert len(tokens.byte_table()) == 256 and sorted(tokens.byte_table().values()) == list(range(256))
    assert tokens.encode(df.limit(0), "id", "text").count() == 0


# 9 mixture


def test_mixture(spark):
    r = random.Random(6)
    rows = [(i, r.choice("aab"), r.randrange(1, 400)) for i in range(3000)] + [(9000 + i, "c", 50) for i in range(20)] + [(9999, None, 5), (10_000, "a", None), (10_001, "a", 0), (10_002, "other", 9), (None, "a", 9), (9000, "c", 50)]
    w = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 5), ("gone", 0.0, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(rows, "id long, source string, n long").withColumn("p", F.lit(1))
    m = mixture.copies(df.repartition(3), "id", "source", "n", w)
    got = m.collect()
    # the seed decides, not how rows are spread
    again = mixture.copies(df.repartition(7, "n"), "id", "source", "n", w)
    assert {(x["id"], x["copies"]) for x in got} == {(x["id"], x["copies"]) for x in again.collect()}
    assert {(x["id"], x["copies"]) for x in got} != {(x["id"], x["copies"]) for x in mixture.copies(df, "id", "source", "n", w, seed=12).collect()}
    assert len({x["id"] for x in got}) == len(got) == 3020 and all(0 <= x["copies"] <= {"a": 2, "b": 1, "c": 5}[x["source"]] for x in got)
    s = {x["source"]: x for x in mixture.shares(m, w).collect()}
    assert s["c"]["tokens"] == 5000 and s["c"]["most"] == 5
    assert abs(s["a"]["tokens"] - 12_500) < 400 and abs(s["b"]["tokens"] - 7_500) < 400 and s["gone"]["tokens"] == 0
    big = {x["source"]: x for x in mixture.shares(mixture.copies(df, "id", "source", "n", w, total=1e9), w).collect()}
    assert big["b"]["most"] == 1 and big["c"]["tokens"] == 5000
    assert mixture.copies(df.limit(0), "id", "source", "n", w).count() == 0


def test_pairing():
    """Each exchange keeps the expected size, and the chances of either outcome keep each probability."""
    r = random.Random(7)
    for _ in range(200):
        a, b = (r.randrange(10**6), r.randrange(1, 99), r.uniform(0.01, 0.99)), (r.randrange(10**6), r.randrange(1, 99), r.uniform(0.01, 0.99))
        x, y = mixture.pair(a, b, 1)
        assert x[1] * x[2] + y[1] * y[2] == pytest.approx(a[1] * a[2] + b[1] * b[2]) and (x[2] in (0.0, 1.0) or y[2] in (0.0, 1.0))
    up = Counter(mixture.pair((i, 2, 0.5), (i + 10**6, 3, 0.25), 5)[0][2] > 0.5 for i in range(4000))
    assert up[True] / 4000 == pytest.approx(1.0 / 1.75, abs=0.03)  # up 0.75, down 1.0


def test_reduction_tree(spark, monkeypatch):
    monkeypatch.setattr(mixture, "FAN_IN", 3)
    df = spark.range(400).select("id", F.lit("a").alias("s"), F.lit(10).alias("n")).repartition(40)
    w = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = mixture.copies(df, "id", "s", "n", w, total=1230).collect()
    assert sum(x["copies"] for x in got) in (123, 122, 124) and len(got) == 400


# 10 spans


def test_spans(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh é한") for _ in range(n))
    shared = [text(45), text(30), text(29), text(120)]
    rows = [(i, text(r.randrange(0, 90)) + r.choice(shared) + text(r.randrange(0, 60)) + r.choice(["", shared[0]])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "z" * 200), (103, "z" * 90), (104, shared[3]), (105, shared[3]), (None, shared[3]), (104, shared[3])]
    df = spark.createDataFrame(rows, "k long, body string").withColumn("doc", F.lit(1)).withColumn("h1", F.lit(1))
    g = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for a in range(len(t or "") - 29):
                g[t[a : a + 30]].add(i)
    want = {p for s in g.values() for p in itertools.combinations(sorted(s), 2)}
    assert {tuple(x) for x in spans.shared_pairs(df, "k", "body", 30).collect()} == want
    got = {x["doc"]: (x["chars"], x["shared_chars"]) for x in spans.shares(df, "k", "body", 30).collect()}
    for i, t in rows:
        if i is not None:
            t, cover = t or "", set()
            for a in range(len(t) - 29):
                if len(g[t[a : a + 30]]) > 1:
                    cover |= set(range(a, a + 30))
            assert got[i] == (len(t), len(cover))
    assert spans.shared_pairs(df.limit(0), "k", "body", 30).count() == 0


def test_long_texts_in_parts(spark, monkeypatch):
    """Texts longer than a chunk are hashed in overlapping parts."""
    monkeypatch.setattr(spans, "CHUNK", 100)
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcd") for _ in range(n))
    s = text(40)
    rows = [(1, text(75) + s + text(300)), (2, text(333) + s), (3, text(400)), (4, s)]
    got = spans._anchor_rows, {tuple(x) for x in spans.shared_pairs(spark.createDataFrame(rows, "k long, body string"), "k", "body", 40).collect()}
    assert got[1] == {(1, 2), (1, 4), (2, 4)}


# sieve


def test_sieve(spark):
    from graniteloom.llm.sieve import marked, sieve, sifted

    rows = spark.createDataFrame([(i, f"k{i}") for i in range(500)] + [(None, None)], "i long, k string")
    keys = rows.where("i % 7 = 0 or i is null").select("k")
    for bits in (6, 8, 24):
        by = sieve(keys, "k", bits)
        got = {r["i"] for r in sifted(rows, "k", by, bits).collect()}
        assert {i for i in range(500) if i % 7 == 0} <= got and None not in got
        assert by.count() <= max(1, 2 ** (bits - 6)) and (bits < 24 or len(got) < 80)
        assert marked(rows, "k", by, "hit", bits).where("hit").count() == len(got)
    assert sifted(rows, "k", sieve(keys.limit(0), "k")).count() == 0


def test_sharers(spark):
    """A passage in n records gives n rows, whatever their pairs."""
    shared = "".join(chr(97 + i * i % 23) for i in range(400))
    docs = spark.createDataFrame([(i, chr(2000 + i) * 40 + shared + chr(1000 + i) * 50) for i in range(60)] + [(99, "x" * 500), (None, shared), (100, None)], "id long, t string")
    got = spans.sharers(docs, "id", "t").collect()
    assert len(got) == 60 == len({r["doc"] for r in got}) and spans.shared_pairs(docs, "id", "t").count() == 60 * 59 // 2
    assert spans.sharers(docs.limit(0), "id", "t").count() == 0


def test_hub_candidates(spark, monkeypatch):
    """Texts meet over a bounded number of centres: candidates stay in the order of a family's pairs."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(w if r.random() > 0.03 else f"e{r.random()}" for w in words)) for i in range(200)]
    seen = []
    over = near_duplicates._over_hubs
    monkeypatch.setattr(near_duplicates, "_over_hubs", lambda e, s, h: seen.append((e.count(), over(e, s, h))) or seen[0][1])
    freed = near_duplicates.freed
    counts = []
    monkeypatch.setattr(near_duplicates, "freed", lambda *t: counts.extend(x.count() for x in t if x is seen[0][1]) if len(t) == 3 else freed(*t))
    how = Similarity(run=3, threshold=0.6, bands=48, rows=4)
    near_duplicates.similar_classes(spark.createDataFrame(rows, "id int, t string"), "id", "t", how)
    assert seen[0][0] <= 200 * 199 // 2 and counts[0] <= near_duplicates.HUBS * 200 * 199 // 2
