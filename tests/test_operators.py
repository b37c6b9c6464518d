"""Chunking, fusion, citations, safety, routing, voting, agents: literal expectations."""

import pytest
import numpy as np
from pyspark.sql import functions as F

from graniteloom.operators import agents, answers, bm25, chunking, linking, retrieval, routing, sparse_index, voting
from graniteloom.providers import HashedShingles, Scripted, WordOverlap, embed, safe_batches, valid_text


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# chunking


def test_text_parents(spark):
    docs = frame(spark, [("a", "one two\n\nthree four\n\nfive"), ("b", "  "), ("c", None), ("d", "A b c. D e f! G h"), ("e", "x")], "id string, t string")
    p = {(r["source"], r["part"]): r for r in chunking.text_parents(docs, "id", "t", chunking.TextSizes(4, 3, 1)).collect()}
    assert p["a", 1]["text"] == "one two\n\nthree four" and p["a", 2]["text"] == "five" and p["a", 1]["is_split"] and p["a", 2]["parent_id"] == "a_text_part2"
    assert [p["d", i]["text"] for i in (1, 2, 3)] == ["A b c.", "D e f!", "G h"] and p["d", 1]["total_parts"] == 3
    assert p["e", 1]["parent_id"] == "e_text" and not p["e", 1]["is_split"]
    assert {s for s, _ in p} == {"a", "d", "e"}
    with pytest.raises(ValueError):
        chunking.TextSizes(10, 5, 5)


@pytest.mark.parametrize(("n", "want"), [(1, 1), (400, 1), (401, 2), (750, 2), (751, 3), (1100, 3)])
def test_child_counts(spark, n, want):
    c = chunking.text_children(frame(spark, [("p", " ".join("w" * n))], "parent_id string, text string")).collect()
    assert len(c) == want and max(r["token_count"] for r in c) <= 400


def test_table_chunks():
    text = "| A | B |\n|---|---|\n" + "\n".join(f"| A{i:03} | SCM440 | 200 | 0.25 | TiAlN |" for i in range(100))
    parents, children = chunking.table_chunks(text, "doc", chunking.TableSizes(parent=500))
    assert len(parents) > 1 and parents[0]["parent_id"] == "doc_table_part1" and sum(p["end_row"] - p["start_row"] for p in parents) == 100
    assert sorted(i for c in children for i in c["row_indices"]) == list(range(100)) and all(len(c["row_indices"]) <= 7 for c in children)
    parents, children = chunking.table_chunks("| H1 | H2 |\n| Val 1 | x |", "s")
    assert "|---|---|" in parents[0]["text"] and "Val 1" in children[0]["text"] and len(children) == 1
    with pytest.raises(ValueError):
        chunking.parse_table("| only |")


def test_giant_row():
    row = "| " + " ".join(["w"] * 30) + " | a b | c |"
    out = chunking.split_row(row, 10, 2)
    assert out[-1] == "| a b | c |" and all(len(r.split()) <= 12 for r in out) and chunking.split_row("no cells", 5, 1) == []


def test_tables_in_spark(spark):
    t = frame(spark, [("t", "| A |\n|---|\n| x |"), ("u", None), ("v", "no table")], "id string, t string")
    assert [r["parent_id"] for r in chunking.table_parents(t, "id", "t").collect()] == ["t_table"]
    assert [r["row_indices"] for r in chunking.table_children(t, "id", "t").collect()] == [[0]]


# fusion


def fused(spark, dense, sparse, weights=None):
    s = "query int, doc string, text string, score double, rank int"
    rows = lambda xs: [(1, d, t, 1.0, i + 1) for i, (d, t) in enumerate(xs)]
    return {r["doc"]: r for r in retrieval.fuse(frame(spark, rows(dense), s), frame(spark, rows(sparse), s), 60, weights).collect()}


def test_fusion(spark):
    assert fused(spark, [("d1", "x")], [("d1", "y")], {"dense": 0.9})["d1"]["rrf_score"] == pytest.approx(1 / 61, abs=1e-8)
    assert fused(spark, [("d1", "")], [("d1", "correct text")])["d1"]["text"] == "correct text"
    assert fused(spark, [("d1", "")], [("d1", "")]) == {}
    r = fused(spark, [("d1", "x")], [("d2", "y")], {"dense": 70, "sparse": 30})
    assert r["d1"]["rrf_score"] == pytest.approx(0.7 / 61, abs=1e-8) and r["d2"]["rrf_score"] == pytest.approx(0.3 / 61, abs=1e-8)
    assert list(fused(spark, [("d1", "x")], [("d2", "")])) == ["d1"]
    with pytest.raises(ValueError, match="non-negative"):
        retrieval.check_weights(-0.5, 0.5)
    with pytest.raises(ValueError, match="At least one weight"):
        retrieval.check_weights(0, 0)


def test_rerank(spark):
    c = frame(spark, [(1, "a", "x", 1), (1, "b", "", 2), (1, "c", "y", 3), (1, "d", "z", 4)], "query int, doc string, text string, rank int")
    s = frame(spark, [(1, "a", 0.1), (1, "c", 0.9)], "query int, doc string, rerank_score double")
    assert [r["doc"] for r in retrieval.rerank(c, s, 3).orderBy("final_rank").collect()] == ["c", "a", "b", "d"]
    r = retrieval.rerank(c, None, 3).orderBy("final_rank").collect()
    assert [x["doc"] for x in r] == ["a", "c", "b", "d"] and [x["rerank_score"] for x in r] == [1.0, 0.9, None, None]
    assert retrieval.keep_for_rerank(5, 3, True) == (15, 20)


def test_variants_and_chunks(spark):
    v = frame(spark, [(1, 0, "Ask"), (1, 1, "ask"), (1, 2, "other"), (1, 3, " ")], "query int, seq int, text string")
    assert [r["text"] for r in retrieval.unique_variants(v).orderBy("seq").collect()] == ["Ask", "other"]
    c = frame(spark, [(1, 0, "a", "p", "c"), (1, 1, "a", "q", "c"), (1, 2, None, "p", None), (1, 3, None, "p", None)], "query int, seq int, child_id string, parent_text string, child_text string")
    assert [r["seq"] for r in retrieval.unique_chunks(c).orderBy("seq").collect()] == [0, 2]


def test_bm25_updates(spark):
    docs = frame(spark, [(1, "alpha beta alpha"), (2, "beta gamma"), (3, "")], "id int, t string")
    tf = bm25.term_frequencies(docs, "id", "t")
    assert {(r["doc"], r["term"]): r["tf"] for r in tf.collect()}[1, "alpha"] == 2
    new = bm25.term_frequencies(frame(spark, [(2, "delta")], "id int, t string"), "id", "t")
    assert {r["term"]: r["df"] for r in bm25.document_frequencies(bm25.upsert(tf, new)).collect()} == {"alpha": 1, "beta": 1, "delta": 1}
    part, status = bm25.index_batch(docs, "id", "t", atomic=True)
    assert part.count() == 0 and {r["error"] for r in status.collect()} == {"no terms", "rolled back"}


# answers

SOURCES = [(1, 0, "doc1_chunk1", "doc1", "data/inputs/sample.pdf", 5, "text"), (1, 1, "doc1_chunk2", "doc1", "data/inputs/sample.pdf", 12, "table"), (1, 2, "doc2_chunk1", "doc2", "data/inputs/catalog.pdf", 3, "text"), (1, 3, "doc1_chunk1", "doc1", "data/inputs/sample.pdf", 5, "text"), (1, 4, None, "", None, None, None)]


def test_citations(spark):
    s = frame(spark, SOURCES, "query int, seq int, child_id string, parent_id string, source_file string, page_number int, parent_type string")
    n = answers.citation_numbers(s)
    assert [r["number"] for r in n.orderBy("seq").collect()] == [1, 2, 3, 1, 0]
    assert "[1] sample.pdf, 5페이지" in answers.citation_list(n, "ko").first()["citations"]
    assert answers.citation_list(n, "en").first()["citations"].startswith("\n\nSources:\n[1] sample.pdf, page 5\n[2]")
    assert answers.citation_metadata(n).count() == 3
    a = frame(spark, [(1, "see [2] and [7] and [2]")], "query int, answer string")
    assert answers.invalid_citations(a, n).first()["invalid"] == [7]


def test_safety(spark):
    a = frame(spark, [(1, "A good long answer [1].", False, [0.9, 0.7]), (2, "short", False, None), (3, "I don't know the answer", True, None), (4, "A good long answer [1].", False, [0.1])], "query int, answer string, has_citations boolean, nli array<double>")
    r = {x["query"]: x for x in answers.safety(a).collect()}
    assert r[1]["passed"] and r[1]["confidence"] == 0.9
    assert r[2]["issues"] == ["too short", "no citations"] and r[2]["confidence"] == pytest.approx(0.4)
    assert r[3]["issues"] == ["refusal"] and r[4]["issues"] == ["low entailment"]


# routing


def test_lane(spark):
    rows = [("LANE: fast\nCONFIDENCE: 0.9\nREASONING: simple", ("fast", 0.9, "simple")), ("```\nlane： SLOW confidence： 1.7\n```", ("slow", 1.0, "Unable to parse LLM response")), ("LANE: maybe", ("fast", 0.5, "Unable to parse LLM response")), ("LANE: slow\nCONFIDENCE: 0.87\nREASONING: one\ntwo Hope this helps!", ("slow", 0.87, "one two"))]
    got = frame(spark, [(t,) for t, _ in rows], "t string").select(routing.lane(F.col("t")).alias("r")).collect()
    assert [tuple(r["r"]) for r in got] == [w for _, w in rows]


def test_path(spark):
    r = routing.route(frame(spark, [("When is Seollal public holiday in Korea",), ("Show last year's overseas export sales by product",), (None,)], "question string")).collect()
    assert [x["path"] for x in r] == ["llm_only", "fact_only", "complex_dual"] and r[2]["scores"]["complex_dual"] == 5


# voting


def test_routes_of_documents(spark, tmp_path):
    """Rule words count wherever they stand in a text, also after the first 60 characters."""
    import re

    from graniteloom.plans.linking_queries import k9_routes

    pad = "lorem ipsum dolor sit amet " * 4
    texts = ["average rate", pad + "how many days", pad * 50 + "the procedure", pad + "explain the total", "what is this", pad + "what is this", pad + "절차", "show " + pad + "why", "howl yearly " + pad, pad, "", None]
    frame(spark, list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for t in texts:
        hit = {p: t is not None and re.search(r, t) is not None for p, r in routing.RULES.items()}
        hit["complex_dual"] = hit["fact_only"] and hit["doc_only"]
        path = next((p for p in routing.PATHS if hit[p]), routing.PATHS[0])
        want[path] = want.get(path, 0) + 1
    assert {r["path"]: r["questions"] for r in k9_routes(spark, str(tmp_path)).collect()} == want


def test_vote():
    assert voting.vote(["long a", "b", "a"], ["x", "y", "x"]) == "a"
    assert voting.vote(["first", "b"], [1, 2]) == "first"
    assert voting.vote(["first", "b"], [None, None]) == "first" and voting.vote([], []) == voting.NO_SQL


def test_solve(spark):
    spark.range(5).createOrReplaceTempView("t5")
    from graniteloom.functions.sqltools import lint

    sqls = ["SELECT id FROM t5 WHERE id > 2", "SELECT id FROM t5 WHERE id >= 3 ", "SELECT max(id) FROM t5", "SELECT nope FROM t5"]
    assert voting.solve(spark, sqls, lint) == sqls[0]
    assert voting.solve(spark, ["SELECT FROM WHERE"], lint) == voting.NO_SQL
    assert voting.same_result(spark.sql("SELECT 1.0D AS a, NULL AS b"), spark.sql("SELECT 1.0000001D AS x, NULL AS y"))
    assert not voting.same_result(spark.sql("SELECT 1 AS a"), spark.sql("SELECT 2 AS a"))


def test_examples(spark):
    e = HashedShingles(16)
    rows = [("db", f"question {i}", f"masked {i % 3}", "SELECT 1", [float(x) for x in e.encode([f"question {i}"])[0]]) for i in range(6)]
    store = voting.add_examples(None, frame(spark, rows, "db_id string, question string, masked string, sql string, embedding array<float>"))
    assert store.count() == 3 and voting.add_examples(store, frame(spark, rows, store.drop("digest").schema)).count() == 3
    q = frame(spark, [(1, [float(x) for x in e.encode(["question 0"])[0]])], "query int, vector array<float>")
    assert voting.retrieve_examples(store, q, "db", 2, dim=16).first()["score"] == 1.0 and voting.retrieve_examples(store, q, "other", dim=16).count() == 0


# agents and providers


def test_multi_step():
    good = agents.ToolResponse(True, "a sufficiently long piece of evidence", context_chunks=[{"child_id": "c1"}, {"child_id": "c1"}])
    plan = '{"plan": [{"step_id": 1, "tool": "sql", "query": "q1"}, {"step_id": 2, "tool": "doc", "query": "q2"}]}'
    s = agents.multi_step("q", {"sql": lambda q: good, "doc": lambda q: good}, Scripted([plan, "the final answer text"]))
    assert s.answer == "the final answer text" and s.steps == 2 and len(s.context) == 1
    s = agents.multi_step("q", {}, Scripted([plan, "again"]), max_steps=3)
    assert s.error == "no evidence for an answer" and s.trace.count("rewrite") == 2 and s.steps == 3
    assert agents.multi_step("q", {}, Scripted(["no plan"])).error == "no valid plan"
    assert agents.plan_with_repairs(Scripted(["bad", plan]), "p")[0]["tool"] == "sql"


def test_refine(spark):
    m = Scripted(["SELECT a FROM t WHERE b = 'X'", "SELECT a, c FROM t WHERE c = 'X'"])
    r = agents.refine(spark, "q", {"v": "schema"}, m, lambda lit: [("T", "C")], {"T": {"A", "B", "C"}})
    assert r.fields == {("T", "A"), ("T", "B"), ("T", "C")} and r.literals == {"X"} and len(r.attempts) == 2 and r.last_sql().startswith("SELECT a, c")
    assert "Additional fields" in m.prompts[1]
    assert linking.augment("s", []) == "s"


def test_tools(spark):
    spark.range(4).createOrReplaceTempView("t4")
    assert agents.sql_tool(spark, lambda q: ["```sql\nSELECT count(*) FROM t4\n```"])("q").answer == "Result: 4"
    d = agents.document_tool(lambda q: [{"child_text": "no"}, {"child_text": "alpha beta"}], lambda q, c: "answer from " + c[0]["child_text"], WordOverlap())
    assert d("alpha").answer == "answer from alpha beta" and agents.call(None, "q").success is False
    assert agents.expand("q", Scripted(["Q", "other"]), 3) == ["q", "other"] and agents.expand("q") == ["q"]
    with pytest.raises(ValueError):
        agents.Request("", 5)
    assert [e["type"] for e in agents.events("x" * 60, [{}])] == ["status", "citation", "chunk", "chunk", "done"]


def test_embedding(spark):
    v = frame(spark, [("abc",), ("abc",), (None,)], "t string").select(embed(F.col("t"), HashedShingles(8)).alias("v")).collect()
    assert v[0]["v"] == v[1]["v"] and v[2]["v"] == [0.0] * 8
    assert safe_batches(["a b", "c", "d e f"], 3) == [["a b", "c"], ["d e f"]] and valid_text("a b c", 2) == "a b"
    with pytest.raises(ValueError):
        valid_text(" ")


def test_dense_search(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = {i: rng.standard_normal(2).tolist() for i in range(40)} | {40: [1.0], 41: [0.0, 0.0], 42: None, 43: [float("nan"), 1.0], 44: [None, 1.0]}
    vectors = spark.createDataFrame(list(v.items()), "id int, v array<double>").repartition(3)
    # a first query of another length takes no part and decides nothing
    queries = spark.createDataFrame([(0, [1.0]), *[(i, v[i]) for i in range(1, 9)], (None, [1.0, 0.0])], "query int, vector array<double>")
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in v.items() if i < 40}
    want = {q: sorted(unit, key=lambda i: (-round(float(unit[q] @ unit[i]), 6), i))[:5] for q in range(1, 9)}
    for most in (65_536, 3):
        monkeypatch.setattr(retrieval, "QUERIES_A_SCAN", most)
        got = retrieval.dense_search(vectors, "id", "v", queries, 5, 2).collect()
        assert {q: [r["doc"] for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] for q in {r["query"] for r in got}} == want
    assert retrieval.dense_search(vectors.limit(0), "id", "v", queries, 5, 2).count() == 0 == retrieval.dense_search(vectors, "id", "v", queries.limit(0), 5, 2).count()


def test_parents_of_candidates(spark):
    c = frame(spark, [("c1", "p1"), ("c1", "p1"), ("c2", "p9"), ("c3", "p1")], "child_id string, parent_id string")
    p = frame(spark, [("p1", "old", "f", 1, 1), ("p1", "new", "f", 1, 2), ("p2", "x", "f", 1, 1)], "parent_id string, parent_text string, source_file string, page_number int, updated_at int")
    got = retrieval.with_parents(frame(spark, [(1, "c1"), (1, "c2"), (2, "c1"), (2, "c8")], "query int, doc string"), c, p).collect()
    assert sorted((r["query"], r["doc"], r["parent_id"] or "", r["parent_text"] or "") for r in got) == [(1, "c1", "p1", "new"), (1, "c2", "p9", ""), (2, "c1", "p1", "new"), (2, "c8", "", "")]


def test_sparse_index(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = {1: "alpha beta", 2: "beta gamma gamma", 3: "alpha alpha delta", 4: ""}
    tf = lambda d: bm25.term_frequencies(frame(spark, list(d.items()), "id int, t string"), "id", "t")
    terms = bm25.query_terms(frame(spark, [(1, "alpha beta"), (2, "gamma nowhere")], "q int, t string"), "q", "t")
    rows = lambda df: sorted(map(tuple, df.collect()))

    def same(now):
        assert rows(sparse_index.search(spark, path, terms)) == rows(bm25.search(tf(now), terms))
        assert rows(sparse_index.postings(spark, path)) == rows(tf(now).select("doc", "term", "tf", "doc_length"))

    with pytest.raises(FileNotFoundError):
        sparse_index.postings(spark, path)
    assert sparse_index.add(spark, path, tf(docs)) == 1
    same(docs)
    sparse_index.add(spark, path, tf({2: "beta", 5: "alpha gamma"}), frame(spark, [(3,), (99,), (None,)], "doc int"))
    now = {1: "alpha beta", 2: "beta", 5: "alpha gamma"}
    same(now)
    sparse_index.add(spark, path, None, frame(spark, [(1,)], "doc int"))
    sparse_index.add(spark, path, tf({1: "gamma", 3: "delta"}))
    now |= {1: "gamma", 3: "delta"}
    same(now)
    # an unfinished segment does not count
    tf({7: "alpha"}).write.parquet(f"{path}/postings/v5")
    same(now)
    sparse_index.compact(spark, path)
    assert len(sparse_index.segments(spark, path)) == 1 == len(list((tmp_path / "index" / "postings").glob("v*")))
    same(now)
    # a search names its folders to the scan
    plan = sparse_index.postings(spark, path, terms)._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") and sparse_index.postings(spark, path, terms).count() < sparse_index.postings(spark, path).count()
    sparse_index.add(spark, path, None, frame(spark, [(i,) for i in range(9)], "doc int"))
    assert sparse_index.search(spark, path, terms).count() == 0


def test_large_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sparse_index, "NAMED_TERMS", 1)
    path = str(tmp_path / "index")
    tf = bm25.term_frequencies(frame(spark, [(1, "alpha beta"), (2, "beta gamma")], "id int, t string"), "id", "t")
    terms = bm25.query_terms(frame(spark, [(1, "alpha gamma")], "q int, t string"), "q", "t")
    sparse_index.add(spark, path, tf)
    assert sorted(map(tuple, sparse_index.search(spark, path, terms).collect())) == sorted(map(tuple, bm25.search(tf, terms).collect()))


def test_candidates():
    calls = []

    def generate(prompt, seed):
        calls.append((prompt, seed))
        if len(calls) == 1:
            raise RuntimeError
        return "" if len(calls) in (3, 4) else "```sql\nSELECT 1;\n```"

    fields = {("t", c) for c in "abcdef"}
    got = agents.candidates(fields, lambda o: " ".join(c for _, c in o), generate, 3, 7)
    assert got == ["SELECT 1", "SELECT 1"] and [b - a for (_, a), (_, b) in ((calls[0], calls[1]), (calls[2], calls[3]))] == [1, 1]
    assert len({p for p, _ in calls}) == 3 and all(sorted(p.split()) == list("abcdef") for p, _ in calls)
    first = calls[:]
    calls.clear()
    assert agents.candidates(fields, lambda o: " ".join(c for _, c in o), generate, 3, 7) == got and calls == first


def test_ingestion(spark, tmp_path):
    from graniteloom.operators import ingestion
    from graniteloom.sources import stores

    root = str(tmp_path / "rag")
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| alpha{i} | beta |" for i in range(9))
    rows = [("in/one.pdf", 1, "text", "First words. More of them.\n\nSecond paragraph"), ("in/one.pdf", 1, "text", "First words. More of them.\n\nSecond paragraph"), ("in/one.pdf", 2, "table", table), ("in/two.pdf", 1, "text", "  "), ("in/two.pdf", 2, "text", None), ("in/three.docx", 5, "table", "no table"), (None, 1, "text", "lost"), ("in/one.pdf", None, "text", "lost")]
    e = frame(spark, rows, "source_file string, element_id int, type string, text string")
    got = {r["source_file"]: (r["parents"], r["children"], r["status"]) for r in ingestion.ingest(spark, e, root, "j1", HashedShingles(16)).collect()}
    assert got == {"in/one.pdf": (2, 3, "completed"), "in/two.pdf": (0, 0, "failed"), "in/three.docx": (1, 1, "completed")}
    kids = stores.read_store(spark, f"{root}/children")
    assert kids.count() == 4 and stores.read_store(spark, f"{root}/vectors").count() == 4 and {r["parent_id"] for r in stores.read_store(spark, f"{root}/parents").collect()} == {r["parent_id"] for r in kids.collect()} == {"one_elem_1_text", "one_elem_2_table", "three_elem_5_corrupted_part0"}
    terms = bm25.query_terms(frame(spark, [(1, "alpha paragraph")], "q int, t string"), "q", "t")
    find = lambda: {r["doc"] for r in sparse_index.search(spark, f"{root}/index", terms).collect()}
    assert "one_elem_1_text_child_0" in find()
    jobs = stores.latest_jobs(spark.read.parquet(f"{root}/jobs").where("source_file = 'in/two.pdf'")).first()
    assert jobs["status"] == "failed" and jobs["error_message"]
    # the file comes again with other words
    ingestion.ingest(spark, frame(spark, [("in/one.pdf", 1, "text", "changed")], e.schema), root, "j2", HashedShingles(16))
    assert "one_elem_1_text_child_0" not in find() and stores.read_store(spark, f"{root}/children").count() == 4
