"""Chunking, citations, safety and answers over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graniteloom.functions import text as T
from graniteloom.operators import answers, chunking
from graniteloom.plans.base import questions  # noqa: F401
from graniteloom.runtime import table

SIZES = chunking.TextSizes(100, 60, 10)


def _docs(spark, d):
    return table(spark, d, "documents")


def _parents_once(spark, d):
    return table(spark, d, "parents").dropDuplicates(["parent_id"])


def f16_paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.coalesce(F.size(T.paragraphs(F.col("text"))), F.lit(0)).alias("paragraphs"), F.md5(F.array_join(F.coalesce(T.paragraphs(F.col("text")), F.array().cast("array<string>")), "|")).alias("digest"))


def f19_text_parents(spark, d):
    """Parents of at most 100 words; oversized paragraphs by sentences."""
    p = chunking.text_parents(_docs(spark, d), "doc_id", "text", SIZES)
    return p.groupBy("source").agg(F.count("*").alias("parents"), F.max("token_count").alias("largest"), F.sum("token_count").alias("words"))


def f20_text_children(spark, d):
    c = chunking.text_children(_parents_once(spark, d).select("parent_id", F.col("parent_text").alias("text")))
    return c.select("parent_id", "chunk_index", "token_count", F.md5("text").alias("digest"))


def broken_tables(spark, d):
    t = _parents_once(spark, d)
    return t.select("parent_id", F.coalesce(chunking.broken_table(F.col("parent_text")), F.lit(False)).alias("broken"))


def f25_broken_parts(spark, d):
    """Every parent taken for a broken table, in slices."""
    _, c = chunking.broken_parts(_parents_once(spark, d), "parent_id", "parent_text", chunking.TableSizes(broken_parent=180, broken_child=35))
    return c.groupBy("parent_id").agg(F.count("*").alias("children"), F.sum("token_count").alias("words"), F.max("token_count").alias("largest"))


def f22_table_parents(spark, d):
    t = _parents_once(spark, d).where("parent_type = 'table'")
    p = chunking.table_parents(t, "parent_id", "parent_text", chunking.TableSizes(parent=120, child=60))
    return p.groupBy("source").agg(F.count("*").alias("parents"), F.sum(F.col("end_row") - F.col("start_row")).alias("rows"))


def f23_table_children(spark, d):
    """Row groups of tables, with the numbers of their rows."""
    t = _parents_once(spark, d).where("parent_type = 'table'")
    c = chunking.table_children(t, "parent_id", "parent_text", chunking.TableSizes(parent=120, child=60))
    return c.select("parent_id", "child_id", "chunk_index", F.array_join(F.col("row_indices").cast("array<string>"), ",").alias("row_numbers"), "token_count", F.md5("text").alias("digest"))


def f8_cosine(spark, d):
    """Each usable vector against its own reverse."""
    v = table(spark, d, "embedding_results").where((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    return v.select("vec_id", T.cosine(F.col("embedding"), F.reverse("embedding")).alias("cosine"))


def x7_variants(spark, d):
    """Every document taken for a rewritten query: its first line without label and quotes."""
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(T.first_line_variant(F.col("text"))).alias("digest"))


def f26_token_counts(spark, d):
    """Stored against counted sizes of parents."""
    return _parents_once(spark, d).select("parent_id", T.word_count(F.col("parent_text")).alias("words"))


def s17_full_text(spark, d):
    """The documents' paragraphs put together again by source file."""
    p = _parents_once(spark, d).where("trim(parent_text) <> ''")
    j = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element_id", "parent_id", "parent_text"))), lambda x: x["parent_text"]), "\n\n")
    return p.groupBy("source_file").agg(F.md5(j).alias("digest"))


def _sources(spark, d):
    """The children of each source file as the sources of one answer, in order."""
    c = table(spark, d, "children").dropDuplicates(["child_id"]).join(_parents_once(spark, d).select("parent_id", "source_file", "page_number", "parent_type"), "parent_id")
    return c.select(F.col("source_file").alias("query"), F.concat_ws("#", "parent_id", F.lpad(F.col("chunk_index").cast("string"), 4, "0"), "child_id").alias("seq"), F.col("parent_id").alias("child_id"), "parent_id", "source_file", "page_number", "parent_type")


def w2_citation_numbers(spark, d):
    return answers.citation_numbers(_sources(spark, d)).select("query", "seq", "number")


def f32_citation_lists(spark, d):
    return answers.citation_list(answers.citation_numbers(_sources(spark, d)), "ko").select("query", F.md5("citations").alias("digest"))


def f33_cited(spark, d):
    """Bracketed numbers of one to three digits in documents, as an answer's citations."""
    a = _docs(spark, d).withColumn("t", F.regexp_replace("text", r"(\d{2})(\d{2})", "[$1] [$2] "))
    return a.select("doc_id", F.array_join(answers.cited(F.col("t")), ",").alias("cited"))


def f34_safety(spark, d):
    """Documents taken for answers: every third has its citations given, scores follow the length."""
    n = F.coalesce(F.length("text"), F.lit(0))
    a = _docs(spark, d).select(F.col("doc_id").alias("query"), F.col("text").alias("answer"), (F.col("doc_id") % 3 == 0).alias("has_citations"), F.when(F.col("doc_id") % 2 == 0, F.array((n % 100) / 100.0, F.lit(0.5))).alias("nli"))
    s = answers.safety(a)
    return s.select("query", "passed", "confidence", F.array_join("issues", ",").alias("issues"))


def f35_contexts(spark, d):
    c = table(spark, d, "children").dropDuplicates(["child_id"])
    c = c.select(F.col("parent_id").alias("query"), F.struct("chunk_index", "child_id").alias("seq"), F.lit(None).cast("string").alias("parent_text"), "child_text")
    return answers.combined_context(c, 300).select("query", F.length("context").alias("n"), F.md5("context").alias("digest"))


def f36_evidence(spark, d):
    return _docs(spark, d).select("doc_id", answers.evidence_ok(F.col("text"), F.col("doc_id") % 5 != 0).alias("ok"))


def f45_softmax(spark, d):
    """Over the first three numbers of each usable embedding."""
    v = table(spark, d, "embedding_results").where((F.size("embedding") >= 3) & ~F.exists(F.slice("embedding", 1, 3), lambda x: F.isnan(x)))
    v = v.select("vec_id", T.softmax(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))).alias("p"))
    return v.select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i + 1}") for i in range(3)])


def x22_answers(spark, d):
    """The pieces of each parent as the events of a stream, put together."""
    c = table(spark, d, "children").dropDuplicates(["child_id"]).select(F.col("parent_id").alias("query"), F.struct("chunk_index", "child_id").alias("seq"), F.lit("chunk").alias("event"), F.col("child_text").alias("content"))
    return answers.answer_events(c).select("query", F.md5("answer").alias("digest"))


def f13_masked(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.mask_values(F.col("text"))).alias("digest"))


def f14_longest_line(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(T.longest_line(F.col("text"))).alias("digest"))


_PAR = "list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"
_WORDS = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
_W = "\\pL\\pM\\p{Nd}\\p{Pc}"
_NUM = f"(^|[^{_W}])\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?([^{_W}]|$)"


def masked_sql(c: str) -> str:
    """The masked form of a text column. A number's neighbours are consumed here: separators get a mark beside them to be consumed, numbers one full stop apart need a second pass."""
    mark = "\ue000"
    for p, r in ((f"([^{_W}.])", "\\1" + mark), (_NUM, "\\1[VALUE]\\2"), (_NUM, "\\1[VALUE]\\2"), (mark, ""), ("''[^'']*''", "[VALUE]"), ('"[^"]*"', "[VALUE]")):
        c = f"regexp_replace({c}, '{p}', '{r}', 'g')"
    return c


_SENT = "list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\\s+([A-Z가-힣])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
_UNIT = "{'para': i, 'big': %s, 'used': len(" + "list_filter(regexp_split_to_array(%s, '\\s+'), lambda w: w <> '')" + "), 'parts': 1, 'most': len(" + "list_filter(regexp_split_to_array(%s, '\\s+'), lambda w: w <> '')" + ")}"
# Greedy packing of markdown tables, row by row: parents of at most 120 words, children of 60 with three to seven rows.
_TABLES = f"""RECURSIVE l AS (SELECT parent_id AS source, list_filter(list_transform(string_split(parent_text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l,
               len(list_filter(regexp_split_to_array(parent_text, '\\s+'), lambda w: w <> '')) AS words FROM (SELECT DISTINCT ON (parent_id) * FROM parents) JOIN broken USING (parent_id) WHERE parent_type = 'table' AND NOT broken),
        h AS (SELECT source, words > 120 AS split, l[1] AS header, regexp_full_match(l[2], '[-|: ]+') AS has, l FROM l WHERE len(l) >= 2),
        p AS (SELECT source, split, header, CASE WHEN has THEN l[2] ELSE '|' || repeat('---|', greatest(1, len(header) - len(replace(header, '|', '')) - 1)) END AS sep, CASE WHEN has THEN l[3:] ELSE l[2:] END AS body FROM h),
        q AS (SELECT *, len(regexp_extract_all(header, '\\S+')) + len(regexp_extract_all(sep, '\\S+')) AS lead FROM p),
        r AS (SELECT source, split, header, sep, lead, unnest(body) AS line, generate_subscripts(body, 1) - 1 AS i FROM q),
        n AS (SELECT *, len(regexp_extract_all(line, '\\S+')) AS n FROM r),
        g AS (SELECT source, i, 1 AS part, lead + n AS pu, 0 AS child, lead + n AS cu, 1 AS k FROM n WHERE i = 0
              UNION ALL SELECT source, n.i, CASE WHEN np THEN part + 1 ELSE part END, CASE WHEN np THEN lead + n ELSE pu + n END, CASE WHEN np THEN 0 WHEN nc THEN child + 1 ELSE child END, CASE WHEN np OR nc THEN lead + n ELSE cu + n END, CASE WHEN np OR nc THEN 1 ELSE k + 1 END
              FROM (SELECT g.source, n.i, part, pu, child, cu, k, lead, n, split AND pu + n > 120 AS np, cu > 3500 OR k >= 7 OR (cu + n > 60 AND k >= 3) AS nc FROM g JOIN n ON n.source = g.source AND n.i = g.i + 1) AS n)"""
_PONCE = "(SELECT DISTINCT ON (parent_id) * FROM parents)"
_CONCE = "(SELECT DISTINCT ON (child_id) * FROM children)"
_SRC = f"""src AS (SELECT source_file AS query, concat_ws('#', c.parent_id, lpad(CAST(chunk_index AS VARCHAR), 4, '0'), child_id) AS seq, c.parent_id AS sid, source_file, page_number FROM {_CONCE} c JOIN {_PONCE} p ON c.parent_id = p.parent_id),
        fst AS (SELECT *, min(seq) OVER (PARTITION BY query, sid) AS f FROM src),
        num AS (SELECT *, dense_rank() OVER (PARTITION BY query ORDER BY f) AS number FROM fst)"""

ORACLES = {
    "f16_paragraphs": f"SELECT doc_id, CAST(coalesce(len({_PAR}), 0) AS INT) AS paragraphs, md5(coalesce(array_to_string({_PAR}, '|'), '')) AS digest FROM documents",
    "f13_masked": f"SELECT doc_id, md5({masked_sql('text')}) AS digest FROM documents",
    "f14_longest_line": """
        WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(trim(replace(regexp_replace(text, '(?i)^(Masked Question:|Answer:|Output:)[ \\t\\n\\x0b\\f\\r]*', ''), '```', ''), ' '), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, md5(coalesce(list_filter(l, lambda x: length(x) = list_max(list_transform(l, lambda y: length(y))))[1], '')) AS digest FROM c""",
    "f8_cosine": """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS cosine FROM embedding_results
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "x7_variants": """
        WITH c AS (SELECT doc_id, string_split(trim(regexp_replace(trim(text, ' '), '(?i)^\\s*(?:\\d+[.)]\\s*|[-*•]\\s*|(?:query|variant|question|질문)\\s*\\d*\\s*[:：]\\s*)', ''), ' '), chr(10))[1] AS l FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, md5(trim(regexp_replace(trim(l, ' '), '^["''“”]+|["''“”]+$', '', 'g'), ' ')) AS digest FROM c""",
    "f19_text_parents": f"""
        WITH p AS (SELECT doc_id, {_PAR} AS ps FROM documents),
        u AS (SELECT doc_id, flatten(list_transform(ps, lambda p, i: CASE WHEN len({_WORDS("p")}) > 100 THEN list_transform({_SENT}, lambda s: {_UNIT % ("true", "s", "s")}) ELSE [{_UNIT % ("false", "p", "p")}] END)) AS u FROM p),
        g AS (SELECT doc_id, u, list_reduce(u, lambda a, x: CASE WHEN (a.big AND x.big AND a.para = x.para AND a.used + x.used <= 100) OR (NOT a.big AND NOT x.big AND a.used + x.used <= 100)
                 THEN {{'para': x.para, 'big': x.big, 'used': a.used + x.used, 'parts': a.parts, 'most': greatest(a.most, a.used + x.used)}} ELSE {{'para': x.para, 'big': x.big, 'used': x.used, 'parts': a.parts + 1, 'most': greatest(a.most, x.used)}} END) AS g FROM u WHERE len(u) > 0)
        SELECT CAST(doc_id AS VARCHAR) AS source, CAST(g.parts AS BIGINT) AS parents, CAST(g.most AS INT) AS largest, CAST(list_sum(list_transform(u, lambda x: x.used)) AS BIGINT) AS words FROM g""",
    "f22_table_parents": f"WITH {_TABLES}, e AS (SELECT source FROM q WHERE NOT split AND len(body) = 0) SELECT source, CAST(max(part) AS BIGINT) AS parents, count(*) AS rows FROM g GROUP BY source UNION ALL SELECT source, 1, 0 FROM e",
    "f23_table_children": f"""WITH {_TABLES}, c AS (SELECT source, part, child, any_value(split) AS split, string_agg(i, ',' ORDER BY i) AS row_numbers, any_value(header) || chr(10) || any_value(sep) || chr(10) || string_agg(line, chr(10) ORDER BY i) AS t FROM g JOIN n USING (source, i) GROUP BY ALL),
        d AS (SELECT *, source || '_table' || CASE WHEN split THEN '_part' || part ELSE '' END AS parent_id FROM c)
        SELECT parent_id, parent_id || '_child_' || child AS child_id, CAST(child AS INT) AS chunk_index, row_numbers, CAST(len(regexp_extract_all(t, '\\S+')) AS INT) AS token_count, md5(t) AS digest FROM d""",
    "f20_text_children": f"""
        WITH w AS (SELECT parent_id, {_WORDS("parent_text")} AS w FROM {_PONCE}),
        k AS (SELECT parent_id, w, unnest(range(CAST(CASE WHEN len(w) <= 400 THEN 1 ELSE ceil((len(w) - 400) / 350) + 1 END AS BIGINT))) AS i FROM w WHERE len(w) > 0)
        SELECT parent_id, CAST(i AS INT) AS chunk_index, CAST(len(w[i * 350 + 1:i * 350 + 400]) AS INT) AS token_count, md5(array_to_string(w[i * 350 + 1:i * 350 + 400], ' ')) AS digest FROM k""",
    "broken_tables": f"""
        WITH l AS (SELECT parent_id, string_split(parent_text, chr(10)) AS l FROM {_PONCE}),
        n AS (SELECT parent_id, len(l) AS k, len({_WORDS("l[1]")}) AS n, trim(translate(trim(l[2]), '|-', '')) AS second FROM l)
        SELECT parent_id, coalesce(k >= 2 AND (n > 1500 OR (n > 500 AND second <> '')), false) AS broken FROM n""",
    "f25_broken_parts": f"""
        WITH w AS (SELECT parent_id, len({_WORDS("parent_text")}) AS n FROM {_PONCE}),
        p AS (SELECT parent_id, i, least(180, n - 180 * i) AS m FROM (SELECT parent_id, n, unnest(range(CAST(ceil(n / 180) AS BIGINT))) AS i FROM w WHERE n > 0)),
        c AS (SELECT parent_id || '_corrupted_part' || i AS parent_id, least(35, m - 35 * j) AS k FROM (SELECT parent_id, i, m, unnest(range(CAST(ceil(m / 35) AS BIGINT))) AS j FROM p))
        SELECT parent_id, count(*) AS children, CAST(sum(k) AS BIGINT) AS words, CAST(max(k) AS INT) AS largest FROM c GROUP BY parent_id""",
    "f26_token_counts": f"SELECT parent_id, CAST(coalesce(len({_WORDS('parent_text')}), 0) AS INT) AS words FROM {_PONCE}",
    "s17_full_text": f"SELECT source_file, md5(string_agg(parent_text, chr(10) || chr(10) ORDER BY element_id, parent_id)) AS digest FROM {_PONCE} WHERE trim(parent_text) <> '' GROUP BY source_file",
    "w2_citation_numbers": f"WITH {_SRC} SELECT query, seq, CAST(number AS INT) AS number FROM num",
    "f32_citation_lists": f"""
        WITH {_SRC}, one AS (SELECT query, number, arg_min(page_number, seq) FILTER (page_number IS NOT NULL) AS pg, arg_min(struct_pack(p := page_number), seq) AS st FROM num GROUP BY ALL)
        SELECT query, md5(chr(10) || chr(10) || '참고 문서:' || chr(10) || string_agg('[' || number || '] ' || string_split(query, '/')[-1] || coalesce(', ' || st.p || '페이지', ''), chr(10) ORDER BY number)) AS digest FROM one GROUP BY query""",
    "f33_cited": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '(\d{2})(\d{2})', '[\1] [\2] ', 'g'), '\[(\d+)\]', 1) AS c FROM documents)
        SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(c, lambda x: CAST(x AS INT)))), ',') AS cited FROM t""",
    "f34_safety": r"""
        WITH a AS (SELECT doc_id AS query, coalesce(text, '') AS t, doc_id % 3 = 0 AS has, CASE WHEN doc_id % 2 = 0 THEN ((coalesce(length(text), 0) % 100) / 100.0 + 0.5) / 2 END AS m FROM documents),
        b AS (SELECT query, length(trim(t, ' ')) < 10 AS s, NOT (regexp_matches(t, '\[\d+\]') OR has) AS c,
                     regexp_matches(lower(t), 'i don''t know|i do not know|i''m not sure|i am not sure|cannot answer|can''t answer|no information|모르겠습니다|알 수 없습니다|정보가 없습니다') AS r, m FROM a),
        e AS (SELECT *, CASE WHEN NOT (s OR c OR r) THEN m END AS mean FROM b),
        i AS (SELECT *, coalesce(mean < 0.5, false) AS low, CAST(s AS INT) + CAST(c AS INT) + CAST(r AS INT) + CAST(coalesce(mean < 0.5, false) AS INT) AS n FROM e)
        SELECT query, n = 0 AS passed, round(CASE WHEN mean IS NOT NULL THEN (greatest(0, 1 - 0.3 * n) + mean) / 2 ELSE greatest(0, 1 - 0.3 * n) END, 6) AS confidence,
               concat_ws(',', CASE WHEN s THEN 'too short' END, CASE WHEN c THEN 'no citations' END, CASE WHEN r THEN 'refusal' END, CASE WHEN low THEN 'low entailment' END) AS issues FROM i""",
    "f35_contexts": f"""
        WITH g AS (SELECT parent_id AS query, string_agg(child_text, chr(10) || chr(10) ORDER BY chunk_index, child_id) AS t FROM {_CONCE} WHERE child_text <> '' GROUP BY parent_id),
        c AS (SELECT query, CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '...' ELSE t END AS context FROM g)
        SELECT query, CAST(length(context) AS INT) AS n, md5(context) AS digest FROM c""",
    "f36_evidence": "SELECT doc_id, doc_id % 5 <> 0 AND length(coalesce(text, '')) >= 20 AND NOT regexp_matches(lower(coalesce(text, '')), '모르겠습니다|알 수 없습니다|정보가 없습니다|cannot|don''t know|no information') AS ok FROM documents",
    "f45_softmax": """
        WITH v AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE)) AS e FROM embedding_results WHERE len(embedding) >= 3 AND len(list_filter(embedding[1:3], lambda x: isnan(x))) = 0),
        x AS (SELECT vec_id, list_transform(e, lambda y: exp(y - list_max(e))) AS e FROM v)
        SELECT vec_id, round(e[1] / list_sum(e), 6) AS p1, round(e[2] / list_sum(e), 6) AS p2, round(e[3] / list_sum(e), 6) AS p3 FROM x""",
    "x22_answers": f"SELECT parent_id AS query, md5(string_agg(coalesce(child_text, ''), '' ORDER BY chunk_index, child_id)) AS digest FROM {_CONCE} GROUP BY parent_id",
}

for _q in ("f22_table_parents", "f23_table_children"):
    ORACLES[_q] = ORACLES[_q].replace("RECURSIVE l AS", f"RECURSIVE broken AS ({ORACLES['broken_tables']}), l AS", 1)

QUERIES = {
    f.__name__: f
    for f in (f8_cosine, x7_variants, f16_paragraphs, f19_text_parents, f20_text_children, broken_tables, f25_broken_parts, f22_table_parents, f23_table_children, f26_token_counts, s17_full_text, w2_citation_numbers, f32_citation_lists, f33_cited, f34_safety, f35_contexts, f36_evidence, f45_softmax, x22_answers, f13_masked, f14_longest_line)
}
