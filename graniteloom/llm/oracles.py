"""DuckDB SQL for the queries that SQL can express on whole tables."""

# Windows of 300 characters by record and place, and those that stand in two records or more.
_WINDOWS = """d AS (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 300),
        w AS (SELECT doc_id, i, md5_number(substr(text, i, 300)) AS h FROM d),
        m AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
        s AS (SELECT doc_id AS doc, i - 1 AS pos FROM w SEMI JOIN m USING (h))"""

ORACLES = {
    "p1_found": r"""
        WITH p AS (SELECT DISTINCT parent_id, parent_text, file_name FROM parents
                   WHERE parent_type = 'text' AND parent_id IS NOT NULL AND parent_text IS NOT NULL AND file_name IS NOT NULL),
        l AS (SELECT parent_id, file_name, unnest(string_split(parent_text, chr(10))) AS line,
                     generate_subscripts(string_split(parent_text, chr(10)), 1) AS line_no FROM p),
        k AS (SELECT parent_id, file_name, line_no, lower(regexp_replace(line, '[^\pL]+', '', 'g')) AS key FROM l),
        s AS (SELECT file_name, key FROM k WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT parent_id) >= 8)
        SELECT parent_id, CAST(line_no AS BIGINT) AS line_no FROM k JOIN s USING (file_name, key)""",
    "p1_stripped": r"""
        WITH p AS (SELECT parent_id, arg_max(struct_pack(t := parent_text, f := file_name), updated_at) AS r FROM parents WHERE parent_type = 'text' AND parent_id IS NOT NULL GROUP BY parent_id),
        l AS (SELECT parent_id, r.f AS f, unnest(string_split(r.t, chr(10))) AS line, generate_subscripts(string_split(r.t, chr(10)), 1) AS i FROM p),
        k AS (SELECT *, lower(regexp_replace(line, '[^\pL]+', '', 'g')) AS key FROM l),
        s AS (SELECT f, key FROM k WHERE key <> '' AND f IS NOT NULL GROUP BY ALL HAVING count(DISTINCT parent_id) >= 8),
        g AS (SELECT parent_id, string_agg(line, chr(10) ORDER BY i) FILTER (s.key IS NULL) AS t, count(s.key) AS n FROM k LEFT JOIN s ON k.f = s.f AND k.key = s.key GROUP BY parent_id)
        SELECT parent_id, CASE WHEN g.parent_id IS NULL THEN r.t WHEN n = 0 THEN r.t ELSE coalesce(g.t, '') END AS parent_text, r.f AS file_name, CAST(coalesce(n, 0) AS INT) AS removed_lines FROM p LEFT JOIN g USING (parent_id)""",
    "p3_groups": r"""
        WITH RECURSIVE c AS (SELECT DISTINCT child_id AS id, child_text AS t FROM children WHERE child_id IS NOT NULL AND child_text IS NOT NULL),
        w AS (SELECT id, list_transform(regexp_extract_all(t, '[\pL\p{Nd}]+'), lambda x: lower(x)) AS w FROM c),
        s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w WHERE len(w) >= 30),
        k AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id, s FROM s),
        u AS (SELECT id, len(s) AS n, unnest(s) AS g FROM k WHERE id = class_id),
        p AS (SELECT a.id AS a, b.id AS b, count(*) AS i, any_value(a.n) + any_value(b.n) AS n FROM u a JOIN u b USING (g) WHERE a.id <> b.id GROUP BY ALL),
        e AS (SELECT a, b FROM p WHERE i >= 0.6 * (n - i) - 1e-9),
        r AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
        g AS (SELECT x, min(y) AS group_id FROM r GROUP BY x), l AS (SELECT a AS x, count(*) AS links FROM e GROUP BY a)
        SELECT id, class_id, coalesce(group_id, class_id) AS group_id, coalesce(links, 0) AS links FROM k LEFT JOIN g ON class_id = g.x LEFT JOIN l ON class_id = l.x""",
    "p3_found": r"""
        WITH c AS (SELECT child_id, any_value(child_text) AS t, any_value(parent_id) AS parent_id FROM children WHERE child_id IS NOT NULL AND child_text IS NOT NULL GROUP BY child_id),
        w AS (SELECT child_id, source_file, list_transform(regexp_extract_all(t, '[\pL\p{Nd}]+'), lambda x: lower(x)) AS w FROM c JOIN (SELECT DISTINCT parent_id, source_file FROM parents) USING (parent_id)),
        s AS (SELECT child_id, source_file, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 30),
        u AS (SELECT child_id, source_file, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.child_id AS child_a, b.child_id AS child_b, count(*) AS i, any_value(a.n) + any_value(b.n) AS n FROM u a JOIN u b USING (g) WHERE a.child_id < b.child_id AND a.source_file <> b.source_file GROUP BY ALL)
        SELECT child_a, child_b FROM p WHERE i >= 0.6 * (n - i) - 1e-9""",
    "p5_found": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embedding_results
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) AS r FROM v a, v b WHERE a.vec_id <> b.vec_id)
        SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM s WHERE r <= 5""",
    "p5_neighbours": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embedding_results
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a, v b WHERE a.vec_id <> b.vec_id)
        SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS INT) AS rank FROM s QUALIFY rank <= 5""",
    "p6_found": r"""
        WITH t AS (SELECT DISTINCT parent_id, parent_text AS t, parent_type = 'table' AS tab FROM parents WHERE parent_id IS NOT NULL AND parent_text IS NOT NULL),
        o AS (SELECT * FROM t WHERE len(regexp_extract_all(t, '\S+')) > 400),
        l AS (SELECT parent_id, tab, generate_subscripts(string_split(t, chr(10)), 1) AS i, unnest(string_split(t, chr(10))) AS line FROM o),
        n AS (SELECT *, len(regexp_extract_all(line, '\S+')) AS n, count(*) FILTER (trim(line, ' ' || chr(9) || chr(13)) = '') OVER (PARTITION BY parent_id ORDER BY i) AS para FROM l),
        q AS (SELECT parent_id, tab, para, sum(n) AS words, max(n) AS line_words, string_agg(line, chr(10) ORDER BY i) AS body FROM n GROUP BY ALL),
        s AS (SELECT *, list_max(list_transform(string_split(regexp_replace(body, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: len(regexp_extract_all(x, '\S+')))) AS sentence FROM q)
        SELECT parent_id, CASE WHEN any_value(tab) THEN CASE WHEN max(line_words) <= 400 THEN 'row' ELSE 'word' END WHEN max(words) <= 400 THEN 'paragraph' WHEN max(sentence) <= 400 THEN 'sentence' ELSE 'word' END AS boundary FROM s GROUP BY parent_id""",
    "p10_found": """
        WITH d AS (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 300),
        w AS (SELECT DISTINCT doc_id, md5_number(substr(text, i, 300)) AS h FROM d),
        m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
        SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b USING (h) WHERE a.doc_id < b.doc_id AND h IN (SELECT h FROM m)""",
    "p10_spans": f"""
        WITH {_WINDOWS}, r AS (SELECT *, sum(CASE WHEN pos - prev > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS run FROM (SELECT *, lag(pos) OVER (PARTITION BY doc ORDER BY pos) AS prev FROM s))
        SELECT doc, min(pos) AS start, max(pos) + 300 AS stop FROM r GROUP BY doc, run""",
    "p10_shares": f"""
        WITH {_WINDOWS}, c AS (SELECT doc, CAST(sum(least(300, coalesce(nxt - pos, 300))) AS BIGINT) AS n FROM (SELECT *, lead(pos) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM s) GROUP BY doc),
        t AS (SELECT doc_id AS doc, CAST(coalesce(length(text), 0) AS INT) AS chars FROM documents WHERE doc_id IS NOT NULL)
        SELECT doc, chars, coalesce(n, 0) AS shared_chars, CASE WHEN chars > 0 THEN round(coalesce(n, 0) / chars, 6) ELSE 0.0 END AS share FROM t LEFT JOIN c USING (doc)""",
    "p10_sharers": f"""
        WITH {_WINDOWS}, g AS (SELECT h, list_sort(list(DISTINCT doc_id)) AS ds FROM w SEMI JOIN m USING (h) GROUP BY h), x AS (SELECT DISTINCT ds FROM g)
        SELECT CAST(len(ds) AS BIGINT) AS records, ds[1] AS first_doc, ds[-1] AS last_doc, CAST(list_sum(ds) AS BIGINT) AS sum_doc FROM x""",
    "p9_bounds": "SELECT source, true AS at_target, true AS within_repeats FROM source_weights",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
