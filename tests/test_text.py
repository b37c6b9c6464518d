"""Text functions with the literal expectations of the fixtures."""

import pytest
from pyspark.sql import functions as F

from graniteloom.functions import sqltools as S
from graniteloom.functions import text as T


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "how", "want"),
    [
        ("Hello is a test", {}, ["hello", "test"]),
        ("한국어 텍스트입니다", {}, ["한국어", "텍스트입니다"]),
        ("Vendor API는 excellent합니다", {}, ["vendor", "api", "excellent", "합니다"]),
        ("short verylongword", {"longest": 5}, ["short"]),
        ("The QUICK Brown FOX", {"lowercase": False}, ["QUICK", "Brown", "FOX"]),
        ("이것은 테스트입니다", {}, ["이것은", "테스트입니다"]),
        ("", {}, []),
        (None, {}, []),
    ],
)
def test_tokens(spark, text, how, want):
    assert one(spark, text, lambda c: T.tokens(c, **how)) == want


PAIRS = [("Goood", "Good", 0.6667), ("Gud", "Good", 0.0), ("Goo", "Good", 0.5), ("Francisco", "San Francisco", 0.6364), ("San Fran", "San Francisco", 0.5455), ("Los", "Los Angeles", 0.1111), ("Supermen", "Superman", 0.5), ("Batmann", "Batman", 0.8), ("Wondor Woman", "Wonder Woman", 0.5385), ("District Five", "District 5", 0.5833), ("District5", "District 5", 0.6667), ("County Office", "County Office of Education", 0.4783), ("Fresno", "Fresno County", 0.3636), ("GOOD", "Good", 1.0), ("good!!!", "Good", 1.0), ("San-Francisco", "San Francisco", 1.0), ("Gren", "Green", 0.25), ("Bleu", "Blue", 0.0)]


def test_jaccard(spark):
    df = spark.createDataFrame([p[:2] for p in PAIRS], "a string, b string")
    sh = lambda c: T.shingles(T.normalize(F.col(c)))
    got = [r["j"] for r in df.select(F.round(T.jaccard(sh("a"), sh("b")), 4).alias("j")).collect()]
    assert got == [p[2] for p in PAIRS]


def test_normal(spark):
    assert one(spark, "L.A.", T.normalize) == "l a"
    assert one(spark, "user_id-Größe", T.normalize) == "user id größe"


def test_sentences(spark):
    assert len(one(spark, "First sentence. Second sentence! Third sentence? Fourth sentence.", T.sentences)) == 4
    assert one(spark, "Dr. Kim wrote it. Nobody knows why! ok.", T.claim_sentences) == ["Dr. Kim wrote it", "Nobody knows why! ok"]


def test_masks(spark):
    assert one(spark, "On 2020-01-01 we sold 3.5 of 'a b' in 3호", T.mask_values) == "On [VALUE]-[VALUE]-[VALUE] we sold [VALUE] of [VALUE] in 3호"
    assert one(spark, "Answer: x\n```\nthe longer line\n```", T.longest_line) == "the longer line"
    assert one(spark, "1. \"new query\"\nnoise", T.first_line_variant) == "new query"


def test_identifiers_and_literals():
    assert [S.identifier(*a) for a in (("age",), ("users.age",), ("my`table",), ('my"col', "postgres"))] == ["`age`", "`users`.`age`", "`my``table`", '"my""col"']
    assert [S.literal(*a) for a in (("25", True), ("O'Brien", False), ("N/A", True), ("123.45", True))] == ["25", "'O''Brien'", "'N/A'", "123.45"]
    assert S.where_clause("users", "age", "25", True) == "`users`.`age` = 25"


def test_question_literals():
    got = S.question_literals("Show schools in 'Fresno County' since 2020-01-01 with more than 500 students in San Francisco")
    assert got == [("Fresno County", "quoted"), ("500", "number"), ("2020-01-01", "date"), ("San Francisco", "capitalized")]


def test_extraction():
    assert S.extract_sql("Here:\n```sql\nSELECT ';' FROM t;\n``` done") == "SELECT ';' FROM t;"
    assert S.extract_sql("SQL: with x AS (SELECT 1) SELECT * FROM x; more") == "with x AS (SELECT 1) SELECT * FROM x;"
    assert S.clean_sql("```sql\nSELECT 1;\n```") == "SELECT 1"
    assert S.json_object('x {"a": "}"} y') == '{"a": "}"}' and S.json_object("none") is None
    assert S.format_results([(1,), (2,), (3,), (4,)]) == "Found 4 results:\n1. (1,)\n2. (2,)\n3. (3,)\n... and 1 more rows"
    assert S.format_results([]) == "No results found." and S.format_results([(7,)]) == S.format_results([{"n": 7}]) == "Result: 7"
    assert S.format_results([{"n": 7}, {"n": 8}]) == "Found 2 results:\n1. {'n': 7}\n2. {'n': 8}\n"


def test_lineage(spark):
    cols = {"CIM_EQP_MST": {"SITE", "EQP_ID", "CIM_EQP_DESC"}, "EQP_MODE_GEN_HIST": {"EQP_ID", "STATUS"}, "WC@L": {"DEPT_CODE", "WORK_CENTER"}, "DEPT@L": {"DEPT_CODE", "DEPT_NAME"}}
    s = S.analyse(spark, "SELECT m.EQP_ID, m.EQP_DESC, g1.N FROM cim_eqp_mst m JOIN (SELECT h.EQP_ID, sum(CASE WHEN h.STATUS = 'RUN' THEN 1 ELSE 0 END) AS N FROM EQP_MODE_GEN_HIST h GROUP BY h.EQP_ID) g1 ON m.EQP_ID = g1.EQP_ID", cols)
    assert s.fields == {("CIM_EQP_MST", "EQP_ID"), ("EQP_MODE_GEN_HIST", "EQP_ID"), ("EQP_MODE_GEN_HIST", "STATUS")}
    s = S.analyse(spark, "WITH a AS (SELECT w.DEPT_CODE, count(*) AS RUN_COUNT FROM EQP_MODE_GEN_HIST h JOIN WC@L w ON h.EQP_ID = w.WORK_CENTER WHERE h.STATUS = 'RUN' GROUP BY w.DEPT_CODE) SELECT d.DEPT_NAME, a.RUN_COUNT FROM a JOIN DEPT@L d ON a.DEPT_CODE = d.DEPT_CODE", cols)
    assert s.tables == {"EQP_MODE_GEN_HIST", "WC@L", "DEPT@L"} and s.literals == {"RUN"}
    assert ("DEPT@L", "DEPT_NAME") in s.fields and ("WC@L", "DEPT_CODE") in s.fields and not any(c == "RUN_COUNT" for _, c in s.fields)
    s = S.analyse(spark, "SELECT name FROM superhero WHERE height > 180 AND id IN (SELECT hero_id FROM p WHERE p.publisher = 'Marvel Comics')")
    assert s.literals == {"180", "Marvel Comics"} and s.tables == {"SUPERHERO", "P"}
    assert not S.analyse(spark, "SELECT FROM WHERE").valid


def test_lint(spark):
    assert not S.lint(spark, "SELECT a FROM t ORDER BY b LIMIT 1").valid
    assert S.lint(spark, "SELECT a FROM t WHERE b IS NOT NULL ORDER BY b LIMIT 1").valid
    assert S.lint(spark, "SELECT a FROM t ORDER BY b DESC LIMIT 1").valid
    assert not S.lint(spark, "SELECT a || b FROM t").valid
    assert not S.lint(spark, "SELECT a, FROM t").valid
