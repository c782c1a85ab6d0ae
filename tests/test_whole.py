import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import text as T
from lodestone.operators import documents

# full-width, zero-width, decomposed, look-alike, other spaces, typed plainly
TEXTS = ["x＝１２cm", "a​b 3", "é = 2", "АВ ∥ СD", "〈x　− 1〉", "３．５kg 없다", "각 12°", "x = 12cm", "ⅹ²≥４", "", "①"]
CRITICAL = re.compile(r"\d+(?:\.\d+)?(?:cm|mm|km|kg|mL|m|g|L|°|%)?|[+\-×÷=≠<>≤≥∥⟂°]|[①②③④⑤]|없|아닌|않")


def norm(s):
    return re.sub(r"\s+", "", s.replace("〈", "").replace("〉", "").replace("−", "-"))


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def exact(p, g):
    p, g = norm(p), norm(g)
    return 1.0 if p == g else 0.0 if not g else max(0.0, 1 - edits(p, g) / len(g))


@pytest.fixture(scope="module")
def exams(spark, tmp_path_factory):
    """A folder with a table of every pair of texts; body is the answer between other text, or another text."""
    d = str(tmp_path_factory.mktemp("whole"))
    rows = [(100 * i + j, 1, j, "1", None, "multiple_choice", 3, f"문제 {a} 끝" if j % 2 else b, {"①": b, "②": a, "③": b + " "}, a) for i, a in enumerate(TEXTS) for j, b in enumerate(TEXTS)]
    schema = "expected_id bigint, exam_id bigint, number int, label string, parent_label string, type string, points int, body string, choices map<string,string>, answer string"
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/expected.parquet")
    return d, rows


def result(spark, exams, name):
    return sorted(tuple(r) for r in entry.queries()[name](spark, exams[0]).collect())


def test_norm_text_and_tokens(spark, exams):
    rows = exams[1]
    assert result(spark, exams, "f1_norm_text") == [(r[0], norm(r[9])) for r in rows]
    assert result(spark, exams, "f4_critical_tokens") == [(r[0], len(CRITICAL.findall(norm(r[7])))) for r in rows]


def test_char_exact(spark, exams):
    got, want = result(spark, exams, "f2_char_exact"), [(r[0], exact(r[8]["①"], r[9])) for r in exams[1]]
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want])


def test_token_overlap(spark, exams):
    want = []
    for r in exams[1]:
        p, g = (Counter(CRITICAL.findall(norm(x))) for x in (r[8]["①"], r[9]))
        m = (p & g).total()
        want.append((r[0], m, g.total(), p.total() - m))
    assert result(spark, exams, "u1_token_overlap") == want


def test_missing_in_render(spark, exams):
    assert [i for i, _ in result(spark, exams, "f18_missing_in_render")] == [r[0] for r in exams[1]]
    want = {r[0]: norm(r[9]) not in norm(r[7]) for r in exams[1] if r[9] in TEXTS[:3]}
    assert {i: bool(n) for i, n in result(spark, exams, "f18_missing_in_render") if i in want} == want


def test_equal_choices(spark, exams):
    got = set(result(spark, exams, "j16_equal_choices"))
    want = {(r[0], a, b) for r in exams[1] for a in r[8] for b in r[8] if a < b and norm(r[8][a]) == norm(r[8][b]) != ""}
    assert got >= want and {x for x in got if x[0] < 100} == {x for x in want if x[0] < 100}


def test_choices_proven_equal(spark):
    texts = {1: {"①": r"\frac{1}{2}", "②": r"\frac{2}{4}", "③": "0.5", "④": "2"}, 2: {"①": "x+1", "②": "1 + x", "③": "x²", "④": "x^2"}, 3: {"①": "가나 2", "②": "나가 2", "③": "ab", "④": None}}
    df = spark.createDataFrame([(k, m, x) for k, c in texts.items() for m, x in c.items()], "k int, mark string, body string")
    got = {tuple(r) for r in documents.proven_choices(df, "k").collect()}
    assert got == {(1, "①", "②"), (1, "①", "③"), (1, "②", "③"), (2, "①", "②")}


def test_signs_out_of_order(spark):
    cases = [("AD BC ∥", "AD∥BC", 0), ("AD BC", "AD∥BC", 1), ("AD∥BC", "AD∥BC", 0), ("∥", "∥∥", 1), ("3 - 4", "-34", 0), ("AC BD ∥", "AD∥BC", 1), ("∠ABC = 30 °", "∠ABC=30°", 0)]
    df = spark.createDataFrame(cases, "t string, x string, n int")
    assert [r.got for r in df.select(T.contains_all(F.col("t"), F.array("x"), T.REORDERED).alias("got")).collect()] == [n for *_, n in cases]


def test_answers_that_differ(spark, tmp_path):
    rows = [(1, "reference_a", '"①"'), (1, "solver", '"1"'), (1, "ocr", '"2"'), (2, "reference_a", "3"), (2, "solver", '"3cm"'), (3, "solver", '"4"'), (4, "reference_a", "null"), (4, "solver", '"5"')]
    schema = "candidate_id bigint, question_id bigint, field string, provider string, value_json string"
    spark.createDataFrame([(i, q, "answer", p, v) for i, (q, p, v) in enumerate(rows)], schema).write.parquet(f"{tmp_path}/candidates.parquet")
    got = {tuple(r) for r in entry.queries()["j17_answers_by_number"](spark, str(tmp_path)).collect()}
    assert got == {(1, "reference", "ocr", "①", "2", 3), (1, "ocr", "solver", "2", "1", 3)}
