import json

from pyspark.sql import functions as F

from lodestone.operators import documents as D
from lodestone.operators import nested
from lodestone.plans import document_queries
from lodestone.plans.stages import Pipeline, Stage


def test_decompose(spark, rows):
    items = [{"number": 3, "type": "x", "points": None, "body": [{"text": "a"}, "b"], "choices": ["p", {"label": "⑤", "body": "q"}, ""], "equations": ["e"], "figure": {"k": 1}}, {"body": "  ", "choices": {"①": "z", "②": None}}, []]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "id int, j string").select("id", nested.parse(F.col("j")).alias("item"))
    got = rows(D.decompose(df, ["id"], "item"), "id", "field", "value")
    assert got == sorted([(0, "number", "3"), (0, "type", "x"), (0, "body", "a b"), (0, "choice:①", "p"), (0, "choice:⑤", "q"), (0, "equation:0", "e"), (0, "figure", '{"k":1}'), (1, "choice:①", "z")], key=repr)
    assert D.decompose(df.limit(0), ["id"], "item").count() == 0


def test_stems_groups_and_names(spark, rows):
    q = spark.createDataFrame([("e", 1, "2", 1), ("e", 2, "논술형 2", 9), ("e", 3, "2-1", 2), ("e", 4, "7-1", 3), ("e", 5, None, 4), ("e", 6, "2", 5)], "x string, id int, label string, pos int")
    assert rows(D.shared_stems(q, ["x"])) == [("e", 3, 2)]
    linked = q.join(D.shared_stems(q, ["x"]), ["x", "id"], "left")
    assert ("e", 2, [2, 3]) in rows(D.context_groups(linked, ["x"]).where("group_id = 2"), "x", "group_id", "members") or ("e", 2, [3]) in rows(D.context_groups(linked, ["x"]), "x", "group_id", "members")
    asked = spark.createDataFrame([("e", "2"), ("e", "논술형 2"), ("e", "zz")], "x string, ask string")
    got = {r.ask: (r.id, r.matches) for r in D.resolve(q.withColumn("number", F.col("pos")), asked, ["x"]).collect()}
    assert got == {"2": (2, 1), "논술형 2": (2, 1), "zz": (None, 0)}


def test_labels_tables_axes(spark, rows):
    c = spark.createDataFrame([("a", 0, "1)"), ("a", 1, "2)"), ("b", 0, "②"), ("b", 1, "①"), ("c", 0, "①"), ("c", 1, "①"), ("d", 0, "①"), ("d", 1, "③")], "k string, pos int, label string")
    got = {(r.k, r.pos): (r.label, r.rule) for r in D.fixed_labels(c, "k").collect()}
    assert got[("a", 1)] == ("②", "choice_label_normalize") and got[("b", 0)] == ("①", "choice_order") and got[("c", 1)] == ("②", "choice_label_dedup") and got[("d", 1)] == ("③", None)
    t = spark.createDataFrame([(1, ["a"], [["x"], ["y", "z"]]), (2, [], [[]]), (3, ["a"], [])], "id int, h array<string>, c array<array<string>>")
    assert rows(D.table_errors(t, "id", "h", "c")) == [(1, "ragged_row"), (2, "no_header")]
    a = spark.createDataFrame([(1, [1.0, 1.0], 0.0, 1.0), (2, [1.0, 2.0], 5.0, 5.0), (3, [], None, None)], "id int, t array<double>, lo double, hi double")
    assert rows(D.axis_errors(a, "id", "t", "lo", "hi")) == [(1, "ticks_do_not_rise"), (2, "empty_range")]


def test_canonical_order(spark):
    q = spark.createDataFrame([("e", 2, "b", "t", None, "x"), ("e", 1, None, "t", 3, None)], "e string, number int, label string, type string, points int, answer string")
    one, two = (D.canonical_exam(x, "e").first().digest for x in (q, q.orderBy("number")))
    assert one == two


def test_pipeline(spark):
    def fail(f):
        raise ValueError("no")

    df = spark.range(3)
    stages = [Stage("a", lambda f: {"y": f["x"]}, ("x",), ("y",)), Stage("b", lambda f: {}, ("z",)), Stage("c", lambda f: {}, (), (), ("gpu",)), Stage("d", fail), Stage("e", lambda f: {})]
    have, log = Pipeline(stages).run(spark, {"x": df})
    assert [(r.name, r.status) for r in log.collect()] == [("a", "COMPLETED"), ("b", "BLOCKED"), ("c", "BLOCKED"), ("d", "FAILED"), ("e", "NOT_RUN")] and "y" in have
    assert [r.status for r in Pipeline(stages).run(spark, {}, lambda: True)[1].collect()] == ["CANCELLED"] * 5


def test_pipeline_computes_what_its_stages_make(spark):
    late = F.udf(lambda x: 1 // (x - 2), "int")
    stages = [Stage("a", lambda f: {"y": f["x"].withColumn("z", F.col("id") + 1)}, ("x",), ("y",)), Stage("b", lambda f: {"w": f["y"].select(late("id").alias("v"))}, ("y",), ("w",)), Stage("c", lambda f: {"u": f["w"]}, ("w",), ("u",))]
    have, log = Pipeline(stages).run(spark, {"x": spark.range(3)})
    log = log.collect()
    assert [(r.name, r.status) for r in log] == [("a", "COMPLETED"), ("b", "FAILED"), ("c", "NOT_RUN")]
    assert "ZeroDivisionError" in log[1].error
    assert "w" not in have and have["y"].count() == 3


def test_pipeline_query_counts_rows(spark, tmp_path):
    rows = [(i, i % 3, 10 + i % 2, "1", f"p{i}", "number") for i in range(6)]
    spark.createDataFrame(rows, "candidate_id bigint, atu_id bigint, question_id bigint, value_json string, provider string, kind string").write.parquet(f"{tmp_path}/candidates.parquet")
    got = {r["name"]: (r.status, r.made) for r in document_queries.r12_stage_records(spark, str(tmp_path)).collect()}
    assert got == {"settle": ("COMPLETED", 3), "questions": ("COMPLETED", 2), "render": ("BLOCKED", None)}
