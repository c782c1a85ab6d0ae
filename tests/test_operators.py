import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import compare, evidence, ordered, scenes, spatial, versions


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_settle(spark):
    r = spark.createDataFrame(
        [("a", "p", "3"), ("a", "q", "3"), ("b", "reference:x", "1"), ("b", "reference:y", "1"), ("c", "p", "3"), ("c", "q", '"3"'), ("d", "p", "1"), ("d", "p ", "1"), ("e", "p", None), ("f", None, "x" * 50), ("f", "q", "y")],
        "atu_id string, provider string, value_json string",
    )
    got = {x.atu_id: (x.status, x.value_json, x.note) for x in evidence.settle(r).collect()}
    assert got["a"] == ("AUTO_VERIFIED", "3", "independent_sources:2")
    assert got["b"][0] == got["d"][0] == got["e"][0] == "UNVERIFIED"
    assert got["c"] == ("CONFLICT", None, 'conflict:"3"<-q; 3<-p')
    assert got["f"][2] == f"conflict:{'x' * 37}...<-; y<-q"
    assert evidence.settle(r.limit(0)).count() == 0


def test_text(spark):
    lit = F.lit
    assert one(spark, T.norm_text(lit(" a\t〈b〉 −1"))) == "ab-1"
    assert [one(spark, T.char_exact(lit(p), lit(g))) for p, g in (("", ""), ("a", ""), ("ab", "ac"), ("abcd", "a"))] == [1.0, 0.0, 0.5, 0.0]
    assert one(spark, T.critical_tokens(lit("답은 3.5 cm 없다 ①"))) == ["3.5cm", "없", "①"]
    assert [one(spark, T.norm_answer(lit(x))) for x in ("③.", "76°", " 5cm ", "x²")] == ["3", "76", "5", "x²"]
    assert one(spark, T.answers_match(lit("7"), lit("76"))) is False and one(spark, T.answers_match(lit("가나"), lit("답은 가나"))) is True
    assert one(spark, T.numeric_typos(lit("2O3 4l ５"))) == "203 41 5"
    assert one(spark, T.normalize_units(lit("<ABC 85˙ 3㎝"))) == "∠ABC 85° 3cm"
    assert one(spark, T.split_choices(lit("① a ② b ① c"))) == {"①": "a", "②": "b"}
    assert one(spark, T.points_tag(lit("값은? [4점]"))) == 4
    assert one(spark, T.scrub(lit("token=abc a@b.co /home/me 010-1234-5678"))) == "token=<REDACTED> <EMAIL> <PATH> <PHONE>"
    assert one(spark, T.page_role(lit("정답 및 해설"))) == "ANSWER_KEY" and one(spark, T.page_role(lit(None).cast("string"))) == "UNKNOWN"
    assert one(spark, T.safe_filename(lit("../x/a:b?.pdf"))) == "a" and one(spark, T.natural_key(lit("p10"))) > one(spark, T.natural_key(lit("p9")))
    assert one(spark, T.tolerant_json(lit('```json\n{"a": "\\frac"}\n```')).isNotNull())
    assert one(spark, T.unsafe_payload(lit("A" * 300))) is True


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 110), st.sampled_from(["end.", "no", "3 x", "Big", "", "x: "])), min_size=1, max_size=25), st.integers(5, 60))
def test_windows_equal_loops(spark, items, budget):
    df = spark.createDataFrame([("g", i, n, t) for i, (n, t) in enumerate(items)], "g string, o int, n int, t string")
    top, opens = 0, []
    for n, _ in items:
        opens.append(1 <= n <= 99 and n > top)
        top = n if opens[-1] else top
    assert [r.opens for r in ordered.blocks(df, ["g"], "o", F.col("n")).orderBy("o").collect()] == opens
    left, kept = budget, []
    for n, i in sorted((n, i) for i, (n, _) in enumerate(items)):
        if n <= left:
            left -= n
            kept.append(i)
    assert {r.o for r in ordered.within_budget(df, ["g"], "n", "o", budget).collect()} == set(kept)
    merged = []
    for _, t in items:
        prev = merged[-1].rstrip() if merged else ""
        if prev and t.lstrip() and not prev.endswith((".", "?", "!", ":", "。")) and t.lstrip()[0] in "abcdefghijklmnopqrstuvwxyz0123456789+-":
            merged[-1] = prev + " " + t.strip()
        else:
            merged.append(t.strip())
    assert [r.text for r in ordered.joined_lines(df, ["g"], "o", "t").orderBy("line_group").collect()] == merged
    total, ok = 0.0, []
    for n, _ in items:
        ok.append(total + n <= budget)
        total += n if ok[-1] else 0
    assert [r.accepted for r in versions.fill_budget(df, "g", "o", "n", float(budget)).orderBy("o").collect()] == ok


def test_ordered(spark, rows):
    df = spark.createDataFrame([("d", i, k, k) for i, k in enumerate([0, 1, 2, 3])], "g string, o int, pos int, k int")
    move = lambda k, to: {r.k: r.place for r in ordered.moved(df.withColumn("t", F.when(F.col("k") == k, to)), ["g"], "pos", "k", "t").collect()}
    assert move(0, 2) == {1: 0, 2: 1, 0: 2, 3: 3} and move(3, -5) == {3: 0, 0: 1, 1: 2, 2: 3} and move(1, 99) == {0: 0, 2: 1, 3: 2, 1: 3}
    big = spark.range(3000).withColumnRenamed("id", "k")
    a = {r.k: r.place for r in ordered.shuffled(big, ["k"], 1).collect()}
    assert sorted(a.values()) == list(range(1, 3001)) and a == {r.k: r.place for r in ordered.shuffled(big.repartition(7), ["k"], 1).collect()} and a != {k: k + 1 for k in a}
    lab = spark.createDataFrame([("d", 1, "2-1"), ("d", 2, "2-1"), ("d", 3, "3-2"), ("d", 4, "x")], "g string, o int, l string")
    assert [r.new_label for r in ordered.renumber_subs(lab, ["g"], "l", "o").orderBy("o").collect()] == ["2-1", "2-2", "3-2", "x"]
    assert [r.unique_label for r in ordered.unique_labels(lab, ["g"], "l", "o").orderBy("o").collect()] == ["2-1", "2-1·2", "3-2", "x"]


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(1)
    boxes = [("p", i, rnd.uniform(0, 90), rnd.uniform(0, 90), rnd.choice([0.0, 5.0, 40.0]), rnd.uniform(0, 30)) for i in range(60)]
    df = spark.createDataFrame(boxes, "p string, id int, x double, y double, w double, h double")
    want = {(a[1], b[1]) for a in boxes for b in boxes if a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]}
    want = {(i, j) for i, j in want if boxes[i][4] and boxes[j][4] and boxes[i][5] and boxes[j][5]}
    got = [(r.a_id, r.b_id) for r in spatial.overlap_join(df, df, ["p"], 10.0).collect()]
    assert set(got) == want and len(got) == len(want)


def test_crowded_pages_meet_in_cells_and_are_spread(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CROWDED", 4, raising=False)
    monkeypatch.setattr(spatial, "TASK_PAIRS", 2_000, raising=False)
    rnd = random.Random(2)
    boxes = [("pq"[i % 2], i, float(rnd.randrange(-6, 9)), rnd.uniform(-3, 4), rnd.choice([1.0, 4.0, 30.0]), rnd.choice([0.5, 9.0])) for i in range(500)]
    df = spark.createDataFrame(boxes, "p string, id int, x double, y double, w double, h double")
    some = df.where("id % 3 = 0")
    want = {(a[1], b[1]) for a in boxes if a[1] % 3 == 0 for b in boxes if a[0] == b[0] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]}
    for left, right, turn in ((some, df, 1), (df, some, -1)):
        j = spatial.overlap_join(left, right, ["p"], 16.0)
        got = [(r.a_id, r.b_id)[::turn] for r in j.collect()]
        assert set(got) == want and len(got) == len(want)
        # few rows make many pairs: tasks follow the pairs
        assert j.rdd.getNumPartitions() > 10


def test_scenes(spark):
    nodes = spark.createDataFrame([("s", "A", "point", [], {"x": 1.0}), ("s", "A", "point", [], {}), ("s", "m", "right_angle_mark", ["A", "B", "C"], {}), ("s", "z", "segment", ["A"], {"x": float("nan")})], "scene_id string, id string, kind string, refs array<string>, props map<string,double>")
    edges = spark.createDataFrame([("s", "parallel", ["A", "Q"]), ("s", "intersection", ["l", "k", "A"]), ("s", "on_line", ["A", "l"])], "scene_id string, kind string, refs array<string>")
    labels = spark.createDataFrame([("s", "A", "x"), ("s", "W", "y")], "scene_id string, node_id string, text string")
    errors = {(r.error, r.about) for r in scenes.validate(nodes, edges, labels).collect()}
    assert {("duplicate_id", "A"), ("few_refs", "z"), ("number_out_of_range", "z"), ("missing_ref", "Q"), ("label_without_node", "W")} <= errors
    issues = {(r.issue, r.about) for r in scenes.inconsistent(nodes, edges).collect()}
    assert issues == {("mark_without_relation", "m"), ("relation_without_mark", "parallel|A,Q"), ("intersection_not_on_line", "A|k")}


def test_compare_and_versions(spark, rows):
    p, g = F.lit("3cm 3cm ① 없"), F.lit("3cm ① ②")
    assert tuple(one(spark, compare.token_overlap(p, g))) == (2, 3, 2)
    chain = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 70)] + [("x", "lost"), ("y", None)], "id string, p string")
    got = {r.id: (r.root, r.depth) for r in versions.ancestors(chain, "id", "p").collect()}
    assert got["69"] == ("1", 68) and got["1"] == ("1", 0) and got["x"] == ("x", 0) and got["y"] == ("y", 0)
    req = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b")], "key string, o int, body_hash string")
    assert [r.outcome for r in compare.replays(req, ["key"], ["o"]).orderBy("o").collect()] == ["first", "replay", "conflict"]
