from lodestone.functions import text as T
from lodestone.operators import compare, documents, evidence, leases, ordered, scenes, versions
from lodestone.sources import files
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def test_people_outrank_machines_and_unread_units_stay(spark):
    r = spark.createDataFrame([("a", "human:1", "1", "x"), ("a", "ocr", "2", "x"), ("b", "p", "3", "x"), ("b", "q", "3", "x"), ("c", "reference:a", "3", "x"), ("c", "reference:b", "3", "x"), ("d", "p", "1", "x"), ("d", "q", None, "x")], "atu_id string, provider string, value_json string, status string")
    u = spark.createDataFrame([("a", "HUMAN_VERIFIED", "1"), ("b", None, None), ("c", "UNVERIFIED", None), ("d", None, None), ("e", None, None)], "atu_id string, status string, value_json string")
    got = {x.atu_id: (x.status, x.value_json, x.readings) for x in evidence.settle(r, u).collect()}
    assert got == {"a": ("HUMAN_VERIFIED", "1", 2), "b": ("AUTO_VERIFIED", "3", 2), "c": ("UNVERIFIED", None, 2), "d": ("CONFLICT", None, 2), "e": ("UNREADABLE", None, 0)}
    none = evidence.settle(r.limit(0), u.limit(0))
    assert none.count() == 0


def test_states_of_questions_and_documents(spark):
    units = spark.createDataFrame([(1, "AUTO_VERIFIED"), (2, "CONFLICT"), (3, "CONFLICT"), (5, "HUMAN_VERIFIED"), (6, "AUTO_VERIFIED"), (8, "AUTO_VERIFIED")], "question_id int, status string")
    q = spark.createDataFrame([(1, False, False, False, True, 0), (2, False, True, True, True, 0), (3, True, False, False, True, 0), (4, None, None, None, None, None), (5, False, True, True, True, 0), (6, False, False, True, True, 0), (7, False, False, False, True, 0), (8, False, False, False, True, 2)], "question_id int, confirmed boolean, edited boolean, corrected boolean, has_content boolean, issues int")
    got = dict(documents.question_status(units, q).collect())
    assert got == {1: "AUTO_RESTORED", 2: "NEEDS_USER_REVIEW", 3: "USER_CONFIRMED", 4: "BLOCKED", 5: "USER_EDITED", 6: "AUTO_CORRECTED", 7: "AUTO_RESTORED", 8: "NEEDS_USER_REVIEW"}
    of = spark.createDataFrame([("a", "AUTO_RESTORED"), ("b", "BLOCKED"), ("b", "USER_CONFIRMED"), ("c", "BLOCKED"), ("c", "NEEDS_USER_REVIEW"), ("d", "AUTO_RESTORED")], "doc_id string, status string")
    docs = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", "IN_PROGRESS"), ("e", None)], "doc_id string, status string")
    assert dict(documents.document_status(of, docs).collect()) == {"a": "READY_FOR_FINAL_EXPORT", "b": "RESTORED_BEST_EFFORT", "c": "NEEDS_USER_REVIEW", "d": "IN_PROGRESS", "e": "RESTORED_BEST_EFFORT"}


def test_figures_keep_the_rules(spark):
    nodes = spark.createDataFrame([("s", "m", "angle_mark", ["p"], {"x": 1.0}), ("s", "p", "point", [], {"x": float("nan")}), ("s", "k", "blob", [], {"x": 1e9}), ("s", "n", None, [], {}), ("s", "l", "polyline", ["p"], {})], "scene_id string, id string, kind string, refs array<string>, props map<string,double>")
    edges = spark.createDataFrame([("s", "parallel", []), ("s", "touches", ["zz"]), ("s", "midpoint", ["p", "q"])], "scene_id string, kind string, refs array<string>")
    labels = spark.createDataFrame([("s", "p", "x" * 201), ("s", "gone", "y"), ("s", "m", "x" * 200)], "scene_id string, node_id string, text string")
    got = {(r.error, r.about) for r in scenes.validate(nodes, edges, labels).collect()}
    assert got == {("unknown_kind", "k|blob"), ("unknown_kind", "n"), ("few_refs", "l"), ("number_out_of_range", "p"), ("relation_without_refs", "parallel"), ("unknown_relation", "touches"), ("missing_ref", "q"), ("label_too_long", "p"), ("label_without_node", "gone")}


def test_long_numbers_sort_as_numbers(spark):
    names = ["a9", "a10", "a" + "1" * 21, "a" + "1" * 22, "a1" + "0" * 120, "a009b", "a0", "b", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", T.natural_key(F.col("n")))
    got = [r.n for r in df.orderBy("k").collect()]
    assert got == ["", "a0", "a9", "a009b", "a10", "a" + "1" * 21, "a" + "1" * 22, "a1" + "0" * 120, "b"]
    assert df.select("k").distinct().count() == len(names)


def test_gaps_of_far_numbers_and_quotas_of_huge_bands(spark):
    df = spark.createDataFrame([("a", 3), ("a", 25_010), ("a", 3), ("b", 1), ("c", None)], "k string, n int")
    assert ordered.gaps(df, ["k"], "n").where("k = 'a'").count() == 25_006
    assert {tuple(r) for r in ordered.gaps(df.where("n < 9"), ["k"], "n", from_one=True).collect()} == {("a", 1), ("a", 2)}
    big = spark.range(5000).select((F.col("id") % 2).alias("band"), "id")
    got, short = ordered.quota(big, "band", "id", spark.createDataFrame([(0, 3), (1, 4000), (7, 1)], "band bigint, quota int"))
    assert sorted(r.id for r in got.where("band = 0").collect()) == [0, 2, 4] and got.count() == 2503
    assert {r.band: r.short for r in short.collect()} == {0: 0, 1: 1500, 7: 1}


def test_budgets_are_filled_in_order(spark):
    rows = [("a", i, 3.0, "x") for i in range(5)] + [("a", 5, 1.0, "x"), ("b", 1, 20.0, "x"), ("b", 2, None, "x"), ("b", 3, 10.0, "x")]
    df = spark.createDataFrame(rows, "k string, i int, c double, accepted string").repartition(3)
    got = {(r.k, r.i): r.accepted for r in versions.fill_budget(df, "k", "i", "c", 10.0).collect()}
    assert [got["a", i] for i in range(6)] == [True, True, True, False, False, True] and [got["b", i] for i in (1, 2, 3)] == [False, True, True]
    assert versions.fill_budget(df.limit(0), "k", "i", "c", 10.0).count() == 0


def test_labels_counted_anew_where_one_is_repeated(spark):
    df = spark.createDataFrame([("e", 1, "3-1"), ("e", 2, "3-1"), ("e", 3, "4-2"), ("e", 4, "x"), ("e", 5, None), ("f", 1, "3-2")], "k string, o int, l string")
    got = {(r.k, r.o): r.new_label for r in ordered.renumber_subs(df, ["k"], "l", "o").collect()}
    assert got == {("e", 1): "3-1", ("e", 2): "3-2", ("e", 3): "4-2", ("e", 4): "x", ("e", 5): None, ("f", 1): "3-2"}


def test_registry_defaults_and_pages(spark):
    df = spark.createDataFrame([("a", 1), ("z", 2)], "k string, brand_id int")
    got = {r.brand_id: r.color for r in documents.with_default(df, "k", spark.createDataFrame([("a", "red")], "k string, color string"), {"color": "grey"}).collect()}
    assert got == {1: "red", 2: "grey"}
    pages = spark.createDataFrame([("d", 0, "ANSWER_KEY"), ("d", 1, None), ("d", 2, "QUESTION"), ("d", None, "UNKNOWN")], "document_id string, pdf_page_index int, page_role string")
    assert [tuple(r) for r in documents.page_lists(pages).collect()] == [("d", [0], [1])]


def test_claims_cancellations_and_fences(spark):
    rows = [("a", "QUEUED", 1, 5.0, None, None, None), ("b", "RUNNING", 9, 9.0, None, 50.0, 2), ("c", "RUNNING", 9, 1.0, None, 150.0, 1), ("d", "SUCCEEDED", 9, 1.0, None, None, 1), ("e", "QUEUED", 9, 1.0, 101.0, None, None), ("f", "QUEUED", 9, 9.0, 1.0, None, None), ("g", None, 9, 9.0, 1.0, None, None)]
    jobs = spark.createDataFrame(rows, "id string, state string, priority int, created_at double, not_before double, lease_expires_at double, attempt int")
    workers = spark.createDataFrame([("w2", 1), ("w1", 1), ("w1", 2), ("w3", 3), ("w4", 4)], "worker string, k int")
    got = {r.id: (r.owner, r.attempt) for r in leases.claim(jobs, workers, 100.0).collect()}
    assert got == {"b": ("w1", 3), "f": ("w2", 1), "a": ("w3", 1)}
    assert leases.claim(jobs.limit(0), workers, 1.0).count() == 0 and leases.claim(jobs, workers.limit(0), 100.0).count() == 0
    asked = spark.createDataFrame([("c",), ("d",), ("a",), ("zz",), ("a",)], "id string")
    assert {tuple(r) for r in leases.cancel(jobs, asked, 1.0).collect()} == {("c", "REQUESTED", "CANCEL_REQUESTED"), ("d", "ALREADY_COMPLETED", "SUCCEEDED"), ("a", "REQUESTED", "QUEUED"), ("zz", "NOT_FOUND", None)}
    held = spark.createDataFrame([("b", "RUNNING", "t", None), ("c", "RUNNING", "t", 5.0), ("d", "SUCCEEDED", "t", None)], "id string, state string, token string, cancel_requested_at double")
    writes = spark.createDataFrame([(1, "b", "t"), (2, "b", "u"), (3, "c", "t"), (4, "d", "t"), (5, "zz", "t"), (6, "b", None)], "write_id int, id string, token string")
    assert dict(leases.fenced(writes, held).collect()) == {1: "COMMITTED", 2: "STALE_LEASE", 3: "ALREADY_CANCELLED", 4: "STALE_LEASE", 5: "STALE_LEASE", 6: "STALE_LEASE"}


def test_changes_under_an_expected_head(spark):
    rows = [("d", 1, "r1", None, "x"), ("d", 2, "r2", "r1", "x"), ("d", 3, "r3", "r1", "x"), ("d", 4, "r4", "r2", "x"), ("e", 1, "q1", "r4", "x"), ("e", 2, "q2", None, "x")]
    df = spark.createDataFrame(rows, "doc string, n int, id string, want string, head string").repartition(2)
    got = {r.id: (r.accepted, r.head) for r in versions.swap_heads(df, "doc", ["n", "id"], "id", "want").collect()}
    assert got == {"r1": (True, None), "r2": (True, "r1"), "r3": (False, "r2"), "r4": (True, "r2"), "q1": (False, None), "q2": (True, None)}
    units = spark.createDataFrame([("a", "CONFLICT", None), ("b", "UNVERIFIED", "1")], "atu_id string, status string, value_json string")
    says = spark.createDataFrame([("a", "7", 1.0, 1), ("a", None, 2.0, 2), ("z", "1", 1.0, 3)], "atu_id string, value_json string, ts double, id int")
    assert {tuple(r) for r in versions.resolve_units(units, says).collect()} == {("a", "HUMAN_VERIFIED", None), ("b", "UNVERIFIED", "1")}


def test_objects_that_should_be_there(spark):
    kind = "question_id string, fields array<string>, choices array<string>, equations int"
    e = spark.createDataFrame([("a", ["body", "points"], ["1", "2"], 2), ("b", ["body"], [], 0), ("c", [], ["1"], 1)], kind)
    a = spark.createDataFrame([("a", ["body"], ["2", "3", "4"], 1), ("c", ["figure"], ["9"], 2)], kind)
    got = {tuple(r) for r in compare.manifest_problems(e, a).collect()}
    assert got == {("a", "missing", "points"), ("a", "missing", "choice:1"), ("a", "duplicate", "choice:3"), ("a", "duplicate", "choice:4"), ("a", "missing", "equation:2/1"), ("b", "missing_question", None), ("c", "missing", "choice:1"), ("c", "duplicate", "equation:1/2")}


def test_gate_counts_what_is_known(spark):
    settled = spark.createDataFrame([("a", "CONFLICT"), ("b", "CONFLICT"), ("c", "AUTO_VERIFIED")], "atu_id string, status string")
    units = spark.createDataFrame([("d", "a", "points"), ("d", "b", "unit"), ("e", "c", "text_token")], "doc_id string, atu_id string, kind string")
    numbers = spark.createDataFrame([("d", 1), ("d", 4), ("d", 4)], "doc_id string, number int")
    q = spark.createDataFrame([("d", True), ("d", None), ("d", False), ("z", False)], "doc_id string, has_content boolean")
    regions = spark.createDataFrame([("d", "REVIEW_REQUIRED"), ("d", "KEEP")], "doc_id string, decision string")
    pages = spark.createDataFrame([("d", True), ("d", False)], "doc_id string, failed boolean")
    flags = spark.createDataFrame([("d", "logic_conflict"), ("d", "none")], "doc_id string, kind string")
    got = {r.doc_id: r.asDict() for r in evidence.gate(settled, units, numbers, q, regions, pages, q.where("doc_id = 'd'").select("doc_id"), flags).collect()}
    d = got["d"]
    assert (d["number_conflict"], d["math_conflict"], d["gaps"], d["duplicates"], d["empty_questions"], d["reconstruction_pending"], d["unprocessed_pages"], d["manifest_mismatch"], d["logic_conflict"], d["passed"]) == (1, 1, 2, 1, 2, 1, 1, 3, 1, False)
    assert got["e"]["passed"] and set(got) == {"d", "e"}


def test_fields_found_in_an_audit_text(spark):
    rows = [("abcdefghij", "xx abcdXefghij"), ("abc", "a b c"), ("abcdefghij", "jihgfedcba"), (None, "a"), ("a", None), ("", "x")]
    df = spark.createDataFrame(rows, "f string, t string")
    assert [r.covered for r in documents.audit_coverage(df, "t", "f").collect()] == [True, True, False, False, False, True]


def test_required_checks_of_the_last_proof(spark):
    required = spark.createDataFrame([("pdf", "a"), ("pdf", "b")], "kind string, check string")
    proofs = spark.createDataFrame([(1, "pdf", 10, 1, "h", "h"), (1, "pdf", 11, 2, "h", "h"), (2, "pdf", 20, 1, "h", "x"), (3, "txt", 30, 1, "h", "h"), (4, "pdf", 40, 1, "h", None)], "artifact int, kind string, proof int, at int, hash string, content_hash string")
    checks = spark.createDataFrame([(10, "a", "PASSED"), (11, "a", "PASSED"), (11, "b", "PASSED"), (11, "b", "PASSED"), (20, "a", "PASSED"), (20, "b", "PASSED"), (40, "a", "FAILED")], "proof int, check string, result string")
    got = {r.artifact: (r.proven, r.open) for r in documents.checks_passed(required, proofs, checks).collect()}
    assert got == {1: (True, []), 2: (False, []), 3: (True, []), 4: (False, ["a", "b"])}


def test_unreadable_rows_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "n": 2}\n{"id": "2", "n": "x"}\n{"id": \n\n[1]\n')
    schema = StructType([StructField("id", StringType()), StructField("n", IntegerType())])
    row = files.unreadable(spark, str(tmp_path), schema).first()
    kept = files.load_documents(spark, str(tmp_path), schema).where("id is not null").count()
    assert row.rows == 4 and row.unreadable == 3 and kept == 1
