import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import nested


def walk(v, path, parent, out):
    if isinstance(v, dict):
        if path:
            out.add((path, parent))
        for k, x in v.items():
            walk(x, f"{path}.{k}" if path else k, path, out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            walk(x, f"{path}[{i}]", parent, out)


DOCS = [
    {"a": 1, "q": [{"b": [{"t": "x"}, None, {"t": "{[\"y\\\""}], "c": {"d": {"e": [[{"f": 1}]]}}}, {"b": "s"}, None, 3]},
    {"q": {"b": {"t": 1}}, "n": None, "e": [], "o": {}},
    {"①": {"가": [{"x": {}}]}},
]


def nodes(spark, texts, **kw):
    df = spark.createDataFrame([(str(i), t, "clash") for i, t in enumerate(texts)], "id string, j string, node string")
    return nested.flatten(df.select("id", "node", nested.parse(F.col("j")).alias("v")), "id", "v", **kw)


def test_paths_match_a_plain_walk(spark):
    texts = [json.dumps(d, ensure_ascii=bool(i % 2)) for i, d in enumerate(DOCS)] + [json.dumps(json.dumps(DOCS[0]))]
    want = set()
    for i, d in enumerate([*DOCS, DOCS[0]]):
        out = set()
        walk(d, "", "", out)
        want |= {(str(i), *x) for x in out}
    for keep in (True, False):
        got = {tuple(r) for r in nodes(spark, texts, keep=keep).where("is_object").select("root_id", "node", "parent").collect()}
        assert got == want


def test_odd_contents_have_no_rows(spark):
    texts = [None, "", "{}", "[]", '{"a": [', "null", '"text"', "5", '{"a": 1}', '{"a": {"b": 1}, "a": {}}', '{"a": {}} x']
    assert nodes(spark, texts).where("is_object").count() == 0
    empty = spark.createDataFrame([], "id string, j string").select("id", nested.parse(F.col("j")).alias("v"))
    assert nested.flatten(empty, "id", "v").count() == 0
    assert [(r.path, r.kind) for r in nested.merged_schema(empty, "v").collect()] == []


def test_deep_and_long(spark):
    """A hostile record is walked on by itself; the others keep their plan."""
    deep = {"k": 1}
    for i in range(120):
        deep = {"a": [deep, None]} if i % 3 else {"b": deep}
    long = {"a": [{"t": "가" * 200_000}] * 3}
    docs = [deep, long, DOCS[0]]
    want = set()
    for i, d in enumerate(docs):
        out = set()
        walk(d, "", "", out)
        want |= {(str(i), *x) for x in out}
    got = [tuple(r) for r in nodes(spark, [json.dumps(d) for d in docs], keep=False).where("is_object").select("root_id", "node", "parent").collect()]
    assert set(got) == want and len(got) == len(want)


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab가\"\\.[", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "B", "b", "가", "1", "22", "x.y", "q`", "it's", "_", ""]), x, max_size=4), max_leaves=12)


@given(st.lists(st.dictionaries(st.sampled_from(["a", "q", "n", "7"]), VALUES, max_size=4), min_size=1, max_size=6))
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_any_records(spark, docs):
    want = set()
    for i, d in enumerate(docs):
        out = set()
        walk(d, "", "", out)
        want |= {(str(i), *x) for x in out}
    got = [tuple(r) for r in nodes(spark, [json.dumps(d) for d in docs]).where("is_object").select("root_id", "node", "parent").collect()]
    assert set(got) == want and len(got) == len(want)


def test_children_carry_keys_and_ordinals(spark):
    n = nodes(spark, [json.dumps(DOCS[0])])
    rows = {r.row_key: r for r in n.collect()}
    assert rows["0#q[0].b[2]"].parent_key == "0#q[0]" and rows["0#q[0].b[2]"].ordinal == 2 and rows["0#q[0].b[2]"].path == "q[].b[]"
    assert rows["0#q[0].c.d.e[0][0]"].parent_key == "0#q[0].c.d" and not rows["0#q[0].b[1]"].is_object


def test_child_table_and_schema(spark):
    n = nodes(spark, [json.dumps({"q": [{"id": "x", "p": 3}, {"id": 5}, {"p": "no"}]})])
    got = [tuple(r) for r in nested.child_table(n, "q[]", {"id": "string", "p": "bigint"}).orderBy("ordinal").collect()]
    assert got == [("0", "0#q[0]", "0#", 0, "x", 3), ("0", "0#q[1]", "0#", 1, "5", None), ("0", "0#q[2]", "0#", 2, None, None)]
    df = spark.createDataFrame([("0", '{"q": [{"b": 1}]}'), ("1", '{"q": {"b": 2}}')], "id string, j string")
    s = nested.merged_schema(df.select("id", nested.parse(F.col("j")).alias("v")), "v")
    assert {(r.path, r.kind) for r in s.collect()} == {("", "object"), ("q", "array"), ("q[]", "object"), ("q[].b", "BIGINT"), ("q", "object"), ("q.b", "BIGINT")}
    mapped = spark.createDataFrame([('{"7": {"a": 1}, "12": {"b": []}}',)], "j string").select(nested.parse(F.col("j")).alias("v"))
    assert {(r.path, r.kind) for r in nested.merged_schema(mapped, "v").collect()} >= {("*", "object"), ("*.a", "BIGINT"), ("*.b", "array")}


def test_map_entries(spark):
    df = spark.createDataFrame([(1, {"①": "a", "②": None}), (2, None), (3, {})], "id int, choices map<string,string>")
    assert [tuple(r) for r in nested.flatten_map(df, "id", "choices").collect()] == [("1", "choices.①", "", "a")]
