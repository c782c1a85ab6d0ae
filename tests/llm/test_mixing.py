import math

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import mixing

T = "source string, target_share double, max_repeats int, note string"


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, "clash") for i, (s, t) in enumerate(rows)], "id bigint, source string, tokens bigint, place string")


def test_shares_and_limits(spark):
    rows = [(["A", " a", "a", "a-x", "b"][i % 5], 10 + i % 7) for i in range(1000)] + [("small", 50)] * 3 + [(None, 99), ("other", 99), ("a", 0), ("a", None)]
    t = spark.createDataFrame([("a", 0.5, 1, ""), ("a_x", 0.2, 1, ""), ("b", 0.2, 3, ""), ("small", 0.1, 4, ""), ("none", 0.1, 5, "")], T)
    m, shares = mixing.mix(docs(spark, rows), t)
    s = {r.source: r for r in shares.collect()}
    assert s["small"].most_uses == 4 and s["small"].used == 600 and 0 < s["small"].exponent < 1
    assert s["none"].used == s["other"].used == s[None].used == 0
    free = 1 - s["small"].actual_share
    assert abs(s["a"].actual_share - free * 0.5 / 0.9) < 0.01 and abs(s["b"].actual_share - free * 0.2 / 0.9) < 0.01
    assert all(r.most_uses <= (r.max_repeats or 0) for r in s.values())
    uses = m.groupBy("id", "block").count()
    assert uses.where("count > 1").count() == 0


def test_same_whatever_the_partitions(spark):
    rows = [("a", 5)] * 300 + [("b", 7)] * 100
    t = spark.createDataFrame([("a", 0.3, 1, ""), ("b", 0.7, 2, "")], T)
    one = {(r.id, r.block) for r in mixing.mix(docs(spark, rows), t)[0].collect()}
    assert one == {(r.id, r.block) for r in mixing.mix(docs(spark, rows).repartition(7), t)[0].collect()}


def test_empty(spark):
    none = spark.createDataFrame([], T)
    t = spark.createDataFrame([("a", 1.0, 1, "")], T)
    for d, g in ((docs(spark, []), t), (docs(spark, [("a", 5)]), none)):
        m, shares = mixing.mix(d if d is not None else d, g)
        assert m.count() == 0 and sum(r.used for r in shares.collect()) == 0


def test_tokens(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(mixing.token_count(df.t)).collect()] == [2, 0, 0]


def _filled(natural, wanted, limit, e):
    """Brute force: one scale over all sources, cut at the limits, found by bisection."""
    raw = {s: natural[s] ** (1 - e) * wanted[s] ** e for s in natural}
    low, high = -80.0, 80.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(min(limit[s], math.exp(mid) * raw[s]) for s in raw) > 1 else (mid, high)
    return {s: min(limit[s], math.exp(low) * raw[s]) for s in raw}


@given(st.lists(st.tuples(st.floats(0.001, 1), st.floats(0.001, 1), st.integers(1, 4)), min_size=1, max_size=9), st.sampled_from([0.5, 1, 3]), st.sampled_from([1, 0.4]))
@settings(max_examples=150, deadline=None)
def test_heat_against_filling(rows, budget, end):
    a, b = sum(r[0] for r in rows), sum(r[1] for r in rows)
    natural, wanted = ({i: r[k] / t for i, r in enumerate(rows)} for k, t in ((0, a), (1, b)))
    limit = {i: r[2] * natural[i] / budget for i, r in enumerate(rows)}
    got, want = mixing.heat(end, natural, wanted, limit), _filled(natural, wanted, limit, end)
    assert all(abs(got[i][0] - want[i]) < 1e-6 for i in want)
    assert all(w <= limit[i] * (1 + 1e-8) and 0 <= e <= end for i, (w, e) in got.items())


def test_entropy_is_met():
    sizes, goal = {"a": 1000.0, "b": 100.0, "c": 10.0}, {"a": (0.3, 1), "b": (0.4, 4), "c": (0.3, 5)}
    seen = set()
    for spread in (0.5, 0.6, 0.65):
        found = mixing.weights(sizes, goal, spread=spread)
        assert abs(mixing.entropy(w for _, w, _ in found) - spread) < 1e-6 and abs(sum(w for _, w, _ in found) - 1) < 1e-9
        assert all(w <= goal[s][1] * sizes[s] / 1110 * (1 + 1e-8) for s, w, _ in found)
        seen.add(tuple(w for _, w, _ in found))
    assert len(seen) == 3
    # a spread out of reach takes the nearest
    assert all(abs(a[1] - b[1]) < 1e-6 for a, b in zip(mixing.weights(sizes, goal, spread=9.0), mixing.weights(sizes, goal)))


def test_limit_is_met_by_the_exponent():
    by = {s: (w, e) for s, w, e in mixing.weights({"a": 1000.0, "b": 100.0, "c": 10.0}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 3)})}
    assert abs(by["b"][0] - 200 / 1110) < 1e-9 and abs(by["c"][0] - 30 / 1110) < 1e-9 and 0 < by["c"][1] < by["b"][1] < 1 == by["a"][1]
