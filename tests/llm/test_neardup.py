import math
import random
from collections import Counter

import pyarrow as pa

from lodestone.llm import neardup


def brute(rows, t):
    bags = [(i, Counter(x for x in w if x)) for i, w in rows if w and any(w)]
    out = set()
    for i, a in bags:
        for j, b in bags:
            if i < j and sum((a & b).values()) >= math.ceil(t * max(sum(a.values()), sum(b.values())) - 1e-9):
                out.add((i, j))
    return out


def run(spark, rows, t, copies=64):
    df = spark.createDataFrame([(i, w, "x", 1, "h") for i, w in rows], "id bigint, w array<string>, token string, n int, h string")
    classes, members = neardup.pairs(df, "id", "w", t)
    return {(r.id_a, r.id_b) for r in neardup.members_pairs(classes, members, copies=copies).collect()}, classes, members


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["the"] * 10
    rows = []
    for i in range(150):
        if rows and rnd.random() < 0.6:
            w = list(rnd.choice(rows)[1])
            for _ in range(rnd.randrange(5)):
                k = rnd.randrange(len(w) + 1)
                w[k : k + rnd.randrange(2)] = [rnd.choice(words)]
            rnd.shuffle(w)
        else:
            w = [rnd.choice(words) for _ in range(rnd.randrange(1, 25))]
        rows.append((i, w))
    for t in (0.7, 0.8):
        assert run(spark, rows, t)[0] == brute(rows, t)


def test_defined_cases(spark):
    rows = [(1, None), (2, []), (3, [None, ""]), (4, ["a", "b"]), (5, ["b", "a"]), (5, ["b", "a"]), (6, ["a"]), (7, ["a", "a", "b"]), (8, ["x"] * 20_000), (9, ["x"] * 19_999 + ["y"])]
    got, classes, members = run(spark, rows, 0.7)
    assert got == {(4, 5), (8, 9)}
    assert {(r["id"], r["class"]) for r in members.collect()} >= {(4, 4), (5, 4), (8, 8)}
    empty, _, _ = run(spark, [], 0.7)
    assert empty == set()


def test_many_copies_keep_their_links(spark):
    rows = [(i, ["a", "b", "c", "d"]) for i in range(200)] + [(500, ["a", "b", "c", "e"]), (501, ["q"])]
    got, classes, members = run(spark, rows, 0.7, copies=10)
    assert len(got) == 200 and (0, 500) in got and all(a == 0 for a, _ in got)
    assert {(r["a"], r["b"]) for r in classes.collect()} == {(0, 500)}
    g = {r["id"]: (r["copies"], r["links"]) for r in neardup.groups(classes, members).collect()}
    assert g[7] == (200, 1) and g[500] == (1, 1) and g[501] == (1, 0)


def test_large_classes_give_all_pairs(spark):
    words = ["a", "b", "c", "d"]
    # more than a block of equal bags in several orders, another such class and some single ones near them
    rows = [(i, words[i % 4 :] + words[: i % 4]) for i in range(150)] + [(200 + i, ["e", "a", "b", "c"]) for i in range(70)] + [(500, ["a", "b", "c"]), (501, ["q"]), (7, ["q"])]
    df = spark.createDataFrame(rows, "id bigint, w array<string>")
    classes, members = neardup.pairs(df, "id", "w", 0.7)
    got = [(r.id_a, r.id_b) for r in neardup.members_pairs(classes, members).collect()]
    want = brute(rows, 0.7)
    assert len(got) == len(set(got)) and set(got) == want
    assert (1, 2) in want and (149, 269) in want and (7, 501) in want


def test_tokens_of_many_bags_meet_in_blocks(spark, monkeypatch):
    # blocks are made where bags are signed, by a function that takes its size along
    monkeypatch.setattr(neardup, "HELD", 50, raising=False)
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(500):
        w = [rnd.choice(words) for _ in range(rnd.randrange(3, 12))] if i % 4 else rnd.choice(rows or [(0, words[:5])])[1][:-1] + [rnd.choice(words)]
        rows.append((i, w))
    for t in (0.3, 0.7):
        want = brute(rows, t)
        assert want and run(spark, rows, t, copies=10**6)[0] == want


def test_no_token_is_one_tasks_work():
    level = bytes([4 * 12]) * neardup.CELLS
    bags = [[7, 100 + i, 200 + i, 300 + i] for i in range(20_000)]
    batch = pa.RecordBatch.from_pydict({"rid": list(range(20_000)), "within": pa.array([1] * 20_000, pa.int64()), "h": pa.array(bags, pa.list_(pa.int64()))})
    held, neardup.HELD = neardup.HELD, 512
    try:
        rows = pa.Table.from_batches(neardup._sign(level, 0.7)([batch]))
    finally:
        neardup.HELD = held
    sizes = Counter(rows.column("key").to_pylist())
    # frequent by the sketch (2 ** 12 bags, eight blocks): of the 20,000 bags no key has more than two blocks
    assert max(sizes.values()) < 2.2 * 20_000 / 8 and set(rows.column("side").to_pylist()) == {0, 1, 2}
