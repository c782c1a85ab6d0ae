from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators.integrity import Bitmap, orphan_references

REFS = "tbl string, ref_field string, row_id string, space string, key string, ref_at timestamp, made_at double, late_counts boolean, spellings string, ck string"
PARENTS = "space string, key string, arrived_at timestamp, deleted_at double, tbl string"
MAY, JUNE = datetime(2025, 5, 10), datetime(2025, 6, 10)


def ref(i, key, at=JUNE, made=100.0, late=True, field="f"):
    return ("t", field, i, "s", key, at, made, late, "clash", "clash")


def found(spark, refs, parents):
    r, p = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    return {(x.row_id, x.orphan_kind, x.period) for x in orphan_references(r, p).collect()}


def test_kinds(spark):
    parents = [("s", "a", MAY, None, "x"), ("s", "b", datetime(2025, 6, 20), None, "x"), ("s", "c", MAY, 50.0, "x"), ("s", "d", datetime(2025, 7, 1), 200.0, "x")]
    refs = [ref("1", "a"), ref("2", "b"), ref("3", "c"), ref("4", "d"), ref("5", "gone"), ref("6", None), ref("7", ""), ref("8", "  "), ref("9", " A "), ref("10", "B"), ref("11", "b", late=False), ref("12", "c", made=49.0)]
    assert found(spark, refs, parents) == {("2", "late", "2025-06"), ("3", "deleted", "2025-06"), ("4", "late", "2025-06"), ("5", "missing", "2025-06")}


def test_same_month_repeats_and_null_times(spark):
    parents = [("s", "a", datetime(2025, 6, 9), None, "x")] * 2 + [("s", "n", None, None, "x")]
    refs = [ref("1", "a")] * 3 + [ref("2", "a", datetime(2025, 6, 8)), ref("3", "a", None), ref("4", "zz", None), ref("5", "n")]
    assert found(spark, refs, parents) == {("2", "late", "2025-06"), ("4", "missing", None)}


def test_empty_tables(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [ref("1", "a")], []) == {("1", "missing", "2025-06")}
    assert found(spark, [], [("s", "a", MAY, None, "x")]) == set()


def test_hot_and_long_keys(spark):
    long = "k" * 50_000
    refs = [ref(str(i), "dead") for i in range(3000)] + [ref("l", long)]
    got = found(spark, refs, [("s", long, MAY, None, "x")])
    assert len(got) == 3000 and {k for _, k, _ in got} == {"missing"}


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 200_000), max_size=400), st.sets(st.integers(0, 200_000), max_size=400), st.booleans())
def test_bitmap_and_not(a, b, dense):
    if dense:
        a, b = a | set(range(60_000, 68_000)), b | set(range(64_000, 70_000, 2))
    got = Bitmap.of(np.array(sorted(a), np.int64)).and_not(Bitmap.of(np.array(sorted(b), np.int64))).decode()
    assert sorted(got.tolist()) == sorted(a - b)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 200_000), max_size=200), st.booleans()), max_size=4))
def test_bitmap_union(parts):
    parts = [p | set(range(i * 5000, i * 5000 + 6000)) if dense else p for i, (p, dense) in enumerate(parts)]
    got = Bitmap({})
    for p in parts:
        got = got.union(Bitmap.of(np.array(sorted(p), np.int64)))
    assert sorted(got.decode().tolist()) == sorted(set().union(*parts))


def test_months_in_order(spark):
    """What came in any month before counts, and only that."""
    at = [datetime(2025, m, 5) for m in range(1, 7)]
    parents = [("s", f"k{m}", at[m], None, "x") for m in range(6)]
    refs = [ref(f"{m}-{n}", f"k{m}", at[n]) for m in range(6) for n in range(6)]
    got = found(spark, refs, parents)
    assert got == {(f"{m}-{n}", "late", f"2025-0{n + 1}") for m in range(6) for n in range(6) if n < m}
