import random

from pyspark.sql import functions as F

from lodestone.llm import annotators
from lodestone.llm.queries import plain_label

SCHEMA = "item string, scale string, annotator string, label int, k int, confidence double, ts double, family string, w string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_held_out_accuracy(spark, monkeypatch):
    """Planted truth: honest, careless, shifted and constant annotators, and one who copies another."""
    rnd = random.Random(3)
    truth, rows = {}, []
    for i in range(600):
        t = truth[f"i{i}"] = rnd.randrange(5)
        noisy = lambda p: t if rnd.random() < p else rnd.choice([x for x in range(5) if x != t])  # noqa: B023, E731
        said = {"good1": noisy(0.9), "good2": noisy(0.85), "weak": noisy(0.5), "shift": (t + 1) % 5 if rnd.random() < 0.9 else t, "three": 3, "ref:a": noisy(0.6)}
        said["ref:b"] = said["ref:a"]
        for a, label in said.items():
            if rnd.random() < 0.8:
                rows.append((f"i{i}", "s", a, label, 5, rnd.choice([0.9, None, 40.0]), 1.0, a.split(":")[0]))
    labels, record, _ = annotators.consensus(frame(spark, rows))
    right = sum(truth[r.item] == r.label for r in labels.where("n > 1").collect())
    assert right / labels.where("n > 1").count() > 0.9
    acc = {r.annotator: r.accuracy for r in record.collect()}
    assert acc["good1"] > 0.8 > acc["weak"] > acc["shift"]
    last = record.first()
    assert 1 < last.rounds < 50 and last.changed <= 1e-5
    want = {(r.item, r.label, round(r.sure, 9)) for r in labels.collect()}
    # many kinds of readings are joined instead of broadcast, to the same labels
    monkeypatch.setattr(annotators, "BROADCAST", 0)
    joined, again, _ = annotators.consensus(frame(spark, rows), most_rounds=last.rounds)
    assert {(r.item, r.label, round(r.sure, 9)) for r in joined.collect()} == want
    assert {(r.annotator, round(r.accuracy, 9)) for r in again.collect()} == {(a, round(x, 9)) for a, x in acc.items()}


def test_defined_cases(spark):
    rows = [
        ("a", "s", "p", 1, 5, 0.5, 1.0, "p"), ("a", "s", "p", 2, 5, 0.5, 9.0, "p"), ("a", "s", "q", 2, 5, float("inf"), None, "q"),
        ("b", "s", "p", 0, 5, None, None, "p"), ("b", "s", "p", 0, 5, None, None, "p"),
        ("t", "s", "x", 1, 5, None, None, "x"), ("t", "s", "y", 0, 5, None, None, "y"),
        (None, "s", "p", 1, 5, 0.1, 1.0, "p"), ("c", "s", None, 1, 5, 0.1, 1.0, None), ("d", "s", "p", None, 5, 0.1, 1.0, "p"),
    ]
    labels, record, _ = annotators.consensus(frame(spark, rows))
    got = {r.item: (r.label, r.n, r.alike) for r in labels.collect()}
    assert got == {"a": (2, 2, True), "b": (0, 1, True), "t": (0, 2, False)}
    assert {r.annotator for r in record.collect()} == {"p", "q", "x", "y"}
    labels, record, _ = annotators.consensus(frame(spark, []))
    assert labels.count() == 0 and record.count() == 0


def test_agreement(spark):
    rows = [(i, "s", a, x, 5, None, None, a) for i, xs in {"a": "11", "b": "22", "c": "12", "d": "1"}.items() for a, x in zip("pq", map(int, xs))]
    got = {r.item: round(r.agreement, 6) for r in annotators.agreement(annotators.votes(frame(spark, rows))[0]).collect()}
    # 3 of 6 votes each: expected agreement (6 + 6) / 30
    assert got == {"a": 1.0, "b": 1.0, "c": round(1 - 1 / 0.6, 6)}


def test_plain_label(spark):
    cases = {("answer", '"③ "'): "3", ("answer", "3.0"): "3", ("answer", '"(2)"'): "2", ("answer", '"4번"'): "4", ("answer", "9"): None, ("answer", '"?"'): None, ("points", '"[3 points]"'): "3", ("points", '" 4"'): "4", ("points", "1"): None, ("type", '"Multiple-Choice."'): "multiple_choice", ("type", '""'): None, ("type", None): None}
    df = spark.createDataFrame([(f, v) for f, v in cases], "f string, v string")
    assert {(r.f, r.v): r.p for r in df.select("f", "v", plain_label(F.col("f"), F.col("v")).alias("p")).collect()} == cases
