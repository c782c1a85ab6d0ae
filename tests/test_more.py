import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestone.functions import raster
from lodestone.functions import text as T
from lodestone.operators import documents as D
from lodestone.operators import spatial, versions


def test_script_and_classes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.script_surface(F.lit("rm ANGLE ABC `` {3} TIMES 4 OVER 5 # x == y"))) == "∠ABC 3 ×4/5 , x ≡ y"
    assert [one(T.pdf_class(F.lit(c), F.lit(i))) for c, i in ((0, 0.0), (5, 0.0), (500, 0.6), (500, 0.1))] == ["SCANNED", "HYBRID", "HYBRID", "DIGITAL"]


def test_references_and_partners(spark, rows):
    box = "p int, id int, x double, y double, w double, h double"
    a = spark.createDataFrame([(1, 1, 10.0, 10.0, 10.0, 10.0), (1, 2, 200.0, 10.0, 10.0, 10.0)], box)
    b = spark.createDataFrame([(1, 7, 9.0, 9.0, 50.0, 50.0), (1, 6, 10.0, 10.0, 10.0, 9.5), (2, 5, 10.0, 10.0, 10.0, 10.0)], box)
    assert rows(spatial.best_reference(a, b, ["p"], tile=16.0), "a_id", "b_id") == [(1, 6)]
    lines = spark.createDataFrame([(1, 3, 300.0, 15.0, 2), (1, 4, 100.0, 15.0, 5), (1, 5, 30.0, 39.0, 4), (1, 6, 25.0, 195.0, 1)], "p int, id int, x double, y double, pos int")
    edge = a.unionByName(spark.createDataFrame([(1, 9, 10.0, 205.0, 10.0, 10.0)], box))
    assert rows(spatial.row_partner(edge, lines, ["p"]), "id", "line_id") == [(1, 5), (9, 6)]


def test_items_verdicts_live(spark, rows):
    items = spark.createDataFrame([("d", 1, 1, "2 - 1"), ("d", 2, 2, "x")], "d string, id int, page int, label string")
    qs = spark.createDataFrame([("d", 8, 1, "2-1"), ("d", 9, 1, "2-1")], "d string, id int, page int, label string")
    assert rows(D.matched_items(items, qs, ["d"]), "item_id", "id") == [(1, 8), (2, None)]
    checks = spark.createDataFrame([("r", True, "PASSED"), ("r", False, "FAILED"), ("s", True, "PASSED"), ("t", True, "NOT_RUN")], "rev string, applicable boolean, status string")
    issues = spark.createDataFrame([("s", True, "OPEN"), ("r", True, "CLOSED")], "rev string, blocking boolean, state string")
    assert rows(D.verdict(checks, issues, "rev")) == [("r", True), ("s", False), ("t", False)]
    used = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], [])], "u array<string>, d array<string>")
    assert [r.outside for r in D.outside(used, "u", "d").collect()] == [["b"]]
    assert versions.live(spark.createDataFrame([(1.0,), (3.0,)], "e double"), "e", 2.0).count() == 1


def test_pixels():
    page = np.zeros((200, 100), bool)
    page[5:200:15, 2:98] = True
    assert not raster.ruled(page)
    page[:, [3, 50, 95]] = True
    assert raster.ruled(page)
    dot = np.zeros((5, 5), bool)
    dot[2, 2] = True
    assert raster.dilate(dot, 1).sum() == 5 and raster.layer_scores(dot, raster.dilate(dot, 1)) == (1.0, 0.2)
    out = next(raster.isolated(iter([pd.DataFrame({"k": [1, 0]})]), lambda r: 1 / r["k"], "k"))
    assert out["error"].isna().tolist() == [True, False] and out["result"][0] == 1.0
