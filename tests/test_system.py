import io
import zipfile
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions import mathexpr, raster
from lodestone.sources import files
from lodestone.streaming import jobs


def test_formulas():
    same = [("2x+4=0", "x=-2"), (r"\frac{x^{2}-1}{2}", "(x-1)(x+1)/2"), ("3(a+b)", "3a+3b"), ("0.5x", r"\frac{1}{2} x")]
    assert all(mathexpr.compare(a, b) == "MATCH" for a, b in same)
    assert mathexpr.compare("x+1", "x+2") == "MISMATCH" and mathexpr.compare("hello", "h") == "UNKNOWN" and mathexpr.compare(None, "1") == "UNKNOWN" and mathexpr.compare(r"\sqrt{2}", "1") == "UNKNOWN"
    assert mathexpr.solve("756 q + 733 = 977") == [Fraction(61, 189)] and mathexpr.solve("x^{2} = 4") == [-2, 2] and mathexpr.solve("x+y=1") is None and mathexpr.solve("x^{2}+1=0") == []
    assert mathexpr.linear(r"\frac{1}{2} x \leq 3") == "{1} over {2} x ≤ 3" and mathexpr.linear(r"\begin{a}") is None and mathexpr.linear("") is None


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.randoms(use_true_random=False))
def test_components_equal_flood_fill(h, w, rnd):
    mask = np.array([[rnd.random() < 0.5 for _ in range(w)] for _ in range(h)])
    left, want = {(y, x) for y in range(h) for x in range(w) if mask[y, x]}, []
    while left:
        stack, seen = [left.pop()], 1
        while stack:
            y, x = stack.pop()
            for n in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    stack.append(n)
                    seen += 1
        want.append(seen)
    assert sorted(raster.boxes(mask)["pixels"]) == sorted(want)


def test_files(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    for name, data in (("b10.pdf", b"%PDF-1"), ("b9.pdf", b"%PDF-1"), ("x.bin", b"??")):
        (tmp_path / "in" / name).write_bytes(data)
    got = {r.name: (r.kind, r.accepted) for r in files.ingest(spark, str(tmp_path / "in")).collect()}
    assert got == {"b9.pdf": ("pdf", True), "x.bin": (None, False)}
    tsv = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t2\t30\t0\t20\t10\t50\tworld\n5\t1\t1\t1\t1\t1\t5\t2\t20\t10\t90\thello\n5\t1\t1\t1\t1\t3\t60\t2\t9\t10\t10\t \n"
    (tmp_path / "w.tsv").write_text(tsv)
    line = files.word_lines(files.read_words(spark, str(tmp_path / "w.tsv"))).first()
    assert (line.text, round(line.conf, 3), line.x, line.w) == ("hello world", 0.7, 5, 64)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.xml", "<r><c>t</c></r>")
    z = files.package_census(spark.createDataFrame([(1, bytearray(buf.getvalue())), (2, bytearray(b"no"))], "id int, data binary"), "id", "data")
    assert rows(z, "id", "path", "tag", "text", "error") == [(1, "0", "r", "", None), (1, "0/0", "c", "t", None), (2, None, None, None, "BadZipFile")]
    reply = '[{"label":"1","body":"b","points":"120","choices":{"①":"① x"},"bbox":[0,0,5,5]},{"label":"","body":"b"}]'
    items = files.normal_items(spark.createDataFrame([("k", reply)], "k string, r string"), "k", "r")
    r = items.first()
    assert items.count() == 1 and r.points is None and r.choices == {"①": "x"}
    assert abs(files.extraction_confidence(items, "k").first().confidence - 0.9) < 1e-9
    flat = spark.createDataFrame([("k", ["a"], [0.5], [[[1.0, 2.0], [4.0, 9.0]]])], "k string, t array<string>, s array<double>, p array<array<array<double>>>")
    assert tuple(files.flatten_results(flat, "k", "t", "s", "p").first().box) == (1.0, 2.0, 3.0, 7.0)


def test_streams(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    data = [(i, "u" if i % 3 else "v", t0 + timedelta(seconds=20 * i)) for i in range(12)]
    spark.createDataFrame(data, "id int, k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "e"))
    s = jobs.event_stream(spark, str(tmp_path / "e"))
    got = {r.id: r.seq for r in jobs.drain(spark, jobs.numbered(s, "k", ["ts"], "id int, k string, ts timestamp")).collect()}
    assert got == {0: 1, 3: 2, 6: 3, 9: 4, 1: 1, 2: 2, 4: 3, 5: 4, 7: 5, 8: 6, 10: 7, 11: 8}
    ok, kept = {}, {}
    for i, k, t in data:
        kept[k] = [x for x in kept.get(k, []) if x > t - timedelta(seconds=100)]
        ok[i] = len(kept[k]) < 2
        kept[k] += [t] if ok[i] else []
    r = jobs.drain(spark, jobs.rate_limited(s, "k", "ts", ["ts"], "id int, k string, ts timestamp", 100.0, 2))
    assert {x.id: x.accepted for x in r.collect()} == ok
