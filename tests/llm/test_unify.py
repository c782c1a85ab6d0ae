import unicodedata

from lodestone.llm import unify

CASES = {
    "plain": "plain", "": "", "ＡＢ１２．": "AB12.", "x y　z": "x y z", "in​vis­ible﻿": "invisible", "é": "é", "한": "한",
    "\U0001d434\U0001d7cf": "A1", "ⅿⅼ": "ml", "ар": "ap", "Αχ": "Aχ", "ﬁne ㎏": "fine kg", "① ㄱ ∠ ⊥ ° ² θ é 한": "① ㄱ ∠ ⊥ ° ² θ é 한", "Это текст": "Это текст", "क्‍ष": "क्‍ष", "​": "",
}


def test_forms(spark):
    rows = [(i, k, "c0", "unified") for i, k in enumerate(CASES)] + [(99, None, "x", "y")]
    df = spark.createDataFrame(rows, "text int, body string, c0 string, unified string")
    got = {r["text"]: r["unified"] for r in unify.unify(df, "body", "unified").collect()}
    assert {list(CASES)[i]: v for i, v in got.items() if i != 99} == CASES and got[99] is None
    odd = {r["body"] for r in unify.changed(df.drop("unified"), "body").collect()}
    assert odd == {k for k, v in CASES.items() if k != v}


def test_long_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "ａ" * 100_000)] * 3, "id int, body string")
    assert [len(r.u) for r in unify.unify(df, "body", "u").collect()] == [100_000] * 3
    assert unify.unify(df.limit(0), "body", "u").count() == 0


def test_tables_follow_unicode():
    src, dst, longer = unify.tables()
    assert len(src) == len(dst) == len(set(src))
    assert all(unicodedata.normalize("NFKC", a) == b for a, b in zip(src, dst) if not 0xFF9F < ord(a) < 0xFFDD and ord(b) < 0x300)
    assert "①" not in src and "²" not in src and "ㄱ" not in src and "°" not in src


def test_look_alikes_word_by_word(spark):
    cases = {"раypal и мир": "paypal и мир", "ѵalue ɑbc օne": "value abc one", "Ꭺpple ꓚat": "Apple Cat", "Тор и сом, дом": "Тор и сом, дом", "점 АВ": "점 AB", "λόγος ΑΒ": "λόγος ΑΒ", "2πr θ α": "2πr θ α", "հայ օր": "հայ օր", "ᎪᏴ": "AB"}
    df = spark.createDataFrame([(i, a) for i, a in enumerate([*cases, "plain", None, ""])], "i int, t string")
    got = {r.t: r.u for r in unify.unify(df, "t", "u").collect()}
    assert got == cases | {"plain": "plain", None: None, "": ""}
