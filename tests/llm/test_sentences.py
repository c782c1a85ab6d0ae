from lodestone.llm import sentences as S

CASES = [
    ["It cost approx. 3.5 cm, i.e. less.", "(See p. 690.)", 'He wrote "Check it. Then go." in the margin.', "Did Prof. X go?!", "‘Is PQ equal?’ asked she, and left."],
    ["Der Wert beträgt ca. 3,6 cm, d. h. mehr als bei JL.", "Am 3. Mai fehlten Karten usw. in der Halle.", "„Prüfe zuerst. Dann geh.“, sagte er."],
    ["«Revisa primero. Luego compara.», dijo él.", "¡Faltan 8!", "Véase la pág. 234 sobre el tema."],
    ['검토자는 "먼저 보세요. 그다음 하세요."라고 적었다.', "2026. 3. 4. 시행한 시험이다.", "page_1.png는 1,128.5점이다!", "잠깐... 값은 7이다!", "1. 삼각형을 그리시오."],
    ["क्या भुजा RT बराबर हैं?", "त्रिज्या 72.78 से.मी. है।", '"देखो। गिनो।" ऐसा बढ़ई ने कहा।'],
]


def split(t):
    return [t[a:b] for a, b in S.units(t)]


def test_languages():
    for want in CASES:
        assert split("  " + " ".join(want) + "\n") == want
    zh = ["“先检查角度。再比较箱子。”面包师这样说道。", "（概率的说明在第174页。）", "为什么是462……画家也不明白。", "相等吗？"]
    assert split("".join(zh)) == zh
    ja = ["「角を確かめて。比べて。」と農夫は言った。", "なぜ9なのか……不明だ。", "（説明。）", "旗！"]
    assert split("".join(ja)) == ja
    assert split("ดูรูปที่3.6เรื่อง  มุม123 องศา") == ["ดูรูปที่3.6เรื่อง", "มุม123", "องศา"]


def test_lines():
    assert split("Hinweis: Parabel\r\nHinweis: Umkreis\nEr geht\nheim. Gut.") == ["Hinweis: Parabel", "Hinweis: Umkreis", "Er geht\nheim.", "Gut."]
    assert split("정답 및 해설 5\n따라서 값은 3임\n[풀이] 확률\n점은\n있다.") == ["정답 및 해설 5", "따라서 값은 3임", "[풀이] 확률", "점은\n있다."]
    assert split("no end\n\nnext") == ["no end", "next"]
    assert [t for x in (None, "", " \n\t") for t in S.units(x)] == []
    assert S.units("😀 Hi. Yo.") == [(0, 5), (6, 9)]


def test_frame(spark):
    rows = [(1, "A b. C d.", "x"), (2, None, "x"), (3, "", "x"), (4, "x" * 200_000 + ". Y.", "x"), (1, "A b. C d.", "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, key string")
    got = sorted(tuple(r) for r in S.sentences(df, "id", "text").collect())
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (4, 0, 200_001), (4, 200_002, 200_004)]
    assert S.sentences(df.limit(0), "id", "text").count() == 0


def test_quotations_of_any_length():
    for n in (10, 100, 3000):
        inner = " ".join(["Check it. Then go."] * n)
        for a, b in ('""', "“”", "„“", "«»", "()"):
            text = f"She wrote {a}{inner}{b} in the margin. Done."
            assert split(text) == [text[:-6], "Done."], (n, a)
    # what is never closed is no quotation, nor is a sign of inches
    assert split('A 5" pipe broke. It was "old" pipe. (Note the bend. Yes.') == ['A 5" pipe broke.', 'It was "old" pipe.', "(Note the bend.", "Yes."]
    assert split("It isn’t ‘so. Or so’ said. Yes.") == ["It isn’t ‘so. Or so’ said.", "Yes."]


def test_abbreviations():
    for text in ("He met Gen. Smith in Jan. 2020.", "In Nov. he went to Mt. Fuji.", "John F. Kennedy met Dr. A. B. Gray.", "Er kam am 3. Mai bzw. im Dez. zurück, vgl. Abb. 3.", "Lo dijo el Sr. Gómez en la pág. 3."):
        assert split(text) == [text]
    assert split("Bring pens etc. The rest is here.") == ["Bring pens etc.", "The rest is here."]


def test_titles_on_no_list():
    cases = ["Zebra thoughts on tilings", "Grazing cows 12", "Ein Wort über Kreise", "GEOMETRY AT HOME", "Tareas del jueves", "Aviso: regla", "우리 반 이야기 7", "[둘러보기] 넓이", "三角形入門", "数学乐园"]
    after = ["The sum is even.", "The sum is even.", "Das Dreieck ist klein.", "The sum is even.", "El valor es par.", "El valor es par.", "삼각형을 그린다.", "삼각형을 그린다.", "角は等しい。", "角相等。"]
    for title, body in zip(cases, after):
        assert split(f"{title}\n{body}") == [title, body]
    for text in ("The mean of\n655 readings taken by the\nmechanic is 73.", "Der Töpfer zählt 916\nHefte in der\nBücherei.", "El alfarero cuenta\n715 tablas.", "삼각형의\n넓이는 3\n이다.", "The line through\nGL meets it."):
        assert split(text) == [text]


def test_scripts_mixed():
    text = "Hello world. 2026. 3. 4. 시행한 시험이다. 我们在这里。他不在。See p. 3 of it. यह है। वह भी। 끝이다."
    assert split(text) == ["Hello world.", "2026. 3. 4. 시행한 시험이다.", "我们在这里。", "他不在。", "See p. 3 of it.", "यह है।", "वह भी।", "끝이다."]
