import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="needs the vocabulary")
TEXTS = [None, "", " ", "\n\n  x", "Hello world's  end", "한국어 문장 123", "図5.2によると、等差数列", "मात्रा", "👍🏽 ok", "<|endoftext|>", "a" * 3000, "가" * 200, "x\r\n\ty z w\x85v", "it's we'll I'd", "é  ​"]


def expected(text):
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=mixing.SPLIT, mergeable_ranks=bpe.ranks(), special_tokens={})
    return enc.encode_ordinary(text or "")


def test_ids_and_decoding(spark):
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice("abc de,1가é\n'") for _ in range(rnd.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "w", [0]) for i, t in enumerate(texts)], "doc int, t string, word string, ids array<int>")
    out = bpe.encode(df, "doc", "t")
    got = {r.doc: r.ids for r in out.collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}
    back = {r.doc: r.b for r in out.select("doc", bpe.decode(F.col("ids")).alias("b")).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0), "doc", "t").count() == 0


@pytest.mark.parametrize("literal", [50_000, 12, 0])
def test_dictionary_of_any_size(spark, monkeypatch, literal):
    monkeypatch.setattr(bpe, "LITERAL", literal)
    texts = [*TEXTS, "end end end"] + ['"\\ \' {}[]:,', "\u0000\u0001"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, t string")
    assert {r.doc: r.ids for r in bpe.encode(df, "doc", "t").collect()} == {i: expected(t) for i, t in enumerate(texts)}


def test_heap_equals_fold(spark):
    words = ["abcabc", "x", "한국어", "zzzzzz"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.ids for r in df.select("word", bpe.fold(F.col("word")).alias("ids")).collect()}
    assert got == {w: bpe.heap(w.encode(), bpe.ranks()) for w in words}
