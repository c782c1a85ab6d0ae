"""Byte-pair encoding of a corpus with a public vocabulary, by ranked merges in Spark.

Texts are cut into words by the vocabulary's pattern; the distinct words are encoded once.
A word is an array of pieces, at first its bytes; a fold merges the adjacent pair of lowest
rank, again and again, looking ranks up in a literal map. Pieces are written in hexadecimal.
Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern of words, with white space as Unicode has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
#: Places of the literal map's first level; a map is searched from its start, so each holds a few pieces.
PLACES = 1 << 13
NONE = 2**31 - 1
#: Most frequent words of the dictionary, and bytes of the longest of them, that are a literal which texts are
#: looked up in where they are; occurrences of other words are shuffled to the dictionary.
LITERAL, LONGEST = 50_000, 1_000
#: Bytes of a word up to which it is folded; longer ones take a heap, in Python, to the same ids.
FOLDED = 96


@cache
def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _places(entries: Iterable[tuple[str, object]]) -> str:
    places: list[dict[str, object]] = [{} for _ in range(PLACES)]
    for name, value in entries:
        places[zlib.crc32(name.encode()) & (PLACES - 1)][name] = value
    return json.dumps(places, separators=(",", ":"))


@cache
def _rank_json(path: str) -> str:
    return _places((piece.hex().upper(), rank) for piece, rank in ranks(path).items())


def rank_map(path: str = VOCABULARY) -> Column:
    """The ranks as a literal: an array of maps from piece to rank, by checksum of the piece."""
    return F.from_json(F.lit(_rank_json(path)), "array<map<string,int>>")


def _look_up(table: Column, name: Column) -> Column:
    place = F.crc32(name.cast("binary")).bitwiseAND(F.lit(PLACES - 1)).cast("int") + 1
    return F.element_at(F.element_at(table, place), name)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def fold(word: Column, path: str = VOCABULARY) -> Column:
    """The ids of a word: merges by rank until no adjacent pair is in the vocabulary."""
    table = rank_map(path)

    def rank(piece: Column) -> Column:
        return F.coalesce(_look_up(table, piece), F.lit(NONE))

    start = F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit(".."), F.lit(0))

    def ranked(parts: Column) -> Column:
        pairs = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))))).otherwise(F.array().cast("array<int>"))
        return F.struct(parts.alias("p"), pairs.alias("r"))

    def merge(acc: Column, low: Column) -> Column:
        p, r = acc["p"], acc["r"]

        def at(i: Column) -> Column:
            new = F.concat(F.element_at(p, i), F.element_at(p, i + 1))

            def put(m: Column) -> Column:
                before = F.when(i > 1, F.array(rank(F.concat(F.element_at(p, i - 1), m)))).otherwise(F.array().cast("array<int>"))
                after = F.when(i < F.size(p) - 1, F.array(rank(F.concat(m, F.element_at(p, i + 2))))).otherwise(F.array().cast("array<int>"))
                parts = F.concat(F.slice(p, F.lit(1), i - 1), F.array(m), F.slice(p, i + 2, F.size(p)))
                pairs = F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), before, after, F.slice(r, i + 2, F.size(p)))
                return F.struct(parts.alias("p"), pairs.alias("r"))

            return _let(new, put)

        return _let(F.array_position(r, low).cast("int"), at)

    def step(acc: Column, _: Column) -> Column:
        return _let(F.coalesce(F.array_min(acc["r"]), F.lit(NONE)), lambda low: F.when(low == NONE, acc).otherwise(merge(acc, low)))

    turns = F.when(F.octet_length(word) > 1, F.sequence(F.lit(2), F.octet_length(word))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, _let(start, ranked), step, lambda acc: F.transform(acc["p"], rank))


def heap(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one long word, with a heap of pairs over a linked list."""
    import heapq

    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    pairs = [(rank[piece[i] + piece[i + 1]], i, piece[i], piece[i + 1]) for i in range(n - 1) if piece[i] + piece[i + 1] in rank]
    heapq.heapify(pairs)
    while pairs:
        _, i, a, b = heapq.heappop(pairs)
        j = after[i] if alive[i] else n
        if j >= n or piece[i] != a or piece[j] != b:
            continue
        piece[i], alive[j], after[i] = a + b, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x in (before[i], i):
            y = after[x] if x >= 0 else n
            if x >= 0 and y < n and piece[x] + piece[y] in rank:
                heapq.heappush(pairs, (rank[piece[x] + piece[y]], x, piece[x], piece[y]))
    return [rank[piece[i]] for i in range(n) if alive[i]]


def dictionary(distinct: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``word, ids`` of distinct words."""

    @F.pandas_udf("array<int>")
    def long(ws: pd.Series) -> pd.Series:
        rank = ranks(path)
        return ws.map(lambda w: heap(w.encode(), rank))

    short = distinct.where(F.octet_length("word") <= FOLDED)
    rest = distinct.where(F.octet_length("word") > FOLDED)
    return short.select("word", fold(F.col("word"), path).alias("ids")).unionByName(rest.select("word", long("word").alias("ids")))


def encode(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """``key, ids`` of every row; keys are unique.

    Null and empty texts have no ids (an empty array). White space and strings that look
    like control tokens are ordinary text. Other columns are ignored. The dictionary of
    distinct words is encoded once. Its most frequent words become a literal map, so that
    texts are encoded where they are; only occurrences of other words are brought to the
    dictionary, and their ids to the texts that hold them.
    """
    rows = df.select(F.col(key).alias("key"), words(F.col(text)).alias("words"))
    counted = cut(rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    known = cut(dictionary(counted.select("word"), path))
    usual = known.join(counted, "word").where(F.octet_length("word") <= LONGEST)
    # a literal of a bounded number of words, none of them long; the others have their own way below
    often = usual.orderBy(F.desc("n"), "word").limit(LITERAL).select("word", "ids").collect()
    every = len(often) == known.count()
    table = F.from_json(F.lit(_places((r.word, r.ids) for r in often)), "array<map<string,array<int>>>")
    done = rows.select("key", "words", F.transform("words", lambda w: _look_up(table, w)).alias("ids"))
    if every:
        return done.select(F.col("key").alias(key), F.coalesce(F.flatten("ids"), F.array().cast("array<int>")).alias("ids"))
    seldom = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), F.when(F.get("ids", i).isNull(), w).alias("word"))), lambda x: x["word"].isNotNull())
    asked = done.select("key", F.inline(seldom))
    # words that are not frequent: no word among them is in a large share of the texts, unless it is a very long one
    found = asked.join(known, "word").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("pos", "ids"))).alias("more"))
    whole = F.transform("ids", lambda x, i: F.coalesce(x, F.element_at("more", i)))
    return done.select("key", "ids").join(found, "key", "left").select(F.col("key").alias(key), F.coalesce(F.flatten(whole), F.array().cast("array<int>")).alias("ids"))


@cache
def _pieces(path: str) -> str:
    return json.dumps([p.hex() for p, _ in sorted(ranks(path).items(), key=lambda x: x[1])], separators=(",", ":"))


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of ids: their binary pieces one after another."""
    pieces = F.from_json(F.lit(_pieces(path)), "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), "")), "UTF-8")
