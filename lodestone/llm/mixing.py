"""Mixing sources to target shares of the total size in tokens.

Temperature: weights are normalised products of powers of token shares, the sources' own to the
power 1 - e and the targets' to the power e, with one exponent e for all. It rises from 0 (each source as
large as it is) to 1 (the targets) or to where the mixture has the entropy asked for; where a
source's repetition limit stops it, the exponent that just meets the limit is bisected, the source
keeps its weight there and the exponent rises on for the others. Weights become block permutations:
a block is one pass over a source in an order of its own, and the last block ends where the source's budget
of tokens is used up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import VOCABULARY, ranks

#: Ranges of a block's order for which tokens are summed before single rows are looked at.
RANGES = 4096
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAN = "source string, weight double, exponent double, full int, rest double"


@cache
def _encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("mixing", pat_str=SPLIT, mergeable_ranks=ranks(path), special_tokens={})


def token_count(text: str | Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text by a public tokenizer; 0 for null."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(path)
        for texts in batches:
            ids = enc.encode_ordinary_batch(texts.fillna("").tolist(), num_threads=1)
            yield pd.Series([len(x) for x in ids], dtype="int64")

    return count(text)


def source_name(c: Column) -> Column:
    """A source's name without letter case, outer blanks and the choice of separator."""
    return F.regexp_replace(F.lower(F.btrim(c)), r"[\s-]+", "_")


def _power(exponent: float, natural: float, wanted: float) -> float:
    return math.exp((1 - exponent) * math.log(natural) + exponent * math.log(wanted))


def _shares(exponent: float, free: list[str], left: float, natural: dict[str, float], wanted: dict[str, float]) -> dict[str, float]:
    """``left`` divided over the free sources by natural ** (1 - exponent) * wanted ** exponent."""
    raw = {s: _power(exponent, natural[s], wanted[s]) for s in free}
    scale = left / sum(raw.values())
    return {s: x * scale for s, x in raw.items()}


def entropy(weights: Iterable[float]) -> float:
    """Entropy of weights, in nats."""
    return -sum(w * math.log(w) for w in weights if w > 0)


def _bisect(low: float, high: float, holds: Callable[[float], bool]) -> float:
    """The largest exponent from ``low`` to ``high`` at which ``holds``, which it does at ``low``."""
    if holds(high):
        return high
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def heat(end: float, natural: dict[str, float], wanted: dict[str, float], limit: dict[str, float]) -> dict[str, tuple[float, float]]:
    """``(weight, exponent)`` of each source once the common exponent has risen from 0 to ``end``.

    All sources share one exponent. Where the next of them would be used more often than it may be, the exponent is
    bisected to just meet its limit: the source keeps the weight and exponent it has there, and the exponent rises
    on for the others, over what is left, until it is a source's turn again or a kept one would ask for less than it
    has and is let go.
    """
    free, kept, at, room = sorted(natural), {}, 0.0, 1e-9

    def ask(e: float) -> dict[str, float]:
        """What each source asks for, by the scale at which the free ones use up what is left."""
        left = 1.0 - sum(w for w, _ in kept.values())
        now = _shares(e, free, left, natural, wanted)
        scale = now[free[0]] / _power(e, natural[free[0]], wanted[free[0]])
        return now | {s: scale * _power(e, natural[s], wanted[s]) for s in kept}

    def over(e: float) -> list[str]:
        now = ask(e)
        return [s for s in free if now[s] > limit[s] * (1 + room)]

    def under(e: float) -> list[str]:
        now = ask(e)
        return [s for s in kept if now[s] < limit[s] * (1 - room)]

    # each source is stopped and let go at most a few times; more turns are rounding and end it
    for _ in range(8 * len(natural) + 1):
        if not free:
            break
        if over(at):
            # what others left over lifts these above their limit at once
            for s in over(at):
                kept[s] = (limit[s], at)
                free.remove(s)
        elif under(at):
            for s in under(at):
                free.append(s)
                del kept[s]
        else:
            at = _bisect(at, end, lambda e: not over(e) and not under(e))
            if at >= end:
                break
            now, soon = ask(at), at + max(1e-9, 1e-9 * at)
            for s in over(min(soon, end)):
                kept[s] = (now[s], at)
            free = [s for s in free if s not in kept]
            if not free:
                break
            for s in under(min(soon, end)):
                free.append(s)
                del kept[s]
    left = 1.0 - sum(w for w, _ in kept.values())
    return kept | {s: (min(w, limit[s]), at) for s, w in (_shares(at, free, left, natural, wanted) if free else {}).items()}


def weights(sizes: dict[str, float], targets: dict[str, tuple[float, int]], budget: float | None = None, spread: float | None = None) -> list[tuple[str, float, float]]:
    """``(source, weight, exponent)`` with weights that sum to 1, or to less where all limits are met.

    ``sizes``: tokens of each source; ``targets``: target share and most uses of a document. The common exponent
    ends at 1, where the weights of sources within their limits are their targets, or, given ``spread``, where
    the mixture's entropy is that: between that of the token shares (exponent 0) and of the targets. A spread that no
    exponent gives takes the exponent whose entropy is nearest.
    Sources without tokens, target or uses have weight 0 and the others' targets are scaled up.
    """
    live = [s for s, (t, m) in targets.items() if t > 0 and m > 0 and sizes.get(s, 0) > 0]
    out = {s: (0.0, 0.0) for s in targets}
    total, asked = sum(sizes[s] for s in live), sum(targets[s][0] for s in live)
    natural, wanted = {s: sizes[s] / total for s in live}, {s: targets[s][0] / asked for s in live}
    limit = {s: targets[s][1] * sizes[s] / (budget or total) for s in live}
    reached = lambda e: entropy(w for w, _ in heat(e, natural, wanted, limit).values())
    end = 1.0
    if spread is not None and live:
        steps = [i / 64 for i in range(65)]
        off = [reached(e) - spread for e in steps]
        crossed = [i for i in range(64) if off[i] == 0 or off[i] * off[i + 1] < 0]
        # of several exponents with this entropy, the one nearest the targets
        i = crossed[-1] if crossed else min(range(65), key=lambda i: abs(off[i]))
        end = _bisect(steps[i], steps[i + 1], lambda e: (reached(e) - spread) * off[i] >= 0) if crossed else steps[i]
    return [(s, *w) for s, w in sorted((out | heat(end, natural, wanted, limit)).items())]


def mix(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 0, spread: float | Callable[[float, float], float] | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and its shares.

    ``docs``: ``id, source, tokens``; ``targets``: ``source, target_share, max_repeats``, one
    row a source. Mixture: ``id, source, tokens, block, place`` with a row for each use of a
    document; within a source, blocks follow each other and ``place`` orders a block. Shares:
    ``source, target_share, max_repeats, documents, available, used, most_uses, exponent,
    actual_share`` for every source that has a target or documents.

    ``budget`` is the total size in tokens, by default that of all documents whose source has
    a target. ``spread`` is the entropy to meet, or a function that gives it from the entropies of the token shares
    and of the mixture nearest the targets. Null sources and sources without a target are not used (they have no target in
    the shares). Documents without tokens are not used. A source may miss its budget by half a
    document. Empty tables give an empty mixture. Repeated ids count as documents of their own.
    """
    d = docs.select("id", source_name(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens")).where("tokens > 0")
    sizes = d.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    known = t.join(sizes, "source", "left").collect()
    have = {r["source"]: float(r["available"] or 0) for r in known}
    goal = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in known}
    total = sum(have[s] for s in have if goal[s][0] > 0 and goal[s][1] > 0)
    if callable(spread):
        nearest = entropy(w for _, w, _ in weights(have, goal, budget))
        spread = spread(entropy(have[s] / total for s in have if goal[s][0] > 0 and goal[s][1] > 0) if total else 0.0, nearest)
    plan = []
    for s, w, e in weights(have, goal, budget, spread):
        tokens = w * (budget or total)
        full = int(tokens / have[s] + 1e-9) if have[s] else 0
        plan.append((s, w, e, full, max(0.0, tokens - full * have[s]) if full < goal[s][1] else 0.0))
    p = docs.sparkSession.createDataFrame(plan, PLAN)

    # the plan has a row for each source that has a target
    mine = d.join(F.broadcast(p.where("weight > 0")), "source")
    blocks = F.when((F.col("full") > 0) | (F.col("rest") > 0), F.sequence(F.lit(0), F.col("full") - F.when(F.col("rest") > 0, 0).otherwise(1)))
    uses = mine.select("id", "source", "tokens", "full", "rest", F.explode(blocks).alias("block"))
    place = F.xxhash64(F.lit(seed), "block", "source", "id")
    uses = uses.withColumn("place", place)
    whole = uses.where("block < full").select("id", "source", "tokens", "block", "place")

    part = uses.where("block = full").withColumn("range", F.shiftrightunsigned("place", 64 - RANGES.bit_length() + 1).cast("int"))
    # signed order of places and order of ranges must agree
    part = part.withColumn("range", (F.col("range") + RANGES // 2) % RANGES)
    sums = part.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    upto = sums.withColumn("before", F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range"))
    part = part.join(upto, ["source", "range"]).where("before < rest")
    inner = part.where("before + in_range <= rest").select("id", "source", "tokens", "block", "place")
    edge = part.where("before + in_range > rest").withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("place", "id")))
    edge = edge.where("upto - tokens / 2 <= rest").select("id", "source", "tokens", "block", "place")
    mixture = whole.unionByName(inner).unionByName(edge)

    uses_of = mixture.groupBy("source", "id").agg(F.sum("tokens").alias("used"), F.count("*").alias("uses"))
    used = uses_of.groupBy("source").agg(F.sum("used").alias("used"), F.max("uses").alias("most_uses"))
    every = sizes.join(t, "source", "full").join(used, "source", "left").join(F.broadcast(p.select("source", "exponent")), "source", "left")
    used0 = F.coalesce("used", F.lit(0))
    # sources without a target are not used, however many there are; the others are as many as the targets
    part = lambda df, share: df.select(
        "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("available", F.lit(0)).alias("available"), used0.alias("used"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "exponent", F.coalesce(share, F.lit(0.0)).alias("actual_share"),
    )
    named = F.col("max_repeats").isNotNull() | F.col("target_share").isNotNull()
    shares = part(every.where(named), used0 / F.nullif(F.sum(used0).over(Window.partitionBy()), F.lit(0))).unionByName(part(every.where(~named), F.lit(0.0)))
    return mixture, shares
