"""One label per item from annotators who disagree.

Iteratively reweighted voting: the consensus of an item adds up its readings, weighted by the accuracy of their
annotators; the accuracy is then measured again on the consensus of the *other* annotators of the same items (leave
one out), smoothed, until the labels are stable. An annotator's accuracy is measured for each turn of the scale: how often
its readings, turned back by so many places, are the consensus. Turned by none it is accuracy as such; one who is
always one place off is as much worth once that is known. It is smoothed from the annotator to the annotator on one
scale to its readings of one confidence, so that a confidence counts as far as it tells of being right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import cut, store

#: Labels of the widest scale; bins of confidence, bin 0 for none or one out of range.
K, BINS = 5, 12
#: Readings that the next wider group counts for, and the accuracy before any reading.
WEIGHT, START = 4.0, 0.7
#: Kinds of readings (annotator, scale, confidence) up to which their weights are broadcast; beyond, they are joined by a shuffle.
BROADCAST = 500_000


def votes(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with their votes, and the kinds of readings; both stored.

    ``readings``: ``item, scale, annotator, label`` (from 0, null for a reading without
    a label), ``k`` (labels of the scale), ``confidence``, ``ts``, ``family``. Of an
    annotator's repeated readings of an item the latest counts, of equally late ones the
    surest, then the least label. Annotators of one family that agree on an item share one vote.
    Items: ``item, scale, k, n, alike, votes`` (``cell, label, w``), at most one vote for each annotator. Kinds: ``cell,
    annotator, scale, bin, k``.
    """
    c = F.col("confidence")
    sure = F.when(c.between(0, 1), c)
    best = F.max_by(F.struct("label", sure.alias("sure")), F.struct(F.coalesce("ts", F.lit(0.0)), F.coalesce(sure, F.lit(-1.0)), -F.col("label")))
    one = (
        readings.where("item is not null and annotator is not null and label is not null")
        .groupBy("item", "scale", "annotator", "family", "k")
        .agg(best.alias("v"))
        .select("item", "scale", "annotator", "family", "k", F.col("v.label").alias("label"), F.coalesce((F.col("v.sure") * (BINS - 2)).cast("int") + 1, F.lit(0)).alias("bin"))
    )
    same = Window.partitionBy("item", "scale", "family", "label")
    # all that follows stays within an item; a much read one has one row for each annotator by now
    shared = store(one.repartition("item").withColumn("w", 1.0 / F.count("*").over(same)).drop("family"))
    kinds = shared.groupBy("annotator", "scale", "bin").agg(F.max("k").alias("k"))
    if kinds.count() <= BROADCAST:
        rows = sorted(kinds.collect(), key=lambda r: (r.annotator, r.scale, r.bin))
        cells = readings.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "cell bigint, annotator string, scale string, bin int, k int")
        known = shared.join(F.broadcast(cells.drop("k")), ["annotator", "scale", "bin"])
    else:
        cells = store(kinds.withColumn("cell", F.monotonically_increasing_id()))
        known = shared.join(cells.drop("k"), ["annotator", "scale", "bin"])
    items = known.groupBy("item", "scale", "k").agg(F.sort_array(F.collect_list(F.struct("cell", "label", "w"))).alias("votes"), F.count("*").alias("n"), (F.min("label") == F.max("label")).alias("alike"))
    return store(items), cells


def _weights(cells: DataFrame, counts: DataFrame | None) -> DataFrame:
    """``cell, annotator, scale, readings, judged, accuracy, p``: logarithms of the accuracy at each turn, against chance."""
    turns = [f"h{c}" for c in range(K)]
    k = F.col("k")
    if counts is None:
        j = cells.select("*", F.lit(0).alias("readings"), F.lit(0).alias("judged"), *[F.lit(0).alias(h) for h in turns])
    else:
        j = cells.join(counts, "cell", "left").select(*cells.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("readings", "judged", *turns)])
    share = [F.when(F.lit(c) < k, F.lit(START) if c == 0 else (1 - START) / (k - 1)).otherwise(0.0) for c in range(K)]
    kept = {"readings": "readings", "judged": "judged"}
    for level in (["annotator"], ["annotator", "scale"], ["annotator", "scale", "bin"]):
        by = Window.partitionBy(*level)
        seen, hits = F.sum("judged").over(by), [F.sum(h).over(by) for h in turns]
        names = [f"p{c}_{len(level)}" for c in range(K)]
        j = j.withColumns({n: F.when(F.lit(c) < k, (h + WEIGHT * s) / (seen + WEIGHT)).otherwise(0.0) for c, (n, h, s) in enumerate(zip(names, hits, share))})
        if len(level) == 2:
            j = j.withColumns({"accuracy": F.col("p0_2"), **{f"all_{c}": F.sum(c).over(by) for c in kept}})
        share = [F.col(n) for n in names]
    total = sum(share[1:], share[0])
    p = F.array(*[F.ln(F.greatest(s / total * k, F.lit(1e-5))) for s in share])
    return j.select("cell", "annotator", "scale", "bin", F.col("all_readings").alias("readings"), F.col("all_judged").alias("judged"), "accuracy", p.alias("p"))


def _weights_here(cells: pd.DataFrame, counts: pd.DataFrame | None) -> pd.DataFrame:
    """As ``_weights``, for kinds of readings that the driver holds: the columns of ``cells`` with the logarithms in ``p0`` …"""
    n, k = len(cells), cells["k"].to_numpy()
    turns = [f"h{c}" for c in range(K)]
    j = cells.assign(readings=0, judged=0, **dict.fromkeys(turns, 0)) if counts is None else cells.merge(counts, on="cell", how="left").fillna(dict.fromkeys(["readings", "judged", *turns], 0))
    hits, judged, within = j[turns].to_numpy(float), j["judged"].to_numpy(float), np.arange(K)[None, :] < k[:, None]
    share = np.where(np.arange(K) == 0, START, (1 - START) / (k[:, None] - 1)) * within
    out = j[["cell", "annotator", "scale"]].copy()
    for level in (["annotator"], ["annotator", "scale"], ["annotator", "scale", "bin"]):
        at = j.groupby(level, sort=False).ngroup().to_numpy()
        add = lambda x: np.bincount(at, x, n)[at]  # noqa: B023, E731
        share = np.stack([add(hits[:, c]) + WEIGHT * share[:, c] for c in range(K)], 1) / (add(judged) + WEIGHT)[:, None] * within
        if len(level) == 2:
            out = out.assign(accuracy=share[:, 0], readings=add(j["readings"].to_numpy(float)).astype(np.int64), judged=add(judged).astype(np.int64))
    p = np.log(np.maximum(share / share.sum(1, keepdims=True) * k[:, None], 1e-5))
    return out.assign(**{f"p{c}": p[:, c] for c in range(K)})


def _scores(batch: pa.RecordBatch, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of a batch of items: each vote's item, cell and label; for each table of weights what votes say and what all say."""
    votes = batch.column("votes")
    flat = votes.flatten()
    item = np.repeat(np.arange(len(votes)), np.diff(votes.offsets.to_numpy()))
    cell, label, w = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("cell", "label", "w"))
    k = batch.column("k").to_numpy(zero_copy_only=False)
    out = []
    for table in tables:
        say = np.empty((len(cell), K))
        total = np.empty((len(k), K))
        for t in range(K):
            say[:, t] = w * table[cell, np.mod(label - t, k[item])]
            total[:, t] = np.bincount(item, say[:, t], len(k))
            total[k <= t, t] = -np.inf
        out.append((say, total))
    return item, cell, label, out


def _counter(share, both: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = share.value
        counts, changed, seen = np.zeros((len(tables[0]), K + 2), np.int64), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            item, cell, label, found = _scores(batch, tables)
            say, total = found[0]
            others = total[item] - say
            top = np.sort(others, 1)
            many = batch.column("n").to_numpy(zero_copy_only=False)[item] > 1
            judged = many & (top[:, -1] - top[:, -2] > 1e-9)
            turn = np.mod(label - others.argmax(1), batch.column("k").to_numpy(zero_copy_only=False)[item])
            counts[:, K] += np.bincount(cell, minlength=len(counts))
            counts[:, K + 1] += np.bincount(cell[judged], minlength=len(counts))
            np.add.at(counts, (cell[judged], turn[judged]), 1)
            seen += batch.num_rows
            changed += int((total.argmax(1) != found[1][1].argmax(1)).sum()) if both else batch.num_rows
        at = np.flatnonzero(counts[:, K])
        rows = np.concatenate([counts[at], [[0, changed, *[0] * (K - 2), seen, seen]]])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), *[pa.array(rows[:, c]) for c in (K, K + 1, *range(K))]], names=["cell", "readings", "judged", *[f"h{c}" for c in range(K)]])

    return run


def _labeller(share):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                total = _scores(batch, share.value)[3][0][1]
                top = total.max(1)
                sure = 1 / np.exp(np.maximum(total - top[:, None], -700)).sum(1)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("item", "scale", "n", "alike")], pa.array(total.argmax(1).astype(np.int32)), pa.array(sure)], names=["item", "scale", "n", "alike", "label", "sure"])

    return run


def _table(weights: pd.DataFrame) -> np.ndarray:
    out = np.zeros((len(weights), K))
    out[weights["cell"].to_numpy()] = weights[[f"p{c}" for c in range(K)]].to_numpy()
    return out


def _with_weights(items: DataFrame, weights: list[DataFrame]) -> DataFrame:
    """Items whose votes say (``s0``, …) something of each label, by a join on each kind of reading."""
    says = lambda p: F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda t: F.col("v.w") * F.element_at(p, F.pmod(F.col("v.label") - t, F.col("k")).cast("int") + 1))
    v = items.select("item", "scale", "k", "n", "alike", F.explode("votes").alias("v")).withColumn("cell", F.col("v.cell"))
    for i, w in enumerate(weights):
        v = v.join(w.select("cell", F.col("p").alias(f"w{i}")), "cell")
    v = v.select("item", "scale", "k", "n", "alike", F.struct("cell", F.col("v.label").alias("label"), *[says(F.col(f"w{i}")).alias(f"s{i}") for i in range(len(weights))]).alias("v"))
    return v.groupBy("item", "scale", "k", "n", "alike").agg(F.sort_array(F.collect_list("v")).alias("votes"))


def _totals(i: int) -> Column:
    """What all votes say of each label."""
    add = lambda a, v: F.zip_with(a, v[f"s{i}"], lambda x, y: x + y)
    return F.aggregate("votes", F.transform(F.sequence(F.lit(1), F.col("k")), lambda _: F.lit(0.0)), add)


def _best(scores: Column) -> Column:
    """The place of the highest score, the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _measure(scored: DataFrame, both: bool) -> DataFrame:
    """Counts of each kind of reading, and in cell -1 how many items changed their label (``h1``)."""
    t = scored.withColumn("t", _totals(0))

    def turn(v: Column) -> Column:
        others = F.zip_with("t", v["s0"], lambda x, y: x - y)
        clear = F.size(F.filter(others, lambda x: x > F.array_max(others) - 1e-9)) == 1
        return F.struct(v["cell"].alias("cell"), F.when(clear & (F.col("n") > 1), F.pmod(v["label"] - _best(others), F.col("k"))).cast("int").alias("turn"))

    changed = F.struct(F.lit(-1).cast("bigint").alias("cell"), (_best(F.col("t")) != _best(_totals(1))).cast("int").alias("turn") if both else F.lit(1).alias("turn"))
    turns = t.select(F.explode(F.concat(F.transform("votes", turn), F.array(changed))).alias("x")).select("x.*")
    return turns.groupBy("cell").agg(F.count("*").alias("readings"), F.count("turn").alias("judged"), *[F.count(F.when(F.col("turn") == c, 1)).alias(f"h{c}") for c in range(K)])


def consensus(readings: DataFrame, most_rounds: int = 50, stable: float = 1e-5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, annotators, and the items with their votes.

    Labels: ``item, scale, label, n, alike, sure`` (share of the probability that the label
    has). Annotators: ``annotator, scale, readings, judged`` (readings with another of the same item whose
    consensus is clear), ``accuracy, rounds, changed``: the number of rounds, and the share of
    items whose label changed in the last one, below ``stable`` unless ``most_rounds`` were used up.

    Null items, annotators and labels are left out; an item with one reading keeps that
    reading's best label and says nothing of its annotator. Ties go to the least label.
    Empty input gives empty tables. Other columns of the input are ignored.
    """
    items, cells = votes(readings)
    spark, small = readings.sparkSession, cells.count() <= BROADCAST
    counted = "cell bigint, readings bigint, judged bigint, " + ", ".join(f"h{c} bigint" for c in range(K))
    if small:
        # kinds of readings are few: their weights are worked out here, items stay where they are
        kinds = cells.toPandas()
        weigh = lambda counts: _weights_here(kinds, counts)

        def measure(weights: list[pd.DataFrame]) -> pd.DataFrame:
            share = spark.sparkContext.broadcast([_table(w) for w in weights])
            parts = items.select("k", "n", "votes").mapInArrow(_counter(share, len(weights) > 1), counted)
            return parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in parts.columns[1:]]).toPandas()

        moved = lambda counts: next(counts[counts["cell"] == -1].itertuples(), None)
    else:
        weigh = lambda counts: cut(_weights(cells, counts))
        measure = lambda weights: cut(_measure(_with_weights(items, weights), len(weights) > 1))
        moved = lambda counts: counts.where("cell = -1").first()
    last, now, changed, rounds = None, weigh(None), 1.0, 0
    while rounds < most_rounds and changed > stable:
        counts = measure([now] if last is None else [now, last])
        found = moved(counts)
        if found is None:
            changed = 0.0
            break
        changed, rounds = float(found.h1 / found.readings), rounds + 1
        last, now = now, weigh(counts)
    says = "annotator string, scale string, readings bigint, judged bigint, accuracy double"
    if small:
        share = spark.sparkContext.broadcast([_table(now)])
        kind = items.schema["item"].dataType.simpleString()
        labels = items.mapInArrow(_labeller(share), f"item {kind}, scale string, n bigint, alike boolean, label int, sure double")
        record = now.drop_duplicates(["annotator", "scale"])[["annotator", "scale", "readings", "judged", "accuracy"]]
        record = spark.createDataFrame([tuple(r) for r in record.astype(object).itertuples(index=False)], says)
    else:
        scored = _with_weights(items, [now]).withColumn("t", _totals(0))
        sure = 1 / F.aggregate("t", F.lit(0.0), lambda a, x: a + F.exp(F.greatest(x - F.array_max("t"), F.lit(-700.0))))
        labels = scored.select("item", "scale", "n", "alike", _best(F.col("t")).alias("label"), sure.alias("sure"))
        record = now.select("annotator", "scale", "readings", "judged", "accuracy").distinct()
    return labels, record.select("*", F.lit(rounds).alias("rounds"), F.lit(changed).alias("changed")), items


def agreement(items: DataFrame) -> DataFrame:
    """Chance-corrected agreement of items with two votes or more: ``item, scale, n, observed, agreement``.

    Items may have any number of missing ratings: observed is the share of agreeing pairs of
    an item's votes, expected the chance that two votes of the scale drawn at random agree
    (Krippendorff's nominal coefficient item by item; its mean weighted by n is the scale's).
    A scale on which all votes are alike has agreement 1.
    """
    many = items.where("n > 1")
    counts = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda t: F.size(F.filter("votes", lambda v: v["label"] == t)))
    same = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c.cast("bigint") * (c - 1))
    marginal = many.select("scale", F.explode("votes.label").alias("label")).groupBy("scale", "label").agg(F.count("*").alias("m")).groupBy("scale").agg(F.sum("m").alias("all"), F.sum(F.col("m") * (F.col("m") - 1)).alias("pairs"))
    expected = marginal.select("scale", F.try_divide("pairs", F.col("all") * (F.col("all") - 1)).alias("expected"))
    observed = same / (F.col("n") * (F.col("n") - 1))
    # a row for each scale
    return many.select("item", "scale", "n", observed.alias("observed")).join(F.broadcast(expected), "scale").select("item", "scale", "n", "observed", F.when(F.col("expected") >= 1, 1.0).otherwise(1 - (1 - F.col("observed")) / (1 - F.col("expected"))).alias("agreement"))
