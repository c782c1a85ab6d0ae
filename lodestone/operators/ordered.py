"""Operators on ordered rows, as windows over an explicit position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts of a band that are ranked by themselves first; numbers of a hole that one row lists.
PARTS, BLOCK = 64, 10_000


def reading_order(df: DataFrame, by: list[str]) -> DataFrame:
    """``place`` from 1 by page, column (centre right of the middle), top, left, old position.

    ``df``: ``page, x, y, w, page_width, pos``.
    """
    col = F.when(F.col("x") + F.col("w") / 2 > F.col("page_width") / 2, 1).otherwise(0)
    return df.withColumn("column_no", col).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("page", "column_no", "y", "x", "pos")))


def extend_regions(df: DataFrame, by: list[str], gap: float = 6.0, last: float = 3.0) -> DataFrame:
    """Height grown to the next region of the column; the last to the page's end or so many heights."""
    nxt = F.lead("y").over(Window.partitionBy(*by, "column_no").orderBy("y", "pos"))
    floor = F.when(nxt.isNotNull(), nxt - gap).otherwise(F.least(F.col("page_height") - gap, F.col("y") + last * F.col("h")))
    return df.withColumn("h", F.greatest(F.col("h"), floor - F.col("y")))


def widest_gap(df: DataFrame, by: list[str], value: str, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """The widest gap between neighbours inside the middle band: ``by..., gap, middle`` (W3); no row without neighbours there."""
    w = Window.partitionBy(*by)
    nxt = F.lead(value).over(w.orderBy(value))
    d = df.select(*by, F.col(value).alias("v"), nxt.alias("next"), F.min(value).over(w).alias("lo"), F.max(value).over(w).alias("hi"))
    mid = (F.col("v") + F.col("next")) / 2
    d = d.withColumn("mid", mid).where((F.col("mid") >= F.col("lo") + low * (F.col("hi") - F.col("lo"))) & (F.col("mid") <= F.col("lo") + high * (F.col("hi") - F.col("lo"))))
    gap = F.col("next") - F.col("v")
    return d.groupBy(*by).agg(F.max(F.struct(gap.alias("gap"), (-F.col("mid")).alias("m"))).alias("b")).select(*by, F.col("b.gap").alias("gap"), (-F.col("b.m")).alias("middle"))


def blocks(df: DataFrame, by: list[str], order: str, number: Column, most: int = 99) -> DataFrame:
    """``opens`` and ``block``: a row opens a block when its number is in range and above every earlier one.

    The running maximum over candidates in range is the one over accepted rows, so no state
    is carried from row to row. Rows before the first block have block 0.
    """
    w = Window.partitionBy(*by).orderBy(order)
    valid = F.when(number.between(1, most), number)
    before = F.coalesce(F.max(valid).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("opens", F.coalesce(valid > before, F.lit(False)))
    return out.withColumn("block", F.sum(F.col("opens").cast("int")).over(w))


def unique_labels(df: DataFrame, by: list[str], label: str, order: str, sign: str = "·") -> DataFrame:
    """``unique_label``: the label, with a counter from its second use on."""
    k = F.row_number().over(Window.partitionBy(*by, label).orderBy(order))
    return df.withColumn("unique_label", F.when(k == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(sign), k.cast("string"))))


def renumber_subs(df: DataFrame, by: list[str], label: str, order: str) -> DataFrame:
    """``N-M`` labels counted anew by position where a number has a repeated one."""
    parent = F.regexp_extract(label, r"^(\d+)-\d+$", 1)
    w = Window.partitionBy(*by, "parent")
    d = df.withColumn("parent", F.nullif(parent, F.lit("")))
    # whether a number has a repeated label is found once, with a partial step before its shuffle
    twice = d.where("parent is not null").groupBy(*by, "parent", label).agg(F.count("*").alias("_n")).groupBy(*by, "parent").agg((F.max("_n") > 1).alias("_several"))
    new = F.concat("parent", F.lit("-"), F.row_number().over(w.orderBy(order)).cast("string"))
    j = d.join(twice, [*by, "parent"], "left").withColumn("new_label", F.when(F.col("_several"), new).otherwise(F.col(label)))
    return j.select(*df.columns, "new_label")


def joined_lines(df: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Lines merged that were broken inside a sentence: ``by..., line_group, text``.

    A line goes on when the one before has no end mark and it begins with a small letter, a
    digit or an operator; only the end of what went before matters, so the line before is enough.
    """
    w = Window.partitionBy(*by).orderBy(order)
    before = F.rtrim(F.lag(text).over(w))
    goes_on = (before != "") & ~before.rlike(r"[.?!:。]$") & F.ltrim(F.col(text)).rlike(r"^[a-z0-9+\-×÷=≤≥<>()]")
    d = df.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("line_group", F.sum("_new").over(w))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.btrim(F.col(text)).alias("t")))), lambda x: x["t"])
    return d.groupBy(*by, "line_group").agg(F.array_join(lines, " ").alias("text"))


def longest_run(df: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """Length of the longest stretch of rows for which a flag holds."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("_on", F.coalesce(flag, F.lit(False))).withColumn("_island", F.row_number().over(w) - F.sum(F.col("_on").cast("int")).over(w))
    runs = d.groupBy(*by, "_island").agg(F.count_if("_on").alias("n"))
    return runs.groupBy(*by).agg(F.max("n").alias("longest"))


def quota(df: DataFrame, band: str, order: str, quotas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first rows of each band up to its quota, and what bands fall short."""
    # the first of each part of a band are found before they are brought together: a huge band is never sorted by one task
    parts = df.join(quotas, band).withColumn("_part", F.pmod(F.xxhash64(order), F.lit(PARTS)))
    near = parts.withColumn("_k", F.row_number().over(Window.partitionBy(band, "_part").orderBy(order))).where("_k <= quota")
    picked = near.withColumn("_k", F.row_number().over(Window.partitionBy(band).orderBy(order))).where("_k <= quota").drop("_k", "_part", "quota")
    short = quotas.join(picked.groupBy(band).agg(F.count("*").alias("got")), band, "left").select(band, "quota", F.coalesce("got", F.lit(0)).alias("got"), (F.col("quota") - F.coalesce("got", F.lit(0))).alias("short"))
    return picked, short


def within_budget(df: DataFrame, by: list[str], cost: str, order: str, budget: float) -> DataFrame:
    """Cheapest first while the sum stays in the budget (W11); costs are not negative."""
    total = F.sum(cost).over(Window.partitionBy(*by).orderBy(cost, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("spent", total).where(F.col("spent") <= budget)


def rate_window(df: DataFrame, by: list[str], seconds: Column, span: int = 60) -> DataFrame:
    """``in_window``: rows of the last ``span`` seconds, this one included."""
    w = Window.partitionBy(*by).orderBy("_s").rangeBetween(-span, 0)
    return df.withColumn("_s", seconds).withColumn("in_window", F.count("*").over(w)).drop("_s")


def chunks(df: DataFrame, by: list[str], order: list[str], size: int = 10) -> DataFrame:
    """``chunk`` from 0, so many rows each."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))


def illegal_steps(df: DataFrame, by: list[str], order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Rows whose state doesn't follow the one before."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(*order))
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    d = df.withColumn("before", before)
    return d.where(F.col("before").isNotNull() & ~F.array_contains(pairs, F.concat_ws(">", "before", state)))


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    last = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(*by).agg(last).select("r.*")


def last_known(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last value of each column that isn't null."""
    return df.groupBy(*by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def gaps(df: DataFrame, by: list[str], number: str, from_one: bool = False) -> DataFrame:
    """Numbers that are missing between the least (or 1) and the greatest."""
    kind = df.schema[number].dataType.simpleString()
    d = df.where(F.col(number).isNotNull()).select(*by, F.col(number).cast("bigint").alias("_n")).distinct()
    if from_one:
        d = d.where("_n >= 0").unionByName(d.select(*by).distinct().withColumn("_n", F.lit(0).cast("bigint"))).distinct()
    hole = d.withColumn("_to", F.lead("_n").over(Window.partitionBy(*by).orderBy("_n")) - 1).where("_to > _n")
    # a wide hole is listed in blocks, so that no row holds all its numbers
    block = hole.select(*by, "_n", "_to", F.explode(F.sequence(F.col("_n") + 1, F.col("_to"), F.lit(BLOCK).cast("bigint"))).alias("_from"))
    return block.select(*by, F.explode(F.sequence("_from", F.least("_to", F.col("_from") + BLOCK - 1))).alias("missing")).withColumn("missing", F.col("missing").cast(kind))


def moved(df: DataFrame, by: list[str], pos: str, key: str, target: str) -> DataFrame:
    """Positions from 0 after moving the row with ``target`` set to that place, clamped to the list (T5).

    ``target`` is null for rows that stay. One move a list.
    """
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    goal = F.least(F.greatest(F.max(target).over(w), F.lit(0)), n - 1)
    rest = F.row_number().over(w.orderBy(F.col(target).isNotNull(), pos)) - 1
    new = F.when(F.col(target).isNotNull(), goal).when(goal.isNull() | (rest < goal), rest).otherwise(rest + 1)
    return df.select(*by, key, new.cast("int").alias("place"))


def shuffled(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """``place`` in a permutation that only seed and keys decide (T7); ties of hashes go by key.

    Ranks within hash ranges are added to the sizes of the ranges before, so no task holds all rows.
    """
    h = F.xxhash64(F.lit(seed), *key)
    d = df.withColumn("_h", h).withColumn("_r", F.shiftrightunsigned("_h", 54).cast("int"))
    sizes = d.groupBy("_r").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).select("_r", "_b")
    w = Window.partitionBy("_r").orderBy(F.shiftrightunsigned("_h", 1), "_h", *key)
    # a row for each of 1024 ranges
    return d.join(F.broadcast(before), "_r").withColumn("place", F.col("_b") + F.row_number().over(w)).drop("_h", "_r", "_b")


def grid(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Row and column of a two-column layout, filled left to right."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return df.withColumns({"grid_column": k % 2, "grid_row": F.floor(k / 2)})


def consecutive(df: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """Groups of neighbours with one label: ``by..., label, first groups' number, n``."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
    d = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("run", F.sum("_new").over(w))
    return d.groupBy(*by, "run", label).agg(F.count("*").alias("n"))
