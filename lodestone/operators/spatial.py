"""Boxes, segments and coordinate chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(a: str, b: str) -> Column:
    """Strict overlap of boxes ``x, y, w, h`` of two aliases."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x") < c(b, "x") + c(b, "w")) & (c(b, "x") < c(a, "x") + c(a, "w")) & (c(a, "y") < c(b, "y") + c(b, "h")) & (c(b, "y") < c(a, "y") + c(a, "h"))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], tile: float) -> DataFrame:
    """Pairs of boxes that overlap on the same page, each once.

    ``left`` and ``right``: ``on..., id, x, y, w, h``. Boxes meet in tiles of the page, so a
    page with very many boxes is spread over its tiles; a pair counts in the tile that holds
    the top left corner of its intersection. Share is the intersection over the smaller area (M5).
    Boxes are counted first: where tiles hold many, boxes meet in cells smaller than themselves instead.
    """
    pairs, boxes, cells = _crowding(left, right, on, tile)
    if pairs <= CROWDED * boxes:
        j = _tiled(left, "a", on, tile).join(_tiled(right, "b", on, tile), [*on, "tx", "ty"])
        meet = (F.floor(F.greatest("a_x", "b_x") / tile) == F.col("tx")) & (F.floor(F.greatest("a_y", "b_y") / tile) == F.col("ty"))
    else:
        # the number of tasks follows the pairs: rows are few beside them
        parts, keys = min(MOST_TASKS, 1 + pairs // TASK_PAIRS), [*on, "lx", "tx", "ly", "ty"]
        spread = lambda d: d.repartition(min(MOST_TASKS, 1 + boxes // TASK_BOXES), *on, "id")
        a, b = _starts_and_spans(spread(left), "a", on, cells, True), _starts_and_spans(spread(right), "b", on, cells, False)
        j = a.repartition(parts, *keys).join(b.repartition(parts, *keys).hint("merge"), keys)
        meet = ((F.col("a_x") >= F.col("b_x")) == F.col("lx")) & ((F.col("a_y") >= F.col("b_y")) == F.col("ly"))
    x0, y0 = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    x1, y1 = F.least(F.col("a_x") + F.col("a_w"), F.col("b_x") + F.col("b_w")), F.least(F.col("a_y") + F.col("a_h"), F.col("b_y") + F.col("b_h"))
    j = j.where((x0 < x1) & (y0 < y1) & meet)
    area = F.least(F.col("a_w") * F.col("a_h"), F.col("b_w") * F.col("b_h"))
    return j.select(*on, "a_id", "b_id", ((x1 - x0) * (y1 - y0) / area).alias("share"))


#: Pairs of boxes in tiles for each box from which smaller cells pay, and cells that a box of average size spans each way.
CROWDED, SPAN = 64, 4
#: Pairs and boxes that a task takes, about, and tasks at most.
TASK_PAIRS, TASK_BOXES, MOST_TASKS = 50_000_000, 100_000, 4_000


def _tiles(start: str, size: str, tile: float) -> Column:
    return F.sequence(F.floor(F.col(start) / tile), F.floor((F.col(start) + F.col(size)) / tile))


def _named(d: DataFrame, p: str, on: list[str], *more: Column) -> DataFrame:
    return d.select(*on, *[F.col(c).alias(f"{p}_{c}") for c in ("id", "x", "y", "w", "h")], *more)


def _tiled(d: DataFrame, p: str, on: list[str], tile: float) -> DataFrame:
    """A row for each tile that a box touches."""
    t = _named(d, p, on, F.explode(_tiles("x", "w", tile)).alias("tx"), "y", "h")
    return t.select(*[c for c in t.columns if c not in ("y", "h")], F.explode(_tiles("y", "h", tile)).alias("ty"))


def _crowding(left: DataFrame, right: DataFrame, on: list[str], tile: float) -> tuple[int, int, tuple[float, float]]:
    """Pairs of boxes that are in one tile, rows of boxes in tiles, and cells of a part of the boxes' average size."""

    def held(d: DataFrame, p: str) -> DataFrame:
        t = _tiled(d, p, on, tile)
        return t.groupBy(*on, "tx", "ty").agg(F.count("*").alias(p), F.sum(f"{p}_w").alias(f"{p}_w"), F.sum(f"{p}_h").alias(f"{p}_h"))

    # every tile's boxes of one side are counted once, as whole numbers in double precision
    n = [F.coalesce(F.col(p), F.lit(0)).cast("double") for p in "ab"]
    sums = [F.sum(F.coalesce(F.col(f"a_{c}"), F.lit(0.0)) + F.coalesce(F.col(f"b_{c}"), F.lit(0.0))) for c in "wh"]
    r = held(left, "a").join(held(right, "b"), [*on, "tx", "ty"], "full").agg(F.sum(n[0] * n[1]), F.sum(n[0] + n[1]), *sums).first()
    boxes = r[1] or 0
    size = lambda total: min(tile, total / boxes / SPAN) if boxes and total and 0 < total < float("inf") else tile
    return int(r[0] or 0), int(boxes), (size(r[2]), size(r[3]))


def _starts_and_spans(d: DataFrame, p: str, on: list[str], cells: tuple[float, float], first: bool) -> DataFrame:
    """A row for each cell in which a box may meet others, by who starts later: its start alone, or all that it spans.

    Each way, one of two boxes that overlap starts within the other: ``lx`` and ``ly`` say that it is the left one.
    """
    meets = lambda start, size, cell: F.array_union(F.array(F.struct(F.lit(first).alias("later"), F.floor(F.col(start) / cell).alias("at"))), F.transform(_tiles(start, size, cell), lambda i: F.struct(F.lit(not first).alias("later"), i.alias("at"))))
    t = _named(d, p, on, "y", "h", F.explode(meets("x", "w", cells[0])).alias("mx"))
    t = t.select("*", F.explode(meets("y", "h", cells[1])).alias("my"))
    return t.select(*on, *[f"{p}_{c}" for c in ("id", "x", "y", "w", "h")], F.col("mx.later").alias("lx"), F.col("mx.at").alias("tx"), F.col("my.later").alias("ly"), F.col("my.at").alias("ty"))


def box_union(df: DataFrame, by: list[str]) -> DataFrame:
    """The box around all boxes of a key."""
    g = df.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))
    return g.select(*by, "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))


def polygon_box(points: Column) -> Column:
    """The box around a polygon ``[[x, y], ...]``."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def grid_to_pixels(v: Column, size: Column, pad: float = 0.04, grid: float = 1000.0) -> tuple[Column, Column]:
    """Start and end in pixels of a span on a 0-1000 grid, padded and clamped (M8). ``v`` has ``lo`` and ``hi``."""
    lo, hi = v["lo"] / grid * size, v["hi"] / grid * size
    more = (hi - lo) * pad
    return F.greatest(F.lit(0.0), lo - more), F.least(size, hi + more)


def unmap_point(x: Column, y: Column, chain: Column) -> Column:
    """A point before a chain of steps ``kind, params`` (M6, M7): known steps undone last to first.

    ``scale`` divides, ``offset`` subtracts, ``rotate`` turns back by degrees around the origin;
    an unknown step makes the result null.
    """

    def undo(p: Column, s: Column) -> Column:
        a = F.radians(-s["params"]["deg"])
        k = s["params"]["factor"]
        return (
            F.when(s["kind"] == "scale", F.struct((p["x"] / k).alias("x"), (p["y"] / k).alias("y")))
            .when(s["kind"] == "offset", F.struct((p["x"] - s["params"]["dx"]).alias("x"), (p["y"] - s["params"]["dy"]).alias("y")))
            .when(s["kind"] == "rotate", F.struct((p["x"] * F.cos(a) - p["y"] * F.sin(a)).alias("x"), (p["x"] * F.sin(a) + p["y"] * F.cos(a)).alias("y")))
        )

    return F.aggregate(F.reverse(chain), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")), undo)


def segment_relations(segments: DataFrame, on: list[str], angle: float = 3.0, length: float = 0.04) -> DataFrame:
    """Relations of pairs of segments of a figure: ``on..., a, b, relation``.

    ``segments``: ``on..., id, p, q`` (names of end points), ``x1, y1, x2, y2``. A shared end
    point is an intersection; else directions within some degrees are parallel; right angles
    and equal lengths count for any pair. Figures have few segments; pairs stay within one.
    """
    deg = F.pmod(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))), F.lit(180.0))
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    s = segments.select(*on, "id", "p", "q", deg.alias("deg"), size.alias("size"))
    a, b = s.alias("a"), s.alias("b")
    c = F.col
    cond = c("a.id") < c("b.id")
    for k in on:
        cond = cond & (c(f"a.{k}") == c(f"b.{k}"))
    shared = (c("a.p") == c("b.p")) | (c("a.p") == c("b.q")) | (c("a.q") == c("b.p")) | (c("a.q") == c("b.q"))
    d = F.abs(c("a.deg") - c("b.deg"))
    d = F.least(d, 180 - d)
    rel = F.array(
        F.when(shared, "intersection"), F.when(~shared & (d <= angle), "parallel"), F.when(F.abs(d - 90) <= angle, "perpendicular"),
        F.when(F.abs(c("a.size") - c("b.size")) <= length * F.greatest(c("a.size"), c("b.size")), "equal_length"),
    )
    found = F.filter(rel, lambda x: x.isNotNull())
    return a.join(b, cond).select(*[c(f"a.{k}").alias(k) for k in on], c("a.id").alias("a"), c("b.id").alias("b"), F.explode(found).alias("relation"))


def best_reference(regions: DataFrame, references: DataFrame, on: list[str], least: float = 0.9, tile: float = 100.0) -> DataFrame:
    """The first reference box that covers a region well enough (J9): ``on..., a_id, b_id, share``."""
    j = overlap_join(regions, references, on, tile).where(F.col("share") >= least)
    return j.groupBy(*on, "a_id").agg(F.min_by(F.struct("b_id", "share"), "b_id").alias("b")).select(*on, "a_id", "b.b_id", "b.share")


def row_partner(boxes: DataFrame, lines: DataFrame, on: list[str], reach: float = 80.0, back: float = 15.0, dy: float = 30.0) -> DataFrame:
    """The first line to the right of an empty box in its row (J11): ``on..., id, line_id``.

    In a row: tops differ by less than the box's height (30 at least); to the right: the gap
    is at most 80, or -15 where they overlap a little. Rows are looked up in bands of the page.
    """
    band = 200.0
    b = boxes.select(*on, "id", "x", "y", "w", "h", F.explode(F.array_distinct(F.array(*[F.floor((F.col("y") + k * F.greatest(F.col("h"), F.lit(dy))) / band) for k in (-1, 0, 1)]))).alias("band"))
    t = lines.select(*on, F.col("id").alias("line_id"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("pos"), F.floor(F.col("y") / band).alias("band"))
    gap = F.col("lx") - (F.col("x") + F.col("w"))
    j = b.join(t, [*on, "band"]).where((F.abs(F.col("ly") - F.col("y")) < F.greatest(F.col("h"), F.lit(dy))) & (gap >= -back) & (gap <= reach))
    return j.groupBy(*on, "id").agg(F.min_by("line_id", F.struct("pos", "line_id")).alias("line_id"))
