"""Figures as tables of nodes and relations: validation, consistency and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks and the relations one of which they need; relations and the marks they need.
MARKS = {"right_angle_mark": ["right_angle", "perpendicular"], "parallel_mark": ["parallel"], "equal_mark": ["equal_length", "equal_angle", "congruent"]}
PRINTED = {"right_angle": ["right_angle_mark", "angle_mark"], "perpendicular": ["right_angle_mark"], "parallel": ["parallel_mark"], "equal_length": ["equal_mark"]}
#: The kinds of nodes with the least number of nodes that each refers to, and the kinds of relations.
REFS = {"point": 0, "segment": 2, "line": 2, "ray": 2, "polyline": 2, "arc": 2, "curve": 2, "circle": 1, "polygon": 3, "angle_mark": 1, "right_angle_mark": 1, "parallel_mark": 1, "equal_mark": 1, "hatch": 1, "label": 0, "axis": 1, "tick": 1}
RELATIONS = ["right_angle", "parallel", "perpendicular", "equal_length", "equal_angle", "on_line", "on_circle", "congruent", "midpoint", "intersection", "tangent"]


def validate(nodes: DataFrame, edges: DataFrame, labels: DataFrame, most_nodes: int = 200, most_edges: int = 100, longest_label: int = 200) -> DataFrame:
    """``scene_id, error, about`` of figures that break a rule.

    ``nodes``: ``scene_id, id, kind, refs, props``; ``edges``: ``scene_id, kind, refs``;
    ``labels``: ``scene_id, node_id, text``. A node of an unknown kind, null included, has that error alone besides those of its
    id; an unknown relation's references are not looked at.
    """
    known, related = F.coalesce(F.col("kind").isin(*REFS), F.lit(False)), F.coalesce(F.col("kind").isin(*RELATIONS), F.lit(False))
    row = lambda d, error, about: d.select("scene_id", F.lit(error).alias("error"), about.alias("about"))
    ids = nodes.select("scene_id", "id").distinct()
    need = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in REFS.items()], F.lit(0))
    many = lambda d, n: d.groupBy("scene_id").agg(F.count("*").alias("n")).where(F.col("n") > n)
    bad = F.exists(F.map_values("props"), lambda v: F.isnan(v) | (F.abs(v) > 1e6))
    refs = edges.where(related).select("scene_id", "kind", F.explode("refs").alias("id"))
    parts = [
        row(many(nodes, most_nodes), "too_many_nodes", F.col("n").cast("string")),
        row(many(edges, most_edges), "too_many_relations", F.col("n").cast("string")),
        row(nodes.where("id is null or id = ''"), "empty_id", F.col("kind")),
        row(nodes.where("id <> ''").groupBy("scene_id", "id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_id", F.col("id")),
        row(nodes.where(~known), "unknown_kind", F.concat_ws("|", "id", "kind")),
        row(nodes.where(known & (F.size("refs") < need)), "few_refs", F.col("id")),
        row(edges.where(~related), "unknown_relation", F.col("kind")),
        row(nodes.where(known & bad), "number_out_of_range", F.col("id")),
        row(edges.where(related & (F.size("refs") <= 0)), "relation_without_refs", F.col("kind")),
        row(refs.join(ids, ["scene_id", "id"], "left_anti"), "missing_ref", F.col("id")),
        row(labels.select("scene_id", F.col("node_id").alias("id")).join(ids, ["scene_id", "id"], "left_anti"), "label_without_node", F.col("id")),
        row(labels.where(F.length("text") > longest_label), "label_too_long", F.col("node_id")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def inconsistent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Marks without a relation and relations without a mark (J12, J13), strokes an intersection isn't on."""
    e = edges.select("scene_id", F.col("kind").alias("e_kind"), F.col("refs").alias("e_refs"))
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    wanted = reduce(lambda a, b: a | b, [(F.col("kind") == m) & F.col("e_kind").isin(rs) for m, rs in MARKS.items()])
    marks = nodes.where(F.col("kind").isin(*MARKS)).select("scene_id", "id", "kind", "refs")
    m = marks.alias("m").join(e.alias("e"), (F.col("m.scene_id") == F.col("e.scene_id")) & wanted & (inside("refs", "e_refs") | inside("e_refs", "refs")), "left_anti")
    n = nodes.select("scene_id", F.col("kind").alias("n_kind"), F.col("refs").alias("n_refs"))
    printed = reduce(lambda a, b: a | b, [(F.col("e_kind") == r) & F.col("n_kind").isin(ms) for r, ms in PRINTED.items()])
    r = e.where(F.col("e_kind").isin(*PRINTED)).alias("e").join(n.alias("n"), (F.col("e.scene_id") == F.col("n.scene_id")) & printed & F.arrays_overlap("e_refs", "n_refs"), "left_anti")
    cross = edges.where((F.col("kind") == "intersection") & (F.size("refs") >= 3)).select("scene_id", F.element_at("refs", 3).alias("pt"), F.explode(F.slice("refs", 1, 2)).alias("stroke"))
    cross = cross.withColumn("pair", F.array_sort(F.array("pt", "stroke")))
    lines = edges.where("kind = 'on_line'").select("scene_id", F.array_sort("refs").alias("pair"))
    return (
        m.select("scene_id", F.lit("mark_without_relation").alias("issue"), F.col("id").alias("about"))
        .unionByName(r.select("scene_id", F.lit("relation_without_mark").alias("issue"), F.concat_ws("|", "e_kind", F.array_join(F.array_sort("e_refs"), ",")).alias("about")))
        .unionByName(cross.join(lines, ["scene_id", "pair"], "left_anti").select("scene_id", F.lit("intersection_not_on_line").alias("issue"), F.concat_ws("|", "pt", "stroke").alias("about")))
        .distinct()
    )


def multiset_diff(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Counts of equal rows on either side where they differ: ``key..., expected, actual``."""
    count = lambda d, n: d.groupBy(*key).agg(F.count("*").alias(n))
    both = count(expected, "expected").join(count(actual, "actual"), key, "full")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("expected", "actual")}).where("expected <> actual")
