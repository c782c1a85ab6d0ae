"""Queries of the general data problems: orphan references and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import integrity, nested
from lodestone.sources.tables import store, table


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rev, pages, reg, assets = (table(spark, d, t) for t in ("revisions", "source_pages", "doc_registry", "source_assets"))
    none = F.lit(None).cast("double")

    def ref(df: DataFrame, tbl: str, field: str, space: str, made=none, late: bool = True) -> DataFrame:
        return df.select(F.lit(tbl).alias("tbl"), F.lit(field).alias("ref_field"), F.col("id").alias("row_id"), F.lit(space).alias("space"), F.col(field).alias("key"), F.col("ingested_at").alias("ref_at"), made.alias("made_at"), F.lit(late).alias("late_counts"))

    refs = (
        ref(rev, "revisions", "document_id", "doc_registry", F.col("created_at"))
        .unionByName(ref(rev, "revisions", "parent_revision_id", "revisions"))
        .unionByName(ref(pages, "source_pages", "asset_id", "source_assets"))
        .unionByName(ref(reg, "doc_registry", "head_revision_id", "revisions", late=False))
    )
    parent = lambda df, space, gone=none: df.select(F.lit(space).alias("space"), F.col("id").alias("key"), F.col("ingested_at").alias("arrived_at"), gone.alias("deleted_at"))
    parents = parent(reg, "doc_registry", F.col("deleted_at")).unionByName(parent(rev, "revisions")).unionByName(parent(assets, "source_assets"))
    return refs, parents


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return integrity.orphan_references(*_references(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return integrity.orphan_report(p5_found(spark, d))


_P5 = """
with refs as (
  select distinct 'revisions' tbl, 'document_id' ref_field, id row_id, 'd' space, document_id k, ingested_at seen, created_at made from revisions
  union all select distinct 'revisions', 'parent_revision_id', id, 'r', parent_revision_id, ingested_at, null from revisions
  union all select distinct 'source_pages', 'asset_id', id, 'a', asset_id, ingested_at, null from source_pages
  union all select distinct 'doc_registry', 'head_revision_id', id, 'r', head_revision_id, null, null from doc_registry),
heads as (select distinct id, ingested_at from doc_registry),
parents as (
  select 'd' space, id k, min(ingested_at) seen, max(deleted_at) gone from doc_registry group by id
  union all select 'r', id, min(ingested_at), null from revisions group by id
  union all select 'a', id, min(ingested_at), null from source_assets group by id),
loose as (select distinct space, lower(trim(k)) lk from parents),
judged as (
  select r.tbl, r.ref_field, r.row_id,
    case when p.k is null and l.lk is null then 'missing'
         when p.gone <= r.made then 'deleted'
         when p.seen > r.seen then 'late' end orphan_kind,
    strftime(coalesce(r.seen, h.ingested_at), '%Y-%m') period
  from refs r left join parents p on p.space = r.space and p.k = r.k
  left join loose l on l.space = r.space and l.lk = lower(trim(r.k))
  left join heads h on r.tbl = 'doc_registry' and h.id = r.row_id
  where trim(r.k) <> '')
"""
P5_FOUND_SQL = _P5 + "select distinct tbl, ref_field, row_id, orphan_kind, period from judged where orphan_kind is not null"
P5_REPORT_SQL = _P5 + "select tbl, ref_field, orphan_kind, period, count(distinct row_id) orphans from judged where orphan_kind is not null group by all"


def variants(spark: SparkSession, d: str, name: str, key: str, col: str) -> DataFrame:
    """The distinct contents as VARIANT, parsed once and stored."""
    rows = table(spark, d, name).select(key, col).where(F.length(col) > 2)
    return store(rows.dropDuplicates([key, col]).select(key, nested.parse(F.col(col)).alias("v")).where("v is not null"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, key, col in (("revisions", "id", "content_json"), ("overrides", "override_id", "raw_json")):
        nodes = nested.flatten(variants(spark, d, name, key, col), key, "v", keep=False).where("is_object")
        parts.append(nodes.select(F.lit(name).alias("src"), "root_id", "node", "parent"))
    choices = nested.flatten_map(table(spark, d, "expected").select("expected_id", "choices"), "expected_id", "choices")
    parts.append(choices.select(F.lit("expected").alias("src"), "root_id", "node", "parent").distinct())
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p6_schema(spark: SparkSession, d: str) -> DataFrame:
    """The merged schema of the revisions' content."""
    return nested.merged_schema(variants(spark, d, "revisions", "id", "content_json"), "v")


def p6_questions(spark: SparkSession, d: str) -> DataFrame:
    """The child table of questions, each with its parent revision and position."""
    nodes = nested.flatten(variants(spark, d, "revisions", "id", "content_json"), "id", "v")
    return nested.child_table(nodes, "questions[]", {"id": "string", "number": "bigint", "label": "string", "type": "string", "points": "bigint"})


P6_FOUND_SQL = r"""
with raw as (select distinct 'revisions' src, id root_id, content_json j from revisions union all select distinct 'overrides', override_id::varchar, raw_json from overrides),
valid as (select * from raw where json_valid(j)),
decoded as (select src, root_id, case when json_type(j) = 'VARCHAR' then json_extract_string(j, '$') else j end j from valid),
roots as (select * from decoded where json_valid(j) and json_type(j) = 'OBJECT'),
nodes as (select src, root_id, replace(regexp_replace(fullkey, '^\$\.?', ''), '"', '') node from roots, json_tree(j) where type = 'OBJECT')
select src, root_id, node, regexp_replace(regexp_replace(node, '(\[\d+\])+$', ''), '\.?[^.]*$', '') parent from nodes where node <> ''
union all
select distinct 'expected', expected_id::varchar, 'choices.' || k, '' from (select expected_id, unnest(map_keys(choices)) k, unnest(map_values(choices)) v from expected) where v is not null"""

P6_QUESTIONS_SQL = r"""
with raw as (select distinct id root_id, content_json j from revisions), valid as (select * from raw where json_valid(j)),
roots as (select root_id, case when json_type(j) = 'VARCHAR' then json_extract_string(j, '$') else j end j from valid),
q as (select root_id, json_extract(j, '$.questions[*]') l from roots where json_valid(j) and json_type(j) = 'OBJECT' and json_type(j, '$.questions') = 'ARRAY'),
e as (select root_id, unnest(l) v, generate_subscripts(l, 1) - 1 ordinal from q)
select root_id, root_id || '#questions[' || ordinal || ']' row_key, root_id || '#' parent_key, ordinal::int ordinal, json_extract_string(v, '$.id') id,
  try_cast(json_extract_string(v, '$.number') as bigint) number, json_extract_string(v, '$.label') as label, json_extract_string(v, '$.type') as type, try_cast(json_extract_string(v, '$.points') as bigint) points from e"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_schema": p6_schema, "p6_questions": p6_questions}
ORACLE = {"p5_found": P5_FOUND_SQL, "p5_report": P5_REPORT_SQL, "p6_found": P6_FOUND_SQL, "p6_questions": P6_QUESTIONS_SQL}
