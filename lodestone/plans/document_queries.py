"""Queries of questions and documents, lookups and pipelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import compare, documents, evidence, nested, versions
from lodestone.plans.evidence_queries import SETTLED, WHOLE, readings, truth_units
from lodestone.plans.stages import Pipeline, Stage
from lodestone.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def questions(s, d):
    return table(s, d, "expected").select("expected_id", "exam_id", "number", "label", "parent_label", "type", "points", "body", "choices", "answer").dropDuplicates(["expected_id"])


_Q = "q as (select distinct on (expected_id) * from expected)"


@query("s5_point_lookup", "select distinct id, tenant_id, lifecycle_state from doc_registry where id=(select min(id) from doc_registry)")
def s5_point_lookup(s, d):
    r = table(s, d, "doc_registry")
    return r.join(r.agg(F.min("id").alias("id")), "id", "left_semi").select("id", "tenant_id", "lifecycle_state").distinct()


@query("s6_scan_by_state", "select distinct id, head_revision_id from doc_registry where lifecycle_state='ARCHIVED'")
def s6_scan_by_state(s, d):
    return table(s, d, "doc_registry").where("lifecycle_state = 'ARCHIVED'").select("id", "head_revision_id").distinct()


@query("s7_composite_key", "select tenant_id, sha256, count(distinct id) assets, min(id) kept from source_assets group by all")
def s7_composite_key(s, d):
    """Equal bytes of one tenant are one asset."""
    return table(s, d, "source_assets").groupBy("tenant_id", "sha256").agg(F.count_distinct("id").alias("assets"), F.min("id").alias("kept"))


@query("proj1_decomposed")
def proj1_decomposed(s, d):
    raw = table(s, d, "overrides").select("override_id", nested.parse(F.col("raw_json")).alias("v"))
    items = raw.select("override_id", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("question", "q"))
    items = items.select("override_id", "question", F.try_variant_get("q", "$.extraction", "variant").alias("item")).where("item is not null")
    return documents.decompose(items, ["override_id", "question"], "item")


@query("proj13_review_package", f"with {SETTLED}, u as (select distinct doc_id, question_id, atu_id, kind, field from candidates), j as (select u.*, status from u join settled using(atu_id)) select doc_id, question_id, count(*) filter(status='UNVERIFIED') unverified, count(*) filter(status='CONFLICT') conflict, list_sort(list(distinct coalesce(field,kind)) filter(status in ('UNVERIFIED','CONFLICT','UNREADABLE'))) pending from j group by all having count(*) filter(status in ('UNVERIFIED','CONFLICT','UNREADABLE'))>0")
def proj13_review_package(s, d):
    r = readings(s, d)
    u = r.select("doc_id", "question_id", "atu_id", "kind", "field").distinct().join(evidence.settle(r).select("atu_id", "status"), "atu_id")
    return documents.review_package(u)


_QS = "qs as (select doc_id||'|'||question_id qk, max(doc_id) doc_id, max(question_id) question_id, case when bool_or(status in ('UNVERIFIED','CONFLICT','UNREADABLE')) then 'NEEDS_USER_REVIEW' else 'AUTO_RESTORED' end status from (select distinct doc_id, question_id, atu_id from candidates) join settled using(atu_id) group by 1)"
_EXAM = "(select exam_id, expected_id, number, label, answer is not null confirmed, coalesce(body,'')<>'' has_content, points is null edited, type is null corrected from (select distinct on (expected_id) * from expected))"


@query("a7_question_status", f"with {WHOLE}, {_QS} select question_id, case when bool_or(status='NEEDS_USER_REVIEW') then 'NEEDS_USER_REVIEW' else 'AUTO_RESTORED' end status from qs group by 1")
def a7_question_status(s, d):
    r = readings(s, d)
    return documents.question_status(r.select("question_id", "atu_id").distinct().join(evidence.settle(*truth_units(s, d)).select("atu_id", "status"), "atu_id"))


@query("a7_status_of_exams", f"select expected_id question_id, case when confirmed and number%3=0 then 'USER_CONFIRMED' when not has_content and number%2=0 then 'BLOCKED' when number%5=0 and number%2=1 then 'NEEDS_USER_REVIEW' when edited then 'USER_EDITED' when corrected then 'AUTO_CORRECTED' else 'AUTO_RESTORED' end status from {_EXAM} where number is not null")
def a7_status_of_exams(s, d):
    """Every way to a status: questions of exams, odd numbers with a unit, which is in conflict in each fifth question."""
    q = questions(s, d).where("number is not null")
    facts = q.select(F.col("expected_id").alias("question_id"), (F.col("answer").isNotNull() & (F.col("number") % 3 == 0)).alias("confirmed"), (F.coalesce("body", F.lit("")) != "").alias("has_content"), F.col("points").isNull().alias("edited"), F.col("type").isNull().alias("corrected"))
    units = q.where("number % 2 = 1").select(F.col("expected_id").alias("question_id"), F.when(F.col("number") % 5 == 0, "CONFLICT").otherwise("AUTO_VERIFIED").alias("status"))
    return documents.question_status(units, facts)


def _document_states(s, d):
    key = F.concat_ws("|", "doc_id", "question_id")
    u = readings(s, d).select("doc_id", key.alias("question_id"), "atu_id").distinct().join(evidence.settle(*truth_units(s, d)).select("atu_id", "status"), "atu_id")
    return documents.question_status(u).join(u.select("doc_id", "question_id").distinct(), "question_id")


@query("a8_document_status", f"with {WHOLE}, {_QS}, w as (select doc_id, case when bool_or(status='NEEDS_USER_REVIEW') then 'NEEDS_USER_REVIEW' else 'READY_FOR_FINAL_EXPORT' end status from qs group by 1), dd as (select id doc_id, bool_or(lifecycle_state='PROCESSING') busy from doc_registry group by 1) select doc_id, case when busy then 'IN_PROGRESS' else coalesce(w.status,'RESTORED_BEST_EFFORT') end status from dd left join w using(doc_id)")
def a8_document_status(s, d):
    r = table(s, d, "doc_registry").groupBy(F.col("id").alias("doc_id")).agg(F.when(F.bool_or(F.col("lifecycle_state") == "PROCESSING"), "IN_PROGRESS").alias("status"))
    return documents.document_status(_document_states(s, d), r)


@query("proj14_awaiting", f"with {WHOLE}, {_QS} select doc_id, question_id, status from qs where status in ('NEEDS_USER_REVIEW','BLOCKED')")
def proj14_awaiting(s, d):
    return documents.awaiting(_document_states(s, d)).select("doc_id", F.substring_index("question_id", "|", -1).alias("question_id"), "status")


@query("proj24_summaries", "select expected_id, exam_id, number, label, type, points, coalesce(cardinality(choices),0)::int n_choices, case when length(body)<=80 then body else left(body,80)||'…' end summary from (select distinct on (expected_id) * from expected)")
def proj24_summaries(s, d):
    return documents.summaries(questions(s, d))


@query("proj25_page_lists", "select document_id, coalesce(list_sort(list(distinct pdf_page_index) filter(page_role='ANSWER_KEY' and pdf_page_index is not null)),[]) answer_pages, coalesce(list_sort(list(distinct pdf_page_index) filter((page_role is null or page_role='UNKNOWN') and pdf_page_index is not null)),[]) unprocessed from source_pages group by 1")
def proj25_page_lists(s, d):
    return documents.page_lists(table(s, d, "source_pages"))


@query("x13_settled_role", "select document_id, pdf_page_index, arg_max(page_role, (coalesce(upper(role_source)='USER',false), ingested_at, id)) filter(page_role is not null) role from source_pages group by all")
def x13_settled_role(s, d):
    p = table(s, d, "source_pages").withColumn("role_source", F.coalesce("role_source", F.lit("")))
    return documents.settled_role(p)


@query("x12_with_default", "with r as (select source, max_repeats, target_share from mix_targets) select doc_id, coalesce(max_repeats,1) max_repeats, coalesce(target_share,0.0) target_share from documents left join r using(source)")
def x12_with_default(s, d):
    return documents.with_default(table(s, d, "documents").select("doc_id", "source"), "source", table(s, d, "mix_targets"), {"max_repeats": 1, "target_share": 0.0}).drop("source")


@query("s3_without_tenant", "select tbl, count(*) n from (select distinct 'doc_registry' tbl, id from doc_registry where tenant_id is null or tenant_id='' union all select distinct 'source_assets', id from source_assets where tenant_id is null or tenant_id='' union all select distinct 'source_pages', id from source_pages where tenant_id is null or tenant_id='') group by 1 union all select t, 0 from (values ('doc_registry',(select count(*) from doc_registry where tenant_id is null or tenant_id='')),('source_assets',(select count(*) from source_assets where tenant_id is null or tenant_id='')),('source_pages',(select count(*) from source_pages where tenant_id is null or tenant_id=''))) v(t,c) where c=0")
def s3_without_tenant(s, d):
    """Rows of each table that belong to no tenant."""
    one = lambda t: table(s, d, t).agg(F.lit(t).alias("tbl"), F.count_distinct(F.when(F.coalesce("tenant_id", F.lit("")) == "", F.col("id"))).alias("n"))
    return one("doc_registry").unionByName(one("source_assets")).unionByName(one("source_pages"))


@query("a30_open_regions", f"with {WHOLE} select doc_id, ord page, count(*) filter(status in ('UNVERIFIED','CONFLICT','UNREADABLE')) uncertain, count(*) units from (select distinct doc_id, ord, atu_id from candidates where ord is not null) join settled using(atu_id) group by all")
def a30_open_regions(s, d):
    """Units of each place that are still open."""
    u = readings(s, d).where("ord is not null").select("doc_id", F.col("ord").alias("page"), "atu_id").distinct().join(evidence.settle(*truth_units(s, d)).select("atu_id", "status"), "atu_id")
    return u.groupBy("doc_id", "page").agg(F.count_if(F.col("status").isin("UNVERIFIED", "CONFLICT", "UNREADABLE")).alias("uncertain"), F.count("*").alias("units"))


@query("j3_shared_stems", f"with {_Q}, s as (select exam_id, expected_id sub, regexp_extract(label,'^(\\d+)-\\d+$',1) n from q where regexp_matches(label,'^\\d+-\\d+$')), t as (select exam_id, expected_id stem, number pos, regexp_matches(replace(label,' ',''),'^\\d+$') pl, unnest(list_distinct(regexp_extract_all(label,'\\d+'))) n from q where label is not null and not contains(label,'-')) select exam_id, sub id, arg_min(stem,(pl,pos,stem)) parent_id from s join t using(exam_id,n) group by all")
def j3_shared_stems(s, d):
    q = questions(s, d).select("exam_id", F.col("expected_id").alias("id"), "label", F.col("number").alias("pos"))
    return documents.shared_stems(q, ["exam_id"])


@query("j4_context_groups", f"with {_Q}, p as (select q.exam_id, q.expected_id id, min(m.expected_id) par from q left join q m on m.exam_id=q.exam_id and m.label=q.parent_label group by all) select exam_id, coalesce(par,id) group_id, list_sort(list(distinct id)) members from p group by all")
def j4_context_groups(s, d):
    q = questions(s, d).select("exam_id", F.col("expected_id").alias("id"), "label", "parent_label")
    stems = q.where("label is not null").groupBy("exam_id", F.col("label").alias("parent_label")).agg(F.min("id").alias("parent_id"))
    return documents.context_groups(q.join(stems, ["exam_id", "parent_label"], "left"), ["exam_id"])


@query("proj22_with_parent", f"with {_Q}, p as (select exam_id, label parent_label, min(expected_id) parent_id from q where label is not null group by all), j as (select q.exam_id, q.expected_id id, p.parent_id from q left join p using(exam_id,parent_label)) select j.id, j.parent_id, m.type parent_type, m.points parent_points from j left join q m on m.expected_id=j.parent_id and m.exam_id=j.exam_id")
def proj22_with_parent(s, d):
    q = questions(s, d).select("exam_id", F.col("expected_id").alias("id"), "label", "parent_label", "type", "points")
    stems = q.where("label is not null").groupBy("exam_id", F.col("label").alias("parent_label")).agg(F.min("id").alias("parent_id"))
    return documents.with_parent(q.join(stems, ["exam_id", "parent_label"], "left"), ["exam_id"], ["type", "points"]).select("id", "parent_id", "parent_type", "parent_points")


@query("proj23_canonical_exam", f"with {_Q}, c as (select exam_id, string_agg(concat_ws('|',coalesce(number::varchar,'-'),coalesce(label,'-'),coalesce(type,'-'),coalesce(points::varchar,'-'),coalesce(answer,'-')),chr(10) order by number nulls first, label nulls first, type nulls first, points nulls first, answer nulls first) canonical from q group by 1) select exam_id, sha256(canonical) digest from c")
def proj23_canonical_exam(s, d):
    return documents.canonical_exam(questions(s, d), "exam_id").select("exam_id", "digest")


@query("j16_equal_choices")
def j16_equal_choices(s, d):
    return documents.proven_choices(questions(s, d).select("expected_id", F.explode("choices").alias("mark", "body")), "expected_id")


@query("j17_answers_by_number")
def j17_answers_by_number(s, d):
    r = readings(s, d).where("field = 'answer'")
    answer = F.coalesce(F.try_variant_get(F.try_parse_json("value_json"), "$", "string"), F.col("value_json"))
    return compare.answers_differ(r.select("question_id", evidence.source_key(F.col("provider")).alias("source"), F.when(F.col("value_json") != "null", answer).alias("answer")), "question_id")


@query("j20_latest_proof", "with a as (select distinct id, sha256 from source_assets), p as (select asset_id, arg_max(original_sha256,(ingested_at,id)) h from source_pages where asset_id is not null group by 1) select a.id, coalesce(p.h=a.sha256,false) proven from a left join p on p.asset_id=a.id")
def j20_latest_proof(s, d):
    a = table(s, d, "source_assets").select("id", "sha256").distinct()
    p = table(s, d, "source_pages").where("asset_id is not null").groupBy(F.col("asset_id").alias("id")).agg(F.max_by("original_sha256", F.struct("ingested_at", "id")).alias("h"))
    return a.join(p, "id", "left").select("id", F.coalesce(F.col("h") == F.col("sha256"), F.lit(False)).alias("proven"))


_PROOFS = "(select l_orderkey artifact, case l_linestatus when 'F' then 'pdf' else 'hwp' end kind, l_orderkey*10+l_linenumber proof, l_linenumber at_, l_quantity>10 same, case l_suppkey%3 when 0 then 'fonts' when 1 then 'layout' else 'text' end chk, l_returnflag<>'R' ok from lineitem)"


@query("j20_required_checks", f"with l as (select artifact, arg_max(struct_pack(kind:=kind,proof:=proof,same:=same), (at_,proof,kind,same)) p from {_PROOFS} group by 1), q as (select * from (values ('pdf','text'),('pdf','fonts'),('hwp','text')) t(kind, chk)), c as (select distinct proof, chk from {_PROOFS} where ok), j as (select artifact, p.same same, q.chk need, c.chk got from l left join q on q.kind=p.kind left join c on c.proof=p.proof and c.chk=q.chk) select artifact, bool_and(same) and count(*) filter(need is not null and got is null)=0 proven, coalesce(list_sort(list(distinct need) filter(got is null)),[]) open from j group by 1")
def j20_required_checks(s, d):
    """Lines as proofs of their orders, the last one counts."""
    line, key = table(s, d, "lineitem"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("proof")
    kind = F.when(F.col("l_linestatus") == "F", "pdf").otherwise("hwp")
    proofs = line.select(F.col("l_orderkey").alias("artifact"), kind.alias("kind"), key, F.col("l_linenumber").alias("at"), F.lit("x").alias("hash"), F.when(F.col("l_quantity") > 10, "x").otherwise("y").alias("content_hash"))
    checks = line.select(key, F.when(F.col("l_suppkey") % 3 == 0, "fonts").when(F.col("l_suppkey") % 3 == 1, "layout").otherwise("text").alias("check"), F.when(F.col("l_returnflag") != "R", "PASSED").otherwise("FAILED").alias("result"))
    required = s.createDataFrame([("pdf", "text"), ("pdf", "fonts"), ("hwp", "text")], "kind string, check string")
    return documents.checks_passed(required, proofs, checks)


@query("j21_head_overlay", "with r as (select distinct id, head_revision_id, lifecycle_state from doc_registry), h as (select document_id, arg_max(id,(revision_no,id)) newest from revisions where document_id is not null group by 1) select r.id, coalesce(h.newest,r.head_revision_id) head from r left join h on h.document_id=r.id")
def j21_head_overlay(s, d):
    r = table(s, d, "doc_registry").select("id", "head_revision_id").distinct()
    h = versions.heads(table(s, d, "revisions").where("document_id is not null")).select("document_id", F.col("id").alias("newest"))
    return r.join(h, r.id == h.document_id, "left").select(r.id, F.coalesce("newest", "head_revision_id").alias("head"))


@query("j25_audit_coverage")
def j25_audit_coverage(s, d):
    q = questions(s, d).where("body is not null and answer is not null")
    return documents.audit_coverage(q, "body", "answer").select("expected_id", "covered")


@query("f9_fixed_labels", "with c as (select l_orderkey k, l_partkey p, case l_linenumber when 1 then '①' when 2 then '②' when 3 then '③' when 4 then '④' else '⑤' end as label from (select distinct l_orderkey, l_partkey, l_linenumber from lineitem)), n as (select *, row_number() over(partition by k order by p, label)-1 pos, count(*) over(partition by k) n from c), r as (select *, instr('①②③④⑤',label) pl from n), x as (select *, coalesce(pl<lag(pl) over(partition by k order by pos),false) st from r), g as (select k, count(distinct label) du, bool_or(st) st from x group by 1) select k, pos, case when n>=2 and (du<n or g.st) and pos<5 then substr('①②③④⑤',pos+1,1) else label end as label, case when n<2 then null when du<n then 'choice_label_dedup' when g.st then 'choice_order' end rule from x join g using(k)")
def f9_fixed_labels(s, d):
    from pyspark.sql import Window

    line = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_linenumber").distinct()
    c = line.withColumn("label", F.get(F.lit(documents.CIRCLED), F.least(F.col("l_linenumber"), F.lit(5)) - 1))
    c = c.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("l_partkey", "label")) - 1)
    return documents.fixed_labels(c, "k")


@query("m1_scores", "with f as (select l_orderkey, count(*) steps, sum(l_quantity) operations, count(distinct l_suppkey) conditions, count(distinct l_shipdate) concepts, count(*) filter(l_returnflag='R') figures, count(*) filter(l_discount>0.08) traps from lineitem group by 1), s as (select *, least(1.5,0.3*steps)+least(1.5,0.05*operations)+least(0.8,0.2*conditions)+least(0.8,0.15*concepts)+least(0.5,0.1*figures)+least(0.5,0.25*traps) score from f), r as (select *, floor(score*100+0.5+1e-9)/100 sc from s) select l_orderkey, sc score, case when sc<1.2 then 'low' when sc<2.6 then 'mid' else 'high' end band, floor((1.0+0.8*steps+0.05*operations+0.5*figures)*10+0.5+1e-9)/10 \"minutes\" from r")
def m1_scores(s, d):
    f = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("steps"), F.sum("l_quantity").alias("operations"), F.count_distinct("l_suppkey").alias("conditions"), F.count_distinct("l_shipdate").alias("concepts"), F.count_if(F.col("l_returnflag") == "R").alias("figures"), F.count_if(F.col("l_discount") > 0.08).alias("traps"))
    return documents.scores(f).select("l_orderkey", "score", "band", "minutes")


_OBJECTS = "case when coalesce(body,'')<>'' then 'body' end, case when points is not null then 'points' end, case when coalesce(figure,'')<>'' then 'figure' end"


@query("j7_manifest", f"""with o as (select exam_id||'|'||number question_id, expected_id, list_filter([{_OBJECTS}], lambda x: x is not null) fields, list_filter(map_keys(coalesce(choices, map {{}})), lambda k: choices[k] is not null) choices, (length(coalesce(body,''))-length(replace(coalesce(body,''),'$','')))//2 equations from (select distinct on (expected_id) * from expected) where number is not null and exam_id is not null),
e as (select question_id, arg_min(struct_pack(f:=fields,c:=choices,q:=equations),expected_id) e from o group by 1), a as (select question_id, arg_max(struct_pack(f:=fields,c:=choices,q:=equations),expected_id) a from o where expected_id%7<>0 group by 1), j as (select * from e left join a using(question_id))
select question_id, 'missing_question' problem, null about from j where a is null
union all select question_id, 'missing', unnest(list_filter(e.f, lambda x: not list_contains(a.f,x))) from j where a is not null
union all select question_id, 'missing', 'choice:'||unnest(list_filter(e.c, lambda x: not list_contains(a.c,x))) from j where a is not null
union all select question_id, 'duplicate', 'choice:'||unnest(list_filter(a.c, lambda x: not list_contains(e.c,x))) from j where a is not null and len(a.c)>len(e.c)
union all select question_id, case when a.q<e.q then 'missing' else 'duplicate' end, 'equation:'||e.q||'/'||a.q from j where a is not null and a.q<>e.q""")
def j7_manifest(s, d):
    """The first reading of each question of an exam says what there should be, the last one what there is."""
    q = table(s, d, "expected").dropDuplicates(["expected_id"]).where("number is not null and exam_id is not null")
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    fields = F.array_compact(F.array(F.when(there("body"), "body"), F.when(F.col("points").isNotNull(), "points"), F.when(there("figure"), "figure")))
    choices = F.coalesce(F.transform(F.filter(F.map_entries("choices"), lambda e: e["value"].isNotNull()), lambda e: e["key"]), F.array().cast("array<string>"))
    body = F.coalesce("body", F.lit(""))
    o = q.select(F.concat_ws("|", "exam_id", "number").alias("question_id"), "expected_id", F.struct(fields.alias("fields"), choices.alias("choices"), F.floor((F.length(body) - F.length(F.translate(body, "$", ""))) / 2).alias("equations")).alias("o"))
    e = o.groupBy("question_id").agg(F.min_by("o", "expected_id").alias("o")).select("question_id", "o.*")
    a = o.where("expected_id % 7 <> 0").groupBy("question_id").agg(F.max_by("o", "expected_id").alias("o")).select("question_id", "o.*")
    return compare.manifest_problems(e, a)


@query("x14_resolved", f"with {_Q}, n as (select exam_id, expected_id id, unnest([0,1,2]) rk, unnest([expected_id::varchar,label,number::varchar]) ask from q), a as (select distinct exam_id, number::varchar ask from q where number is not null), g as (select exam_id, ask, rk, count(distinct id) m, min(id) id from a left join n using(exam_id,ask) group by all) select exam_id, ask, case when arg_min(m,rk)=1 then arg_min(id,rk) end id, arg_min(m,rk) matches from g group by all")
def x14_resolved(s, d):
    q = questions(s, d).select("exam_id", F.col("expected_id").alias("id"), "label", "number")
    return documents.resolve(q, q.where("number is not null").select("exam_id", F.col("number").cast("string").alias("ask")).distinct(), ["exam_id"])


@query("x5_permutation", "with p as (select document_id, list_sort(list(distinct upload_index)) got from source_pages where document_id is not null and upload_index is not null group by 1) select document_id, got=generate_series(list_min(got),list_min(got)+len(got)-1)::int[] complete from p")
def x5_permutation(s, d):
    p = table(s, d, "source_pages").where("document_id is not null and upload_index is not null").groupBy("document_id").agg(F.array_sort(F.collect_set("upload_index")).alias("got"))
    return p.select("document_id", (F.col("got") == F.sequence(F.array_min("got"), F.array_min("got") + F.size("got") - 1)).alias("complete"))


@query("x8_endnotes", f"with {_Q} select exam_id, string_agg(coalesce(label,number::varchar)||': '||coalesce(answer,'—'),chr(10) order by number, expected_id) notes from q where points>0 and number is not null group by 1")
def x8_endnotes(s, d):
    q = questions(s, d).where("points > 0 and number is not null")
    line = F.concat(F.coalesce("label", F.col("number").cast("string")), F.lit(": "), F.coalesce("answer", F.lit("—")))
    return q.groupBy("exam_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "expected_id", line.alias("t")))), lambda x: x["t"]), "\n").alias("notes"))


@query("a26_call_budget", "select user_id, sum(case when event_type not in ('signup','error') then 1 else 0 end)::bigint calls, sum(case when event_type not in ('signup','error') then 1 else 0 end)>40 over_cap from events group by 1")
def a26_call_budget(s, d):
    calls = F.count_if(~F.col("event_type").isin("signup", "error"))
    return table(s, d, "events").groupBy("user_id").agg(calls.alias("calls"), (calls > 40).alias("over_cap"))


@query("a28_first_seen", "select user_id, string_agg(event_type,',' order by f) kinds from (select user_id, event_type, min(event_id) f from events group by all) group by 1")
def a28_first_seen(s, d):
    f = table(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return f.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("v13_hash_chain", "select distinct a.id asset_id, p.id page_id, sha256(coalesce(a.sha256,'')||'|'||coalesce(p.original_sha256,'')) chain from source_assets a join source_pages p on p.asset_id=a.id")
def v13_hash_chain(s, d):
    a = table(s, d, "source_assets").select(F.col("id").alias("asset_id"), "sha256").distinct()
    p = table(s, d, "source_pages").select("asset_id", F.col("id").alias("page_id"), "original_sha256").distinct()
    return a.join(p, "asset_id").select("asset_id", "page_id", F.sha2(F.concat(F.coalesce("sha256", F.lit("")), F.lit("|"), F.coalesce("original_sha256", F.lit(""))), 256).alias("chain"))


@query("u5_ordered_distinct", "select question_id, field, min(candidate_id) first_seen, count(*) n from (select distinct * from candidates) where field is not null group by all")
def u5_ordered_distinct(s, d):
    return readings(s, d).where("field is not null").groupBy("question_id", "field").agg(F.min("candidate_id").alias("first_seen"), F.count("*").alias("n"))


@query("proj19_adequate_choices", "select question_id, count(distinct atu_id)>0 and (not bool_or(field='type' and contains(lower(coalesce(value_json,'')),'multiple')) or bool_or(starts_with(field,'choice:') or kind='choice')) adequate from candidates group by 1")
def proj19_adequate_choices(s, d):
    """Whether reading a question was worth it (P19): it gave units, and one with choices gave at least one."""
    field = F.coalesce("field", F.lit(""))
    multiple = (field == "type") & F.contains(F.lower(F.coalesce("value_json", F.lit(""))), F.lit("multiple"))
    choice = F.startswith(field, F.lit("choice:")) | F.coalesce(F.col("kind") == "choice", F.lit(False))
    return table(s, d, "candidates").groupBy("question_id").agg(((F.count_distinct("atu_id") > 0) & (~F.bool_or(multiple) | F.bool_or(choice))).alias("adequate"))


@query("r12_stage_records")
def r12_stage_records(s, d):
    """The path from readings to document states as a pipeline; its records, with the rows that each stage made."""
    stages = [
        Stage("settle", lambda f: {"settled": evidence.settle(f["readings"])}, ("readings",), ("settled",)),
        Stage("questions", lambda f: {"questions": documents.question_status(f["readings"].select("question_id", "atu_id").distinct().join(f["settled"].select("atu_id", "status"), "atu_id"))}, ("readings", "settled"), ("questions",)),
        Stage("render", lambda f: {}, ("questions",), (), ("office",)),
    ]
    have, log = Pipeline(stages).run(s, {"readings": readings(s, d)})
    made = [have[k].agg(F.count("*").alias("n")).select(F.lit(x.name).alias("name"), "n") for x in stages for k in x.makes if k in have]
    counts = reduce(DataFrame.unionByName, made, s.createDataFrame([], "name string, n bigint")).groupBy("name").agg(F.sum("n").alias("made"))
    return log.join(counts, "name", "left").select("name", "status", "error", "made")


@query("f18_missing_in_render")
def f18_missing_in_render(s, d):
    return questions(s, d).where("body is not null").select("expected_id", T.contains_all(F.col("body"), F.array_compact(F.array("answer")), T.REORDERED).alias("missing"))


@query("s23_manifest_state", "with m as (select id path, any_value(sha256) h from source_assets group by 1), f as (select asset_id path, min(original_sha256) h from source_pages where asset_id is not null group by 1), j as (select case when f.path is null then 'missing' when m.path is null then 'unlisted' when m.h=f.h then 'ok' else 'mismatched' end state from m full join f on m.path=f.path) select state, count(*) n from j group by 1")
def s23_manifest_state(s, d):
    m = table(s, d, "source_assets").groupBy(F.col("id").alias("path")).agg(F.first("sha256").alias("sha256"))
    f = table(s, d, "source_pages").where("asset_id is not null").groupBy(F.col("asset_id").alias("path")).agg(F.min("original_sha256").alias("sha256"))
    return compare.verify_hashes(m, f).groupBy("state").agg(F.count("*").alias("n"))


@query("f15_script_surface")
def f15_script_surface(s, d):
    from lodestone.functions.mathexpr import linear_udf

    v = table(s, d, "variants").select("variant_id", "new_equations").distinct()
    e = v.select("variant_id", F.posexplode("new_equations").alias("place", "latex"))
    return e.select("variant_id", "place", T.script_surface(linear_udf("latex")).alias("surface"))


@query("proj16_routes", "select distinct expected_id, case when regexp_matches(coalesce(label,''),'논술|서술|서답|[Ee]ssay') or type='descriptive' or length(body)>400 then 'long' else 'short' end route from (select distinct expected_id, label, type, body from expected)")
def proj16_routes(s, d):
    return questions(s, d).select("expected_id", T.route(F.coalesce("label", F.lit("")), F.col("type"), F.col("body")).alias("route"))


@query("proj15_confirm", "select distinct candidate_id, (model_version is null) or coalesce(case when confidence between 0 and 1 then confidence end,0.0)<0.8 confirm from candidates")
def proj15_confirm(s, d):
    c = readings(s, d).select("candidate_id", "confidence", F.col("model_version").isNull().alias("requires_user_confirm"))
    return documents.needs_confirmation(c).select("candidate_id", "confirm")


@query("proj17_solve_targets", f"with {_Q}, p as (select q.exam_id, q.expected_id id, min(m.expected_id) par from q join q m on m.exam_id=q.exam_id and m.label=q.parent_label group by all) select expected_id id from q where trim(body,' ')<>'' and expected_id not in (select par from p) and coalesce(number%2=0 or number%4=1,true)")
def proj17_solve_targets(s, d):
    """Odd numbers have a unit, which is verified in every second one."""
    q = questions(s, d).select("exam_id", F.col("expected_id").alias("id"), "label", "parent_label", "body", "number")
    stems = q.where("label is not null").groupBy("exam_id", F.col("label").alias("parent_label")).agg(F.min("id").alias("parent_id"))
    units = q.where("number % 2 = 1").select(F.col("id").alias("question_id"), F.when(F.col("number") % 4 == 1, "AUTO_VERIFIED").otherwise("CONFLICT").alias("status"))
    return documents.solve_targets(q.join(stems, ["exam_id", "parent_label"], "left"), units)


@query("t6_figures_last", f"with {_Q}, k as (select expected_id, exam_id, row_number() over(partition by exam_id order by (type='multiple_choice'), expected_id) place from q where type is not null) select expected_id, place::int place from k where place<=20")
def t6_figures_last(s, d):
    q = questions(s, d).where("type is not null").withColumn("has_figure", F.col("type") == "multiple_choice")
    return documents.figures_last(q, ["exam_id"], "has_figure", "expected_id", 20).select("expected_id", "place")


@query("w14_blank_band", "with z as (select user_id, event_id, (event_type not in ('error','signup'))::int ink, floor(max(event_id) over(partition by user_id)*(1-0.55::double))::int as zone from events), d as (select * from z where event_id>=zone), i as (select *, row_number() over(partition by user_id order by event_id)-sum((ink=0)::int) over(partition by user_id order by event_id) isl from d), r as (select user_id, zone, isl, count(*) filter(ink=0) n from i group by all) select user_id, zone, max(n) longest from r group by all")
def w14_blank_band(s, d):
    e = table(s, d, "events").withColumn("ink", (~F.col("event_type").isin("error", "signup")).cast("int"))
    return documents.blank_band(e, ["user_id"], "event_id", "ink")


@query("j24_pinned", "with p as (select id, arg_min(sha256,(ingested_at,id)) as digest from source_assets group by 1), c as (select asset_id id, min(original_sha256) h from source_pages where asset_id is not null group by 1) select p.id, coalesce(p.digest=c.h,false) same from p left join c on c.id=p.id")
def j24_pinned(s, d):
    p = table(s, d, "source_assets").groupBy("id").agg(F.min_by("sha256", F.struct("ingested_at", "id")).alias("digest"))
    c = table(s, d, "source_pages").where("asset_id is not null").groupBy(F.col("asset_id").alias("id")).agg(F.min("original_sha256").alias("digest"))
    return documents.pinned(p, c, ["id"])


@query("v1_append_revision", "with r as (select distinct id, document_id, revision_no, content_hash from revisions where document_id is not null), h as (select document_id, arg_max(id,(revision_no,id)) id, max(revision_no) no, arg_max(content_hash,(revision_no,id)) ch from r group by 1) select document_id, no+1 revision_no, id parent_revision_id, sha256(document_id||'!') content_hash from h where ch is null or ch<>sha256(document_id||'!')")
def v1_append_revision(s, d):
    r = table(s, d, "revisions").where("document_id is not null").select("id", "document_id", "revision_no", "content_hash").distinct()
    new = r.select("document_id", F.concat("document_id", F.lit("!")).alias("content")).distinct()
    return versions.append_revision(r, new).select("document_id", "revision_no", "parent_revision_id", "content_hash")


@query("x2_current", "select user_id, event_type, event_id from (select *, row_number() over(partition by user_id, event_type order by ts desc, event_id desc) k from events) where k=1 and not value<5")
def x2_current(s, d):
    e = table(s, d, "events").withColumn("gone", F.col("value") < 5)
    return versions.current(e, ["user_id", "event_type"], ["ts", "event_id"], "gone").select("user_id", "event_type", "event_id")
