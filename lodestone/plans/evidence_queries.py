"""Queries of evidence, text functions, comparisons and histories over the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import compare, evidence, ordered, versions
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


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Each reading once. Repeated rows are equal in all columns, so only the columns that a query uses are shuffled."""
    return table(spark, d, "candidates").dropDuplicates(["candidate_id"])


def truth_units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Readings that name a value, and all units: those that a surely reading reviewer settled are verified by a person."""
    r = readings(spark, d)
    human = (evidence.evidence_class(F.col("provider")) == "HUMAN") & (F.col("confidence") >= 0.97) & F.col("value_json").isNotNull()
    units = r.groupBy("atu_id").agg(F.when(F.bool_or(F.coalesce(human, F.lit(False))), "HUMAN_VERIFIED").alias("status"), F.min(F.when(human, F.col("value_json"))).alias("value_json"))
    return r.where("value_json is not null and value_json <> 'null'"), units


KEY = "case when trim(coalesce(provider,'')) like 'reference%' then 'reference' else trim(coalesce(provider,'')) end"
CLASS = "case when regexp_matches(lower(trim(coalesce(provider,''))),'^(human|user|reviewer)') then 'HUMAN' when regexp_matches(lower(trim(coalesce(provider,''))),'^(reference|native_pdf|pdf_text)') then 'SOURCE' when regexp_matches(lower(trim(coalesce(provider,''))),'^(math_checker|sympy|manifest|hash)') then 'CONSISTENCY' else 'OBSERVATION' end"
SETTLED = f"""r as (select distinct * from candidates),
bv as (select atu_id, coalesce(value_json,'null') v, string_agg(distinct {KEY}, '/' order by {KEY}) ks, count(distinct {KEY}) k, count(*) n from r group by all),
s as (select atu_id, count(*) vals, sum(n)::bigint readings, min(v) v, max(k) sources,
  string_agg(case when length(v)<=40 then v else substr(v,1,37)||'...' end || '<-' || ks, '; ' order by v) parts from bv group by 1),
settled as (select atu_id, case when vals>1 then 'CONFLICT' when sources>=2 then 'AUTO_VERIFIED' else 'UNVERIFIED' end status,
  case when vals=1 and sources>=2 then v end value_json,
  case when vals>1 then 'conflict:'||parts when sources>=2 then 'independent_sources:'||sources else 'single_source' end note, readings from s)"""


#: Settled units with those a person verified and those nothing was read for.
WHOLE = SETTLED.replace("r as (select distinct * from candidates)", "r as (select distinct * from candidates where value_json is not null and value_json<>'null')").replace("settled as (", "machine as (") + f""",
u as (select atu_id, bool_or(h) human, min(value_json) filter(h) own from (select *, coalesce({CLASS}='HUMAN' and confidence>=0.97 and value_json is not null, false) h from candidates) group by 1),
settled as (select u.atu_id, case when human then 'HUMAN_VERIFIED' else coalesce(status,'UNREADABLE') end status, case when human then own else value_json end value_json, case when not human then note end note, coalesce(readings,0) readings from u left join machine using(atu_id))"""


@query("a1_settle", f"with {WHOLE} select * from settled")
def a1_settle(s, d):
    return evidence.settle(*truth_units(s, d))


@query("a2_machine_status", f"with {SETTLED} select * from settled")
def a2_machine_status(s, d):
    """What readings alone say of units, whatever a person decided."""
    return evidence.settle(readings(s, d))


@query("a3_bundle", f"select atu_id, count(*) filter(c='SOURCE') source, count(*) filter(c='OBSERVATION') observation, count(*) filter(c='CONSISTENCY') consistency, count(*) filter(c='HUMAN') human from (select distinct *, {CLASS} c from candidates) group by 1")
def a3_bundle(s, d):
    return evidence.bundle(readings(s, d))


@query("a4_status_histogram", f"with {WHOLE}, k as (select distinct atu_id, kind from candidates), dom as (select kind, status from (select distinct kind from k), (values ('AUTO_VERIFIED'),('CONFLICT'),('HUMAN_VERIFIED'),('UNVERIFIED'),('UNREADABLE')) t(status)), c as (select kind, status, count(*) n from k join settled using(atu_id) group by all) select kind, status, coalesce(n,0) n from dom left join c using(kind,status)")
def a4_status_histogram(s, d):
    r = readings(s, d)
    j = r.select("atu_id", "kind").distinct().join(evidence.settle(*truth_units(s, d)).select("atu_id", "status"), "atu_id")
    return evidence.histogram(j, ["kind"], "status", ["AUTO_VERIFIED", "CONFLICT", "HUMAN_VERIFIED", "UNVERIFIED", "UNREADABLE"])


@query("proj18_draft_safe", "select atu_id, min(value_json) value_json, max(case when confidence between 0 and 1 then confidence end) confidence from (select distinct * from candidates) group by 1 having count(distinct coalesce(value_json,'null'))=1 and max(case when confidence between 0 and 1 then confidence end)>=0.7")
def proj18_draft_safe(s, d):
    return evidence.draft_safe(readings(s, d))


@query("c1_agreed_value", r"""select atu_id, case when count(distinct v)=1 then min(v) end agreed from (select atu_id, case when v='null' then null else v end v from (select atu_id, nullif(trim(regexp_replace(value_json,'^"(.*)"$','\1')),'') v from (select distinct * from candidates))) group by 1""")
def c1_agreed_value(s, d):
    return evidence.agreed_value(readings(s, d))


@query("a6_restoration_confidence", f"with {SETTLED} select question_id, coalesce(count(*) filter(status in ('AUTO_VERIFIED','HUMAN_VERIFIED'))::double/nullif(count(status),0),0.0) confidence from (select distinct question_id, atu_id from candidates) left join settled using(atu_id) group by 1")
def a6_restoration_confidence(s, d):
    r = readings(s, d)
    return evidence.restoration_confidence(evidence.settle(r), r)


@query("a11_expected_manifest", "select question_id, list_sort(list(distinct field)) fields, count(distinct case when field like 'equation:%' then field end) equations from candidates where field is not null and value_json is not null and value_json<>'null' group by 1")
def a11_expected_manifest(s, d):
    return evidence.expected_manifest(readings(s, d))


@query("j2_merged_units", "select question_id, kind, field, count(*) readings from (select distinct * from candidates) where field is not null group by all union all select question_id, kind, field, 1 from (select distinct * from candidates) where field is null")
def j2_merged_units(s, d):
    return evidence.merged_units(readings(s, d))


@query("a5_gate", f"""with {SETTLED}, u as (select distinct doc_id, atu_id, case kind when 'number' then 'number' when 'question_number' then 'number' when 'points' then 'number' when 'unit' then 'math' when 'choice' then 'choice' when 'math_symbol' then 'math' when 'variable' then 'math' when 'angle' then 'figure' when 'length' then 'figure' when 'figure_label' then 'figure' else 'text' end b, kind from candidates),
c as (select doc_id, count(*) filter(status='UNVERIFIED') unverified, {', '.join(f"count(*) filter(status='CONFLICT' and b='{b}') {b}_conflict" for b in ('number', 'choice', 'math', 'figure', 'text'))} from u join settled using(atu_id) group by 1),
n as (select doc_id, ord number, count(*) times from (select distinct doc_id, question_id, ord from candidates where ord is not null) group by all),
g as (select doc_id, max(number)-min(number)+1-count(*) gaps, count(*) filter(times>1) duplicates from n group by 1)
select c.*, coalesce(gaps,0) gaps, coalesce(duplicates,0) duplicates, unverified+number_conflict+choice_conflict+math_conflict+figure_conflict+text_conflict+coalesce(gaps,0)+coalesce(duplicates,0)=0 passed from c left join g using(doc_id)""")
def a5_gate(s, d):
    r = readings(s, d)
    numbers = r.select("doc_id", "question_id", F.col("ord").alias("number")).distinct()
    return evidence.gate(evidence.settle(r), r, numbers)


@query("a5_gate_in_full", f"""with {WHOLE}, du as (select distinct doc_id, atu_id from candidates), c as (select doc_id, count(*) filter(status='UNVERIFIED') unverified from du join settled using(atu_id) group by 1),
q as (select doc_id, count(*) filter(not ok) empty_questions from (select doc_id, question_id, bool_or(coalesce(field='body' and value_json is not null,false)) ok from candidates group by all) group by 1),
rr as (select doc_id, count(*) filter(value_json is null) reconstruction_pending from (select distinct * from candidates) group by 1),
p as (select doc_id, count(*) filter(bad) unprocessed_pages from (select doc_id, ord, bool_and(value_json is null) bad from candidates group by all) group by 1),
m as (select doc_id, count(*) manifest_mismatch from candidates where false group by 1),
g as (select doc_id, count(*) filter(confidence>1) logic_conflict, count(*) filter(confidence<0) ambiguous_answer from (select distinct * from candidates) group by 1)
select doc_id, unverified, empty_questions, reconstruction_pending, unprocessed_pages, coalesce(manifest_mismatch,0) manifest_mismatch, logic_conflict, ambiguous_answer from c join q using(doc_id) join rr using(doc_id) join p using(doc_id) left join m using(doc_id) join g using(doc_id)""")
def a5_gate_in_full(s, d):
    """Questions without a body, readings without a value, places where nothing was read, and confidences out of range as flags."""
    r, (named, units) = readings(s, d), truth_units(s, d)
    questions = r.groupBy("doc_id", "question_id").agg(F.bool_or(F.coalesce((F.col("field") == "body") & F.col("value_json").isNotNull(), F.lit(False))).alias("has_content"))
    regions = r.select("doc_id", F.when(F.col("value_json").isNull(), "REVIEW_REQUIRED").otherwise("KEEP").alias("decision"))
    pages = r.groupBy("doc_id", "ord").agg(F.bool_and(F.col("value_json").isNull()).alias("failed"))
    flags = r.select("doc_id", F.when(F.col("confidence") > 1, "logic_conflict").when(F.col("confidence") < 0, "ambiguous_answer").alias("kind"))
    numbers = r.select("doc_id", F.col("ord").alias("number")).limit(0)
    g = evidence.gate(evidence.settle(named, units), r, numbers, questions, regions, pages, r.select("doc_id").limit(0), flags)
    return g.select("doc_id", "unverified", "empty_questions", "reconstruction_pending", "unprocessed_pages", "manifest_mismatch", "logic_conflict", "ambiguous_answer")


@query("w8_latest_reading", "select atu_id, provider, candidate_id, value_json from (select *, row_number() over(partition by atu_id, provider order by ts desc nulls last, candidate_id desc) k from (select distinct * from candidates)) where k=1")
def w8_latest_reading(s, d):
    return evidence.sure_label(readings(s, d)).select("atu_id", "provider", "candidate_id", "value_json")


def exams(s, d):
    return table(s, d, "expected").dropDuplicates(["expected_id"])


ONE = "(select distinct on (expected_id) * from expected)"


def answers(s, d):
    return table(s, d, "expected").select("expected_id", "answer").distinct().where("answer is not null")


def bodies(s, d):
    return table(s, d, "expected").select("expected_id", "body").distinct().where("body is not null")


def answers_and_choices(s, d):
    return table(s, d, "expected").select("expected_id", "answer", F.col("choices")["①"].alias("c")).distinct().where("answer is not null and c is not null")


#: Unicode's white space, and the normal form of a text, in DuckDB.
_WS = r"[\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_PLAIN = lambda c: f"regexp_replace(translate({c},'〈〉−','  -'),'{_WS}','','g')"
_TOKENS = T.CRITICAL.replace("\\d", "\\p{Nd}")
_PAIR = "select distinct expected_id, answer, choices['①'] c from expected where answer is not null and choices['①'] is not null"
F1_NORM_TEXT_SQL = f"select expected_id, {_PLAIN('answer')} plain from (select distinct expected_id, answer from expected) where answer is not null"
F2_CHAR_EXACT_SQL = f"with t as (select distinct expected_id, {_PLAIN('answer')} g, {_PLAIN('c')} p from ({_PAIR})) select expected_id, case when p=g then 1.0 when g='' then 0.0 else greatest(0.0, 1.0-levenshtein(p,g)::double/length(g)) end score from t"
F4_CRITICAL_TOKENS_SQL = f"select expected_id, len(regexp_extract_all({_PLAIN('body')},'{_TOKENS}'))::int n from (select distinct expected_id, body from expected) where body is not null"
U1_TOKEN_OVERLAP_SQL = f"with x as (select expected_id, regexp_extract_all({_PLAIN('answer')},'{_TOKENS}') g, regexp_extract_all({_PLAIN('c')},'{_TOKENS}') p from ({_PAIR})), gc as (select expected_id, k, count(*) n from (select expected_id, unnest(g) k from x) group by all), pc as (select expected_id, k, count(*) n from (select expected_id, unnest(p) k from x) group by all), m as (select expected_id, sum(least(gc.n,pc.n))::int matched from gc join pc using(expected_id,k) group by 1) select expected_id, coalesce(matched,0) matched, len(g)::int wanted, (len(p)-coalesce(matched,0))::int extra from x left join m using(expected_id)"


@query("f1_norm_text", F1_NORM_TEXT_SQL)
def f1_norm_text(s, d):
    return answers(s, d).select("expected_id", T.norm_text(F.col("answer")).alias("plain"))


@query("f2_char_exact", F2_CHAR_EXACT_SQL)
def f2_char_exact(s, d):
    return answers_and_choices(s, d).select("expected_id", T.char_exact(F.col("c"), F.col("answer")).alias("score"))


@query("f4_critical_tokens", F4_CRITICAL_TOKENS_SQL)
def f4_critical_tokens(s, d):
    return bodies(s, d).select("expected_id", F.size(T.critical_tokens(F.col("body"))).alias("n"))


@query("f5_norm_answer", r"with t as (select distinct expected_id, regexp_replace(trim(answer,' '),'\.+$','') t from expected where answer is not null), c as (select expected_id, case t when '①' then '1' when '②' then '2' when '③' then '3' when '④' then '4' when '⑤' then '5' else t end t from t) select expected_id, trim(regexp_replace(trim(t,' '),'([\d.])(?:㎠|㎝|㎢|cm²|cm³|cm|mm|km|m|°|도|개|자리)$','\1'),' ') plain from c")
def f5_norm_answer(s, d):
    return table(s, d, "expected").select("expected_id", "answer").distinct().where("answer is not null").select("expected_id", T.norm_answer(F.col("answer")).alias("plain"))


_ANSWER = lambda c: "trim(regexp_replace(trim(case regexp_replace(trim(" + c + r",' '),'\.+$','') " + "".join(f"when '{m}' then '{i}' " for i, m in enumerate(T.CIRCLED, 1)) + "else regexp_replace(trim(" + c + r",' '),'\.+$','') end,' '),'([\d.])(?:" + T.ANSWER_UNITS + r")$','\1'),' ')"


@query("f6_answers_match", f"with t as (select expected_id, {_ANSWER('answer')} x, {_ANSWER('c')} y from (select distinct expected_id, answer, choices['①'] c from expected)), b as (select *, regexp_replace(x,'[^\\w가-힣]','','g') bx, regexp_replace(y,'[^\\w가-힣]','','g') b_y from t) select expected_id, coalesce(x<>'' and y<>'' and (x=y or (length(bx)>=2 and not regexp_full_match(bx,'\\d+') and contains(b_y,bx))),false) \"match\" from b")
def f6_answers_match(s, d):
    e = table(s, d, "expected").select("expected_id", "answer", F.col("choices")["①"].alias("c")).distinct()
    return e.select("expected_id", F.coalesce(T.answers_match(F.col("answer"), F.col("c")), F.lit(False)).alias("match"))


@query("f7_numeric_typos")
def f7_numeric_typos(s, d):
    e = table(s, d, "expected").select("expected_id", "body").distinct().where("body is not null")
    return e.select("expected_id", T.numeric_typos(F.col("body")).alias("fixed")).where(F.col("fixed").isNotNull())


@query("f8_units", r"select expected_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(body,'㎝','cm'),'㎜','mm'),'㎞','km'),'㎏','kg'),'㎡','m²'),'˚','°'),'º','°'),'⊿','△'),'∆','△'),'∟','∠'),'𝑥','x'),'𝑦','y'),'<([A-Z]{3})','∠\1','g'),'(\d)\s*˙','\1°','g') fixed from (select distinct expected_id, body from expected) where body is not null")
def f8_units(s, d):
    return table(s, d, "expected").select("expected_id", "body").distinct().where("body is not null").select("expected_id", T.normalize_units(F.col("body")).alias("fixed"))


@query("f12_traps", r"select expected_id, list_sort(list_filter([case when regexp_matches(body,'않은|아닌|없는|not\b|cannot') then 'negation' end, case when regexp_matches(body,'모두|every|all\b') then 'all' end, case when regexp_matches(body,'\(-|-\(') then 'sign' end], lambda x: x is not null)) traps from (select distinct expected_id, body from expected) where body is not null")
def f12_traps(s, d):
    return table(s, d, "expected").select("expected_id", "body").distinct().where("body is not null").select("expected_id", T.traps(F.col("body")).alias("traps"))


@query("f13_split_choices", "with l as (select expected_id, string_agg(k||' '||v, '  ' order by k) line from (select distinct expected_id, unnest(map_keys(choices)) k, unnest(map_values(choices)) v from expected) where v is not null group by 1), p as (select expected_id, unnest(regexp_extract_all(line,'[①②③④⑤][^①②③④⑤]*')) x, generate_subscripts(regexp_extract_all(line,'[①②③④⑤][^①②③④⑤]*'),1) i from l) select expected_id, left(x,1) mark, trim(regexp_replace(arg_min(substr(x,2),i),'^\\s+',''),' ') text from p group by 1, 2")
def f13_split_choices(s, d):
    e = table(s, d, "expected").select("expected_id", F.array_sort(F.map_entries("choices")).alias("c")).distinct().where("c is not null")
    line = F.array_join(F.transform(F.filter("c", lambda x: x["value"].isNotNull()), lambda x: F.concat(x["key"], F.lit(" "), x["value"])), "  ")
    return e.select("expected_id", F.explode(T.split_choices(line)).alias("mark", "text"))


@query("f14_points_tag", r"select expected_id, try_cast(nullif(regexp_extract(body,'\[\s*(\d{1,2})\s*점\s*\]',1),'') as int) points from (select distinct expected_id, body from expected) where body is not null")
def f14_points_tag(s, d):
    return table(s, d, "expected").select("expected_id", "body").distinct().where("body is not null").select("expected_id", T.points_tag(F.col("body")).alias("points"))


@query("proj5_role_of_text", "select doc_id, case when t='' then 'UNKNOWN' when a>=1 and a>q then 'ANSWER_KEY' when q>=1 then 'QUESTION' else 'UNKNOWN' end role from (select doc_id, t, " + "+".join(f"(contains(t,'{m}') or contains(lower(t),'{m}'))::int" for m in T.ANSWER_MARKERS) + " a, " + "+".join(f"(contains(t,'{m}') or contains(lower(t),'{m}'))::int" for m in T.QUESTION_MARKERS) + " q from (select doc_id, trim(coalesce(text,''),' ') t from documents))")
def proj5_role_of_text(s, d):
    return table(s, d, "documents").select("doc_id", T.page_role(F.col("text")).alias("role"))


@query("proj4_label_spelling", r"select distinct expected_id, regexp_replace(regexp_replace(trim(regexp_replace(label,'\s+',' ','g')),'(\d)\s*-\s*(\d)','\1-\2','g'),'^(?:서답형|단답형|서술형|주관식|논술형)\s*(\d+)$','논술형 \1') label from expected where label is not null")
def proj4_label_spelling(s, d):
    return table(s, d, "expected").where("label is not null").select("expected_id", T.norm_label(F.col("label")).alias("label")).distinct()


@query("proj20_scrub", r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,'(api[_-]?key|token|secret|password|passwd|authorization)(\s*[:=]\s*)[''"]?[^\s''"]+','\1\2<REDACTED>','gi'),'bearer\s+[a-z0-9._\-]+','Bearer <REDACTED>','gi'),'[A-Za-z]:\\[^\s''"]+','<PATH>','g'),'/(?:home|Users|tmp|var)/[^\s''"]+','<PATH>','g'),'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}','<EMAIL>','g'),'\b0\d{1,2}[-.\s]?\d{3,4}[-.\s]?\d{4}\b','<PHONE>','g') clean from documents where text is not null""")
def proj20_scrub(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.scrub(F.col("text")).alias("clean"))


@query("proj21_digest", """select id, sha256('{"checked":' || case when deleted_at is null then 'null' else '1' end || ',"id":"' || id || '","state":' || coalesce('"'||lifecycle_state||'"','null') || '}') digest from (select distinct id, deleted_at, lifecycle_state from doc_registry)""")
def proj21_digest(s, d):
    r = table(s, d, "doc_registry").select("id", "deleted_at", "lifecycle_state").distinct()
    return r.select("id", T.digest({"id": F.col("id"), "state": F.col("lifecycle_state"), "checked": F.when(F.col("deleted_at").isNotNull(), 1)}).alias("digest"))


@query("f21_candidate_id", "select distinct candidate_id, 'cand_'||substr(sha256(kind||'|'||doc_id||'|'||question_id||'|'||sha256(coalesce(value_json,''))),1,12) id from candidates")
def f21_candidate_id(s, d):
    return readings(s, d).select("candidate_id", T.candidate_id(F.col("kind"), F.col("doc_id"), F.col("question_id"), F.sha2(F.coalesce("value_json", F.lit("")), 256)).alias("id"))


@query("t4_natural_sort", r"select distinct id, array_to_string(list_transform(regexp_extract_all(lower(original_name),'\d+|\D+'), lambda p: case when regexp_matches(p,'^\d') then length(length(ltrim(p,'0'))::varchar)::varchar||length(ltrim(p,'0'))::varchar||':'||ltrim(p,'0') else p end),'') sort_key from source_assets where original_name is not null")
def t4_natural_sort(s, d):
    return table(s, d, "source_assets").where("original_name is not null").select("id", T.natural_key(F.col("original_name")).alias("sort_key")).distinct()


@query("s12_safe_filename", r"""with t as (select distinct id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(original_name,'^.*[/\\]',''),':.*$',''),'[\p{Cc}\p{Cf}]','','g'),'[<>"|?*]','_','g'),' .') t from source_assets) select distinct id, case when t='' then 'unnamed' else left(t,200) end as name from t""")
def s12_safe_filename(s, d):
    return table(s, d, "source_assets").select("id", T.safe_filename(F.col("original_name")).alias("name")).distinct()


@query("s16_tolerant_json")
def s16_tolerant_json(s, d):
    v = table(s, d, "overrides").select("override_id", T.tolerant_json(F.concat(F.lit("```json\n"), "raw_json", F.lit("\n```"))).alias("v"))
    return v.select("override_id", F.col("v").isNotNull().alias("parsed"))


# --- comparisons


@query("j7_reconcile", "with e as (select distinct id k from doc_registry), a as (select distinct document_id k from revisions where document_id is not null) select k document_id, 'missing' problem from e where k not in (select k from a) union all select k, 'extra' from a where k not in (select k from e)")
def j7_reconcile(s, d):
    e = table(s, d, "doc_registry").select(F.col("id").alias("document_id"))
    return compare.reconcile(e, table(s, d, "revisions").where("document_id is not null"), ["document_id"])


_GOLD = "g as (select exam_id, arg_min(struct_pack(a:=type,b:=points,c:=label),expected_id) r from expected group by all), p as (select exam_id, arg_max(struct_pack(a:=type,b:=points,c:=label),expected_id) r from expected group by all)"


@query("j19_fields_differ", f"with {_GOLD}, u as (select exam_id, unnest(['type','points','label']) field, unnest([g.r.a,g.r.b::varchar,g.r.c]) expected, unnest([p.r.a,p.r.b::varchar,p.r.c]) actual from g join p using(exam_id)) select * from u where expected is not null and expected is distinct from actual")
def j19_fields_differ(s, d):
    e = table(s, d, "expected")
    v = F.struct("type", "points", "label")
    g = e.groupBy("exam_id").agg(F.min_by(v, "expected_id").alias("g"), F.max_by(v, "expected_id").alias("p"))
    return compare.fields_differ(g.select("exam_id", "g.*"), g.select("exam_id", "p.*"), ["exam_id"], ["type", "points", "label"])


@query("u1_token_overlap", U1_TOKEN_OVERLAP_SQL)
def u1_token_overlap(s, d):
    return answers_and_choices(s, d).select("expected_id", compare.token_overlap(F.col("c"), F.col("answer")).alias("o")).select("expected_id", "o.*")


@query("j22_leakage", "with a as (select distinct asset_id asset, case when ascii(right(document_id,1))%4=0 then 'holdout' else 'dev' end split from source_pages where asset_id is not null) select distinct asset, split from a where split<>'holdout' and asset in (select asset from a where split='holdout')")
def j22_leakage(s, d):
    p = table(s, d, "source_pages").where("asset_id is not null and document_id is not null")
    split = F.when(F.ascii(F.right("document_id", F.lit(1))) % 4 == 0, "holdout").otherwise("dev")
    return compare.leakage(p.select(F.col("asset_id").alias("asset"), split.alias("split")), "holdout")


_RESULT = "case min(l_returnflag) when 'A' then 'PASS' when 'N' then 'REVIEW' else 'FAIL' end"


@query("a12_run_summary", f"with dd as (select distinct l_suppkey run_id, l_orderkey*10+l_linenumber item_id from lineitem), r as (select l_suppkey run_id, l_orderkey*10+l_linenumber item_id, {_RESULT} status, bool_or(l_linenumber=1) critical from lineitem where l_linestatus='F' group by 1,2), j as (select dd.*, coalesce(status,'NOT_RUN') status, critical from dd left join r using(run_id,item_id)) select run_id, count(*) declared, count(*) filter(status='PASS') pass, count(*) filter(status='FAIL') fail, count(*) filter(status='REVIEW') review, count(*) filter(status='REJECT') reject, count(*) filter(status='NOT_RUN') not_run, count(*) filter(status='PASS')::double/count(*) auto_rate, count(*) filter(status in ('REVIEW','NOT_RUN'))::double/count(*) review_rate, count(*) filter(critical and status='FAIL') critical_failures from j group by 1")
def a12_run_summary(s, d):
    lines = table(s, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), "l_linestatus", "l_returnflag", "l_linenumber")
    flag = F.min("l_returnflag")
    results = lines.where("l_linestatus = 'F'").groupBy("run_id", "item_id").agg(F.when(flag == "A", "PASS").when(flag == "N", "REVIEW").otherwise("FAIL").alias("status"), F.bool_or(F.col("l_linenumber") == 1).alias("critical"))
    return compare.run_summary(lines.select("run_id", "item_id"), results)


@query("a14_accuracy", "select exam_id, avg((answer is not null)::int) answered, avg((points>=3)::int) heavy from (select distinct expected_id, exam_id, answer, points from expected) group by 1")
def a14_accuracy(s, d):
    e = table(s, d, "expected").select("expected_id", "exam_id", F.col("answer").isNotNull().alias("answered"), (F.col("points") >= 3).alias("heavy")).distinct()
    return compare.accuracy(e, ["exam_id"], ["answered", "heavy"])


@query("s23_verify_hashes", "with m as (select id path, any_value(sha256) h from source_assets group by 1), f as (select asset_id path, min(original_sha256) h from source_pages where asset_id is not null group by 1) select coalesce(m.path,f.path) path, case when f.path is null then 'missing' when m.path is null then 'unlisted' when m.h=f.h then 'ok' else 'mismatched' end state from m full join f on m.path=f.path")
def s23_verify_hashes(s, d):
    m = table(s, d, "source_assets").groupBy(F.col("id").alias("path")).agg(F.first("sha256").alias("sha256"))
    f = table(s, d, "source_pages").where("asset_id is not null").groupBy(F.col("asset_id").alias("path")).agg(F.min("original_sha256").alias("sha256"))
    return compare.verify_hashes(m, f)


@query("j26_replays", "with r as (select event_id, user_id, event_type, props, first_value(props) over w p, row_number() over w k from events window w as (partition by user_id, event_type order by ts, event_id)) select event_id, case when k=1 then 'first' when props=p then 'replay' else 'conflict' end outcome from r")
def j26_replays(s, d):
    e = table(s, d, "events").withColumn("body_hash", F.sha2("props", 256))
    return compare.replays(e, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "outcome")


# --- histories


@query("v7_heads", "select document_id, arg_max(id, (revision_no, id)) id, max(revision_no) revision_no from revisions where document_id is not null group by 1")
def v7_heads(s, d):
    return versions.heads(table(s, d, "revisions").where("document_id is not null"))


@query("v3_stale", "with r as (select distinct id, document_id, revision_no, content_hash from revisions) select id, document_id, coalesce(b is not null and content_hash is distinct from b, false) changed from (select *, lag(content_hash) over(partition by document_id order by revision_no, id) b from r)")
def v3_stale(s, d):
    return versions.stale(table(s, d, "revisions").select("id", "document_id", "revision_no", "content_hash").distinct())


@query("v5_lineage", "with recursive n as (select distinct id, parent_revision_id p from revisions), k as (select n.id, case when q.id is not null then n.p end p from n left join n q on q.id=n.p), w as (select id, id root, 0 depth, p from k union all select w.id, k.id, depth+1, k.p from w join k on k.id=w.p) select id, arg_max(root,depth) root, max(depth)::int depth from w group by 1")
def v5_lineage(s, d):
    return versions.ancestors(table(s, d, "revisions"), "id", "parent_revision_id")


@query("v2_fold", "select user_id, event_type, arg_max(value,(ts,event_id)) as value from events group by all")
def v2_fold(s, d):
    return versions.fold(table(s, d, "events"), ["user_id"], "event_type", "value", ["ts", "event_id"])


@query("r6_lost_updates", "select event_id, coalesce(value < max(value) over(partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), false) rejected from events")
def r6_lost_updates(s, d):
    return versions.lost_updates(table(s, d, "events"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "rejected")


@query("v7_swap_heads", "with recursive o as (select *, row_number() over(partition by document_id order by revision_no, id) k from (select distinct id, document_id, revision_no, parent_revision_id from revisions where document_id is not null)), f as (select document_id, k, id, parent_revision_id, parent_revision_id is null accepted, null::varchar head, case when parent_revision_id is null then id end nxt from o where k=1 union all select o.document_id, o.k, o.id, o.parent_revision_id, o.parent_revision_id is not distinct from f.nxt, f.nxt, case when o.parent_revision_id is not distinct from f.nxt then o.id else f.nxt end from f join o on o.document_id=f.document_id and o.k=f.k+1) select document_id, id, parent_revision_id, accepted, head from f")
def v7_swap_heads(s, d):
    """Revisions as changes under the head that their parent names."""
    r = table(s, d, "revisions").select("id", "document_id", "revision_no", "parent_revision_id").where("document_id is not null").distinct()
    return versions.swap_heads(r, "document_id", ["revision_no", "id"], "id", "parent_revision_id")


@query("v9_resolved", f"with {SETTLED}, h as (select atu_id, arg_max(struct_pack(v:=value_json),(coalesce(ts,0.0),candidate_id)) x from (select *, {CLASS} c from candidates) where c='HUMAN' group by 1) select atu_id, case when x is not null then 'HUMAN_VERIFIED' else status end status, case when x is not null then x.v else value_json end value_json from settled left join h using(atu_id)")
def v9_resolved(s, d):
    """What reviewers read is their decision."""
    r = readings(s, d)
    human = r.where(evidence.evidence_class(F.col("provider")) == "HUMAN").select("atu_id", "value_json", F.coalesce("ts", F.lit(0.0)).alias("ts"), F.col("candidate_id").alias("id"))
    return versions.resolve_units(evidence.settle(r), human)


@query("r11_purge", "select distinct id, case when lifecycle_state='DELETED' and retention_deadline<=1780000000 then 'PURGED' else lifecycle_state end state from doc_registry")
def r11_purge(s, d):
    return versions.purge(table(s, d, "doc_registry"), 1_780_000_000.0).distinct()


@query("a27_fill_budget", "with recursive o as (select user_id, event_id, value, row_number() over(partition by user_id order by event_id) k from events), f as (select user_id, k, event_id, value, value<=500 accepted, case when value<=500 then value else 0.0 end spent from o where k=1 union all select o.user_id, o.k, o.event_id, o.value, f.spent+o.value<=500, case when f.spent+o.value<=500 then f.spent+o.value else f.spent end from f join o on o.user_id=f.user_id and o.k=f.k+1) select user_id, event_id, value, accepted from f")
def a27_fill_budget(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "value")
    return versions.fill_budget(e, "user_id", "event_id", "value", 500.0)


@query("proj11_access", "with m as (select s_suppkey%97 user_id, 't'||(s_nationkey%5) tenant_id, min(case when s_acctbal>5000 then 'OWNER' else 'VIEWER' end) r from supplier group by all), g as (select user_id%97 user_id, event_type doc_id, min('EDITOR') r from events where event_type='click' group by all), q as (select event_id request_id, user_id%97 user_id, 't'||(user_id%5) tenant_id, event_type doc_id, case when event_id%2=0 then 'read' else 'write' end act from events) select request_id, coalesce(m.r,g.r) as role, case coalesce(m.r,g.r) when 'OWNER' then true when 'EDITOR' then true when 'VIEWER' then act='read' else false end allowed from q left join m using(user_id,tenant_id) left join g using(user_id,doc_id)")
def proj11_access(s, d):
    e = table(s, d, "events")
    user = (F.col("user_id") % 97).alias("user_id")
    members = table(s, d, "supplier").groupBy((F.col("s_suppkey") % 97).alias("user_id"), F.concat(F.lit("t"), (F.col("s_nationkey") % 5).cast("string")).alias("tenant_id")).agg(F.min(F.when(F.col("s_acctbal") > 5000, "OWNER").otherwise("VIEWER")).alias("member_role"))
    grants = e.where("event_type = 'click'").select(user, F.col("event_type").alias("doc_id"), F.lit("EDITOR").alias("grant_role")).distinct()
    requests = e.select(F.col("event_id").alias("request_id"), user, F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"), F.col("event_type").alias("doc_id"), F.when(F.col("event_id") % 2 == 0, "read").otherwise("write").alias("action"))
    actions = s.createDataFrame([("OWNER", "read"), ("OWNER", "write"), ("EDITOR", "read"), ("EDITOR", "write"), ("VIEWER", "read")], "role string, action string")
    return versions.access(requests, members, grants, actions)


@query("x3_last_known", "select document_id, arg_max(manifest_id,(revision_no,id)) filter(manifest_id is not null) manifest_id, arg_max(metadata_snapshot,(revision_no,id)) filter(metadata_snapshot is not null) metadata_snapshot from revisions where document_id is not null group by 1")
def x3_last_known(s, d):
    return ordered.last_known(table(s, d, "revisions").where("document_id is not null"), ["document_id"], ["revision_no", "id"], ["manifest_id", "metadata_snapshot"])
