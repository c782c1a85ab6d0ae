"""Queries of ordered, spatial and figure operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import leases, nested, ordered, scenes, spatial
from lodestone.plans.pipeline_queries import variants
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


def boxes(s: SparkSession, d: str) -> DataFrame:
    """Order lines as boxes on pages; rows that are equal in all of these are one."""
    line = table(s, d, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("page"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
        (F.col("l_discount") * 100).alias("w"), F.col("l_tax").alias("h"), F.lit(50.0).alias("page_width"), F.lit(105000.0).alias("page_height"), F.col("l_partkey").alias("pos"),
    ).distinct()


_BOX = "b as (select distinct l_orderkey doc_id, l_linenumber%3 page, l_quantity x, l_extendedprice y, l_discount*100 w, l_tax h, 50.0::double page_width, 105000.0::double page_height, l_partkey pos from lineitem)"
_ORD = "o as (select *, case when x+w/2>page_width/2 then 1 else 0 end column_no from b), p as (select *, row_number() over(partition by doc_id order by page, column_no, y, x, pos) place from o)"


@query("w1_reading_order", f"with {_BOX}, {_ORD} select doc_id, page, column_no, x, y, place::int place from p")
def w1_reading_order(s, d):
    return ordered.reading_order(boxes(s, d), ["doc_id"]).select("doc_id", "page", "column_no", "x", "y", "place")


@query("w2_extend_regions", f"with {_BOX}, {_ORD}, n as (select *, lead(y) over(partition by doc_id, page, column_no order by y, pos) nx from p) select doc_id, page, x, y, greatest(h, case when nx is not null then nx-6.0 else least(page_height-6.0, y+3.0*h) end - y) h from n")
def w2_extend_regions(s, d):
    return ordered.extend_regions(ordered.reading_order(boxes(s, d), ["doc_id"]), ["doc_id", "page"]).select("doc_id", "page", "x", "y", "h")


@query("w3_widest_gap", "with v as (select user_id, value v, lead(value) over(partition by user_id order by value) nx, min(value) over(partition by user_id) lo, max(value) over(partition by user_id) hi from events), m as (select user_id, nx-v gap, (v+nx)/2 mid from v where (v+nx)/2>=lo+0.3*(hi-lo) and (v+nx)/2<=lo+0.7*(hi-lo)) select user_id, gap, min(mid) middle from m where (user_id,gap) in (select (user_id,max(gap)) from m group by user_id) group by all")
def w3_widest_gap(s, d):
    return ordered.widest_gap(table(s, d, "events"), ["user_id"], "value")


@query("w4_blocks", "with e as (select *, case when floor(value) between 1 and 99 then floor(value) end v from events), m as (select *, coalesce(v>coalesce(max(v) over(partition by user_id order by event_id rows between unbounded preceding and 1 preceding),0),false) opens from e) select user_id, event_id, opens, sum(opens::int) over(partition by user_id order by event_id)::bigint as block from m")
def w4_blocks(s, d):
    return ordered.blocks(table(s, d, "events"), ["user_id"], "event_id", F.floor("value")).select("user_id", "event_id", "opens", "block")


@query("w6_unique_labels", "with e as (select distinct expected_id, exam_id, type from expected) select expected_id, case when k=1 then type else type||'·'||k end unique_label from (select *, row_number() over(partition by exam_id, type order by expected_id) k from e)")
def w6_unique_labels(s, d):
    e = table(s, d, "expected").select("expected_id", "exam_id", "type").distinct()
    return ordered.unique_labels(e, ["exam_id"], "type", "expected_id").select("expected_id", "unique_label")


@query("w7_renumber_subs", "with e as (select distinct l_orderkey, l_extendedprice p, (l_partkey%3)||'-'||l_linenumber as label from lineitem), g as (select *, split_part(label,'-',1) par, row_number() over(partition by l_orderkey, split_part(label,'-',1) order by p, label) k, count(*) over(partition by l_orderkey, split_part(label,'-',1)) n from e), u as (select l_orderkey, par, count(distinct label) du from g group by all) select l_orderkey, p, label, case when du<n then par||'-'||k else label end new_label from g join u using(l_orderkey,par)")
def w7_renumber_subs(s, d):
    e = table(s, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("p"), F.concat((F.col("l_partkey") % 3).cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("label")).distinct()
    e = e.withColumn("o", F.struct("p", "label"))
    return ordered.renumber_subs(e, ["l_orderkey"], "label", "o").drop("o")


@query("w9_grid", "with e as (select distinct expected_id, exam_id from expected), k as (select *, row_number() over(partition by exam_id order by expected_id)-1 k from e) select expected_id, (k%2)::int grid_column, (k//2)::bigint grid_row from k")
def w9_grid(s, d):
    e = table(s, d, "expected").select("expected_id", "exam_id").distinct()
    return ordered.grid(e, ["exam_id"], "expected_id").select("expected_id", "grid_column", "grid_row")


_BANDS = "(values ('STANDARD',40),('ECONOMY',25),('PROMO',100000),('NONE',3)) q(p_type,quota)"


@query("w10_quota", f"select p_partkey, p_type from (select p.*, quota, row_number() over(partition by p_type order by p_partkey) k from part p join {_BANDS} using(p_type)) where k<=quota")
def w10_quota(s, d):
    q = s.createDataFrame([("STANDARD", 40), ("ECONOMY", 25), ("PROMO", 100000), ("NONE", 3)], "p_type string, quota int")
    return ordered.quota(table(s, d, "part"), "p_type", "p_partkey", q)[0].select("p_partkey", "p_type")


@query("w10_shortfall", f"with g as (select p_type, count(*) n from part group by 1) select p_type, quota, least(quota,coalesce(n,0))::bigint got, (quota-least(quota,coalesce(n,0)))::bigint short from {_BANDS} left join g using(p_type)")
def w10_shortfall(s, d):
    q = s.createDataFrame([("STANDARD", 40), ("ECONOMY", 25), ("PROMO", 100000), ("NONE", 3)], "p_type string, quota int")
    return ordered.quota(table(s, d, "part"), "p_type", "p_partkey", q)[1]


@query("w11_within_budget", "with e as (select *, sum(value) over(partition by user_id order by value, event_id rows between unbounded preceding and current row) spent from events) select user_id, event_id from e where spent<=100")
def w11_within_budget(s, d):
    return ordered.within_budget(table(s, d, "events"), ["user_id"], "value", "event_id", 100.0).select("user_id", "event_id")


def body_lines(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "expected").select("expected_id", "body").distinct().where("body is not null")
    return e.select("expected_id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))


@query("w12_joined_lines", r"with l as (select expected_id, unnest(string_split(body,chr(10))) line, generate_subscripts(string_split(body,chr(10)),1) no from (select distinct expected_id, body from expected where body is not null)), b as (select *, rtrim(lag(line) over w,' ') bf from l window w as (partition by expected_id order by no)), f as (select *, sum((not coalesce(bf<>'' and not regexp_matches(bf,'[.?!:。]$') and regexp_matches(ltrim(line,' '),'^[a-z0-9+\-×÷=≤≥<>()]'),false))::int) over(partition by expected_id order by no) g from b) select expected_id, g::bigint line_group, string_agg(trim(line,' '),' ' order by no) as text from f group by 1,2")
def w12_joined_lines(s, d):
    return ordered.joined_lines(body_lines(s, d), ["expected_id"], "line_no", "line")


@query("w13_longest_run", "with e as (select *, event_type in ('click','view') o from events), i as (select *, row_number() over(partition by user_id order by event_id)-sum(o::int) over(partition by user_id order by event_id) g from e), r as (select user_id, g, count(*) filter(o) n from i group by all) select user_id, max(n) longest from r group by 1")
def w13_longest_run(s, d):
    return ordered.longest_run(table(s, d, "events"), ["user_id"], "event_id", F.col("event_type").isin("click", "view"))


@query("w15_rate_window", "select event_id, count(*) over(partition by user_id order by epoch_us(ts)//1000000 range between 3600 preceding and current row) in_window from events")
def w15_rate_window(s, d):
    return ordered.rate_window(table(s, d, "events"), ["user_id"], F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint"), 3600).select("event_id", "in_window")


@query("w16_chunks", "with e as (select distinct expected_id, exam_id from expected) select expected_id, ((row_number() over(partition by exam_id order by expected_id)-1)//10)::bigint as chunk from e")
def w16_chunks(s, d):
    return ordered.chunks(table(s, d, "expected").select("expected_id", "exam_id").distinct(), ["exam_id"], ["expected_id"]).select("expected_id", "chunk")


@query("w17_illegal_steps", "with e as (select *, lag(event_type) over(partition by user_id order by ts, event_id) before from events) select event_id, before, event_type from e where before is not null and before||'>'||event_type not in ('signup>view','view>click','click>purchase','view>view','click>view','purchase>view')")
def w17_illegal_steps(s, d):
    ok = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view")]
    return ordered.illegal_steps(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", ok).select("event_id", "before", "event_type")


@query("t1_job_claim", "select o_orderkey, o_orderpriority from orders where o_orderstatus='O' order by o_orderpriority, o_orderdate, o_orderkey limit 1")
def t1_job_claim(s, d):
    return table(s, d, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderpriority")


_JOBS = "(select o_orderkey id, case o_orderstatus when 'O' then 'QUEUED' when 'P' then 'RUNNING' else 'SUCCEEDED' end state, 6-left(o_orderpriority,1)::int priority, o_orderdate created_at, case o_orderkey%3 when 1 then 999.0 when 2 then 1001.0 end lease_expires_at, case when o_orderkey%5=0 then 1001.0 else 0.0 end not_before, (o_orderkey%4)::int attempt from orders)"


def jobs(s, d):
    """Orders as jobs, of which some are held by a worker."""
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("SUCCEEDED")
    return table(s, d, "orders").select(
        k.alias("id"), state.alias("state"), (6 - F.left("o_orderpriority", F.lit(1)).cast("int")).alias("priority"), F.col("o_orderdate").alias("created_at"),
        F.when(k % 3 == 1, 999.0).when(k % 3 == 2, 1001.0).alias("lease_expires_at"), F.when(k % 5 == 0, 1001.0).otherwise(0.0).alias("not_before"), (k % 4).cast("int").alias("attempt"),
    )


@query("r3_claims", f"with j as (select *, row_number() over(order by priority desc, created_at, id) k from {_JOBS} where state in ('QUEUED','RUNNING') and not_before<=1000 and (lease_expires_at is null or lease_expires_at<1000)), w as (select n_name as owner, row_number() over(order by n_name) k from nation) select id, owner, 'lease_'||substr(sha256(id||'|'||(attempt+1)),1,12) as token, 1090.0 lease_expires_at, attempt+1 attempt from j join w using(k)")
def r3_claims(s, d):
    return leases.claim(jobs(s, d), table(s, d, "nation").select(F.col("n_name").alias("worker")), 1000.0)


@query("r7_cancelled", f"select id, case when state is null then 'NOT_FOUND' when state='SUCCEEDED' then 'ALREADY_COMPLETED' else 'REQUESTED' end outcome, case when state='RUNNING' then 'CANCEL_REQUESTED' else state end state from (select distinct l_orderkey-(l_linenumber//6) id from lineitem) left join {_JOBS} using(id)")
def r7_cancelled(s, d):
    asked = table(s, d, "lineitem").select((F.col("l_orderkey") - F.floor(F.col("l_linenumber") / 6)).alias("id"))
    return leases.cancel(jobs(s, d), asked, 1000.0)


@query("r3_fenced_writes", f"select l_orderkey*10+l_linenumber write_id, case when state is null or state<>'RUNNING' or l_linenumber%4<>attempt then 'STALE_LEASE' when id%7=0 then 'ALREADY_CANCELLED' else 'COMMITTED' end outcome from lineitem left join {_JOBS} on id=l_orderkey")
def r3_fenced_writes(s, d):
    """Lines as writes to their orders; the attempt is the token."""
    held = jobs(s, d).withColumns({"token": F.col("attempt").cast("string"), "cancel_requested_at": F.when(F.col("id") % 7 == 0, 990.0)})
    w = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("write_id"), F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 4).cast("string").alias("token"))
    return leases.fenced(w, held)


@query("t2_audit_top", "select event_id, user_id, event_type from events order by ts desc, event_id desc limit 200")
def t2_audit_top(s, d):
    return table(s, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(200).select("event_id", "user_id", "event_type")


@query("t3_after_cursor", "select event_id, seq from (select event_id, row_number() over(partition by user_id order by ts, event_id) seq from events) where seq>25")
def t3_after_cursor(s, d):
    return ordered.chunks(table(s, d, "events"), ["user_id"], ["ts", "event_id"], 1).select("event_id", (F.col("chunk") + 1).cast("int").alias("seq")).where("seq > 25")


@query("t5_moved", "with l as (select distinct l_orderkey, l_partkey k from lineitem), p as (select *, row_number() over(partition by l_orderkey order by k)-1 pos, max(k) over(partition by l_orderkey) mk from l), t as (select *, case when k=mk then 1 end tg, count(*) over(partition by l_orderkey) n from p), r as (select *, row_number() over(partition by l_orderkey order by (tg is not null)::int, pos)-1 rest, least(1,n-1) goal from t) select l_orderkey, k, (case when tg is not null then goal when rest<goal then rest else rest+1 end)::int place from r")
def t5_moved(s, d):
    from pyspark.sql import Window

    p = table(s, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("k")).distinct()
    p = p.withColumn("target", F.when(F.col("k") == F.max("k").over(Window.partitionBy("l_orderkey")), 1))
    return ordered.moved(p, ["l_orderkey"], "k", "k", "target")


@query("t7_shuffled")
def t7_shuffled(s, d):
    return ordered.shuffled(table(s, d, "part").select("p_partkey"), ["p_partkey"], 7)


_REV = "from revisions where revision_no is not null and document_id is not null"


@query("t8_gaps", f"with g as (select document_id, min(revision_no) lo, max(revision_no) hi {_REV} group by 1), a as (select document_id, unnest(generate_series(lo,hi))::int missing from g) select * from a where (document_id,missing) not in (select (document_id,revision_no) {_REV})")
def t8_gaps(s, d):
    return ordered.gaps(table(s, d, "revisions").where("document_id is not null"), ["document_id"], "revision_no")


@query("t8_gaps_from_one", f"with g as (select document_id, max(revision_no) hi {_REV} group by 1), a as (select document_id, unnest(generate_series(1,hi))::int missing from g) select * from a where (document_id,missing) not in (select (document_id,revision_no) {_REV})")
def t8_gaps_from_one(s, d):
    return ordered.gaps(table(s, d, "revisions").where("document_id is not null"), ["document_id"], "revision_no", from_one=True)


@query("t9_first_wins", "select user_id, event_type, arg_min(value,(ts,event_id)) as value from events group by all")
def t9_first_wins(s, d):
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("value"))


@query("c2_consecutive", "with e as (select *, (event_type is distinct from lag(event_type) over(partition by user_id order by ts, event_id) or row_number() over(partition by user_id order by ts, event_id)=1)::int nw from events), r as (select *, sum(nw) over(partition by user_id order by ts, event_id) run from e) select user_id, run::bigint run, event_type, count(*) n from r group by all")
def c2_consecutive(s, d):
    return ordered.consecutive(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("c3_last_event", "select user_id, arg_max(event_type,(ts,event_id)) last_type, count(distinct event_type) kinds from events group by 1")
def c3_last_event(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count_distinct("event_type").alias("kinds"))


# --- boxes and figures


def part_boxes(s, d) -> DataFrame:
    p = table(s, d, "part")
    return p.select("p_brand", F.col("p_partkey").alias("id"), (F.col("p_size") * 1.0).alias("x"), (F.col("p_retailprice") / 10).alias("y"), F.lit(4.0).alias("w"), F.lit(9.0).alias("h"))


_PART = "b as (select p_brand, p_partkey id, p_size*1.0::double x, p_retailprice/10 y, 4.0::double w, 9.0::double h from part)"


@query("j8_overlaps", f"with {_PART} select a.p_brand, a.id a_id, b.id b_id, (least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*(least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y))/least(a.w*a.h,b.w*b.h) share from b a join b on a.p_brand=b.p_brand and a.x<b.x+b.w and b.x<a.x+a.w and a.y<b.y+b.h and b.y<a.y+a.h")
def j8_overlaps(s, d):
    b = part_boxes(s, d)
    return spatial.overlap_join(b, b, ["p_brand"], 16.0)


@query("a18_box_union", f"with {_PART} select p_brand, min(x) x, min(y) y, max(x+w)-min(x) w, max(y+h)-min(y) h from b group by 1")
def a18_box_union(s, d):
    return spatial.box_union(part_boxes(s, d), ["p_brand"])


@query("j15_segment_relations", "with g as (select p_partkey//20 figure, p_partkey id, 'n'||(p_partkey%5) p, 'n'||(p_partkey%7) q, degrees(atan2((p_size%7)-3.0, (p_partkey%11)-5.0)) d0, sqrt(((p_partkey%11)-5.0)*((p_partkey%11)-5.0)+((p_size%7)-3.0)*((p_size%7)-3.0)) z from part where (p_partkey%11)<>5 or p_size%7<>3), s as (select *, d0-180.0*floor(d0/180.0) dg from g), j as (select a.figure, a.id a, b.id b, a.p in (b.p,b.q) or a.q in (b.p,b.q) sh, least(abs(a.dg-b.dg),180-abs(a.dg-b.dg)) d, abs(a.z-b.z)<=0.04*greatest(a.z,b.z) eq from s a join s b on a.figure=b.figure and a.id<b.id) select figure, a, b, 'intersection' relation from j where sh union all select figure, a, b, 'parallel' from j where not sh and d<=3 union all select figure, a, b, 'perpendicular' from j where abs(d-90)<=3 union all select figure, a, b, 'equal_length' from j where eq")
def j15_segment_relations(s, d):
    dx, dy = (F.col("p_partkey") % 11) - 5.0, (F.col("p_size") % 7) - 3.0
    name = lambda k: F.concat(F.lit("n"), (F.col("p_partkey") % k).cast("string"))
    seg = table(s, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("figure"), F.col("p_partkey").alias("id"), name(5).alias("p"), name(7).alias("q"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), dx.alias("x2"), dy.alias("y2")).where("x2 <> 0 or y2 <> 0")
    return spatial.segment_relations(seg, ["figure"])


@query("m6_unmap_point", "select p_partkey, (p_size/2.0-3.0) x, (p_retailprice/2.0-4.0) y from part")
def m6_unmap_point(s, d):
    step = lambda kind, **p: F.struct(F.lit(kind).alias("kind"), F.struct(*[F.lit(float(p.get(k, 0.0))).alias(k) for k in ("factor", "dx", "dy", "deg")]).alias("params"))
    chain = F.array(step("offset", dx=3, dy=4), step("scale", factor=2))
    return table(s, d, "part").select("p_partkey", spatial.unmap_point(F.col("p_size"), F.col("p_retailprice"), chain).alias("u")).select("p_partkey", "u.x", "u.y")


def figures(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, relations and labels of the figures in the revisions' content."""
    n = nested.flatten(variants(s, d, "revisions", "id", "content_json"), "id", "v")
    scene = lambda depth: F.concat_ws("#", "root_id", F.regexp_extract("node", r"^(.*figures(?:\[\d+\])?)", 1))
    get = lambda p, t: F.try_variant_get("value", p, t)
    refs = F.coalesce(get("$.refs", "array<string>"), F.array().cast("array<string>"))
    nodes = n.where("path rlike 'figures(\\\\[\\\\])?[.]scene[.]primitives(\\\\[\\\\])?$' and is_object").select(scene(0).alias("scene_id"), get("$.id", "string").alias("id"), get("$.kind", "string").alias("kind"), refs.alias("refs"), F.coalesce(get("$.props", "map<string,double>"), F.create_map().cast("map<string,double>")).alias("props"))
    edges = n.where("path rlike 'figures(\\\\[\\\\])?[.]scene[.]relations(\\\\[\\\\])?$' and is_object").select(scene(0).alias("scene_id"), get("$.kind", "string").alias("kind"), refs.alias("refs"))
    labels = n.where("path rlike 'figures(\\\\[\\\\])?[.]labels$' and is_object").select(scene(0).alias("scene_id"), F.explode(get("$", "map<string,string>")).alias("node_id", "text"))
    return nodes, edges, labels


@query("proj8_scene_errors")
def proj8_scene_errors(s, d):
    return scenes.validate(*figures(s, d))


@query("j12_scene_issues")
def j12_scene_issues(s, d):
    nodes, edges, _ = figures(s, d)
    return scenes.inconsistent(nodes, edges)


@query("u2_multiset_diff", "with e as (select l_orderkey, l_returnflag, count(*) n from lineitem where l_linenumber<=3 group by all), a as (select l_orderkey, l_returnflag, count(*) n from lineitem where l_linenumber>3 group by all) select coalesce(e.l_orderkey,a.l_orderkey) l_orderkey, coalesce(e.l_returnflag,a.l_returnflag) l_returnflag, coalesce(e.n,0) expected, coalesce(a.n,0) actual from e full join a on e.l_orderkey=a.l_orderkey and e.l_returnflag=a.l_returnflag where coalesce(e.n,0)<>coalesce(a.n,0)")
def u2_multiset_diff(s, d):
    line = table(s, d, "lineitem")
    return scenes.multiset_diff(line.where("l_linenumber <= 3"), line.where("l_linenumber > 3"), ["l_orderkey", "l_returnflag"])
