"""Queries of streams, files, formulas and pixels."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import mathexpr, raster
from lodestone.sources import files
from lodestone.sources.tables import shared_dir, table
from lodestone.streaming import jobs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def events(s, d):
    return jobs.event_stream(s, f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")



def _ddl(df) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


@query("r1_numbered_events", "select event_id, row_number() over(partition by user_id order by ts, event_id) seq from events")
def r1_numbered_events(s, d):
    e = events(s, d)
    return jobs.drain(s, jobs.numbered(e, "user_id", ["ts", "event_id"], _ddl(e)).select("event_id", "seq"))


@query("r8_rate_limited")
def r8_rate_limited(s, d):
    e = events(s, d)
    return jobs.drain(s, jobs.rate_limited(e, "user_id", "ts", ["ts", "event_id"], _ddl(e), 3600.0, 2).select("event_id", "accepted"))


@query("r5_lapsed_leases", "with e as (select user_id, epoch_us(ts)/1000000.0 t, lag(epoch_us(ts)/1000000.0) over(partition by user_id order by ts, event_id) b from events) select user_id, b+36000.0 lapsed_at from e where t-b>36000")
def r5_lapsed_leases(s, d):
    return jobs.drain(s, jobs.lapsed_leases(events(s, d), "user_id", "ts", ["ts", "event_id"], 36000.0))


@query("r9_without_repeats", "select distinct user_id, event_type from events")
def r9_without_repeats(s, d):
    return jobs.drain(s, jobs.without_repeats(events(s, d), ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"))


@query("r2_window_counts", "select date_trunc('hour', ts) \"start\", event_type, count(*) n from events group by all")
def r2_window_counts(s, d):
    return jobs.drain(s, jobs.window_counts(events(s, d), "ts", ["event_type"]), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("s2_documents_of_tenant", "select distinct id, tenant_id, lifecycle_state from doc_registry where tenant_id='ten_pine'")
def s2_documents_of_tenant(s, d):
    at = f"{shared_dir(s)}/documents-{uuid.uuid4().hex}"
    docs = table(s, d, "doc_registry").select("id", "tenant_id", "lifecycle_state").distinct()
    files.save_documents(docs, at)
    return files.load_documents(s, at, docs.schema, "ten_pine")


@query("s10_log_fold", "select event_type stage, count(*) runs, count(*) filter(event_type='error' or value<10) failed, sum(value) \"seconds\" from events group by 1")
def s10_log_fold(s, d):
    at = f"{shared_dir(s)}/log-{uuid.uuid4().hex}"
    e = table(s, d, "events")
    files.save_documents(e.select(F.col("event_type").alias("stage"), ((F.col("event_type") != "error") & (F.col("value") >= 10)).alias("ok"), F.col("value").alias("duration_s")), at, "append")
    return files.fold_log(s, at, "stage string, ok boolean, duration_s double")


@query("s19_uncached", "select distinct user_id, event_type from events where (user_id, event_type) not in (select (user_id, event_type) from events where value>90)")
def s19_uncached(s, d):
    e = table(s, d, "events")
    cache = e.where("value > 90").select(F.sha2(F.to_json(F.struct("user_id", "event_type")), 256).alias("cache_key")).distinct()
    return files.uncached(e, cache, ["user_id", "event_type"])[1].select("user_id", "event_type")


def equations(s, d):
    v = table(s, d, "variants").select("variant_id", "new_equations").distinct()
    return v.select("variant_id", F.posexplode("new_equations").alias("place", "latex"))


@query("m9_linear_script")
def m9_linear_script(s, d):
    return equations(s, d).select("variant_id", "place", mathexpr.linear_udf("latex").alias("script"))


@query("m10_equal_equations")
def m10_equal_equations(s, d):
    """Each equation of a variant against the one at its place in the variant before it of the same question."""
    v = table(s, d, "variants").select("question_id", "variant_id", "new_equations").distinct()
    e = v.select("question_id", "variant_id", F.posexplode("new_equations").alias("place", "latex"))
    before = F.lag(F.struct("variant_id", "latex")).over(Window.partitionBy("question_id", "place").orderBy("variant_id"))
    pairs = e.withColumn("b", before).where("b is not null")
    return pairs.select("variant_id", F.col("b.variant_id").alias("other_id"), "place", mathexpr.compare_udf("latex", F.col("b.latex")).alias("verdict"))


@query("m12_solutions")
def m12_solutions(s, d):
    return equations(s, d).select("variant_id", "place", mathexpr.solve_udf("latex").alias("solutions")).where("solutions is not null")


@query("m13_components")
def m13_components(s, d):
    """Components of the sign pattern of each vector, laid out in rows of eight."""
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "01").otherwise("00")), "")
    pages = table(s, d, "embeddings").select("vec_id", F.lit(8).alias("width"), F.unhex(bits).alias("pixels"))
    return raster.component_table(pages, "vec_id")
