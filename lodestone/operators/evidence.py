"""What providers read, counted as evidence: consensus, classes, reviews and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_key(provider: Column) -> Column:
    """Independent source of a reading: all of the ``reference`` family are one."""
    p = F.btrim(F.coalesce(provider, F.lit("")))
    return F.when(p.startswith("reference"), "reference").otherwise(p)


#: Prefixes of providers and the class of their evidence, the first that fits.
CLASSES = {"HUMAN": ["human", "user", "reviewer"], "SOURCE": ["reference", "native_pdf", "pdf_text"], "CONSISTENCY": ["math_checker", "sympy", "manifest", "hash"]}


def evidence_class(provider: Column) -> Column:
    """HUMAN, SOURCE, CONSISTENCY or OBSERVATION, by the provider's prefix."""
    p = F.lower(F.btrim(F.coalesce(provider, F.lit(""))))
    return F.coalesce(*[F.when(p.rlike(f"^({'|'.join(xs)})"), c) for c, xs in CLASSES.items()], F.lit("OBSERVATION"))


def settle(readings: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Status, value and note of each unit from its readings (A1, A2).

    ``units`` (``atu_id, status, value_json``, one row each) are all units there are: one that a person has
    verified (HUMAN_VERIFIED) keeps its value and status, whatever was read; one without a reading is UNREADABLE. Without
    ``units``, those with readings are there.

    ``readings``: ``atu_id, provider, value_json``. Values are compared as JSON text, so
    ``3``, ``3.0`` and ``"3"`` are three values; null is a value of its own. Two independent
    sources that agree verify a value, one alone doesn't, disagreement is a conflict whose
    note names the sources of every value. Confidence never decides. Two levels of
    aggregation, each with a partial step before its shuffle.
    """
    value = F.coalesce("value_json", F.lit("null"))
    by_value = readings.groupBy("atu_id", value.alias("v")).agg(F.collect_set(source_key(F.col("provider"))).alias("keys"), F.count("*").alias("n"))
    short = F.when(F.length("v") <= 40, F.col("v")).otherwise(F.concat(F.substring("v", 1, 37), F.lit("...")))
    part = F.concat(short, F.lit("<-"), F.array_join(F.array_sort("keys"), "/"))
    one = by_value.groupBy("atu_id").agg(
        F.count("*").alias("values"), F.sum("n").alias("readings"), F.min("v").alias("v"), F.max(F.size("keys")).alias("sources"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("v").alias("v"), part.alias("p")))), lambda x: x["p"]), "; ").alias("parts"),
    )
    agreed = (F.col("values") == 1) & (F.col("sources") >= 2)
    if units is not None:
        u = units.select("atu_id", F.coalesce(F.col("status") == "HUMAN_VERIFIED", F.lit(False)).alias("human"), F.col("value_json").alias("own"))
        every, human = one.join(u, "atu_id", "right"), F.col("human")
        return every.select(
            "atu_id",
            F.when(human, "HUMAN_VERIFIED").when(F.col("values").isNull(), "UNREADABLE").when(F.col("values") > 1, "CONFLICT").when(agreed, "AUTO_VERIFIED").otherwise("UNVERIFIED").alias("status"),
            F.when(human, F.col("own")).when(agreed, F.col("v")).alias("value_json"),
            F.when(human | F.col("values").isNull(), F.lit(None)).when(F.col("values") > 1, F.concat(F.lit("conflict:"), "parts")).when(agreed, F.concat(F.lit("independent_sources:"), F.col("sources").cast("string"))).otherwise("single_source").alias("note"),
            F.coalesce("readings", F.lit(0)).alias("readings"),
        )
    return one.select(
        "atu_id",
        F.when(F.col("values") > 1, "CONFLICT").when(agreed, "AUTO_VERIFIED").otherwise("UNVERIFIED").alias("status"),
        F.when(agreed, F.col("v")).alias("value_json"),
        F.when(F.col("values") > 1, F.concat(F.lit("conflict:"), "parts")).when(agreed, F.concat(F.lit("independent_sources:"), F.col("sources").cast("string"))).otherwise("single_source").alias("note"),
        "readings",
    )


def bundle(readings: DataFrame) -> DataFrame:
    """Readings of each class per unit (A3)."""
    c = evidence_class(F.col("provider"))
    return readings.groupBy("atu_id").agg(*[F.count_if(c == k).alias(k.lower()) for k in ("SOURCE", "OBSERVATION", "CONSISTENCY", "HUMAN")])


def histogram(df: DataFrame, by: list[str], column: str, domain: list[str]) -> DataFrame:
    """Counts of every value of a fixed domain for each group, zeros included."""
    keys = df.select(*by).distinct().withColumn(column, F.explode(F.array(*[F.lit(x) for x in domain])))
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    return keys.join(counts, [*by, column], "left").select(*by, column, F.coalesce("n", F.lit(0)).alias("n"))


def draft_safe(readings: DataFrame, least: float = 0.7) -> DataFrame:
    """Units that only one value was read for, surely enough: ``atu_id, value_json, confidence``."""
    sure = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    g = readings.groupBy("atu_id").agg(F.count_distinct(F.coalesce("value_json", F.lit("null"))).alias("k"), F.max(sure).alias("confidence"), F.min("value_json").alias("value_json"))
    return g.where((F.col("k") == 1) & (F.col("confidence") >= least)).select("atu_id", "value_json", "confidence")


def agreed_value(readings: DataFrame) -> DataFrame:
    """The one non-empty value of a unit, numbers and strings alike, else null."""
    v = F.nullif(F.btrim(F.regexp_replace("value_json", r'^"(.*)"$', "$1")), F.lit(""))
    v = F.when(v != "null", v)
    return readings.groupBy("atu_id").agg(F.count_distinct(v).alias("k"), F.min(v).alias("v")).select("atu_id", F.when(F.col("k") == 1, F.col("v")).alias("agreed"))


def restoration_confidence(settled: DataFrame, units: DataFrame) -> DataFrame:
    """Verified units as a share of those with readings, for each question; 0 without any."""
    j = units.select("question_id", "atu_id").distinct().join(settled.select("atu_id", "status"), "atu_id", "left")
    return j.groupBy("question_id").agg(F.coalesce(F.try_divide(F.count_if(F.col("status").isin("AUTO_VERIFIED", "HUMAN_VERIFIED")), F.count("status")), F.lit(0.0)).alias("confidence"))


def expected_manifest(readings: DataFrame) -> DataFrame:
    """What a question must have, by what was read: fields, number of equations."""
    read = readings.where("field is not null and value_json is not null and value_json <> 'null'")
    return read.groupBy("question_id").agg(F.array_sort(F.collect_set("field")).alias("fields"), F.count_distinct(F.when(F.col("field").startswith("equation:"), F.col("field"))).alias("equations"))


def merged_units(readings: DataFrame) -> DataFrame:
    """Units after merging readings of one question, kind and field; a reading without a field stays alone."""
    key = F.when(F.col("field").isNotNull(), F.concat_ws("|", "question_id", "kind", "field")).otherwise(F.concat(F.lit("#"), F.col("candidate_id").cast("string")))
    return readings.groupBy("question_id", "kind", "field", key.alias("unit_key")).agg(F.count("*").alias("readings")).select("question_id", "kind", "field", "readings")


#: Kinds of units and the counter that their conflicts go to (all others: text); kinds of flags that count.
BUCKETS = {"number": "number", "question_number": "number", "points": "number", "choice": "choice", "math_symbol": "math", "variable": "math", "unit": "math", "angle": "figure", "length": "figure", "figure_label": "figure"}
FLAGS = ["missing_condition", "logic_conflict", "unsolvable_question", "ambiguous_answer", "invalid_figure", "math_check_failed"]


def gate(settled: DataFrame, units: DataFrame, numbers: DataFrame, questions: DataFrame | None = None, regions: DataFrame | None = None, pages: DataFrame | None = None, problems: DataFrame | None = None, flags: DataFrame | None = None) -> DataFrame:
    """Counters of a document: unverified, conflicts by kind, duplicate and missing numbers.

    ``units``: ``doc_id, atu_id, kind``; ``numbers``: ``doc_id, number``. What else is known adds counters: ``questions``
    (``doc_id, has_content``) those without content, ``regions`` (``doc_id, decision``) those whose decision is
    REVIEW_REQUIRED, ``pages`` (``doc_id, failed``) those not processed, ``problems`` (``doc_id``) mismatches of
    the manifest, ``flags`` (``doc_id, kind``) each kind of flag. A document is one that has a unit; it passes when
    all counters are 0.
    """
    kind = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in BUCKETS.items()], F.lit("text"))
    j = units.select("doc_id", "atu_id", "kind").distinct().join(settled.select("atu_id", "status"), "atu_id")
    conflict = lambda b: F.count_if((F.col("status") == "CONFLICT") & (kind == b)).alias(f"{b}_conflict")
    out = j.groupBy("doc_id").agg(F.count_if(F.col("status") == "UNVERIFIED").alias("unverified"), *[conflict(b) for b in ("number", "choice", "math", "figure", "text")])
    n = numbers.where("number is not null").groupBy("doc_id", "number").agg(F.count("*").alias("times"))
    more = [n.groupBy("doc_id").agg((F.max("number") - F.min("number") + 1 - F.count("*")).alias("gaps"), F.count_if(F.col("times") > 1).alias("duplicates"))]
    if questions is not None:
        more.append(questions.groupBy("doc_id").agg(F.count_if(~F.coalesce("has_content", F.lit(False))).alias("empty_questions")))
    if regions is not None:
        more.append(regions.groupBy("doc_id").agg(F.count_if(F.col("decision") == "REVIEW_REQUIRED").alias("reconstruction_pending")))
    if pages is not None:
        more.append(pages.groupBy("doc_id").agg(F.count_if("failed").alias("unprocessed_pages")))
    if problems is not None:
        more.append(problems.groupBy("doc_id").agg(F.count("*").alias("manifest_mismatch")))
    if flags is not None:
        more.append(flags.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in FLAGS]))
    for m in more:
        out = out.join(m, "doc_id", "left")
    counters = [c for c in out.columns if c != "doc_id"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counters})
    return out.withColumn("passed", F.forall(F.array(*[F.col(c).cast("bigint") for c in counters]), lambda x: x == 0))


def sure_label(readings: DataFrame) -> DataFrame:
    """Latest reading of each unit and provider."""
    w = Window.partitionBy("atu_id", "provider").orderBy(F.col("ts").desc_nulls_last(), F.col("candidate_id").desc())
    return readings.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
