"""Comparing what is there with what should be: manifests, gold answers, splits, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T


def reconcile(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """``key..., problem``: what is missing and what is extra."""
    e, a = expected.select(*key).distinct(), actual.select(*key).distinct()
    return e.join(a, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(a.join(e, key, "left_anti").withColumn("problem", F.lit("extra")))


def manifest_problems(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``question_id, problem, about``: objects of a question that are missing or too many.

    Both: ``question_id, fields, choices`` (arrays of names), ``equations`` (their number), one row a question. Extra choices
    are reported where there are more than expected.
    """
    a = actual.select("question_id", *[F.col(c).alias(f"a_{c}") for c in ("fields", "choices", "equations")], F.lit(True).alias("there"))
    j = expected.join(a, "question_id", "left")
    row = lambda problem, about: F.struct(F.lit(problem).alias("problem") if isinstance(problem, str) else problem.alias("problem"), about.alias("about"))
    none = F.array().cast("array<struct<problem:string,about:string>>")
    named = lambda names, problem, head: F.transform(names, lambda x: row(problem, F.concat(F.lit(head), x)))
    more = F.size("a_choices") > F.size("choices")
    count = F.concat_ws("/", F.concat(F.lit("equation:"), F.col("equations").cast("string")), F.col("a_equations").cast("string"))
    found = F.concat(
        named(F.array_except("fields", "a_fields"), "missing", ""),
        named(F.array_except("choices", "a_choices"), "missing", "choice:"),
        F.when(more, named(F.array_except("a_choices", "choices"), "duplicate", "choice:")).otherwise(none),
        F.when(F.col("equations") != F.col("a_equations"), F.array(row(F.when(F.col("a_equations") < F.col("equations"), "missing").otherwise("duplicate"), count))).otherwise(none),
    )
    gone = F.array(row("missing_question", F.lit(None).cast("string")))
    return j.select("question_id", F.inline(F.when(F.col("there"), found).otherwise(gone)))


def fields_differ(expected: DataFrame, actual: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """One row per field that differs; null expected fields are skipped, a missing row differs in all."""
    e = expected.select(*key, *[F.col(f).cast("string").alias(f"e_{f}") for f in fields])
    a = actual.select(*key, F.lit(True).alias("there"), *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").alias("expected"), F.col(f"a_{f}").alias("actual")) for f in fields])
    j = e.join(a, key, "left").select(*key, F.inline(pairs))
    return j.where(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("actual")))


def token_overlap(pred: Column, gold: Column) -> Column:
    """Critical tokens of the gold text found, wanted and invented, as multisets."""
    g, p = T.critical_tokens(gold), T.critical_tokens(pred)
    number = lambda s: F.transform(s, lambda x, i: F.concat(x, F.lit("\u0001"), (i - F.array_position(s, x) + 1).cast("string")))
    common = F.size(F.array_intersect(F.transform(F.array(F.array_sort(g)), number)[0], F.transform(F.array(F.array_sort(p)), number)[0]))
    return F.struct(common.alias("matched"), F.size(g).alias("wanted"), (F.size(p) - common).alias("extra"))


def answers_differ(answers: DataFrame, by: str) -> DataFrame:
    """Answers of two sources to one question that don't match (J17): ``by, source_a, source_b, answer_a, answer_b, compared``.

    ``answers``: ``by, source, answer``. The recorded answer (source ``reference``) comes first, as the key; ``compared``
    are all pairs of the question's answers from two sources.
    """
    r = answers.where("answer is not null and source is not null").select(by, "source", "answer").distinct().withColumn("place", F.struct(F.col("source") != "reference", "source"))
    a, b = (r.select(by, *[F.col(c).alias(f"{c}_{s}") for c in ("source", "answer", "place")]) for s in "ab")
    pairs = a.join(b, by).where("place_a < place_b")
    match = F.coalesce(T.answers_match(F.col("answer_a"), F.col("answer_b")), F.lit(False))
    one = pairs.select(by, "source_a", "source_b", "answer_a", "answer_b", match.alias("match"))
    return one.withColumn("compared", F.count("*").over(Window.partitionBy(by))).where("not match").drop("match")


def leakage(assets: DataFrame, sealed: str) -> DataFrame:
    """Assets of a sealed split that an open one has too: ``asset, split`` of the open side."""
    inside = assets.where(F.col("split") == sealed).select("asset").distinct()
    return assets.where(F.col("split") != sealed).join(inside, "asset", "left_semi").select("asset", "split").distinct()


def run_summary(declared: DataFrame, results: DataFrame) -> DataFrame:
    """Counts of each status over all declared items; an item without a result wasn't run.

    ``declared``: ``run_id, item_id``; ``results``: ``run_id, item_id, status, critical``.
    """
    d = declared.distinct().join(results, ["run_id", "item_id"], "left").withColumn("status", F.coalesce("status", F.lit("NOT_RUN")))
    n = F.count("*")
    count = lambda s: F.count_if(F.col("status") == s)
    return d.groupBy("run_id").agg(
        n.alias("declared"), *[count(s).alias(s.lower()) for s in ("PASS", "FAIL", "REVIEW", "REJECT", "NOT_RUN")],
        (count("PASS") / n).alias("auto_rate"), ((count("REVIEW") + count("NOT_RUN")) / n).alias("review_rate"),
        F.count_if(F.col("critical") & (F.col("status") == "FAIL")).alias("critical_failures"),
    )


def accuracy(df: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """Share of true flags, nulls left out."""
    return df.groupBy(*by).agg(*[F.avg(F.col(f).cast("int")).alias(f) for f in flags])


def verify_hashes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, state``: ok, missing, mismatched or unlisted."""
    j = manifest.select("path", F.col("sha256").alias("m")).join(files.select("path", F.col("sha256").alias("f")), "path", "full")
    return j.select("path", F.when(F.col("f").isNull(), "missing").when(F.col("m").isNull(), "unlisted").when(F.col("m") == F.col("f"), "ok").otherwise("mismatched").alias("state"))


def replays(requests: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``outcome`` of each request: first, replay, or conflict when its body differs from the first of its key."""
    first = requests.groupBy(*key).agg(F.min_by(F.struct(F.col("body_hash").alias("h"), F.struct(*order).alias("o")), F.struct(*order)).alias("first"))
    j = requests.join(first, key)
    return j.withColumn("outcome", F.when(F.struct(*order) == F.col("first.o"), "first").when(F.col("body_hash") == F.col("first.h"), "replay").otherwise("conflict")).drop("first")
