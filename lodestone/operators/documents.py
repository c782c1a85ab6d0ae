"""Questions and documents: decomposition, grouping, status roll-ups, reviews, layout checks."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.mathexpr import compare_udf

CIRCLED = T.CIRCLED[:5]
#: The most that a feature adds to the difficulty, and how much each one of it does.
DIFFICULTY = {"steps": (1.5, 0.3), "operations": (1.5, 0.05), "conditions": (0.8, 0.2), "concepts": (0.8, 0.15), "figures": (0.5, 0.1), "traps": (0.5, 0.25)}


def decompose(items: DataFrame, key: list[str], item: str) -> DataFrame:
    """``kind, field, value`` of each structured item.

    ``item`` is a VARIANT with any of ``number, type, points, body, figure``, ``choices`` (an
    object, or an array whose places give circled labels) and ``equations``. Null and empty
    values have no row; a body of spans is joined.
    """
    get = lambda p, t: F.try_variant_get(item, p, t)
    row = lambda kind, field, value: F.struct(F.lit(kind).alias("kind"), (field if isinstance(field, Column) else F.lit(field)).alias("field"), value.alias("value"))
    spans = F.array_join(F.transform(get("$.body", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$", "string"))), " ")
    body = F.coalesce(F.when(F.size(get("$.body", "array<variant>")) >= 0, spans), get("$.body", "string"))
    single = F.array(row("question_number", "number", get("$.number", "string")), row("text_token", "type", get("$.type", "string")), row("points", "points", get("$.points", "string")), row("text_token", "body", body), row("figure", "figure", get("$.figure", "string")))
    named = F.transform(F.map_entries(get("$.choices", "map<string,variant>")), lambda e: row("choice", F.concat(F.lit("choice:"), e["key"]), F.try_variant_get(e["value"], "$", "string")))
    placed = F.transform(get("$.choices", "array<variant>"), lambda x, i: row("choice", F.concat(F.lit("choice:"), F.coalesce(F.try_variant_get(x, "$.label", "string"), F.get(F.lit(CIRCLED), i))), F.coalesce(F.try_variant_get(x, "$.body", "string"), F.try_variant_get(x, "$", "string"))))
    equations = F.transform(get("$.equations", "array<variant>"), lambda x, i: row("math_symbol", F.concat(F.lit("equation:"), i.cast("string")), F.coalesce(F.try_variant_get(x, "$.latex", "string"), F.try_variant_get(x, "$", "string"))))
    none = F.filter(single, lambda x: F.lit(False))
    every = F.concat(single, F.coalesce(named, none), F.coalesce(placed, none), F.coalesce(equations, none))
    return items.select(*key, F.inline(F.filter(every, lambda x: F.btrim(x["value"]) != "")))


def shared_stems(questions: DataFrame, by: list[str]) -> DataFrame:
    """``id, parent_id``: the stem of each ``N-M`` question.

    A stem's label has the number N and no hyphen; labels in words come before a plain number,
    then the first by place. ``questions``: ``by..., id, label, pos``.
    """
    q = questions.where("label is not null")
    subs = q.select(*by, F.col("id").alias("sub"), F.regexp_extract("label", r"^(\d+)-\d+$", 1).alias("n")).where("n <> ''")
    stems = q.where(~F.col("label").contains("-")).select(*by, F.col("id").alias("stem"), "pos", F.replace("label", F.lit(" "), F.lit("")).rlike(r"^\d+$").alias("plain"), F.explode(F.array_distinct(F.regexp_extract_all("label", F.lit(r"\d+"), F.lit(0)))).alias("n"))
    best = stems.groupBy(*by, "n").agg(F.min_by("stem", F.struct("plain", "pos", "stem")).alias("parent_id"))
    return subs.join(best, [*by, "n"]).select(*by, F.col("sub").alias("id"), "parent_id")


def context_groups(questions: DataFrame, by: list[str]) -> DataFrame:
    """Groups of questions that share a stem, the stem in it; others are groups of one (J4): ``by..., group_id, members``."""
    group = F.coalesce("parent_id", "id")
    return questions.groupBy(*by, group.alias("group_id")).agg(F.array_sort(F.collect_set("id")).alias("members"))


def with_parent(questions: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Questions with the named columns of their stem beside them."""
    p = questions.select(*by, F.col("id").alias("parent_id"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    return questions.join(p, [*by, "parent_id"], "left")


def canonical_exam(questions: DataFrame, by: str) -> DataFrame:
    """One text and digest an exam, questions by number and label (P23): the same whatever the order of rows."""
    q = F.array_sort(F.collect_list(F.struct("number", "label", "type", "points", "answer")))
    line = lambda x: F.concat_ws("|", *[F.coalesce(x[c].cast("string"), F.lit("-")) for c in ("number", "label", "type", "points", "answer")])
    return questions.groupBy(by).agg(F.array_join(F.transform(q, line), "\n").alias("canonical")).withColumn("digest", F.sha2("canonical", 256))


def question_status(units: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Status of a question from its units' (A7): ``question_id, status``.

    ``questions`` (``question_id`` and, where known, ``confirmed, edited, corrected, has_content``, BOOLEAN, ``issues``, INT)
    are all questions there are; without them, those with units. A confirmed one stays so; one without units
    and content is BLOCKED; open units or issues need a person; what is left was edited, corrected or restored.
    """
    still_open = F.bool_or(F.col("status").isin("UNVERIFIED", "CONFLICT", "UNREADABLE")).alias("open")
    u = units.groupBy("question_id").agg(still_open)
    q = u if questions is None else questions.join(u, "question_id", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in q.columns else F.lit(False)
    issues = F.coalesce(F.col("issues"), F.lit(0)) > 0 if "issues" in q.columns else F.lit(False)
    status = (
        F.when(has("confirmed"), "USER_CONFIRMED").when(F.col("open").isNull() & ~has("has_content"), "BLOCKED").when(has("open") | issues, "NEEDS_USER_REVIEW")
        .when(has("edited"), "USER_EDITED").when(has("corrected"), "AUTO_CORRECTED").otherwise("AUTO_RESTORED")
    )
    return q.select("question_id", status.alias("status"))


def document_status(questions: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Status of a document from its questions' (A8): ``doc_id, status``.

    ``documents`` (``doc_id``, and ``status`` where it is IN_PROGRESS) are all documents there are: one in progress stays
    so, one without questions is a best effort.
    """
    has = lambda s: F.bool_or(F.col("status") == s)
    worst = F.when(has("NEEDS_USER_REVIEW"), "NEEDS_USER_REVIEW").when(has("BLOCKED"), "RESTORED_BEST_EFFORT").otherwise("READY_FOR_FINAL_EXPORT")
    q = questions.groupBy("doc_id").agg(worst.alias("worst"))
    if documents is None:
        return q.select("doc_id", F.col("worst").alias("status"))
    return documents.join(q, "doc_id", "left").select("doc_id", F.when(F.col("status") == "IN_PROGRESS", "IN_PROGRESS").otherwise(F.coalesce("worst", F.lit("RESTORED_BEST_EFFORT"))).alias("status"))


def awaiting(questions: DataFrame) -> DataFrame:
    """Questions that a person must see or that nothing could be restored of."""
    return questions.where(F.col("status").isin("NEEDS_USER_REVIEW", "BLOCKED"))


def summaries(questions: DataFrame, longest: int = 80) -> DataFrame:
    """What planning an edit needs of a question (P24): its place, label, type, points, choices and the start of its body."""
    short = F.when(F.length("body") <= longest, F.col("body")).otherwise(F.concat(F.substring("body", 1, longest), F.lit("…")))
    return questions.select("expected_id", "exam_id", "number", "label", "type", "points", F.coalesce(F.size("choices"), F.lit(0)).alias("n_choices"), short.alias("summary"))


def page_lists(pages: DataFrame, role: str = "page_role", number: str = "pdf_page_index") -> DataFrame:
    """Pages of a document that hold answers, and those of no known role (P25)."""
    pick = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col(number))))
    return pages.groupBy("document_id").agg(pick(F.col(role) == "ANSWER_KEY").alias("answer_pages"), pick(F.col(role).isNull() | (F.col(role) == "UNKNOWN")).alias("unprocessed"))


def settled_role(pages: DataFrame) -> DataFrame:
    """A page's role: what a person said before what was suggested (X13): ``document_id, pdf_page_index, role``."""
    said = F.max_by("page_role", F.when(F.col("page_role").isNotNull(), F.struct((F.upper("role_source") == "USER").alias("user"), "ingested_at", "id")))
    return pages.groupBy("document_id", "pdf_page_index").agg(said.alias("role"))


def with_default(df: DataFrame, key: str, registry: DataFrame, columns: dict[str, object]) -> DataFrame:
    """Columns of a registry beside each row, the defaults where it has none (X12). The registry has a row for each key."""
    j = df.join(registry.select(key, *columns), key, "left")
    return j.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in columns.items()})


def review_package(units: DataFrame) -> DataFrame:
    """What is left to do in each question (A10, P13): counts by status and the pending fields."""
    n = lambda s: F.count_if(F.col("status") == s)
    pending = F.col("status").isin("UNVERIFIED", "CONFLICT", "UNREADABLE")
    g = units.groupBy("doc_id", "question_id").agg(n("UNVERIFIED").alias("unverified"), n("CONFLICT").alias("conflict"), F.array_sort(F.collect_set(F.when(pending, F.coalesce("field", "kind")))).alias("pending"))
    return g.where(F.size("pending") > 0)


def proven_choices(choices: DataFrame, key: str) -> DataFrame:
    """Pairs of marks of a question whose texts say the same or are proven equal as formulas (J16): ``key, a, b``."""
    c = choices.select(key, "mark", "body", T.norm_text(F.col("body")).alias("n")).where("n <> ''")
    a, b = (c.select(key, *[F.col(x).alias(f"{x}_{s}") for x in ("mark", "body", "n")]) for s in "ab")
    pairs = a.join(b, key).where("mark_a < mark_b")
    # words of Hangul are no variables
    formulas = ~F.concat("body_a", "body_b").rlike("[가-힣ㄱ-ㅎ]")
    verdict = compare_udf(F.when(formulas & (F.col("n_a") != F.col("n_b")), F.col("body_a")), F.col("body_b"))
    return pairs.where((F.col("n_a") == F.col("n_b")) | (verdict == "MATCH")).select(key, F.col("mark_a").alias("a"), F.col("mark_b").alias("b"))


def equal_choices(choices: DataFrame, key: str) -> DataFrame:
    """Pairs of marks of a question whose texts are the same (J16, without formulas): ``key, a, b``. A question has few choices."""
    norm = T.norm_text(F.col("body"))
    c = choices.select(key, "mark", norm.alias("n")).where("n <> ''")
    a, b = c.alias("a"), c.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.mark") < F.col("b.mark"))).select(F.col(f"a.{key}").alias(key), F.col("a.mark").alias("a"), F.col("b.mark").alias("b"))


def matched_share(field: pd.Series, text: pd.Series) -> pd.Series:
    """Characters of a field in blocks that it has in common with a text, as a share; null for a null field."""
    share = lambda f, t: None if f is None or t is None else sum(b.size for b in difflib.SequenceMatcher(None, f, t).get_matching_blocks()) / max(1, len(f))
    return pd.Series([share(f, t) for f, t in zip(field, text)], dtype="float64")


def audit_coverage(df: DataFrame, text: str, field: str, least: float = 0.8) -> DataFrame:
    """``covered``: whether a field is found in an audit text, or four fifths of it are in blocks that the text has too.

    Only fields that aren't found as they are go to Python. A null field or text is not covered.
    """
    plain, sought = T.norm_text(F.col(text)), T.norm_text(F.col(field))
    there = F.coalesce(F.contains(plain, sought), F.lit(False))
    share = F.pandas_udf(matched_share, "double")
    near = F.coalesce(share(F.when(~there, sought), plain) >= least, F.lit(False))
    return df.withColumn("covered", there | near)


def checks_passed(required: DataFrame, proofs: DataFrame, checks: DataFrame) -> DataFrame:
    """Whether an artifact's last proof is of its content and passed all that is required of its kind (J20): ``artifact, proven, open``.

    ``required``: ``kind, check``; ``proofs``: ``artifact, kind, proof, at, hash, content_hash``; ``checks``: ``proof, check,
    result``. ``open`` are the required checks that didn't pass, by name. A kind that nothing is required of needs the hash only.
    """
    p = F.struct("at", "proof", "kind", (F.col("hash") == F.col("content_hash")).alias("same"))
    last = proofs.groupBy("artifact").agg(F.max(p).alias("p")).select("artifact", "p.kind", "p.proof", "p.same")
    passed = checks.where("result = 'PASSED'").select("proof", "check", F.lit(True).alias("ok")).distinct()
    j = last.join(required.distinct(), "kind", "left").join(passed, ["proof", "check"], "left")
    still = F.array_sort(F.collect_set(F.when(F.col("check").isNotNull() & F.col("ok").isNull(), F.col("check"))))
    return j.groupBy("artifact").agg(F.bool_and(F.coalesce("same", F.lit(False))).alias("same"), still.alias("open")).select("artifact", (F.col("same") & (F.size("open") == 0)).alias("proven"), "open")


def fixed_labels(choices: DataFrame, key: str) -> DataFrame:
    """Choice labels by place where they are bare digits, repeated or out of order (F9): ``key, pos, label, rule``.

    ``choices``: ``key, pos`` (from 0), ``label``.
    """
    w = Window.partitionBy(key)
    place = F.array_position(F.lit(CIRCLED), F.col("label"))
    bare = F.min(F.col("label").rlike(r"^\(?\d{1,2}[.)]?$")).over(w)
    circled = F.min(place > 0).over(w)
    repeated = F.max("_same").over(w) > 1
    prev = F.lag(place).over(w.orderBy("pos"))
    d = choices.withColumn("_same", F.count("*").over(Window.partitionBy(key, "label"))).withColumns({"_bare": bare, "_circled": circled, "_rep": repeated, "_step": F.coalesce(place < prev, F.lit(False))})
    rule = F.when(F.count("*").over(w) < 2, None).when(F.col("_bare"), "choice_label_normalize").when(F.col("_circled") & F.col("_rep"), "choice_label_dedup").when(F.col("_circled") & F.max("_step").over(w), "choice_order")
    d = d.withColumn("rule", rule)
    return d.select(key, "pos", F.when(F.col("rule").isNotNull() & (F.col("pos") < len(CIRCLED)), F.get(F.lit(CIRCLED), F.col("pos").cast("int"))).otherwise(F.col("label")).alias("label"), "rule")


def scores(df: DataFrame) -> DataFrame:
    """Difficulty, band and minutes from structural features (M1-M3); ``steps, operations, conditions, concepts, figures, traps``."""
    s = reduce(lambda a, b: a + b, [F.least(F.lit(most), k * F.col(c)) for c, (most, k) in DIFFICULTY.items()])
    minutes = 1.0 + 0.8 * F.col("steps") + 0.05 * F.col("operations") + 0.5 * F.col("figures")
    # sums of decimals are a little off in binary: what is half is rounded up
    places = lambda c, n: F.floor(c * 10**n + 0.5 + 1e-9) / 10**n
    return df.withColumn("score", places(s, 2)).withColumn("band", F.when(F.col("score") < 1.2, "low").when(F.col("score") < 2.6, "mid").otherwise("high")).withColumn("minutes", places(minutes, 1))


def resolve(questions: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """The question a word names: by id, then label, then number; several are refused.

    ``asked``: ``by..., ask``; result ``by..., ask, id, matches``.
    """
    names = questions.select(*by, "id", F.inline(F.array(*[F.struct(F.lit(i).alias("rank"), F.col(c).cast("string").alias("ask")) for i, c in enumerate(("id", "label", "number"))])))
    g = asked.join(names, [*by, "ask"], "left").groupBy(*by, "ask", "rank").agg(F.count_distinct("id").alias("matches"), F.min("id").alias("id"))
    best = g.groupBy(*by, "ask").agg(F.min_by(F.struct("id", "matches"), "rank").alias("b"))
    return best.select(*by, "ask", F.when(F.col("b.matches") == 1, F.col("b.id")).alias("id"), F.coalesce("b.matches", F.lit(0)).alias("matches"))


def layout_problems(slots: DataFrame, questions: DataFrame, notes: DataFrame, by: str) -> DataFrame:
    """``by, problem, about``: doubled slots, questions without a slot, scored ones without a note."""
    row = lambda d, p, c: d.select(by, F.lit(p).alias("problem"), F.col(c).cast("string").alias("about"))
    parts = [
        row(slots.groupBy(by, "slot").agg(F.count("*").alias("n")).where("n > 1"), "doubled_slot", "slot"),
        row(questions.join(slots, [by, "id"], "left_anti"), "no_slot", "id"),
        row(questions.where("points > 0").join(notes, [by, "id"], "left_anti"), "no_note", "id"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def table_errors(df: DataFrame, key: str, header: str, cells: str) -> DataFrame:
    """``key, error`` of tables without a header, too large or with ragged rows."""
    width = F.coalesce(F.size(header), F.lit(0))
    e = F.array(F.when(width <= 0, "no_header"), F.when((width > 50) | (F.size(cells) > 200), "too_large"), F.when(F.exists(cells, lambda r: F.size(r) != width), "ragged_row"))
    return df.select(key, F.explode(F.filter(e, lambda x: x.isNotNull())).alias("error"))


def axis_errors(df: DataFrame, key: str, ticks: str, low: str, high: str) -> DataFrame:
    """``key, error`` of axes whose ticks don't rise or whose range is empty (P10)."""
    steps = F.arrays_zip(F.slice(ticks, F.lit(1), F.greatest(F.size(ticks) - 1, F.lit(0))).alias("a"), F.slice(ticks, 2, 1_000_000).alias("b"))
    e = F.array(F.when(F.exists(steps, lambda s: s["b"] <= s["a"]), "ticks_do_not_rise"), F.when(F.col(low) >= F.col(high), "empty_range"), F.when(F.exists(ticks, lambda t: F.isnan(t) | (F.abs(t) > 1e6)), "number_out_of_range"))
    return df.select(key, F.explode(F.filter(e, lambda x: x.isNotNull())).alias("error"))


def matched_items(items: DataFrame, questions: DataFrame, by: list[str]) -> DataFrame:
    """Items with the question of their page and normal label, the first of several (J1): ``by..., item_id, id``."""
    i = items.select(*by, "page", F.col("id").alias("item_id"), T.norm_label(F.col("label")).alias("l"))
    q = questions.groupBy(*by, "page", T.norm_label(F.col("label")).alias("l")).agg(F.min("id").alias("id"))
    return i.join(q, [*by, "page", "l"], "left").select(*by, "item_id", "id")


def needs_confirmation(candidates: DataFrame, least: float = 0.8) -> DataFrame:
    """Candidates that a person must confirm: marked so, or not sure enough (P15); the others can be preselected."""
    sure = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    return candidates.withColumn("confirm", F.col("requires_user_confirm") | (F.coalesce(sure, F.lit(0.0)) < least))


def solve_targets(questions: DataFrame, units: DataFrame) -> DataFrame:
    """Questions to solve: no stem of others, with content, and no unit or a verified one."""
    stems = questions.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    u = units.groupBy(F.col("question_id").alias("id")).agg(F.bool_or(F.col("status").isin("AUTO_VERIFIED", "HUMAN_VERIFIED")).alias("ok"))
    q = questions.where(F.btrim("body") != "").join(stems, "id", "left_anti").join(u, "id", "left")
    return q.where(F.coalesce("ok", F.lit(True))).select("id")


def outside(df: DataFrame, used: str, declared: str) -> DataFrame:
    """Used concepts that aren't declared; nothing where none is declared."""
    return df.where(F.size(declared) > 0).withColumn("outside", F.array_except(used, declared))


def pinned(plan: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Whether every planned element still has its digest (J24, V6): ``key..., same``."""
    c = current.select(*key, F.col("digest").alias("now"))
    return plan.join(c, key, "left").select(*key, F.coalesce(F.col("digest") == F.col("now"), F.lit(False)).alias("same"))


def figures_last(df: DataFrame, by: list[str], has_figure: str, order: str, most: int) -> DataFrame:
    """``place`` with figure questions behind the others, so many at most."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(has_figure, order))
    return df.withColumn("place", place).where(F.col("place") <= most)


def blank_band(rows: DataFrame, by: list[str], order: str, ink: str, lowest: float = 0.55) -> DataFrame:
    """Length of the longest blank run in the lower part of a page (W14): ``by..., zone, longest``; the zone's start, not the run's."""
    w = Window.partitionBy(*by)
    d = rows.withColumn("zone", F.floor(F.max(order).over(w) * (1 - lowest)).cast("int")).where(F.col(order) >= F.col("zone"))
    n = F.row_number().over(w.orderBy(order)) - F.sum(F.when(F.col(ink) == 0, 1).otherwise(0)).over(w.orderBy(order))
    runs = d.withColumn("island", n).groupBy(*by, "zone", "island").agg(F.count_if(F.col(ink) == 0).alias("n"))
    return runs.groupBy(*by, "zone").agg(F.max("n").alias("longest"))


def verdict(checks: DataFrame, issues: DataFrame, by: str) -> DataFrame:
    """Passed when every applicable check passed and no blocking issue is open."""
    open_ = issues.where("blocking and state = 'OPEN'").select(by).distinct().withColumn("open", F.lit(True))
    g = checks.where("applicable").groupBy(by).agg(F.bool_and(F.col("status") == "PASSED").alias("all_passed"))
    return g.join(open_, by, "left").select(by, (F.col("all_passed") & F.col("open").isNull()).alias("passed"))
