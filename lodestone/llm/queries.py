"""Queries over the training-text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import annotators, bpe, mixing, neardup, scan_repair, sentences, unify
from lodestone.sources.tables import cut, table

# --- 1: consensus of several annotators

#: The labels of each scale, in order.
SCALES = {"answer": ["1", "2", "3", "4", "5"], "points": ["2", "3", "4", "5", "6"], "type": ["multiple_choice", "subjective", "descriptive"]}


def plain_label(field: Column, value: Column) -> Column:
    """A reading's plain label, null when it names no possible value."""
    s = F.lower(F.btrim(F.translate(value, '"', "")))
    s = F.translate(s, "①②③④⑤", "12345")
    digit = F.regexp_extract(s, r"^[\[(]?\s*([0-9])(?:\.0+)?\s*(?:번|점|pts?|points?)?\s*[\])]?\.?$", 1)
    name = F.regexp_replace(F.btrim(s, F.lit(" .")), r"[\s_-]+", "_")
    label = F.when(field == "type", name).otherwise(digit)
    known = F.coalesce(*[F.when((field == f) & label.isin(ls), label) for f, ls in SCALES.items()])
    return known


#: Providers of one family, by the start of their names: they copy from one another.
FAMILIES = ("reference",)


def readings(spark: SparkSession, d: str, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """The labelled readings of answer, points and type as the annotators' operator takes them."""
    raw = table(spark, d, "candidates").where(F.col("field").isin(*SCALES)).select("atu_id", "field", "provider", "value_json", "confidence", "ts")
    name = F.regexp_replace(F.lower(F.btrim("provider")), r"\s+", "")
    place = F.coalesce(*[F.when(F.col("field") == f, F.array_position(F.lit(ls), F.col("plain")).cast("int") - 1) for f, ls in SCALES.items()])
    k = F.coalesce(*[F.when(F.col("field") == f, F.lit(len(ls))) for f, ls in SCALES.items()])
    r = raw.withColumn("plain", plain_label(F.col("field"), F.col("value_json"))).where("plain is not null and provider is not null")
    r = r.withColumn("annotator", name)
    family = F.coalesce(*[F.when(F.col("annotator").startswith(f), f) for f in families], F.col("annotator"))
    return r.select(F.col("atu_id").alias("item"), F.col("field").alias("scale"), "annotator", place.alias("label"), k.alias("k"), F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), "ts", family.alias("family"))


def _named(scale: Column, label: Column) -> Column:
    return F.coalesce(*[F.when(scale == f, F.element_at(F.lit(ls), label + 1)) for f, ls in SCALES.items()])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    labels, _, _ = annotators.consensus(readings(spark, d))
    return labels.where("n >= 3 and not alike").select(F.col("item").alias("atu_id"), _named(F.col("scale"), F.col("label")).alias("label")).distinct()


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every item's label, how sure it is, and the agreement of its votes."""
    labels, _, items = annotators.consensus(readings(spark, d))
    agree = annotators.agreement(items).select("item", "scale", "observed", "agreement")
    return labels.join(agree, ["item", "scale"], "left").select(F.col("item").alias("atu_id"), F.col("scale").alias("field"), _named(F.col("scale"), F.col("label")).alias("label"), F.col("n").alias("providers"), "sure", "observed", "agreement")


def p1_reliability(spark: SparkSession, d: str) -> DataFrame:
    return annotators.consensus(readings(spark, d))[1].withColumnRenamed("annotator", "provider").withColumnRenamed("scale", "field")


# --- 2: near-duplicates with small edits


def token_bags(spark: SparkSession, d: str) -> DataFrame:
    """``src, id, tokens``: words of exam bodies, equations (without white space) of variants."""
    e = table(spark, d, "expected").where("body is not null").select(F.lit("expected").alias("src"), F.col("expected_id").alias("id"), F.split("body", r"(?U)\s+").alias("tokens"))
    v = table(spark, d, "variants").where("new_equations is not null").select(F.lit("variants").alias("src"), F.col("variant_id").alias("id"), F.transform("new_equations", lambda x: F.regexp_replace(x, r"(?U)\s+", "")).alias("tokens"))
    return e.unionByName(v)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    classes, members = neardup.pairs(token_bags(spark, d), "id", "tokens", 0.7, ["src"])
    return neardup.members_pairs(classes, members, ["src"])


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its class of equal bags and its number of links."""
    classes, members = neardup.pairs(token_bags(spark, d), "id", "tokens", 0.7, ["src"])
    return neardup.groups(classes, members, ["src"])


# --- 3: text from scanned pages


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """``src, row_id, text, doc``: decoded page texts of providers, of which several may read one page, and exam bodies."""
    c = table(spark, d, "candidates").where("field = 'body' and value_json is not null").select("candidate_id", "value_json", "atu_id")
    decoded = F.try_variant_get(F.try_parse_json("value_json"), "$", "string")
    c = c.select(F.lit("candidates").alias("src"), F.col("candidate_id").alias("row_id"), decoded.alias("text"), F.coalesce(F.col("atu_id"), F.col("candidate_id").cast("string")).alias("doc"))
    e = table(spark, d, "expected").select(F.lit("expected").alias("src"), F.col("expected_id").alias("row_id"), F.col("body").alias("text"), F.col("expected_id").cast("string").alias("doc"))
    return c.unionByName(e)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.find_noise(page_texts(spark, d)).distinct()


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every text as continuous paragraphs."""
    return scan_repair.repair(page_texts(spark, d))


# --- 4: visually identical text


def exam_texts(spark: SparkSession, d: str) -> DataFrame:
    """``expected_id, field, text`` of bodies, answers and first choices, distinct."""
    e = table(spark, d, "expected").select("expected_id", "body", "answer", F.col("choices")["①"].alias("first"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("text")) for f, c in (("body", "body"), ("answer", "answer"), ("choices.①", "first"))])
    return e.select("expected_id", F.inline(fields)).where("text is not null")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.changed(exam_texts(spark, d), "text").select("expected_id", "field").distinct()


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its consistent form."""
    return unify.unify(exam_texts(spark, d), "text", "unified").select("expected_id", "field", "unified").distinct()


# --- 7: encoding with a public tokenizer


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents, their number of ids, and whether decoding gives the text again."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = bpe.encode(docs, "doc_id", "text").select("doc_id", F.size("ids").alias("n_ids"), bpe.decode(F.col("ids")).alias("back"))
    return docs.join(back, "doc_id").select("doc_id", "n_ids", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


# --- 8: mixing sources


def _mix(spark: SparkSession, d: str, spread=None) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "source", mixing.token_count(F.col("text")).alias("tokens"))
    return mixing.mix(cut(docs), table(spark, d, "mix_targets"), spread=spread)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document in the mixture."""
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, d)[1]


def p8_tempered(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mixture whose entropy lies halfway between that of the token shares and of the mixture nearest the targets."""
    return _mix(spark, d, lambda natural, nearest: (natural + nearest) / 2)[1]


# --- 9: sentences


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").distinct()


def p9_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Units and their mean length for each document."""
    return p9_found(spark, d).groupBy("doc_id").agg(F.count("*").alias("units"), F.avg(F.col("end_pos") - F.col("start_pos")).alias("mean_length"))


QUERIES = {"p1_found": p1_found, "p1_labels": p1_labels, "p1_reliability": p1_reliability, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_repaired": p3_repaired, "p4_found": p4_found, "p4_unified": p4_unified, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_tempered": p8_tempered, "p9_found": p9_found, "p9_lengths": p9_lengths}
_WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
P2_FOUND_SQL = rf"""
with e as (
  select distinct 'expected' src, expected_id id, list_filter(regexp_split_to_array(body, '{_WS}'), lambda x: x <> '') w from expected where body is not null
  union all select distinct 'variants', variant_id, list_filter(list_transform(new_equations, lambda x: regexp_replace(x, '{_WS}', '', 'g')), lambda x: x is not null and x <> '') from variants where new_equations is not null),
n as (select src, id, len(w) n from e where len(w) > 0),
k as (select src, id, t, count(*) c from (select src, id, unnest(w) t from e) group by all),
p as (select a.src, a.id a, b.id b, sum(least(a.c, b.c)) o from k a join k b on a.src = b.src and a.t = b.t and a.id < b.id group by all)
select p.src, a id_a, b id_b from p join n x on x.src = p.src and x.id = a join n y on y.src = p.src and y.id = b where o >= 0.7 * greatest(x.n, y.n) - 1e-9"""

#: What exam texts have in these tables when typed plainly: ASCII, syllables, accented letters and the signs kept by design.
_TYPED = r"[^\x00-\x7F가-힣À-ÖØ-öø-ÿ°²θ∠⊥①-⑤ㄱ-ㅎ]"
P4_FOUND_SQL = " union all ".join(f"select distinct expected_id, '{f}' field from expected where regexp_matches({c}, '{_TYPED}')" for f, c in (("body", "body"), ("answer", "answer"), ("choices.①", "choices['①']")))

ORACLE = {"p2_found": P2_FOUND_SQL, "p4_found": P4_FOUND_SQL}
