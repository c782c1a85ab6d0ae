"""Text expressions: normal forms, tokens, repairs and classifications, all built-in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens whose loss changes an exam's meaning.
CRITICAL = r"\d+(?:\.\d+)?(?:cm|mm|km|kg|mL|m|g|L|°|%)?|[+\-×÷=≠<>≤≥∥⟂°]|[①②③④⑤]|없|아닌|않"
#: Compatibility units and look-alike signs.
UNITS = {"㎝": "cm", "㎜": "mm", "㎞": "km", "㎏": "kg", "㎡": "m²", "˚": "°", "º": "°", "⊿": "△", "∆": "△", "∟": "∠", "𝑥": "x", "𝑦": "y"}
#: Full-width digits and signs, and the plain ones.
FULL_WIDTH = ("０１２３４５６７８９．，（）＋－＝：；／　", "0123456789.,()+-=:;/ ")
CIRCLED = ["①", "②", "③", "④", "⑤", "⑥", "⑦", "⑧", "⑨", "⑩"]
#: Words that mark answer sheets and question pages.
ANSWER_MARKERS = ["정답", "해답", "답안", "배점", "채점", "정답지", "정답 및", "answer key", "answer sheet", "solutions", "marking scheme"]
QUESTION_MARKERS = ["문제", "다음", "물음", "구하시오", "답하시오", "풀이하시오"]

#: What is masked in logs, in this order, and what takes its place.
SCRUB = [
    (r"(?i)(api[_-]?key|token|secret|password|passwd|authorization)(\s*[:=]\s*)['\"]?[^\s'\"]+", "$1$2<REDACTED>"),
    (r"(?i)bearer\s+[a-z0-9._\-]+", "Bearer <REDACTED>"),
    (r"[A-Za-z]:\\[^\s'\"]+", "<PATH>"),
    (r"/(?:home|Users|tmp|var)/[^\s'\"]+", "<PATH>"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"),
    (r"\b0\d{1,2}[-.\s]?\d{3,4}[-.\s]?\d{4}\b", "<PHONE>"),
]
#: Units that an answer may carry behind its number.
ANSWER_UNITS = "㎠|㎝|㎢|cm²|cm³|cm|mm|km|m|°|도|개|자리"


def norm_text(s: Column) -> Column:
    """Without white space and equation brackets, with a plain minus (F1)."""
    return F.regexp_replace(F.translate(s, "〈〉−", "\u0001\u0001-"), r"(?U)[\s\u0001]+", "")


def char_exact(pred: Column, gold: Column) -> Column:
    """1 for equal normal forms, 0 for an empty gold text, else 1 - edits / gold length, at least 0."""
    p, g = norm_text(pred), norm_text(gold)
    return F.when(p == g, 1.0).when(g == "", 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.levenshtein(p, g) / F.length(g)))


def critical_tokens(s: Column) -> Column:
    """Numbers with units, operators, circled digits and negations, in order (F4); digits of any script and width."""
    return F.regexp_extract_all(norm_text(s), F.lit("(?U)" + CRITICAL), F.lit(0))


def norm_answer(s: Column) -> Column:
    """An answer's plain form: trimmed, no final dot, circled digit as digit, no unit behind a number."""
    t = F.regexp_replace(F.btrim(s), r"\.+$", "")
    t = reduce(lambda c, x: c.when(t == x[1], str(x[0])), enumerate(CIRCLED, 1), F.when(F.lit(False), "")).otherwise(t)
    return F.btrim(F.regexp_replace(F.btrim(t), rf"([\d.])(?:{ANSWER_UNITS})$", "$1"))


def answers_match(a: Column, b: Column) -> Column:
    """Equal plain forms, or a key of two characters or more, not a number, contained."""
    x, y = norm_answer(a), norm_answer(b)
    bare = lambda c: F.regexp_replace(c, r"[^\w가-힣]", "")
    contained = (F.length(bare(x)) >= 2) & ~bare(x).rlike(r"^\d+$") & F.contains(bare(y), bare(x))
    return (x != "") & (y != "") & ((x == y) | contained)


def numeric_typos(s: Column) -> Column:
    """Letters read for digits next to digits, full-width forms, minus-like dashes before digits."""
    t = F.translate(s, *FULL_WIDTH)
    t = F.regexp_replace(t, r"[−–—‐‑﹣]\s*(?=\d)", "-")
    t = F.regexp_replace(t, r"(?<=\d)[Oo](?=\d)", "0")
    t = F.regexp_replace(t, r"(?<=\d)[lI](?=\d)", "1")
    return F.regexp_replace(F.regexp_replace(t, r"(?<=\d)[Oo]\b", "0"), r"(?<=\d)[lI]\b", "1")


def normalize_units(s: Column) -> Column:
    """Compatibility units, ``<ABC`` as an angle, a dot above as degrees (F8)."""
    t = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), UNITS.items(), s)
    return F.regexp_replace(F.regexp_replace(t, r"<([A-Z]{3})", "∠$1"), r"(\d)\s*˙", "$1°")


def occluded(s: Column) -> Column:
    """Whether a text says that part of it can't be seen."""
    return s.rlike(r"[□■▢]{2,}|\?{3,}|\[(?:가림|판독불가|occluded)\]")


def traps(s: Column) -> Column:
    """Trap marks in a question: negation, exception, brackets that flip a sign."""
    marks = {"negation": r"않은|아닌|없는|not\b|cannot", "all": r"모두|every|all\b", "sign": r"\(-|-\("}
    return F.array_sort(F.filter(F.array(*[F.when(s.rlike(p), n) for n, p in marks.items()]), lambda x: x.isNotNull()))


def split_choices(s: Column) -> Column:
    """``mark`` to text of the choices in one line, the first of a mark."""
    marks = F.regexp_extract_all(s, F.lit(r"([①②③④⑤])\s*([^①②③④⑤]*)"), F.lit(1))
    texts = F.transform(F.regexp_extract_all(s, F.lit(r"([①②③④⑤])\s*([^①②③④⑤]*)"), F.lit(2)), lambda x: F.btrim(x))
    first = F.filter(F.arrays_zip(marks.alias("k"), texts.alias("v"), F.transform(marks, lambda k, i: F.array_position(marks, k) == i + 1).alias("first")), lambda x: x["first"])
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["k"], x["v"])))


def points_tag(s: Column) -> Column:
    """The points of a ``[N점]`` mark, null without one."""
    return F.regexp_extract(s, r"\[\s*(\d{1,2})\s*점\s*\]", 1).try_cast("int")


def strip_format_chars(s: Column) -> Column:
    """Without control, format, private and surrogate characters (F16)."""
    return F.regexp_replace(s, r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}]", "")


def norm_label(s: Column) -> Column:
    """A question label's one spelling."""
    t = F.btrim(F.regexp_replace(s, r"(?U)\s+", " "))
    t = F.regexp_replace(t, r"(\d)\s*-\s*(\d)", "$1-$2")
    return F.regexp_replace(t, r"^(?:서답형|단답형|서술형|주관식|논술형)\s*(\d+)$", "논술형 $1")


def _hits(s: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [(F.contains(s, F.lit(m)) | F.contains(F.lower(s), F.lit(m))).cast("int") for m in markers])


def page_role(s: Column) -> Column:
    """The role that a page's words suggest (P5)."""
    t = F.btrim(F.coalesce(s, F.lit("")))
    answers, questions = _hits(t, ANSWER_MARKERS), _hits(t, QUESTION_MARKERS)
    return F.when(t == "", "UNKNOWN").when((answers >= 1) & (answers > questions), "ANSWER_KEY").when(questions >= 1, "QUESTION").otherwise("UNKNOWN")


def scrub(s: Column) -> Column:
    """Secrets, tokens, paths, addresses and numbers of persons masked, in this order (P20)."""
    for pattern, to in SCRUB:
        s = F.regexp_replace(s, pattern, to)
    return s


def natural_key(s: Column) -> Column:
    """A sort key in which runs of digits compare as numbers, however long: the number of digits, itself led by its length, stands before them (T4)."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"\d+|\D+"), F.lit(0))
    bare = lambda p: F.ltrim(p, F.lit("0"))
    size = lambda p: F.length(bare(p)).cast("string")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.length(size(p)).cast("string"), size(p), F.lit(":"), bare(p))).otherwise(p)), "")


def safe_filename(s: Column) -> Column:
    """A file name without path, streams, control characters and reserved signs; NFC is left to the reader."""
    t = F.regexp_replace(F.regexp_replace(s, r"^.*[/\\]", ""), r":.*$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\p{Cc}\p{Cf}]", ""), r'[<>"|?*]', "_")
    t = F.btrim(t, F.lit(" ."))
    return F.when(t == "", "unnamed").otherwise(F.substring(t, 1, 200))


def tolerant_json(s: Column) -> Column:
    """JSON out of a reply: fences dropped, then lone backslashes doubled if it can't be parsed."""
    t = F.btrim(F.regexp_replace(s, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    body = F.regexp_extract(t, r"(?s)^[^{\[]*([{\[].*[}\]])", 1)
    escape = lambda x: F.regexp_replace(x, r'\\(?!["\\/bfnrtu])', r"\\\\\\\\")
    tries = [F.try_parse_json(x) for x in (t, escape(t), F.nullif(body, F.lit("")), escape(F.nullif(body, F.lit(""))))]
    return F.coalesce(*tries)


def canonical_json(columns: dict[str, Column]) -> Column:
    """Text with sorted names and nulls kept, the same for the same values."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def digest(columns: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def candidate_id(kind: Column, section: Column, path: Column, value_digest: Column) -> Column:
    """A candidate's id from what it is and where."""
    return F.concat(F.lit("cand_"), F.substring(F.sha2(F.concat_ws("|", kind, section, path, value_digest), 256), 1, 12))


#: Signs that text extraction from a render may give out of order.
REORDERED = "∥⊥∠△□○●×÷°≡≠≤≥±√∴∵∽≒⊙′″—–-·"


def contains_all(text: Column, expected: Column, reordered: str = "") -> Column:
    """How many expected strings aren't in a rendered text.

    One is there too if it is without the signs ``reordered``, and each such sign of it is somewhere.
    """
    blob = norm_text(text)
    bare = lambda c: F.translate(c, reordered, "")

    def found(x: Column) -> Column:
        x = norm_text(x)
        if not reordered:
            return F.contains(blob, x)
        signs = F.forall(F.lit([*reordered]), lambda c: ~F.contains(x, c) | F.contains(blob, c))
        return F.contains(blob, x) | ((bare(x) != "") & F.contains(bare(blob), bare(x)) & signs)

    return F.size(F.filter(expected, lambda x: ~found(x)))


def unsafe_payload(s: Column) -> Column:
    """Text that carries binary data."""
    return s.rlike(r"data:[\w/+.-]+;base64,|[A-Za-z0-9+/]{256,}={0,2}")


#: Words of equation script and the signs they stand for.
SCRIPT_WORDS = {"TRIANGLE": "△", "ANGLE": "∠", "THEREFORE": "∴", "BECAUSE": "∵", "BOT": "⊥", "DEG": "°", "TIMES": "×", "==": "≡", "//": "∥"}


def script_surface(s: Column) -> Column:
    """Equation script as readable text (F15): number fractions with a slash, words as signs, layout words dropped."""
    t = F.regexp_replace(s, r"(?i)\b(?:rm|it|bar|left|right)\b\s*|\beqalign\s*", "")
    t = F.regexp_replace(t, r"(\d+)\s*OVER\s*(\d+)", "$1/$2")
    for word, sign in SCRIPT_WORDS.items():
        t = F.regexp_replace(t, rf"\b{word}\b\s*" if word.isalpha() else word, sign)
    t = F.regexp_replace(F.replace(t, F.lit("#"), F.lit(", ")), r"[{}]", "")
    return F.btrim(F.regexp_replace(t, r"[`\s]+", " "))


def route(label: Column, kind: Column, body: Column, long: int = 400) -> Column:
    """``long`` for descriptive or very long items, else ``short``."""
    return F.when(label.rlike("논술|서술|서답|[Ee]ssay") | (kind == "descriptive") | (F.length(body) > long), "long").otherwise("short")


def pdf_class(chars: Column, image_share: Column) -> Column:
    """SCANNED without text, HYBRID with little text or half the page an image, else DIGITAL."""
    return F.when(F.coalesce(chars, F.lit(0)) == 0, "SCANNED").when((chars < 20) | (F.coalesce(image_share, F.lit(0.0)) >= 0.5), "HYBRID").otherwise("DIGITAL")
