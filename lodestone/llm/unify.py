"""One form for text that looks the same: embedded SQL over Arrow batches.

Every Arrow batch is a DuckDB relation in its Python worker; one SQL expression maps
compatibility forms and look-alike letters (``translate``), removes what can't be seen
(``regexp_replace``) and composes accents and Hangul (``nfc_normalize``). The tables
of compatibility forms are made from Unicode's own decompositions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks whose characters have a plain counterpart: superscripts, circled
#: digits and item letters are not among them, exams print those by design.
BLOCKS = [(0x2000, 0x200A), (0x00A0, 0x00A0), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0x2100, 0x214F), (0x2160, 0x217F), (0x3380, 0x33DF), (0xFB00, 0xFB06), (0xFF01, 0xFF5E), (0xFFA1, 0xFFDC), (0xFFE0, 0xFFE6), (0x1D400, 0x1D7FF)]
#: Letters of other alphabets, or of phonetic use, that look like Latin ones, pair by pair.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХҮӀԌԚԜЗаеѕіјорсухһүӏԁԛԝѵѡ", "ABESIJKMHOPCTYXYIGQW3aesijopcyxhyldqwvw")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo")
ARMENIAN = ("ՍՕԼօոսհցզյ", "UOLonuhgqj")
CHEROKEE = ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ")
LISU = ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")
PHONETIC = ("ɑɡıɩʋᴄᴏᴠᴡᴢꜱ", "agiivcovwzs")


def _others(first: int, last: int, pair: tuple[str, str]) -> str:
    """A class of the letters of an alphabet that look like no Latin one."""
    return "[" + "".join(chr(c) for c in range(first, last + 1) if chr(c) not in pair[0] and chr(c).isalpha()) + "]"


#: Alphabets with what shows that a text is written in them.
ALPHABETS = {"cyr": (CYRILLIC, r"[бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯ]"), "gre": (GREEK, r"[\x{03B1}-\x{03C9}\x{03AC}-\x{03CE}]{2}"), "arm": (ARMENIAN, _others(0x531, 0x587, ARMENIAN)), "che": (CHEROKEE, _others(0x13A0, 0x13F5, CHEROKEE)), "lis": (LISU, _others(0xA4D0, 0xA4F7, LISU))}
#: Characters without width.
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FEFF}"
#: Scripts and symbols in which a joiner after a letter means something.
JOINING = r"\p{Devanagari}\p{Bengali}\p{Gujarati}\p{Gurmukhi}\p{Kannada}\p{Malayalam}\p{Oriya}\p{Sinhala}\p{Tamil}\p{Telugu}\p{Arabic}\p{So}\x{FE0F}"
KEEP = {"‍": "\U000f0d01", "‌": "\U000f0d02"}


@cache
def tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters with a plain counterpart of one character, the counterparts, and the pairs with longer ones."""
    one, longer = [], []
    for first, last in BLOCKS:
        for code in range(first, last + 1):
            ch = chr(code)
            plain = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", ch))
            if plain != ch and unicodedata.category(ch) != "Cn":
                (one if len(plain) == 1 else longer).append((ch, plain))
    # half-width Hangul letters are item marks in their usual width, not parts of syllables
    one = [(a, b) for a, b in one if not 0xFFA0 < ord(a) < 0xFFDD] + [(a, chr(c)) for a, c in _half_width_hangul()]
    return "".join(a for a, _ in one), "".join(b for _, b in one), longer


def _half_width_hangul() -> list[tuple[str, int]]:
    out = []
    for code in range(0xFFA1, 0xFFDD):
        name = unicodedata.name(chr(code), "")
        if name.startswith("HALFWIDTH HANGUL LETTER"):
            out.append((chr(code), ord(unicodedata.lookup(name.removeprefix("HALFWIDTH ")))))
    return out


@cache
def expression(text: str = "text") -> tuple[str, dict[str, str]]:
    """The SQL expression and its parameters."""
    src, dst, longer = tables()
    args = {"src": src, "dst": dst}
    sql = f"translate({text}, $src, $dst)"
    for i, (a, b) in enumerate(longer):
        args |= {f"a{i}": a, f"b{i}": b}
    has = "".join(a for a, _ in longer)
    args["many"] = f"[{has}]"
    chain = sql
    for i in range(len(longer)):
        chain = f"replace({chain}, $a{i}, $b{i})"
    sql = f"CASE WHEN regexp_matches({text}, $many) THEN {chain} ELSE {sql} END"
    for n, (joiner, mark) in enumerate(KEEP.items()):
        args |= {f"j{n}": f"([{JOINING}]){joiner}", f"m{n}": f"\\1{mark}"}
        sql = f"regexp_replace({sql}, $j{n}, $m{n}, 'g')"
    args["inv"] = f"[{INVISIBLE}]"
    sql = f"regexp_replace({sql}, $inv, '', 'g')"
    args |= {"marks": "".join(KEEP.values()), "joiners": "".join(KEEP)}
    sql = f"translate({sql}, $marks, $joiners)"
    # look-alikes are decided word by word: by the Latin letters beside them, else by the other words of the text
    everyone = "".join(x[0] for x, _ in ALPHABETS.values()) + PHONETIC[0]
    plain = "".join(x[1] for x, _ in ALPHABETS.values()) + PHONETIC[1]
    args |= {"alike": everyone, "latin": plain, "some": f"[{everyone}]", "cut": r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+", "az": "[A-Za-z]"}
    word = "CASE WHEN regexp_matches(w, $az) THEN translate(w, $alike, $latin)"
    for name, (pair, shown) in ALPHABETS.items():
        args |= {f"{name}0": pair[0], f"{name}1": pair[1], f"{name}2": shown, f"{name}3": f"[{pair[0]}]"}
        word += f" WHEN regexp_matches(w, ${name}3) AND NOT regexp_matches({text}, ${name}2) THEN translate(w, ${name}0, ${name}1)"
    sql = f"CASE WHEN regexp_matches({text}, $some) THEN array_to_string(list_transform(regexp_extract_all({sql}, $cut), lambda w: {word} ELSE w END), '') ELSE {sql} END"
    return f"nfc_normalize({sql})", args


def _unified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "512MB"})
    sql, args = expression()
    for batch in batches:
        texts = batch.column("text")
        odd = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
        if not batch.num_rows or not pc.any(odd).as_py():
            yield batch
            continue
        # the relation has the texts that aren't ASCII; the others are their own form
        con.register("batch", pa.table({"i": pa.array(range(batch.num_rows)).filter(odd), "text": texts.filter(odd)}))
        found = con.sql(f"SELECT {sql} AS text FROM batch ORDER BY i", params=args).to_arrow_table().column("text").combine_chunks().cast(texts.type)
        con.unregister("batch")
        yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pc.replace_with_mask(texts, odd, found))


def unify(df: DataFrame, text: str, to: str) -> DataFrame:
    """The frame with column ``to``: the text of column ``text`` in its one consistent form.

    Null stays null and an empty text empty; a text of nothing but invisible characters
    becomes empty. ASCII texts are their own form and no part of the SQL's relation. A look-alike letter is plain
    in a word that has Latin letters too, and in any other word unless letters of the text are surely of that alphabet. Repeated rows stay repeated. Other columns pass through, whatever
    their names (but for ``to``, which is replaced).
    """
    from pyspark.sql.types import StringType, StructField, StructType

    # inside, columns have their place as name, so that none can clash
    names = [c for c in df.columns if c != to]
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("text"))
    schema = StructType([*inner.schema.fields[:-1], StructField("text", StringType())])
    out = inner.mapInArrow(_unified, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("text").alias(to))


def changed(df: DataFrame, text: str) -> DataFrame:
    """The rows whose text isn't in its consistent form, with that form in ``unified``.

    Texts of ASCII alone are in it already and aren't sent to Python.
    """
    odd = df.where(F.col(f"`{text}`").rlike(r"[^\x00-\x7F]"))
    return unify(odd, text, "unified").where(F.col("unified") != F.col(f"`{text}`"))
