"""Sentence boundaries by cascading tables of break and no-break rules.

A rule is a pair of regular expressions, for the text before a position and the text after
it, with the decision to break or not. A position is where a sentence could end: after an end mark with what closes
behind it, at a line break, in Thai at white space. Each kind of position has its tables: the one of the
language first, then that of the script, then the common one; the first rule whose two sides match decides, and where none
does, nothing ends. The language is that of the stretch of text at the position, so a text may mix scripts.
Nothing but a blank line ends inside a quotation or brackets, however long they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks that end a sentence, and what may close behind them.
ENDS, CLOSERS = ".!?…。！？｡।॥؟", "\"'”’»)]}）」』】〉》］"
#: What opens a quotation or bracket, and what closes it.
OPENERS = {"„": "“”", "“": "”", "«": "»", "»": "«", "‘": "’", "「": "」", "『": "』", "(": ")", "（": "）", '"': '"'}

Rule = tuple[bool, str, str]

_END = rf"[{regex.escape(ENDS)}]"
_CLOSE = rf"[{regex.escape(CLOSERS)}]"
#: What a unit may start with.
_OPEN = r"[\p{Lu}\p{Lo}\d„«“\"'‘「『(（¿¡\[#$√∠<]"
#: A heading is a line by itself, the first of its unit.
_LINE = r"\A\s*"

#: Abbreviations after which nothing ends, and those after which a sentence ends where a new one seems to start.
NEVER = {
    "en": r"Mrs?|Ms|Dr|Prof|Rev|Hon|Gen|Col|Capt|Lt|Sgt|Maj|Cmdr|Adm|Gov|Sen|Rep|Pres|St|Mt|Ft|Figs?|figs?|Secs?|secs?|Eqs?|eqs?|Nos?|Nr|Vol|vol|Chs?|ch|pp?|cf|vs|viz|approx|ca|i\.e|e\.g|ed|eds|est|Ave|Blvd|Rd|Dept|Refs?|Thm|Prop|Def|Ex",
    "de": r"z\. ?B|d\. ?h|u\. ?a|u\. ?U|s\. ?o|s\. ?u|i\. ?d\. ?R|i\. ?A|z|d|u|bzw|vgl|Vgl|ca|Nrn?|Abb|Abs|Kap|Aufg|Bd|Bsp|Dr|Prof|Hr|Fr|St|Str|Tab|Gln?|ggf|evtl|inkl|exkl|Mio|Mrd|sog|allg|bes|geb|gest|Anm|Art|Aufl|Hrsg|ebd|einschl|insb|lt|n\. ?Chr|v\. ?Chr|rd|vs|zit|zzgl",
    "es": r"págs?|p\. ?ej|núms?|caps?|arts?|figs?|Figs?|Sra?s?|Srta|Sres|Dra?|Profa?|Uds?|Vds?|aprox|vol|ed|tel|Avda?|dpto|ej|máx|mín|No|ss|vs|cf|pp?|ca",
}
SOMETIMES = {
    "en": r"etc|al|Inc|Ltd|Co|Corp|Bros|Jr|Sr|a\.m|p\.m|U\.S|U\.K|U\.N|Ph\.D|M\.D|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec|Mon|Tue|Wed|Thu|Fri|Sat|Sun",
    "de": r"usw|usf|etc|o\. ?Ä|u\. ?Ä|ff?|max|min|Jan|Feb|Apr|Aug|Sept?|Okt|Nov|Dez",
    "es": r"etc|EE\. ?UU|a\. ?C|d\. ?C|a\. ?m|p\. ?m|S\. ?A|Cía|Ltda|ene|feb|abr|ago|sept?|oct|nov|dic",
}
#: Words of closed classes, by which a language is told and that a heading doesn't start or end with.
WORDS = {
    "en": "the a an in on at by to of for from with and or but nor if when whenever while after before between because since although as than that this these those which who whose what where how why is are was were be been has have had do does did can could will would shall should may might must it its he she they we you his her their our your each every no not then there here some any all both either neither into over under until upon about against during without within",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber denn wenn als ob weil dass daß da wie wo was wer wen wem warum wann welche welcher welches in im an am auf aus bei beim mit nach von vom vor zu zum zur über unter für gegen ohne um durch zwischen seit bis ist sind war waren hat haben hatte wird werden wurde kann können soll sollen muss müssen darf er sie es wir ihr sein seine seinen ihre ihren nicht kein keine auch nur noch so dann hier dort jede jeder jedes alle diese dieser dieses",
    "es": "el la los las un una unos unas y e o u pero ni si cuando mientras después antes entre porque como que quien cual cuyo donde cómo por para de del a al en con sin sobre bajo desde hasta hacia según contra es son fue era está están ha han hay se lo le les su sus mi tu este esta estos estas ese esa esos esas aquel cada todo todos toda todas no ya muy más menos también entonces luego",
}
#: Words that name a part of a book or exam, by language.
PARTS = {
    "en": r"Chapter|Section|Part|Unit|Lesson|Exercises?|Problems?|Questions?|Examples?|Solutions?|Answers?|Notes?|Hints?|Remarks?|Reviews?|Appendix|Steps?|Theorem|Lemma|Definition|Corollary|Proof|Summary|Figure|Table",
    "de": r"Kapitel|Abschnitt|Teil|Lektion|Aufgaben?|Übung(?:en)?|Beispiele?|Lösung(?:en)?|Antwort(?:en)?|Hinweise?|Anmerkung(?:en)?|Anhang|Schritt|Satz|Lemma|Definition|Beweis|Zusammenfassung|Abbildung|Tabelle",
    "es": r"Capítulo|Sección|Parte|Unidad|Lección|Ejercicios?|Problemas?|Preguntas?|Ejemplos?|Solución|Soluciones|Respuestas?|Notas?|Observación|Apéndice|Paso|Teorema|Lema|Definición|Demostración|Resumen|Figura|Tabla",
}


def _any(words: str) -> str:
    # in small letters or with a capital: names of points have capitals alone
    return "(?:" + "|".join(sorted({x for w in words.split() for x in (w, w.capitalize())}, key=lambda w: (-len(w), w))) + ")"


def _ends_for(language: str) -> list[Rule]:
    never = "|".join(NEVER.values()) if language == "latin" else NEVER[language]
    some = "|".join(SOMETIMES.values()) if language == "latin" else SOMETIMES[language]
    rules = [(False, rf"(?<!\w)(?:{never})\.", r""), (False, rf"(?<!\w)(?:{some})\.", r"\s*[\p{Ll}0-9,;(]")]
    if language in ("de", "latin"):
        rules.append((False, r"\b\d{1,2}\.", r"\s+(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Klasse|Semester)\b"))
    return rules


def _lines_for(language: str) -> list[Rule]:
    closed = _any(WORDS[language])
    starters = "(?:" + "|".join(w.capitalize() for w in sorted(WORDS[language].split(), key=len, reverse=True) if len(w) > 1) + ")"
    title = rf"{_LINE}(?!{closed}\b)\p{{Lu}}[^\n.!?:;]{{0,100}}"
    rules = [
        (False, rf"(?<!\w){closed}", r""),
        (True, rf"{_LINE}(?:{PARTS[language]})\b[^\n.!?]{{0,120}}", rf"\s+{_OPEN}"),
        # words and a number: no sentence, unless it starts like one
        (True, rf"{_LINE}(?!{closed}\b)\p{{Lu}}[\p{{L}} '’-]{{0,60}} \d+(?:\.\d+)*", rf"\s+{_OPEN}"),
        # a word of a closed class has a capital only where a sentence or title starts
        (True, rf"{_LINE}\p{{Lu}}[^\n.!?:;]{{0,100}}", rf"\s+{starters}\b"),
    ]
    if language != "de":
        rules.append((True, title, r"\s+\p{Lu}\p{Ll}+ [\p{Ll}\p{Lu}]"))
    return rules


#: Rules after an end mark.
END_RULES: dict[str, list[Rule]] = {
    **{x: _ends_for(x) for x in ("en", "de", "es", "latin")},
    "script:latin": [
        (False, r"", r"\s*[,;:]"),
        (False, r"", r"\s+\p{Ll}"),
        (False, r"\.\.\.|…", r"\s+[^\p{Lu}¿¡\s]"),
        # an initial between names
        (False, r"(?:\p{Lu}\p{Ll}+\.?|\p{Lu}\.) \p{Lu}\.", r"\s+\p{Lu}(?:\p{Ll}|\.)"),
    ],
    "script:hangul": [
        (False, r"(?<!\d)\d{4}\.", r"\s*\d{1,2}\."),
        (False, r"(?<!\d)\d{4}\.\s*\d{1,2}\.", r"\s*\d"),
        (False, r"(?<!\d)\d{4}\.\s*\d{1,2}\.\s*\d{1,2}\.", r""),
        (False, r"(?:^|\s)[ㄱ-ㅎ가-하]\.", r"\s"),
        (False, rf"(?<!\w)(?:{NEVER['en']})\.", r"\s*[\d(A-Z가-힣]"),
        (False, r"\.\.\.+|…+", r"\s*\S"),
        (False, r"", r"\s*[,;:]"),
        (False, r"[\"”’]", r"\s*(?:라고|하고|라며|고)\s"),
    ],
    "script:cjk": [
        (False, r"[…]+", r"\S"),
        (False, rf"{_END}[」』”’]+", r"\s*(?:と|って|とい)"),
        (False, rf"{_END}[」』”’]+", r"[^\s「『“（(]"),
        (False, r"", r"[、，；：,]"),
        (True, r"[。！？｡]+[」』”’）)】]*", r""),
    ],
    "script:deva": [
        (False, r"[ऀ-ॿ]{1,4}\.", r"[ऀ-ॿ]"),
        (False, r"[ऀ-ॿ]\.[ऀ-ॿ]{1,4}\.", r""),
        (False, r"(?:^|\s)(?:डॉ|श्री|प्रो|रु|कि|मी)\.", r""),
        (False, rf"{_END}[\"”’]+", r"\s*(?:ऐसा|यह|कहकर|कह|बोल|इस तरह)"),
        (False, r"", r"\s*[,;:]"),
        (True, r"[।॥]+[\"”’)]*", r""),
    ],
    "common": [
        # an item number opens the unit that follows
        (False, r"\A\s*[(\[]?(?:\d{1,3}|[A-Za-zㄱ-ㅎ①-⑳])\.", r"\s"),
        (True, r"", r"\s*\Z"),
        (False, r"", r"\S"),
        (True, r"", r"\s"),
    ],
}

#: Rules at a line break that no end mark stands before.
LINE_RULES: dict[str, list[Rule]] = {
    "first": [
        (True, rf"{_LINE}[^\n:：]{{1,40}}[:：]", r"\s*[^\p{Ll}\s]"),
        (False, r"[,;،、，；–—(\[{„«“「『（-]", r""),
        (False, r"", r"\s*[,;:.!?…)\]}”’»」』、，。！？；：]"),
        (True, r"", r"\s*[•●▪◦‣]"),
        (True, rf"{_LINE}[-–*•●▪◦‣] [^\n]*", r"\s*[-–*•●▪◦‣] "),
        (True, rf"{_LINE}\(?\d{{1,3}}[.)]\s[^\n]*", r"\s*\(?\d{1,3}[.)]\s"),
        (True, rf"{_LINE}#{{1,6}} [^\n]+", r""),
    ],
    **{x: _lines_for(x) for x in ("en", "de", "es")},
    "latin": [(False, rf"(?<!\w){_any(' '.join(WORDS.values()))}", r"")],
    "script:latin": [
        (False, r"", r"\s+\p{Ll}"),
        # a label and its note
        (True, rf"{_LINE}\p{{Lu}}[\p{{L}}\d '’-]{{0,40}}: [^\n:]{{1,120}}", rf"\s+{_OPEN}"),
        (True, rf"{_LINE}(?=[^\n]*\p{{Lu}}{{2}})[^\n\p{{Ll}}]{{4,80}}", r"\s+\p{Lu}\p{Ll}"),
    ],
    "script:hangul": [
        (True, rf"{_LINE}[\[【<〔(《][^\]】>〕)》\n]{{1,12}}[\]】>〕)》](?:\s+(?:[ㄱ-ㅎ]\.|[^\s.?!]+)){{0,6}}", r""),
        (True, rf"{_LINE}[^\s.?!:][^\n.?!:]{{0,11}}: [^\n.?!]{{1,80}}", r""),
        (True, rf"{_LINE}제\s?\d+\s?(?:장|절|과|부|편|강|회)(?:\s[^\n.?!]{{1,40}})?", r""),
        # words and a number without its counter
        (True, rf"{_LINE}(?:[가-힣]+ ){{1,5}}\d+", r"\s"),
        # notes that end in a noun form
        (True, rf"{_LINE}[^\n.?!]{{2,120}}(?:[\d가-힣][임됨]|[있없했였았었겠같]음|(?<![포결])함)", r"\s"),
    ],
    "script:cjk": [
        (True, rf"{_LINE}(?:第\s?\d+\s?[題题問章節节課课回]|[問例问]\s?\d+|[（(]\d+[)）])[ 　]?[^\n。！？]{{0,40}}", r""),
        (False, r"[、，はがをにでとへもや和与在是]", r""),
        (True, rf"{_LINE}[^\n。！？、，]{{1,40}}(?:解説|解答|説明|問題|例題|例题|答え|答案|解析|说明|题解|概要|目次|注意|まとめ)", r""),
        # a noun phrase by itself
        (True, rf"{_LINE}[^\n。！？、，；：「」“”\d]{{1,20}}[\p{{Han}}\p{{Katakana}}ー]", r""),
    ],
    "script:deva": [
        (True, rf"{_LINE}(?:प्रश्न|हल|उत्तर|उदाहरण|टिप्पणी|अध्याय|अभ्यास|पाठ)\s?\d*[^\n।]{{0,60}}", r""),
    ],
    # what is written without a mark or space between sentences ends at any white space
    "script:thai": [(True, r"", r"")],
}

_SCRIPTS = [("thai", regex.compile(r"[฀-๿]")), ("deva", regex.compile(r"[ऀ-ॿ]")), ("hangul", regex.compile(r"[가-힣]")), ("cjk", regex.compile(r"[぀-ヿ㐀-䶿一-鿿]"))]
_LETTER = regex.compile(r"\p{L}")
_SPEAKS = {x: frozenset(y for z in w.split() for y in (z, z.capitalize())) for x, w in WORDS.items()}
_WORD = regex.compile(r"\p{L}+")
_BREAK = r"\r\n|\n|\r"
_POSITION = regex.compile(rf"{_END}+{_CLOSE}*|[ \t]*(?:{_BREAK})\s*")
_SPACE = regex.compile(r"[^\S\r\n]+")
_BLANK = regex.compile(rf"(?:{_BREAK})[^\S\r\n]*(?:{_BREAK})")
_MARKED = regex.compile(rf"(?<={_END}{_CLOSE}*)")
_QUOTE = regex.compile("[" + regex.escape("".join(OPENERS) + "".join(OPENERS.values())) + "]|" + rf"(?:{_BREAK})[^\S\r\n]*(?:{_BREAK})")
#: Characters before a position that tell the language there; the longest heading.
STRETCH, HEADING = 300, 200


@lru_cache(maxsize=64)
def cascade(kind: str, language: str, script: str) -> list[tuple[bool, bool, regex.Pattern, regex.Pattern | None]]:
    """Compiled rules: whether it breaks, whether it looks at the whole unit, and its pattern or pair of patterns."""
    tables, names = (END_RULES, [language, f"script:{script}", "common"]) if kind == "end" else (LINE_RULES, ["first", f"script:{script}", language] if script != "latin" else ["first", language, "script:latin"])
    out: list[tuple[bool, bool, regex.Pattern, regex.Pattern | None]] = []
    group: list[str] = []

    def close(breaks: bool) -> None:
        # of rules that follow one another and decide alike, it doesn't matter which one matches
        if group:
            out.append((breaks, False, regex.compile("|".join(group)), None))
            group.clear()

    last = False
    for breaks, before, after in [r for n in dict.fromkeys(names) for r in tables.get(n, [])]:
        if breaks != last or before.startswith(r"\A"):
            close(last)
        last = breaks
        if before.startswith(r"\A"):
            out.append((breaks, True, regex.compile(before), regex.compile(after)))
        else:
            # what stands before is matched backwards from the position, as far as it needs
            group.append(f"(?:(?<={before}){after})" if before else f"(?:{after})")
    close(last)
    return out


#: A character's script: 0 no letter, 1 a letter of another script, then as in _SCRIPTS.
@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    out = np.zeros(0x10000, np.uint8)
    for n, chars in enumerate([_LETTER, *(p for _, p in _SCRIPTS)], 1):
        out[[ord(m[0]) for m in chars.finditer(every)]] = n
    return out


class Stretches:
    """What script and language a text is in, place by place."""

    def __init__(self, text: str):
        self.text, self.ascii = text, text.isascii()
        self.spoken: dict[int, str] = {}
        if not self.ascii:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            kinds = _classes()[np.minimum(codes, 0xFFFF)]
            # letters up to each place, by script; those beyond the first plane are of another script
            self.upto = np.zeros((len(_SCRIPTS) + 2, len(text) + 1), np.int32)
            for n in range(1, len(_SCRIPTS) + 2):
                np.cumsum(kinds == n, out=self.upto[n, 1:])
            self.seen = [n for n in range(2, len(_SCRIPTS) + 2) if self.upto[n, -1]]

    def script(self, start: int, end: int) -> str:
        """The script whose rules fit from ``start`` to ``end``; if no letter is there, that of the next letter."""
        if self.ascii or not self.seen:
            return "latin"
        counts = (self.upto[:, end] - self.upto[:, start]).tolist()
        letters = sum(counts)
        if not letters:
            m = _LETTER.search(self.text, end)
            return next((x for x, p in _SCRIPTS if m and p.match(m[0])), "latin")
        n = max(self.seen, key=counts.__getitem__)
        return _SCRIPTS[n - 2][0] if counts[n] and counts[n] * 5 >= letters else "latin"

    def language(self, at: int) -> str:
        """The Latin language that most words of closed classes around a place speak for; ``latin`` if none does."""
        block = at // STRETCH
        if block not in self.spoken:
            near = _WORD.findall(self.text, max(0, (block - 1) * STRETCH), (block + 2) * STRETCH)
            found = {x: sum(map(known.__contains__, near)) for x, known in _SPEAKS.items()}
            best = max(found, key=found.__getitem__)
            self.spoken[block] = best if found[best] and sorted(found.values())[-2] < found[best] else "latin"
        return self.spoken[block]


def _decide(kind: str, text: str, where: Stretches, start: int, at: int) -> bool:
    script = where.script(max(start, at - STRETCH), at)
    unit = text[start:at] if at - start <= HEADING else None
    for breaks, whole, pattern, after in cascade(kind, where.language(at) if script == "latin" else script, script):
        if whole:
            if unit is not None and after.match(text, at) and pattern.fullmatch(unit):
                return breaks
        elif pattern.match(text, at):
            return breaks
    return False


def spans(text: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets, start and end (exclusive), by a stack; what isn't closed before a blank line is none."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _QUOTE.finditer(text):
        c, i = m[0], m.start()
        if c.isspace():
            stack.clear()
            continue
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        # an apostrophe or a sign of inches closes nothing, nor does a mark behind a blank
        closes = not (c == "’" and (after.isalnum() or after == "_")) and not (c == '"' and (not before or before.isspace()))
        k = next((j for j in range(len(stack) - 1, -1, -1) if c in OPENERS[stack[j][0]]), -1) if closes else -1
        if k >= 0:
            first = stack[k][1]
            del stack[k:]
            while found and found[-1][0] > first:
                found.pop()
            found.append((first, i + 1))
        elif c in OPENERS and not (c == "‘" and (before.isalnum() or before in ("’", "'", "_")) and before) and not (c == '"' and (not after or after.isspace())):
            stack.append((c, i))
    return found


def units(text: str) -> list[tuple[int, int]]:
    """Start and end (exclusive) of each sentence unit, in code points."""
    if not text or text.isspace():
        return []
    closed, where = spans(text), Stretches(text)
    cuts: list[int] = []
    start = k = 0
    positions = list(_POSITION.finditer(text))
    thai = bool(_SCRIPTS[0][1].search(text))
    if thai:
        positions = sorted([*positions, *_SPACE.finditer(text)], key=lambda m: (m.start(), m.end()))
    for m in positions:
        a, at = m.span()
        if at <= start:
            continue
        while k < len(closed) and closed[k][1] <= a:
            k += 1
        inside = k < len(closed) and closed[k][0] < a and at < closed[k][1]
        if inside and at == closed[k][1] - 1 and not m[0].isspace():
            inside, at = False, at + 1
        if not m[0].isspace():
            ends, here = not inside and _decide("end", text, where, start, at), at
        elif _BLANK.search(m[0]):
            ends, here = True, a
        elif "\n" in m[0] or "\r" in m[0]:
            here = a
            marked = a > start and _MARKED.match(text, a) is not None
            ends = not inside and _decide("end" if marked else "line", text, where, start, a)
        else:
            here = a
            ends = not inside and bool(_SCRIPTS[0][1].search(text, start, a))
        if ends and text[start:here].strip():
            cuts.append(here)
            start = here
    out = []
    start = 0
    for cut in [*cuts, len(text)]:
        piece = text[start:cut]
        left = len(piece) - len(piece.lstrip())
        if left < len(piece):
            out.append((start + left, start + len(piece.rstrip())))
        start = cut
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, first, last = [], [], []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            found = units(text or "")
            key += [k] * len(found)
            first += [a for a, _ in found]
            last += [b for _, b in found]
        yield pa.RecordBatch.from_arrays([pa.array(key, batch.schema.field("key").type), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["key", "start_pos", "end_pos"])


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, start_pos, end_pos`` of every sentence unit.

    Null, empty and blank texts have none; outer white space belongs to no unit. The rules
    follow the script and words of the text, so a null or wrong language doesn't matter. A quotation or bracket
    that isn't closed before a blank line is none. Rows that are repeated give repeated
    units; other columns are ignored.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_split, f"key {kind}, start_pos bigint, end_pos bigint").withColumnRenamed("key", key)
