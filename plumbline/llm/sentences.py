"""Problem 8: sentence units of documents in any language or script.

The sentence-break rules of Unicode Standard Annex 29 over its character classes, for the terminators of all scripts,
with suppression after abbreviations, initials and ordinals on top. Text between a quotation's marks is never cut, and
a quotation stays with the words that frame it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import table

# Abbreviations, lower case and without their last full stop, by what may follow them.
TITLES = set(
    "mr mrs ms messrs dr drs prof st lt capt sgt hr hrn frl dipl ing mm mme mlle mgr sr sra srta dra dña uds "
    "г-н г-жа им ул просп д-р проф акад доц डॉ प्रो श्री श्रीमती".split()
)
NUMBERED = set(
    "no nos nr nrn num núm sec sect fig figs vol ch chap art arts p pp pg pag pág págs abs abb bd eq ex ed ser tab "
    "par para cl app apt rm ste lfd kap s str z sch стр рис гл табл п пп ст № кв д рр т ч см n кап cap ref refs "
    "jan feb mar apr jun jul aug sep sept oct nov dec नं पृ".split()
)
INNER = set(
    "e.g i.e eg ie viz cf vs v al approx ca c circa incl excl resp est dept univ inc ltd co corp bros "
    "z d bzw vgl evtl ggf inkl exkl zzgl sog geb gest bes insb i u o a "
    "env av apr ej aprox ss "
    "напр т см ср род "
    "z.b d.h u.a i.d.r s.o s.u p.ex p.ej т.е т.к т.н".split()
)
ORDINAL_BEFORE = set("am vom zum beim im dem den der des die das ab bis seit und".split())
MONTHS = set(
    "januar jänner februar märz april mai juni juli august september oktober november dezember "
    "jan feb mär apr jun jul aug sept sep okt nov dez jahrhundert jh".split()
)
#: Nouns whose label may be a single capital, as in "plan B".
LABELLED = set(
    "plan type class group team option grade section part appendix figure vitamin level phase side point room gate "
    "platform exhibit schedule annex hepatitis block wing row zone model version train line".split()
)
_EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))


def _class(name: str) -> frozenset[str]:
    """The characters of a Sentence_Break class."""
    return frozenset(regex.findall(rf"\p{{Sentence_Break={name}}}", _EVERY))


DASHES = "—–―-"
#: Full stops that may also mark an abbreviation, and terminators that may not. Ellipses, the half-width and Tibetan
#: stops end sentences too, though the standard has no or another class for them.
ATERM = _class("ATerm")
STERM = _class("STerm") | set("…｡།༎")
TERMS = ATERM | STERM
#: Marks after which a sentence goes on; dashes have a rule of their own.
CONTINUE = {c for c in _class("SContinue") if unicodedata.category(c) != "Pd"} | set(";；؛%")
_CLOSE_CLASS = _class("Close")
OPENERS = {c for c in _CLOSE_CLASS if unicodedata.category(c) in ("Ps", "Pi")} | set('"¿¡')
CLOSERS = {c for c in _CLOSE_CLASS if unicodedata.category(c) in ("Pe", "Pf")} | set('"')
PAIR = {"«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "（": "）", "(": ")", "[": "]"}
_CLOSE = {v: k for k, v in PAIR.items()}
_MARKS = re.compile(r"[\"“”„«»‹›「」『』《》（）()\[\]]")
_TERM = re.compile(rf"[{re.escape(''.join(sorted(TERMS)))}]+|(?<=[\u0e00-\u0eff])\s+(?=[^\s\d.,!?…:;%)\]])")
_BLANK = re.compile(r"(?:\r\n|\n|\r| |\u0085)[^\S\r\n]*(?:\r\n|\n|\r| |\u0085)\s*| \s*")
_LINE = re.compile(r"(?:\r\n|\n|\r)(?=\s*(?:>|\[\d|\[[A-Z]|<|[-*•|] ))|(?<=>)(?:\r\n|\n|\r)+")
_WORD_BEFORE = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*$|\d+$")
_LAST = re.compile(r"[^\W\d_]+(?=\W*$)")
_WORD_AT = re.compile(r"[^\W\d_]+")
_CJK_MARKS = set("。！？｡")
#: Full-width letters, digits, quotes and stops read like their usual forms.
_FULL = {c: c - 0xFEE0 for c in (0xFF02, 0xFF0E, *range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))}
_IS_FULL = re.compile("[" + "".join(map(chr, _FULL)) + "]")


def _wide(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def _spans(t: str, a: int, b: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets of the paragraph, as (opening mark, one past the closing mark)."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _MARKS.finditer(t, a, b):
        c, i = m[0], m.start()
        if c == '"':
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if k is None:
                stack.append((c, i))
                continue
        elif c == "”" or (c == "“" and any(s == "„" for s, _ in stack)):
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in "“„"), None)
        elif c in _CLOSE:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == _CLOSE[c]), None)
        else:
            stack.append((c, i))
            continue
        if k is None:
            continue
        start = stack[k][1]
        del stack[k:]
        out.append((start, i + 1))
    if len(out) > 1:
        out.sort()
        kept = [out[0]]
        for s in out[1:]:
            if s[0] >= kept[-1][1]:
                kept.append(s)
            elif s[1] > kept[-1][1]:
                kept[-1] = (kept[-1][0], s[1])
        out = kept
    return out


def _next(t: str, i: int, b: int) -> int:
    while i < b and t[i].isspace():
        i += 1
    return i


def _initial(t: str, start: int, s: int) -> bool:
    """Whether the single capital before the full stop at ``s`` stands for a name."""
    before = t[max(start, s - 40) : s - 1]
    stripped = before.rstrip()
    if not stripped or stripped[-1] in "([\"“„«—–-,;:":
        return True
    if stripped[-1] == ".":
        return True  # another initial, a title, "vs.", "z. B."
    last = _LAST.search(stripped)
    w = last[0] if last else ""
    if w.lower() in LABELLED:
        return False
    if w.lower() in TITLES or (w[:1].isupper() and len(w) > 1):
        return True
    return bool(re.match(r"\.\s*[^\W\d_]\.", t[s : s + 6])) or bool(re.match(r"\.\s+[^\W\d_]+", t[s : s + 12]))


def _dash_opens(t: str, j: int, b: int) -> bool:
    """A dash that opens speech: what follows is attached and starts a sentence."""
    return j + 1 < b and (t[j + 1].isupper() or t[j + 1] in OPENERS)


def _ends(t: str, start: int, s: int, e: int, b: int) -> bool:
    """Whether the marks ``t[s:e]``, outside any quotation, end the unit that began at ``start``."""
    if t[s].isspace():
        return True  # a space between phrases of a script that writes no full stops
    j = _next(t, e, b)
    if j >= b:
        return True  # SB4
    c, gap = t[j], j > e
    mark = t[s:e]
    if mark[-1] in _CJK_MARKS or "……" in mark:
        return True
    if c.islower() or c in CONTINUE:
        return False  # SB8, SB8a
    if c in DASHES:
        return _dash_opens(t, j, b)
    if mark not in ATERM:
        return not (not gap and c.isdigit() and mark[-1] in "…") or c.isupper() or not c.isalpha()
    if not gap and c in CLOSERS and c not in OPENERS:
        return True
    p = t[s - 1] if s > start else ""
    if not gap and c.isdigit() and p.isdigit():
        return False  # SB6
    m = _WORD_BEFORE.search(t, max(start, s - 30), s)
    if not m:
        return gap or not c.isdigit()
    w = re.split(r"['’]", m[0])[-1]
    low = w.lower()
    if low.isdigit():
        if not gap:
            return not c.isdigit()
        after = _WORD_AT.match(t, j)
        if after and after[0].lower() in MONTHS:
            return False
        prev = _LAST.search(t, max(start, m.start() - 20), m.start())
        if prev and prev.end() >= m.start() - 2 and prev[0].lower() in ORDINAL_BEFORE:
            return not c.isalpha()
        if m.start() == start and len(low) < 4:
            return False  # a list number
        return True
    dotted = m.start() >= 2 and t[m.start() - 1] == "." and m.start() - 2 >= start
    if len(m[0]) == 1:
        if dotted or (t[m.start() - 1 : m.start()].isspace() and t[m.start() - 2 : m.start() - 1] == "."):
            before = t[max(start, m.start() - 4) : m.start()].strip().lower()
            if w == "m" and before[-2:] in ("a.", "p."):
                return True
            if w in ("д", "п") and before[-2:] == "т.":
                return True
        if low in NUMBERED and c.isdigit():
            return False
        if w == "г":
            return bool(re.search(r"\d\s*$", t[max(start, m.start() - 6) : m.start()]))
        if w.isupper():
            return not _initial(t, start, s)
        return False
    if low in TITLES or (low in INNER and (w.islower() or m.start() == start)):
        return False
    if low in NUMBERED and (c.isdigit() or c in "№"):
        return False
    if not gap and not (c.isupper() or c in OPENERS or _wide(c) or c.isdigit() or not c.isascii()):
        return False
    return True


def _after_span(t: str, start: int, span: tuple[int, int], b: int) -> bool:
    """Whether the quotation or bracket ``span``, which closes after a final mark, ends the unit too."""
    s, e = span
    inner = e - 2
    while inner > s and t[inner].isspace():
        inner -= 1
    last = t[inner]
    if last not in TERMS:
        return False
    j = _next(t, e, b)
    if j >= b:
        return True
    c = t[j]
    if c.islower() or c in CONTINUE or c in TERMS:
        return False  # SB8, SB8a
    if c in DASHES:
        return _dash_opens(t, j, b)
    if c in OPENERS:
        return True
    if s == start and t[s] not in "(（[":
        if c.isdigit():
            return True
        if last in ".…।۔" or last == "。":
            return not (_wide(c) or c.islower()) if last != "。" else False
        return False
    return True


def units(text: str, lines: bool = False) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit, in code points and order; none of a text without visible characters.

    Blank lines end a unit; with ``lines`` so do breaks before quoted, bulleted, tagged or time-stamped lines.
    """
    if not text.isascii() and _IS_FULL.search(text):
        text = text.translate(_FULL)
    cuts, pos = [], 0
    for m in _BLANK.finditer(text):
        cuts.append((pos, m.start()))
        pos = m.end()
    cuts.append((pos, len(text)))
    if lines:
        finer = []
        for a, b in cuts:
            pos = a
            for m in _LINE.finditer(text, a, b):
                finer.append((pos, m.start()))
                pos = m.end()
            finer.append((pos, b))
        cuts = finer
    out: list[tuple[int, int]] = []
    for a, b in cuts:
        while b > a and text[b - 1].isspace():
            b -= 1
        start = _next(text, a, b)
        if start >= b:
            continue
        spans = _spans(text, start, b)
        k, n = 0, len(spans)
        pos = start
        while pos < b:
            m = _TERM.search(text, pos, b)
            at = m.start() if m else b
            if k < n and spans[k][0] < at:
                span = spans[k]
                k += 1
                pos = span[1]
                if pos >= b:
                    break
                if _after_span(text, start, span, b):
                    out.append((start, pos))
                    start = pos = _next(text, pos, b)
                continue
            if not m:
                break
            end = m.end()
            if _ends(text, start, at, end, b):
                if text[at].isspace():
                    end = at
                else:
                    while end < b and text[end] in CLOSERS and not (k < n and spans[k][0] == end):
                        end += 1
                out.append((start, end))
                start = pos = _next(text, end, b)
            else:
                pos = end
        if start < b:
            out.append((start, b))
    return out


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, starts, ends, places = [], [], [], []
        for doc, text, form in zip(pdf["doc_id"], pdf["text"], pdf["form"]):
            got = units(text, form != "prose")
            ids.append(np.full(len(got), doc, dtype="int64"))
            starts.extend(x[0] for x in got)
            ends.extend(x[1] for x in got)
            places.append(np.arange(len(got), dtype="int32"))
        empty = np.empty(0, "int64")
        yield pd.DataFrame({
            "doc_id": np.concatenate(ids) if ids else empty, "unit": np.concatenate(places) if ids else empty,
            "start_char": np.array(starts, "int32"), "end_char": np.array(ends, "int32"),
        })


def sentence_units(documents: DataFrame) -> DataFrame:
    """``(doc_id, unit, start_char, end_char)`` for all units of all documents; needs doc_id, text, form.

    Null, empty and blank texts, and rows without an id, have no units; a null form is treated as captured text;
    repeated rows repeat their units.
    """
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text", F.coalesce("form", F.lit("")).alias("form"))
    return texts.mapInPandas(_cut, "doc_id long, unit int, start_char int, end_char int")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prose = table(spark, sf_dir, "documents").where("form = 'prose'")
    return sentence_units(prose).select("doc_id", "start_char", "end_char")


def p8_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of every document, captured ones too."""
    return sentence_units(table(spark, sf_dir, "documents"))
