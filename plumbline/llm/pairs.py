"""Problem 1: prompt and response pairs whose response is defective.

Copied responses are measured by traversing a suffix automaton of the prompt; refusals are found by a phrase automaton
(Aho-Corasick), broken delimiters by a stack, languages by stopword votes. Whether a text without a final mark is
finished is read off the table itself: how often the last few token shapes stand before a final mark, counted over
all replies.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.automaton import SuffixAutomaton
from plumbline.session import stage, table

# Stop reasons that say the model declined, and answers that stand for "no answer".
REFUSED_STOPS = {"refusal", "refused", "content_filter", "safety", "blocked"}
PLACEHOLDERS = {
    "none", "null", "nil", "nan", "na", "n a", "tbd", "todo", "empty", "no rationale", "rationale", "no reason",
    "no answer", "not available", "not applicable", "unknown", "blank", "missing", "undefined", "placeholder",
}
# Wordings by which a model declines, lower case, straight apostrophes.
REFUSALS = [
    "i cannot assist", "i can't assist", "i can not assist", "i cannot help", "i can't help", "i can not help",
    "i'm unable to", "i am unable to", "i am not able to", "i'm not able to", "i won't be able", "i will not be able",
    "i must decline", "i have to decline", "i decline to", "i would rather not", "i'd rather not", "i have to pass",
    "i must pass on", "i'll pass on", "i am not comfortable", "i'm not comfortable", "not something i can",
    "outside what i can", "beyond what i can", "against my guidelines", "against my policy", "against my policies",
    "i do not take part in", "i don't take part in", "i refuse to", "i cannot comply", "i can't comply",
    "i cannot provide", "i can't provide", "i cannot answer", "i can't answer", "i cannot judge", "i can't judge",
    "i cannot discuss", "i can't discuss", "i cannot fulfil", "i can't fulfil", "as an ai ", "i'm sorry, but i can",
    "ich kann dabei nicht helfen", "dabei kann ich nicht", "ich kann das nicht", "ich kann diese anfrage nicht",
    "ich muss ablehnen", "ich möchte das nicht beurteilen", "das kann ich nicht beurteilen",
    "je ne peux pas", "je ne suis pas en mesure", "je dois refuser", "je préfère ne pas", "je refuse de",
    "no puedo ayudar", "no puedo responder", "no puedo juzgar", "debo rechazar", "prefiero no responder",
    "lo siento, no puedo", "я не могу помочь", "я не могу ответить", "я вынужден отказаться", "我无法", "我不能",
    "抱歉，我", "对不起，我",
]
# Frequent function words by language.
STOPWORDS = {
    "en": "the of and to in is that it for as with was on by be this are from at which or an not have has had they "
    "these but if can do does did there their than its who what two both how why please these".split(),
    "de": "der die das und ist nicht den dem des ein eine einen einem einer zu von mit sich auf für im es sie er wir "
    "ich dass auch als wie oder aber wenn war sind hat haben wird kann beide beiden nur noch so um aus bei".split(),
    "fr": "le la les un une des du de et est que qui ne pas dans en au aux ce cette ces il elle ils elles on se sa son "
    "ses pour par sur avec plus mais ou où si deux sont être été peut peuvent vous nous".split(),
    "es": "el la los las un una unos unas de del y es que no en al por para con su sus se lo como más pero o si son "
    "ser está están puede pueden dos ambas esta este estas estos porque entre fue".split(),
}
_VOTE = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words):
        _VOTE.setdefault(_w, []).append(_lang)
# Scripts that settle a text's language on their own.
SCRIPTS = [
    ("ja", re.compile(r"[぀-ヿ]")), ("zh", re.compile(r"[㐀-鿿]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")), ("ar", re.compile(r"[؀-ۿ]")),
    ("hi", re.compile(r"[ऀ-ॿ]")), ("th", re.compile(r"[฀-๿]")),
    ("ko", re.compile(r"[가-힯]")), ("el", re.compile(r"[Ͱ-Ͽ]")),
    ("he", re.compile(r"[֐-׿]")),
]
PAIRS = {"“": "”", "„": "“”", "«": "»", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "《": "》"}
_TOKEN = re.compile(
    r"[㐀-鿿぀-ヿ]|\d+(?:[.,:]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?…。！？؟।]+|[^\w\s]"
)
_FINAL = re.compile(r"[.!?…。！？؟।]+$")
_WORD = re.compile(r"[㐀-鿿぀-ヿ]|[^\W_]+")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」")
_LETTERS = re.compile(r"[^\W\d_]+")
CONTEXTS = (4, 3, 2)
#: Codes of contexts that a task holds before it adds them up.
HELD = 1 << 21


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in REFUSALS:
        a.add_word(p, p)
    a.make_automaton()
    return a


def rationale_of(output: str | None) -> tuple[str | None, bool]:
    """(rationale, cut): the reply's rationale, and whether its JSON breaks off inside it."""
    if output is None:
        return None, False
    try:
        d = json.loads(output)
        r = d.get("rationale") if isinstance(d, dict) else None
        return (r if isinstance(r, str) else None), False
    except ValueError:
        m = re.search(r'"rationale"\s*:\s*"((?:[^"\\]|\\.)*)("?)', output, re.S)
        if not m:
            return None, False
        try:
            return json.loads(f'"{m[1]}"', strict=False), not m[2]
        except ValueError:
            return m[1], not m[2]


def bare_words(text: str) -> list[str]:
    """Lower-case words without their marks (a mark inside a word joins its parts); Han and kana by character."""
    t = re.sub(r"[^\w\s㐀-鿿぀-ヿ]+", "", text.casefold().replace("_", " "))
    return re.findall(r"[㐀-鿿぀-ヿ]|[^\s㐀-鿿぀-ヿ]+", t)


def has_content(text: str | None) -> bool:
    if text is None:
        return False
    words = _WORD.findall(text.casefold())
    return bool(words) and " ".join(words) not in PLACEHOLDERS


def language_votes(text: str) -> tuple[str | None, int, int]:
    """(language, votes, lead over the second); a script of its own counts by characters, Latin text by stopwords."""
    if not text.isascii():
        for lang, rx in SCRIPTS:
            n = len(rx.findall(text))
            if n and n * 4 >= sum(c.isalpha() for c in text):
                return lang, n, n
    votes = dict.fromkeys(STOPWORDS, 0)
    for w in _LETTERS.findall(text.lower()):
        for lang in _VOTE.get(w, ()):
            votes[lang] += 1
    (best, n), (_, m) = sorted(votes.items(), key=lambda x: -x[1])[:2]
    return (best, n, n - m) if n else (None, 0, 0)


def shapes(text: str) -> tuple[list[str], list[str]]:
    """Tokens and their shapes: a number is ``#``, a capitalised word inside a sentence ``N``, others lower case."""
    tokens = _TOKEN.findall(text)
    out, start = [], True
    for t in tokens:
        if t[0].isdigit():
            out.append("#")
        elif _FINAL.fullmatch(t):
            out.append(".")
        elif t[0].isupper() and not start:
            out.append("N")
        else:
            out.append(t.lower())
        if t[0].isalnum():
            start = False
        elif out[-1] == ".":
            start = True
    return tokens, out


class Codes(dict):
    """Numbers of words and token shapes, the same in every task."""

    def __missing__(self, name: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[name] = xxhash.xxh64_intdigest(name)
        return code


def contexts(shapes_: list[int], words: list[int], place: list[int]) -> np.ndarray:
    """For every token a row: the runs of so many shapes as ``CONTEXTS`` says that end with it, and its word. ``place``
    is the token's place in its reply: runs do not reach back into the reply before."""
    h, at = np.array(shapes_, np.uint64), np.array(place)
    out = np.empty((len(h), len(CONTEXTS) + 1), np.uint64)
    parts = [h]
    for j in range(1, max(CONTEXTS)):
        back = np.zeros_like(h)
        back[j:] = h[:-j] * np.uint64(0x9E3779B97F4A7C15 >> 3 * j | 1)
        back[at < j] = 0
        parts.append(back)
    for x, k in enumerate(CONTEXTS):
        out[:, x] = sum(parts[:k], np.uint64(k))
    out[:, -1] = words
    return out.view(np.int64)


def open_delimiters(text: str) -> bool:
    """Whether a quotation mark or bracket stays open at the end of ``text``."""
    stack: list[str] = []
    plain = False
    for c in text:
        if c == '"':
            plain = not plain
        elif stack and c in stack[-1]:
            stack.pop()
        elif c in PAIRS:
            stack.append(PAIRS[c])
    return plain or bool(stack)


def _endings(tokens: list[str], shape: list[str]) -> tuple[list[int], list[bool]]:
    """Tokens that are words, the last token apart as nothing follows it, and whether a final mark ends a sentence
    right after them."""
    n = len(shape) - 1
    at = [i for i in range(n) if shape[i] != "." and tokens[i][0].isalnum()]
    end = [
        shape[i + 1] == "." and (i + 1 == n or tokens[i + 2][0].isupper() or not tokens[i + 2][0].isascii()) for i in at
    ]
    return at, end


class Counts:
    """How often each context stands before a final mark, and at all."""

    def __init__(self):
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, codes: np.ndarray, ends: np.ndarray):
        self.codes.append(codes.ravel())
        self.times.append(np.stack([np.repeat(ends, codes.shape[1]), np.ones(codes.size, np.int64)], 1))

    def __len__(self) -> int:
        return sum(map(len, self.codes))

    def shrink(self):
        keys, where = np.unique(np.concatenate(self.codes), return_inverse=True)
        n = np.concatenate(self.times)
        self.codes, self.times = [keys], [np.stack([np.bincount(where, n[:, i]).astype(np.int64) for i in (0, 1)], 1)]

    def frame(self) -> pd.DataFrame:
        self.shrink()
        out = {"reply_id": None, "verdict": None, "must": None, "final": None, "ctx": None, "known": None}
        out |= {"code": self.codes[0], "n_end": self.times[0][:, 0], "n_all": self.times[0][:, 1]}
        self.codes, self.times = [], []
        return pd.DataFrame(out)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over the replies: what each shows by itself with the contexts whose counts must say whether it is
    finished, and (rows with a null reply) how often each context stands before a final mark and at all."""
    refusals, numbers, counts = _automaton(), Codes(), Counts()
    for pdf in batches:
        rows, kinds, words, place, at, ends = [], [], [], [], [], []
        for rid, request, output, stop in zip(pdf["reply_id"], pdf["request"], pdf["output"], pdf["stop_reason"]):
            text, cut = rationale_of(output)
            tokens, shape = shapes(text) if text else ([], [])
            first = len(kinds)
            kinds.extend([numbers[x] for x in shape])
            words.extend([numbers["w|" + t.lower()] for t in tokens])
            place.extend(range(len(shape)))
            mine, end = _endings(tokens, shape)
            at.extend([first + i for i in mine])
            ends.extend(end)
            verdict, must, final, last, known = _judge(request, text, cut, stop, tokens, refusals)
            rows.append((rid, verdict, must, final, None if last is None else first + last, known))
        runs = contexts(kinds, words, place)
        counts.add(runs[at], np.array(ends, np.int64))
        out = pd.DataFrame(rows, columns=["reply_id", "verdict", "must", "final", "ctx", "known"])
        out["ctx"] = [[] if np.isnan(i) else runs[int(i)].tolist() for i in out["ctx"].astype(float)]
        yield out.assign(code=None, n_end=None, n_all=None)
        if len(counts) > HELD:
            counts.shrink()
            if len(counts) > HELD // 2:
                yield counts.frame()
    if len(counts):
        yield counts.frame()


def _judge(request: str | None, text: str | None, cut: bool, stop: str | None, tokens: list[str], refusals):
    """(verdict, must, final, last, known): what one reply shows by itself, see ``defects``; ``last`` is the place of
    the word that the text ends with, null if it ends otherwise."""
    verdict, must, final, last, known = None, cut, False, None, False
    low = (text or "").lower().replace("’", "'")
    unquoted = _QUOTED.sub(" ", low)
    if (stop or "").strip().lower() in REFUSED_STOPS or next(refusals.iter(unquoted), None):
        return "refusal", must, final, last, known
    if not has_content(text):
        return "empty", must, final, last, known
    words = bare_words(text)
    asked = bare_words(request) if request else []
    there = set(asked)
    if len(words) >= 2 and sum(w in there for w in words) >= 0.7 * len(words):
        spare = max(2, round(0.2 * len(words))) if len(words) > 2 else 0
        if len(words) - SuffixAutomaton(asked).coverage(words, min(3, len(words))) <= spare:
            return "copy", must, final, last, known
    whole = text.rstrip()
    bare = whole.rstrip("\"'”’»“)]}」』）》")
    stripped = bare.rstrip()
    final = bool(_FINAL.search(stripped))
    must = must or open_delimiters(text) or bool(re.search(r"[\w][-‐–]$|[,;:，、；：]$", stripped))
    left = len(tokens) - (len(whole) - len(bare)) - final  # each closing mark, and the final marks, are a token
    if left > 0 and tokens[left - 1][0].isalnum():
        last, t = left - 1, tokens[left - 1]
        known = t[0].isdigit() or (t[0].isupper() and t.lower() in there)
    if request:
        a, b = language_votes(request), language_votes(_QUOTED.sub(" ", text))
        if a[0] and b[0] and a[0] != b[0] and a[2] >= 2 and b[1] >= 2 and b[2] >= 1:
            verdict = "language"
    return verdict, must, final, last, known


def latest_replies(llm: DataFrame) -> DataFrame:
    """One row per reply: the one created last. Replies without an id are dropped."""
    last = F.max_by(F.struct("request", "output", "stop_reason", "schema_name"), F.struct("created_at", "output"))
    return llm.where("reply_id is not null").groupBy("reply_id").agg(last.alias("x")).select("reply_id", "x.*")


def defects(llm: DataFrame, schema_name: str = "RelationV22", least: int = 4) -> DataFrame:
    """``(reply_id, defect)`` for every defective reply with ``schema_name``.

    Defects, the first that holds: ``refusal``, ``empty``, ``copy`` (at most a fifth of the words, or two, lie outside
    runs of three or more of the request's words), ``truncated``, ``language``. ``truncated``: an open delimiter, a
    dangling hyphen or comma, or no final mark after a run of token shapes that in the table stands before a final
    mark less than three times in ten, or 15 in a hundred for runs of two or three (the longest run of up to four tokens
    that occurs often enough, at last the word alone; a name that only the request has counts as whole). Null ids are dropped; a null output or rationale is
    ``empty``; a null request shows neither copies nor languages; repeated rows count once; empty tables give no rows.
    """
    replies = latest_replies(llm).where(F.col("schema_name") == schema_name).select(
        "reply_id", "request", "output", "stop_reason"
    )
    schema = "reply_id long, verdict string, must boolean, final boolean, ctx array<long>, known boolean, code long, n_end long, n_all long"
    read = stage(replies.mapInPandas(_read, schema))
    counts = read.where("reply_id is null").groupBy(F.col("code").alias("ctx")).agg(
        F.sum("n_end").alias("n_end"), F.sum("n_all").alias("n_all"))
    judged = read.where("reply_id is not null").select("reply_id", "verdict", "must", "final", "ctx", "known")
    k = F.col("k")
    asked = judged.where("verdict is null or verdict = 'language'").select(
        "reply_id", "final", "must", "known", "verdict", F.posexplode_outer("ctx").alias("k", "ctx")
    )
    ratio = F.col("n_end") / F.col("n_all") * F.when(k == 0, 1).when(k == len(CONTEXTS), 1).otherwise(2)
    enough = F.col("n_all") >= F.when(F.col("final"), 40).when(k == 0, 2).when(k == len(CONTEXTS), 1).otherwise(least)
    ends = (
        asked.join(counts, "ctx", "left").groupBy("reply_id").agg(
            F.first("final").alias("final"), F.first("must").alias("must"), F.first("known").alias("known"),
            F.first("verdict").alias("verdict"),
            F.min_by(ratio, F.when(enough, k)).alias("ratio"),
            F.max(F.when(k == len(CONTEXTS), F.coalesce("n_all", F.lit(0)))).alias("seen"),
        )
    )
    cut = F.when(F.col("final"), F.col("must") | F.coalesce(F.col("ratio") < 0.01, F.lit(False))).otherwise(
        F.col("must")
        | F.coalesce(F.col("ratio") < 0.3, F.lit(False))
        | ((F.coalesce("seen", F.lit(0)) == 0) & ~F.col("known"))
    )
    loose = ends.select("reply_id", F.when(cut, F.lit("truncated")).otherwise(F.col("verdict")).alias("defect"))
    sure = judged.where("verdict in ('refusal', 'empty', 'copy')").select("reply_id", F.col("verdict").alias("defect"))
    return sure.unionByName(loose.where("defect is not null"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "llm"))


def p1_defect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model: replies and defective replies by type."""
    llm = table(spark, sf_dir, "llm")
    model = llm.where("schema_name = 'RelationV22' and reply_id is not null").groupBy("reply_id").agg(
        F.max_by("model", F.struct("created_at", "output")).alias("model")
    )
    found = model.join(defects(llm), "reply_id", "left")
    return found.groupBy("model").agg(
        F.count(F.lit(1)).alias("replies"),
        *[
            F.sum(F.when(F.col("defect") == d, 1).otherwise(0)).alias(d)
            for d in ("refusal", "empty", "copy", "truncated", "language")
        ],
    )
