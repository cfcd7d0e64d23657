"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Titles after which a full stop ends no sentence.
TITLES = "Mr|Mrs|Ms|Dr|St|Prof"


def normalize_ws(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def simple_sentences(c: Column) -> Column:
    """Sentences of plain English: cut after ``. ! ?`` before blanks and a capital, but not after a title."""
    return F.split(normalize_ws(c), rf"(?<=[.!?])(?<!\b(?:{TITLES})\.) (?=[A-Z])")


def plain_words(c: Column) -> Column:
    """Lower-case words without punctuation; an empty array for null, empty or mark-only text."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\p{P}", ""), r"[\s\p{Z}]+", " "))
    return F.when(F.length(t) > 0, F.split(t, " ")).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def folded(c: Column) -> Column:
    """Compatibility form (NFKC), caseless; plain ASCII never leaves the JVM's own functions' result."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), F.lower(c)).otherwise(_folded(c))


def folded_words(c: Column) -> Column:
    """Words in compatibility form, caseless, without punctuation; an empty array for null, empty or mark-only text."""
    t = F.trim(F.regexp_replace(F.regexp_replace(folded(c), r"\p{P}", ""), r"[\s\p{Z}]+", " "))
    return F.when(F.length(t) > 0, F.split(t, " ")).otherwise(F.array().cast("array<string>"))


def review_form(c: Column) -> Column:
    """Compatibility form, caseless, without quotation marks, blanks collapsed: how reviews compare statements."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(c), "[\u201c\u201d\u2018\u2019\"']", ""), r"[\s\p{Z}]+", " "))


def word_grams(words: Column, k: int) -> Column:
    """Distinct runs of ``k`` words; none for shorter texts."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n >= k, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    # the lambda binds the words, which would else be split again for every run
    return F.get(F.transform(F.array(words), runs), 0)


def occurrences(text: Column, needle: Column) -> Column:
    """How often the literal ``needle`` occurs, without overlaps; 0 for an empty needle, null for nulls."""
    gone = F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, ((F.length(text) - gone) / F.length(needle)).cast("int")).otherwise(F.when(text.isNotNull() & needle.isNotNull(), 0))


def clock_minutes(c: Column) -> Column:
    """``HH:MM`` as minutes, hours from 24 on included; null for anything else."""
    part = lambda i: F.regexp_extract(c, r"^\s*([0-9]{1,3}):([0-5][0-9])\s*$", i)
    return F.when(c.rlike(r"^\s*[0-9]{1,3}:[0-5][0-9]\s*$"), part(1).cast("int") * 60 + part(2).cast("int"))


def length_range(n: Column) -> tuple[Column, Column]:
    """The lengths that count as near ``n``: within 15 percent or 25 words, whichever is more."""
    spare = F.greatest(F.ceil(n * 15 / 100), F.lit(25))
    return F.greatest(n - spare, F.lit(0)), n + spare


def canonical_cycle(c: Column) -> Column:
    """A cycle's nodes from the smallest on, in the direction whose second node is the smaller one."""
    n = F.size(c)
    at = F.array_position(c, F.array_min(c)).cast("int")
    turned = F.concat(F.slice(c, at, n), F.slice(c, F.lit(1), at - 1))
    back = F.concat(F.slice(turned, F.lit(1), F.lit(1)), F.reverse(F.slice(turned, F.lit(2), n)))
    return F.when(n < 3, F.array_sort(c)).when(F.get(turned, 1) <= F.get(back, 1), turned).otherwise(back)
