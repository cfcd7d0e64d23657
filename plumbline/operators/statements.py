"""Statements that order entities, and the directed relations they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import normalize_ws
from plumbline.operators.entity_graph import canonical_key, equality_classes, expand_superlatives
from plumbline.session import stage

# Which side of a comparison is the greater one, by kind of order (greater is later, or more).
LEXICON = {
    "sequence": {
        "subject": ["after", "later than", "behind", "followed"],
        "object": ["before", "earlier than", "ahead of", "preceded", "prior to"],
        "max": ["last", "final"],
        "min": ["first", "earliest"],
    },
    "magnitude": {
        "subject": ["older", "taller", "heavier", "larger", "bigger", "longer", "more", "higher"],
        "object": ["younger", "shorter", "lighter", "smaller", "less", "fewer", "lower"],
        "max": ["oldest", "tallest", "heaviest", "largest", "biggest", "longest", "most", "highest"],
        "min": ["youngest", "shortest", "lightest", "smallest", "least", "fewest", "lowest"],
    },
}
# Comparisons used as an attribute's name, the attribute they compare, and whether they point to less.
COMPARATIVES = {
    "older": ("age", False), "younger": ("age", True), "taller": ("height", False), "shorter": ("height", True),
    "heavier": ("weight", False), "lighter": ("weight", True), "later": ("time", False), "earlier": ("time", True),
    "faster": ("speed", False), "slower": ("speed", True),
}
WORDS = list(dict.fromkeys(w for kinds in LEXICON.values() for words in kinds.values() for w in words))
_EDGE = r"""[ \t\n"'.,;:!?()\[\]]+"""


def comparative_key(c: Column) -> Column:
    """Lower case, blanks collapsed, marks at the ends off, then a leading "the" and a trailing "than"."""
    t = F.regexp_replace(normalize_ws(F.lower(c)), f"^{_EDGE}|{_EDGE}$", "")
    return F.regexp_replace(F.regexp_replace(t, "^the ", ""), "(.) than$", "$1")


def lexicon(spark: SparkSession) -> DataFrame:
    """``(order_kind, comparative, lexical)``: some forty rows."""
    rows = [(kind, w, side) for kind, sides in LEXICON.items() for side, words in sides.items() for w in words]
    t = spark.createDataFrame(rows, "order_kind string, comparative string, lexical string")
    return t.withColumn("comparative", comparative_key(F.col("comparative")))


def lexicon_words(c: Column) -> Column:
    """The lexicon's words and phrases in a text, lower case, in the order of the text."""
    longest = "|".join(sorted(WORDS, key=len, reverse=True))
    return F.transform(F.regexp_extract_all(normalize_ws(c), F.lit(rf"(?i)\b({longest})\b"), 1), F.lower)


def attribute_key(c: Column) -> Column:
    """An attribute's normal form; a comparison is renamed to what it compares."""
    key = canonical_key(c)
    pairs = F.create_map(*[F.lit(x) for k, (name, _) in COMPARATIVES.items() for x in (k, name)])
    return F.coalesce(pairs[key], key)


def normalize_relations(relations: DataFrame) -> DataFrame:
    """``attribute, a, b`` in normal form; ``greater`` under an attribute that points to less has its ends swapped."""
    less = [k for k, (_, toward) in COMPARATIVES.items() if toward]
    swap = (F.col("kind") == "greater") & canonical_key(F.col("attribute")).isin(less)
    a, b = canonical_key(F.col("a")), canonical_key(F.col("b"))
    return relations.withColumns({
        "attribute": attribute_key(F.col("attribute")), "a": F.when(swap, b).otherwise(a), "b": F.when(swap, a).otherwise(b),
    })


class Derivation:
    """What statements stand for, as staged tables.

    ``statements(doc_id, seq, claim_id, statement, attribute, comparative, subject, object, restriction, confidence)``
    with statement ``order``, ``extreme`` (of the subject), ``same`` or ``different``; ``kinds(doc_id, attribute, seq,
    order_kind)`` and ``senses(doc_id, attribute, comparative, seq, greater_side)`` are what a model said, first ones
    first; ``claims(doc_id, claim_id)`` are the claims that exist.

    The lexicon's side counts where it has the comparison for the attribute's kind of order, else the model's.
    Statements of unknown claims are dropped. An extreme with a restriction stands for nothing; any other for one
    ``greater`` relation with each participant of its attribute outside its own class.
    """

    def __init__(self, statements: DataFrame, kinds: DataFrame, senses: DataFrame, claims: DataFrame):
        spark = statements.sparkSession
        known = statements.join(claims.select("doc_id", "claim_id").distinct(), ["doc_id", "claim_id"], "left_semi")
        s = known.withColumns({
            "stated": F.col("comparative"), "attribute": attribute_key(F.col("attribute")), "comparative": comparative_key(F.col("comparative")),
            "subject": canonical_key(F.col("subject")), "object": canonical_key(F.col("object")),
            "restricted": F.coalesce(F.length(F.trim("restriction")) > 0, F.lit(False)) & (F.col("statement") == "extreme"),
        })
        kind = kinds.where("order_kind is not null").groupBy("doc_id", attribute_key(F.col("attribute")).alias("attribute")).agg(
            F.min_by("order_kind", "seq").alias("order_kind"))
        model = senses.where("greater_side is not null").groupBy(
            "doc_id", attribute_key(F.col("attribute")).alias("attribute"), comparative_key(F.col("comparative")).alias("comparative")
        ).agg(F.min_by("greater_side", "seq").alias("model"))
        s = s.drop("order_kind", "greater_side").join(kind, ["doc_id", "attribute"], "left").join(model, ["doc_id", "attribute", "comparative"], "left")
        s = s.join(F.broadcast(lexicon(spark)), ["order_kind", "comparative"], "left")
        self.sided = stage(s.withColumn("side", F.coalesce("lexical", "model")))

    def _directed(self) -> DataFrame:
        return self.sided.where("statement in ('order', 'extreme') and not restricted")

    def overrides(self) -> DataFrame:
        """Statements whose side the lexicon and the model see differently."""
        return self._directed().where("lexical <> model").select("doc_id", "claim_id", "attribute", F.col("stated").alias("comparative"), "model", "lexical")

    def unresolved(self) -> DataFrame:
        """Statements without a side, or with one of the wrong kind."""
        fits = F.when(F.col("statement") == "order", F.col("side").isin("subject", "object")).otherwise(F.col("side").isin("max", "min"))
        return self._directed().where(~F.coalesce(fits, F.lit(False))).select(
            "doc_id", "claim_id", "attribute", F.col("stated").alias("comparative"), "statement", F.col("side").alias("sense"))

    def restricted(self) -> DataFrame:
        return self.sided.where("restricted").select("doc_id", "claim_id", "attribute", F.col("subject").alias("entity"), "restriction")

    def expanded(self) -> DataFrame:
        """The relations that unrestricted extremes stand for, with their ``side``."""
        s = self._directed()
        x = s.where("statement = 'extreme' and side in ('max', 'min')").select(
            "doc_id", "claim_id", "attribute", F.col("subject").alias("entity"), "side")
        p = s.select("doc_id", "attribute", F.col("subject").alias("entity")).unionByName(
            s.where("statement = 'order'").select("doc_id", "attribute", F.col("object").alias("entity"))).distinct()
        same = self.sided.where("statement in ('same', 'different')").select(
            "doc_id", "attribute", F.col("statement").alias("kind"), F.col("subject").alias("a"), F.col("object").alias("b"))
        return expand_superlatives(x, p, equality_classes(same))

    def relations(self) -> DataFrame:
        """``(doc_id, claim_id, attribute, kind, a, b, from_extreme)``: all relations, stated and derived."""
        cols = ["doc_id", "claim_id", "attribute"]
        s = self.sided
        stated = s.where("statement in ('same', 'different')").select(
            *cols, F.col("statement").alias("kind"), F.col("subject").alias("a"), F.col("object").alias("b"), F.lit(False).alias("from_extreme"))
        up = F.col("side") == "subject"
        order = s.where("statement = 'order' and side in ('subject', 'object')").select(
            *cols, F.lit("greater").alias("kind"), F.when(up, F.col("subject")).otherwise(F.col("object")).alias("a"),
            F.when(up, F.col("object")).otherwise(F.col("subject")).alias("b"), F.lit(False).alias("from_extreme"))
        most = self.expanded().select(*cols, F.lit("greater").alias("kind"), "a", "b", F.lit(True).alias("from_extreme"))
        return stated.unionByName(order).unionByName(most)
