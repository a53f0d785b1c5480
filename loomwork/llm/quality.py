"""Quality by perplexity: an interpolated modified Kneser-Ney trigram model of trusted text, one per language.

``scores`` uses the model of ``word_model``: every word of trusted text is a token. A document is rejected if its cross
entropy is beyond a bound made of quantiles of its language's trusted text of like length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_model
from .common import materialize

#: A language has a model of its own if so many trusted documents speak it; the others share one of all trusted text.
LEAST_DOCS = 20
#: The bound is the upper quantile plus (upper - median): a tail as long again. Lengths in tokens that part the classes.
UPPER, MIDDLE, LENGTHS = 0.99, 0.5, (16, 64)
#: Trusted documents are parted by a hash of their id: of HALVES parts the first gives the bounds, the model is trained on the rest.
HALVES = 2
#: A class with fewer trusted documents takes its language's quantiles, with twice the tail.
LEAST_CLASS = 20
POOLED = "*"


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents labelled of good quality and not toxic, in all rows of ``labels``."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # a merge join at every size: what is shuffled then grows with the input, and no side has to fit anywhere
    return docs.join(good.hint("merge"), "doc_id", "left_semi")


def _part() -> F.Column:
    """0 for documents whose perplexity gives the bounds."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(HALVES))


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))


def length_class() -> F.Column:
    return sum((F.col("n_tokens") >= edge).cast("int") for edge in LENGTHS)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, lang, n_tokens, perplexity, bound, rejected)`` per row of ``docs``.

    ``bound`` is the largest perplexity that passes; it comes from trusted documents that the model has not seen. Without trusted text nothing is rejected and perplexity is null. A null
    text is empty, a null language is one of its own; labels with null fields are no trust. Repeated rows stay repeated.
    """
    own = _own(docs)
    good = materialize(trusted(own.where(_part() > 0), labels), "trusted")
    spoken = {r["lang"] for r in good.groupBy("lang").agg(F.count("*").alias("n")).where(f"n >= {LEAST_DOCS}").select("lang").collect()}
    if not spoken and not good.take(1):
        return own.selectExpr("doc_id", "lang", "cast(null as long) as n_tokens", "cast(null as double) as perplexity", "cast(null as double) as bound", "false as rejected")
    texts = good.where(F.col("lang").isin(*spoken)) if spoken else good.where("false")
    texts = texts.withColumn("model_lang", F.col("lang"))
    pooled = not spoken or bool(own.where(~F.col("lang").isin(*spoken)).take(1))
    if pooled:
        texts = texts.unionByName(good.withColumn("model_lang", F.lit(POOLED)))
    used = F.when(F.col("lang").isin(*spoken), F.col("lang")).otherwise(POOLED) if spoken else F.lit(POOLED)
    rows = own.withColumn("model_lang", used)
    if pooled and spoken:
        # the pooled bounds come from held-out trusted text of all languages, so its other rows meet the pooled model too
        rows = rows.unionByName(trusted(own.where(_part() == 0), labels).where(F.col("lang").isin(*spoken)).withColumn("model_lang", F.lit(POOLED)))
    found = materialize(word_model.entropies(rows, texts).withColumn("class", length_class()), "entropies")
    known = trusted(found, labels).where(_part() == 0)
    both = [F.percentile_approx("entropy", [MIDDLE, UPPER], 10_000).alias("q"), F.count("*").alias("n")]
    classes = known.groupBy("model_lang", "class").agg(*both).where(f"n >= {LEAST_CLASS}").selectExpr("model_lang", "class", "2 * q[1] - q[0] as edge")
    whole = known.groupBy("model_lang").agg(*both).selectExpr("model_lang", "3 * q[1] - 2 * q[0] as wide")
    # a row per language and class
    asked = found.where((F.col("model_lang") != POOLED) | ~F.col("lang").isin(*spoken)) if pooled and spoken else found
    judged = asked.join(F.broadcast(classes), ["model_lang", "class"], "left").join(F.broadcast(whole), "model_lang", "left").withColumn("at_most", F.coalesce("edge", "wide"))
    return judged.selectExpr("doc_id", "lang", "n_tokens", "exp(entropy) as perplexity", "exp(at_most) as bound", "coalesce(entropy > at_most, false) as rejected")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass; all columns stay. Rows of one doc_id go or stay by its best row, rows without one each by its own text."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    passed = scores(docs.select(key.alias("doc_id"), "lang", "text"), labels).where("not rejected").select(F.col("doc_id").alias("passing_key")).distinct()
    return docs.join(passed, key == passed.passing_key, "left_semi")
