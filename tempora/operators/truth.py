"""Truth among conflicting claims (D18, N4): source reliability and claim truth, estimated together on grouped counts.

Sources claim values of objects. A value is the likelier the more reliable
sources claim it; a source is the more reliable the likelier its claims are. The
two are estimated in turns, from the reliability class of each source, which
is a prior and no verdict.

Objects about whose values the same sources agree and disagree in the same way
have the same answer. So the turns run on one object of each such pattern, with
the number of objects as its weight, and their cost follows the number of
patterns. A pattern is recognised by sums of hashes; no list of claims is
collected, however many there are for one object.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The share of right claims with which a source of a class starts.
PRIORS = {"A": 0.95, "B": 0.85, "C": 0.7, "D": 0.5}
#: No source is taken to be always right or always wrong.
LEAST, MOST = 0.01, 0.99


@dataclass(frozen=True)
class Truth:
    """``values``: object, value, claims, probability, unknown (mass of values that no one claims), disagreement. ``sources``: source, claims, reliability."""

    values: DataFrame
    sources: DataFrame
    turns: int
    patterns: int


def class_prior(reliability_class: Column) -> Column:
    """The prior of a class; an unknown class has that of D."""
    out = F.lit(PRIORS["D"])
    for name, p in PRIORS.items():
        out = F.when(reliability_class == name, p).otherwise(out)
    return out


def _hash_sum(seed: int, *columns: str) -> Column:
    return F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)"))


def agreement_patterns(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of claims (object, value, source), each once: (object, value, claims, side, pattern), and (pattern, objects, example).

    ``side`` stands for the sources of a value, ``pattern`` for the sides of an
    object; both are pairs of sums of 64-bit hashes with different seeds.
    """
    sides = claims.groupBy("object", "value").agg(F.count(F.lit(1)).alias("claims"), F.struct(_hash_sum(1, "source").alias("a"), _hash_sum(2, "source").alias("b")).alias("side"))
    whole = sides.groupBy("object").agg(F.struct(_hash_sum(3, "side"), _hash_sum(4, "side"), F.count(F.lit(1))).alias("pattern"))
    classes = whole.groupBy("pattern").agg(F.count(F.lit(1)).alias("objects"), F.min("object").alias("example"))
    return sides.join(whole, "object"), classes


def _probabilities(votes: DataFrame, reliability: DataFrame, wrong: int) -> DataFrame:
    """(object, value, probability, unknown) of claims, for the reliabilities given."""
    vote = F.log(F.lit(float(wrong)) * F.col("reliability") / (1 - F.col("reliability")))
    scores = votes.join(reliability, "source").groupBy("object", "value").agg(F.sum(vote).alias("score"))
    # A value that no one claims has the score 0.
    top = scores.groupBy("object").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("top"), F.greatest(F.lit(wrong + 1) - F.count(F.lit(1)), F.lit(0)).alias("unclaimed"))
    mass = scores.join(top, "object").withColumn("e", F.exp(F.col("score") - F.col("top")))
    rest = F.col("unclaimed") * F.exp(-F.first("top"))
    totals = mass.groupBy("object", "unclaimed").agg((F.sum("e") + rest).alias("total"), (rest / (F.sum("e") + rest)).alias("unknown")).drop("unclaimed")
    return mass.join(totals, "object").select("object", "value", (F.col("e") / F.col("total")).alias("probability"), "unknown")


def estimate(claims: DataFrame, priors: DataFrame, wrong: int, save: Callable[[DataFrame], DataFrame], strength: float = 10.0, turns: int = 30, tolerance: float = 1e-4) -> Truth:
    """Joint estimate for ``claims`` (object, value, source) and ``priors`` (source, prior).

    ``wrong`` is the number of wrong values that a claim could take; what no one
    claims keeps its share as unknown mass. ``strength`` is how many claims a
    prior is worth. A claim that is repeated counts once: republication is no
    corroboration. A claim with a null, or of a source without a prior, does not
    count. It ends after ``turns``, or when no reliability moves by ``tolerance``.
    """
    first = save(priors.select("source", F.col("prior").cast("double").alias("prior")).filter("source IS NOT NULL AND prior IS NOT NULL").dropDuplicates(["source"]))
    once = save(claims.select("object", "value", "source").dropna().join(first.select("source"), "source", "left_semi").distinct())
    sides, classes = agreement_patterns(once)
    sides, classes = save(sides), save(classes)
    votes = save(once.join(classes.select(F.col("example").alias("object"), "objects"), "object"))
    bounded = lambda c: F.least(F.greatest(c, F.lit(LEAST)), F.lit(MOST))
    now, done = first.select("source", bounded(F.col("prior")).alias("reliability")), 0
    for done in range(1, turns + 1):
        said = votes.join(_probabilities(votes, now, wrong), ["object", "value"])
        right = said.groupBy("source").agg(F.sum(F.col("objects") * F.col("probability")).alias("right"), F.sum("objects").alias("claims"))
        share = (F.col("prior") * strength + F.coalesce("right", F.lit(0.0))) / (F.lit(strength) + F.coalesce("claims", F.lit(0)))
        new = save(first.join(right, "source", "left").select("source", F.coalesce("claims", F.lit(0)).cast("long").alias("claims"), bounded(share).alias("reliability")))
        moved = new.join(now.select("source", F.col("reliability").alias("was")), "source").agg(F.max(F.abs(F.col("reliability") - F.col("was")))).first()[0]
        now = new.select("source", "reliability")
        if moved is None or moved < tolerance:
            break
    found = _probabilities(votes, now, wrong)
    # An object's values have the probabilities of its pattern's example, side by side; equal sides have equal ones.
    known = found.join(sides.select("object", "value", "side", "pattern"), ["object", "value"]).groupBy("pattern", "side").agg(F.max("probability").alias("probability"), F.max("unknown").alias("unknown"))
    values = sides.join(known, ["pattern", "side"]).select("object", "value", "claims", "probability", "unknown")
    spread = lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0)
    doubt = values.groupBy("object").agg(((F.sum(spread(F.col("probability"))) + spread(F.max("unknown"))) / F.log(F.lit(float(wrong + 1)))).alias("disagreement"))
    return Truth(values.join(doubt, "object"), new, done, classes.count())
