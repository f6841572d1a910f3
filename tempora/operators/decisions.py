"""Policies and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.temporal import asof_join


def policy_result(metric: Column, operator: Column, threshold: Column, margin: Column) -> Column:
    """PASS, WARN, BREACH or UNKNOWN_DATA (Y1). Null is looked at first: a comparison with it would fall through."""
    breach = F.when(operator == ">=", metric < threshold).otherwise(metric > threshold)
    near = F.when(operator == ">=", metric < threshold + margin).otherwise(metric > threshold - margin)
    return F.when(metric.isNull() | threshold.isNull(), "UNKNOWN_DATA").when(breach, "BREACH").when(near, "WARN").otherwise("PASS")


def evaluate_policies(metrics: DataFrame, policies: DataFrame) -> DataFrame:
    """Every enabled policy on every owner's metric of its name (Y1-Y3); a metric that is absent is unknown."""
    enabled = policies.filter("enabled")
    joined = enabled.join(metrics, "metric", "left")
    return joined.withColumn("result", policy_result(F.col("value"), F.col("operator"), F.col("threshold"), F.col("margin")))


#: The decision types, none of which executes anything, and the impact domains that are about a place.
DECISION_TYPES = ("OBSERVE", "VERIFY", "WAIT", "PREPARE", "REVIEW_ALLOCATION", "REVIEW_LOCATION", "REVIEW_POLICY", "NO_ACTION")
PLACES = ("migration", "residency", "geography", "housing")


def candidates(attention: Column, policy: Column, domain: Column, urgency: Column, urgent_at: float = 0.5) -> Column:
    """Decision candidate from attention, policy, impact domain and urgency.

    A breach asks for a review of the policy, and a policy that can't be
    evaluated to wait for data. What is important and sure is reviewed by its
    domain if it is urgent and prepared for if not; the rest is verified,
    observed or left alone.
    """
    review = F.when(domain.isin(*PLACES), "REVIEW_LOCATION").otherwise("REVIEW_ALLOCATION")
    act = F.when(urgency >= urgent_at, review).otherwise("PREPARE")
    by_attention = F.when(attention == "ACT_OR_REVIEW", act).when(attention == "VERIFY", "VERIFY").when(attention == "NOTE", "OBSERVE").otherwise("NO_ACTION")
    return F.when(policy == "BREACH", "REVIEW_POLICY").when(policy == "UNKNOWN_DATA", "WAIT").otherwise(by_attention)


def snapshot(decisions: DataFrame, facts: DataFrame, names: Sequence[str], owner: str, decided: str, observed: str, fact: str, value: str) -> DataFrame:
    """What was known of the owner at each decision (J2): the latest value of each named fact not after the decision, sorted.

    An as-of join for each (decision, fact): linear in both tables, whatever the
    length of an owner's history. Facts later than the decision never enter, so
    later data cannot change a snapshot; a fact not seen before it is left out.
    """
    asked = decisions.withColumn("__fact", F.explode(F.array(*[F.lit(n) for n in names])))
    given = facts.select(owner, F.col(fact).alias("__fact"), F.col(observed).alias("__seen"), F.col(value).alias("__value"))
    met = asof_join(asked, given, [owner, "__fact"], decided, "__seen", ["__seen", "__value"], ["__value"])
    known = F.when(F.col("__seen").isNotNull(), F.struct(F.col("__fact").alias("fact"), F.col("__value").alias("value")))
    return met.groupBy(*decisions.columns).agg(F.array_sort(F.collect_list(known)).alias("state"))


def with_outcomes(decisions: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Decisions with their outcomes, which are rows of their own and change no decision."""
    return decisions.join(outcomes, key, "left")


def premise_against_outcome(rows: DataFrame, premise: str, outcome: str) -> DataFrame:
    """Counts of right and wrong premises against good and bad outcomes."""
    return rows.groupBy(premise, outcome).agg(F.count(F.lit(1)).alias("decisions"))


def last_matches(episodes: DataFrame, where: Column, keys: Sequence[str], order: Sequence[Column], k: int = 3) -> DataFrame:
    """The last k times that something held."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return episodes.filter(where).withColumn("nth", n).filter(F.col("nth") <= k)
