"""Scenario probabilities with explicit unknown mass, and forecast scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pressure(drivers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weighted evidence pressure (C3): weight x direction x score; null if a score is missing."""
    p = F.sum(F.col("weight") * F.col("direction") * F.col("current_score"))
    missing = F.count_if(F.col("current_score").isNull())
    return drivers.groupBy(*by).agg(F.when(missing == 0, p).alias("pressure"), missing.alias("missing_drivers"))


def drivers(mapping: DataFrame, narratives: DataFrame, narrative: str, score: str) -> DataFrame:
    """Drivers of scenarios with the current score of their narrative (C2); one without a narrative has none, and is counted by ``pressure``."""
    return mapping.join(narratives.select(narrative, F.col(score).alias("current_score")), narrative, "left")


def bounded_update(sets: DataFrame, set_id: Sequence[str], prior: str, target: str, bound: float) -> DataFrame:
    """Posterior (C4, C5): the whole vector of changes is scaled so that none exceeds the bound.

    If prior and target have equal sums, the posterior has it too, stays
    non-negative, and every change keeps its sign.
    """
    w = Window.partitionBy(*set_id)
    delta = F.col(target) - F.col(prior)
    most = F.max(F.abs(delta)).over(w)
    scale = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(bound), most), F.lit(1.0)))
    return sets.withColumn("scale", scale).withColumn("posterior", F.col(prior) + F.col("scale") * delta)


def renormalised(p: Column, set_id: Sequence[str]) -> Column:
    """Share in the set's sum (C5, the case without unknown mass)."""
    return F.try_divide(p, F.sum(p).over(Window.partitionBy(*set_id)))


def integrity(sets: DataFrame, set_id: Sequence[str], p: str, floor: float, ceiling: float) -> DataFrame:
    """Unknown mass and status of each set (C6, C7); null probabilities are unknown, never shared out."""
    out = sets.groupBy(*set_id).agg((F.lit(1.0) - F.sum(F.coalesce(F.col(p), F.lit(0.0)))).alias("unknown_mass"), F.count_if(F.col(p).isNull()).alias("unevaluated"))
    return out.withColumn("integrity_status", F.when(F.col("unknown_mass") <= floor, "COMPLETE").when(F.col("unknown_mass") <= ceiling, "DEGRADED").otherwise("UNRELIABLE"))


def displayed(p: Column, steps: int = 20) -> Column:
    """Rounded to 1/steps, half up."""
    return F.floor(p * steps + F.lit(0.5)) / F.lit(float(steps))


def displayed_changes(df: DataFrame, key: Sequence[str], order: str, p: str) -> DataFrame:
    """Displayed values, and whether the display changes."""
    shown = df.withColumn("shown", displayed(F.col(p)))
    back = F.lag("shown").over(Window.partitionBy(*key).orderBy(order))
    return shown.withColumn("changed", F.coalesce(F.col("shown") != back, F.lit(True)))


def band(confidence: Column, low: float, high: float) -> Column:
    """low, moderate or high."""
    return F.when(confidence < low, "low").when(confidence < high, "moderate").otherwise("high")


def brier(p: str, outcome: str) -> Column:
    """Mean squared error."""
    return F.avg(F.pow(F.col(p) - F.col(outcome), F.lit(2.0)))


def calibration(forecasts: DataFrame, by: Sequence[str], p: str, outcome: str, bins: int = 10) -> DataFrame:
    """Mean forecast against frequency for each bin (C13); 1 falls into the last bin."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return forecasts.groupBy(*by, b).agg(F.avg(p).alias("mean_p"), F.avg(F.col(outcome).cast("double")).alias("frequency"), F.count(F.lit(1)).alias("n"))


def brier_vs_base(forecasts: DataFrame, by: Sequence[str], p: str, outcome: str) -> DataFrame:
    """Brier score against that of the base rate (C14), in one pass.

    The mean of (b - o)^2 with b = mean(o) is b - b^2 for outcomes of 0 and 1.
    """
    base = F.avg(F.col(outcome).cast("double"))
    out = forecasts.groupBy(*by).agg(brier(p, outcome).alias("brier"), base.alias("base_rate"))
    return out.withColumn("base_brier", F.col("base_rate") - F.col("base_rate") * F.col("base_rate")).withColumn("skill", F.lit(1.0) - F.try_divide("brier", "base_brier"))
