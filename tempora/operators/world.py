"""World state: registry-driven snapshots, bounded steps and typed deltas (W1-W11), narratives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def bounded_step(previous: Column, proposed: Column, step: float, low: float, high: float) -> Column:
    """The proposed score, at most one step from the previous one and inside the scale."""
    move = clamp(proposed - previous, F.lit(-step), F.lit(step))
    return clamp(previous + move, F.lit(low), F.lit(high))


def snapshot_from_registry(registry: DataFrame, scores: DataFrame, key: str, value: str) -> DataFrame:
    """Every enabled dimension with its score; one without data stays, with status unknown."""
    return registry.filter("enabled").select(key).join(scores, key, "left").withColumn("status", F.when(F.col(value).isNull(), "unknown").otherwise("scored"))


def next_snapshot(previous: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """All dimensions of either side; an update replaces, the rest is carried over."""
    p = previous.select(key, F.col(value).alias("old_score"))
    u = updates.select(key, F.col(value).alias("update_score"))
    return p.join(u, key, "full_outer").select(key, "old_score", F.coalesce("update_score", "old_score").alias("new_score"), F.col("update_score").isNull().alias("carried"))


def material_deltas(snapshot: DataFrame, threshold: float) -> DataFrame:
    """Typed deltas whose materiality reaches the threshold (W5, W6). A first score is material."""
    m = F.when(F.col("old_score").isNull(), F.lit(1.0)).otherwise(F.abs(F.col("new_score") - F.col("old_score")))
    return snapshot.withColumn("materiality", m).filter(F.col("materiality") >= threshold)


def direction(delta: Column, epsilon: float) -> Column:
    """rising, falling or stable; uncertain without a previous score."""
    return F.when(delta.isNull(), "uncertain").when(delta > epsilon, "rising").when(delta < -epsilon, "falling").otherwise("stable")


def history(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Scores with their predecessor and change."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("delta", F.col(value) - F.col("previous"))


def market_features(df: DataFrame, key: str, order: str, value: str, rows: int) -> DataFrame:
    """One-step return, and mean and sample deviation of the last ``rows`` values."""
    w = Window.partitionBy(key).orderBy(order)
    near = w.rowsBetween(-(rows - 1), 0)
    back = F.lag(value).over(w)
    return df.withColumns({"step_return": F.try_divide(F.col(value), back) - 1, "mean_near": F.avg(value).over(near), "stddev_near": F.stddev_samp(value).over(near)})


def regime(df: DataFrame, score: str, high: float, low: float) -> DataFrame:
    """Overall regime of a snapshot by the mean score, and its confidence: the share of dimensions that have one."""
    out = df.agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("dimensions"), F.coalesce(F.try_divide(F.count(score).cast("double"), F.count(F.lit(1))), F.lit(0.0)).alias("confidence"))
    return out.withColumn("overall_regime", F.when(F.col("mean_score").isNull(), "unknown").when(F.col("mean_score") >= high, "expansion").when(F.col("mean_score") <= low, "contraction").otherwise("neutral"))


def owner_dimensions(places: DataFrame, template: Sequence[str], registry: DataFrame, place: str) -> DataFrame:
    """Dimensions that the owner's places call for against those registered (W2): added, kept or retired, none deleted.

    The template is a short list in the code, so it is an array and not a join.
    """
    wanted = places.select(F.explode(F.array(*[F.concat(F.lit("geography."), F.lower(F.col(place)), F.lit(f".{t}")) for t in template])).alias("dimension_key")).distinct()
    both = wanted.withColumn("wanted", F.lit(True)).join(registry.select("dimension_key").withColumn("known", F.lit(True)), "dimension_key", "full_outer")
    return both.select("dimension_key", F.when(F.col("known").isNull(), "added").when(F.col("wanted").isNull(), "retired").otherwise("kept").alias("status"))


def strength(assigned: DataFrame, narrative: str, event: str, sign: str, weight: str, limit: float) -> DataFrame:
    """Strength of a narrative (N2): signed weights of different events, clamped; duplicates have no effect."""
    once = assigned.groupBy(narrative, event).agg(F.max(sign).alias("s"), F.max(weight).alias("w"))
    raw = once.groupBy(narrative).agg(F.sum(F.col("s") * F.col("w")).alias("raw"), F.count(F.lit(1)).alias("events"))
    return raw.withColumn("strength", clamp(F.col("raw"), F.lit(-limit), F.lit(limit)))


def lifecycle(df: DataFrame, key: str, order: str, value: str, days: str, dormant: int, resolved: int, active: float, epsilon: float) -> DataFrame:
    """Status of a narrative over time."""
    back = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    status = (
        F.when(F.col(days) >= resolved, "resolved").when(F.col(days) >= dormant, "dormant").when(F.col(value) < active, "candidate")
        .when(back.isNull(), "active").when(F.col(value) > back + epsilon, "strengthening").when(F.col(value) < back - epsilon, "weakening").otherwise("active")
    )
    return df.withColumn("status", status)


def disagreement(positive: Column, negative: Column) -> Column:
    """Share of the weaker side (N4); null without evidence."""
    return F.try_divide(F.least(positive, negative), positive + negative)
