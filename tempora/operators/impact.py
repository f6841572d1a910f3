"""Impact, priority, attention, alerts and brief."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The classes of attention, and the severity that each stands for.
SEVERITY = {"ACT_OR_REVIEW": "CRITICAL", "VERIFY": "IMPORTANT", "NOTE": "IMPORTANT", "BACKLOG": "INFO"}


def priority_product(severity: Column, exposure: Column, confidence: Column, urgency: Column, irreversibility: Column) -> Column:
    """Product form (I4)."""
    return severity * exposure * confidence * urgency * (F.lit(1.0).cast("double") + irreversibility)


def priority_geometric(severity: Column, exposure: Column, urgency: Column, irreversibility: Column, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """Weighted geometric mean times (1 + irreversibility), in 0..2 (I5). Confidence has no part; a zero factor gives zero."""
    ws, we, wu = (F.lit(float(w)) for w in weights)
    product = F.pow(severity, ws) * F.pow(exposure, we) * F.pow(urgency, wu)
    return F.pow(product, F.lit(1.0) / F.lit(float(sum(weights)))) * (F.lit(1.0) + irreversibility)


def attention(priority: Column, confidence: Column, priority_at: float, confidence_at: float) -> Column:
    """The four classes (I6): important and sure, important and unsure, minor and sure, minor and unsure."""
    high, sure = priority >= priority_at, confidence >= confidence_at
    return F.when(high & sure, "ACT_OR_REVIEW").when(high, "VERIFY").when(sure, "NOTE").otherwise("BACKLOG")


def severity_of(attention_class: Column) -> Column:
    """Routing severity, derived from the class of attention (A1)."""
    out = F.lit(None).cast("string")
    for name, severity in SEVERITY.items():
        out = F.when(attention_class == name, severity).otherwise(out)
    return out


def resolve_exposures(deltas: DataFrame, rules: DataFrame, exposures: DataFrame, dimension: str, exposure: str) -> DataFrame:
    """Exposures that a delta touches, through the rule table."""
    return deltas.join(rules, dimension).join(exposures, exposure)


def causal_chains(deltas: DataFrame, edges: DataFrame, hops: int, start: str = "dimension") -> DataFrame:
    """Deterministic impacts along the causal rule graph (I2), or research where no rule leads on.

    ``edges`` has source, target, weight and terminal. Each hop is one join with
    the rules, so a chain has at most ``hops`` of them; a delta of which no chain
    ends in a terminal target comes out once, with status ``research``.
    """
    rules = edges.select(F.col("source").alias("__at"), F.col("target").alias("__to"), F.col("weight").alias("__w"), F.col("terminal").alias("__end"))
    here = deltas.withColumns({"__at": F.col(start), "chain": F.array(F.col(start)), "effect": F.col("delta")})
    found = None
    for _ in range(hops):
        step = here.join(rules, "__at").filter(~F.array_contains("chain", F.col("__to")))
        step = step.withColumns({"chain": F.concat("chain", F.array("__to")), "effect": F.col("effect") * F.col("__w")})
        ended = step.filter("__end").drop("__at", "__w", "__end").withColumnRenamed("__to", "target")
        found = ended if found is None else found.unionByName(ended)
        here = step.filter("NOT __end").drop("__at", "__w", "__end").withColumnRenamed("__to", "__at")
    reached = found.select(start).distinct()
    open_ = deltas.join(reached, start, "left_anti").select(*deltas.columns, F.array(F.col(start)).alias("chain"), F.lit(None).cast("double").alias("effect"), F.lit(None).cast("string").alias("target"))
    return found.withColumn("status", F.lit("impact")).unionByName(open_.withColumn("status", F.lit("research")))


def citations(claims: DataFrame, sources: DataFrame, claim: str, cited: str, source: str) -> DataFrame:
    """Claims with the number of their citations and of those that lead to a known source.

    A fact needs a source; an inference or speculation needs to be called one.
    """
    each = claims.select(claim, F.explode(F.array_distinct(cited)).alias("__cited"))
    known = each.join(sources.select(F.col(source).alias("__cited")).distinct(), "__cited").groupBy(claim).agg(F.count(F.lit(1)).alias("sourced"))
    out = claims.join(known, claim, "left").withColumns({"cited": F.size(F.array_distinct(cited)), "sourced": F.coalesce("sourced", F.lit(0))})
    verdict = F.when((F.col("kind") == "fact") & (F.col("sourced") == 0), "unsupported").when(F.col("sourced") < F.col("cited"), "broken_link").otherwise("ok")
    return out.withColumn("verdict", verdict)


def classify(calculated: DataFrame, by_rule: DataFrame, inferred: DataFrame, speculative: DataFrame) -> DataFrame:
    """Impacts of every branch with their class."""
    out = calculated.withColumn("impact_class", F.lit("DIRECT_CALCULATED"))
    for frame, name in ((by_rule, "DIRECT_RULE"), (inferred, "INFERRED_CAUSAL"), (speculative, "SPECULATIVE")):
        out = out.unionByName(frame.withColumn("impact_class", F.lit(name)))
    return out


def opportunities(impacts: DataFrame, objectives: DataFrame, key: str) -> DataFrame:
    """Impacts that serve an active objective (I8): a view, not a copy."""
    return impacts.join(objectives.select(key).distinct(), key, "left_semi")


def interruptions(df: DataFrame, owner: str, time_col: str, value: str, base: float, growth: float, days: int) -> DataFrame:
    """Interrupt only above a threshold that grows with the interruptions offered in the last days.

    An owner's history is cut into days. What was offered in the last days is
    the number of the whole days before, less that of rows of the first day that
    have dropped out, plus that of rows of this day that came before: one window
    over two days' rows, however long the history is.
    """
    us, length = F.unix_micros(time_col), 86_400_000_000
    come = df.withColumns({"__us": us, "__day": F.floor(us / F.lit(length)).cast("long"), "__add": F.lit(1)})
    counts = come.groupBy(owner, "__day").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(owner).orderBy("__day").rangeBetween(-days, -1))  # one row for each day
    whole = counts.select(F.col(owner).alias("__owner"), F.col("__day").alias("__d"), F.coalesce(before, F.lit(0)).alias("__base"))
    gone = come.select(owner, (F.col("__us") + days * length).alias("__us"), (F.col("__day") + days).alias("__day"), F.lit(-1).alias("__add"))
    both = come.unionByName(gone, allowMissingColumns=True)
    inside = Window.partitionBy(owner, "__day").orderBy("__us").rangeBetween(Window.unboundedPreceding, -1)
    counted = both.withColumn("__moved", F.coalesce(F.sum("__add").over(inside), F.lit(0))).filter("__add = 1")
    same = F.col(owner).eqNullSafe(F.col("__owner")) & (F.col("__day") == F.col("__d"))
    recent = (F.col("__base") + F.col("__moved")).cast("long")
    joined = counted.join(whole, same).withColumn("recent", recent).select(*df.columns, "recent")
    return joined.withColumn("threshold", F.lit(base) + F.lit(growth) * F.col("recent")).withColumn("interrupt", F.col(value) > F.col("threshold"))


def critical_allowed(deterministic: Column, sources: Column, best_class: Column) -> Column:
    """CRITICAL needs a deterministic trigger, or two sources of which the best is not class D (A2)."""
    return deterministic | ((sources >= 2) & (best_class < "D"))


def unsent(alerts: DataFrame, sent: DataFrame, key: Sequence[str], order: Sequence[Column], sent_key: Sequence[str] | None = None) -> DataFrame:
    """Alerts not sent before, the first of each key (A3). ``sent_key``: what makes an alert one that was sent, if that is less than the key."""
    once = list(sent_key or key)
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return alerts.join(sent.select(*once).distinct(), once, "left_anti").withColumn("__n", first).filter("__n = 1").drop("__n")


def brief(impacts: DataFrame, order: Sequence[Column], k: int, briefed: DataFrame | None = None, key: Sequence[str] = ()) -> DataFrame:
    """The k most important items (B1), without what was briefed before (B2). The order is total."""
    fresh = impacts if briefed is None else impacts.join(briefed.select(*key).distinct(), list(key), "left_anti")
    return fresh.orderBy(*order).limit(k)


def or_no_action(items: DataFrame, column: str) -> DataFrame:
    """The items, or one row NO_ACTION where there is none."""
    none = items.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("NO_ACTION").alias(column))
    return items.select(F.col(column).cast("string")).unionByName(none)


def usefulness(marks: DataFrame, by: str, brief_id: str, useful: Column) -> DataFrame:
    """Share of briefs with a useful item."""
    briefs = marks.groupBy(by, brief_id).agg(F.max(useful.cast("int")).alias("any_useful"))
    return briefs.groupBy(by).agg(F.count(F.lit(1)).alias("briefs"), F.avg(F.col("any_useful").cast("double")).alias("useful_share"))
