"""Point-in-time operators (T1-T13, S4, V6). Time is always a parameter; nothing reads a clock.

Ties are broken by total orders, so a replay gives the same rows. Windows over
one key are cut into time buckets first: a key that holds a large part of all
rows is then sorted by many tasks, and only one row for each key and bucket
meets in the second, small window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def instant(as_of: str) -> Column:
    """``as_of`` as a UTC timestamp literal."""
    return F.lit(as_of).cast("timestamp")


def known_at(df: DataFrame, time_col: str, as_of: str) -> DataFrame:
    """No leakage: only rows whose time is not after ``as_of`` (T4). Reaches the scan as a pushed filter."""
    return df.filter(F.col(time_col) <= instant(as_of))


def latest_as_of(df: DataFrame, keys: Sequence[str], time_col: str, as_of: str, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """The last row of each key at ``as_of`` (T2). A null in the last row stays null.

    Filter first, then ``max_by``: the filter is pushed down and the aggregation
    is partial, so no window sorts a key's history.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(time_col, *tie_breakers)).alias("last")
    return known_at(df, time_col, as_of).groupBy(*keys).agg(last).select(*keys, "last.*")


def _following(df: DataFrame, keys: Sequence[str], time_col: str, ties: Sequence[str], bucket: str) -> DataFrame:
    df = df.withColumn("__bucket", F.date_trunc(bucket, time_col))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(time_col, *ties)
    firsts = df.groupBy(*keys, "__bucket").agg(F.min(time_col).alias("__first"))
    across = Window.partitionBy(*keys).orderBy("__bucket")
    later = firsts.select(*keys, "__bucket", F.lead("__first").over(across).alias("__later"))
    return df.withColumn("__next", F.lead(time_col).over(inside)).join(later, [*keys, "__bucket"]).withColumn("valid_to", F.coalesce("__next", "__later")).drop("__bucket", "__next", "__later")


def preceding(df: DataFrame, keys: Sequence[str], time_col: str, ties: Sequence[str], value: str, name: str, bucket: str = "month") -> DataFrame:
    """Every row with the value of the row before it (of its keys, by time and ties).

    Windows see one bucket of a key; the first row of a bucket has the last of an
    earlier one, from one row for each key and bucket.
    """
    order = F.struct(time_col, *ties)
    dealt = df.withColumn("__bucket", F.date_trunc(bucket, time_col))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(time_col, *ties)
    ends = dealt.groupBy(*keys, "__bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__bucket")
    carried = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__b"), F.lag("__last").over(across).alias("__far"))
    same = F.col("__bucket").eqNullSafe(F.col("__b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    near = dealt.withColumn("__near", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
    return near.join(carried, same).select(*df.columns, F.coalesce("__near", "__far")["v"].alias(name))


def intervals(df: DataFrame, keys: Sequence[str], time_col: str, tie_breakers: Sequence[str] = (), bucket: str = "day") -> DataFrame:
    """History as half-open intervals: every row is closed by its successor."""
    return _following(df, keys, time_col, tie_breakers, bucket).withColumnRenamed(time_col, "valid_from")


def state_at(history: DataFrame, as_of: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows of a stored history that hold at ``as_of``, which lies in [start, end)."""
    return history.filter((F.col(start) <= instant(as_of)) & (F.col(end).isNull() | (instant(as_of) < F.col(end))))


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tie_breakers: Sequence[str] = (), bucket: str = "day") -> DataFrame:
    """Every left row with the values of the last right row of its key that is not later (T5).

    Left rows without one stay, with nulls; a null value in the matching row
    stays null. Both sides are dealt out by key and time bucket; what a bucket
    inherits is the last row of an earlier one, from one row for each key and bucket.
    """
    names = [*on, "__t"]
    lefts = left.withColumns({"__t": F.col(left_time), "__side": F.lit(1)}).withColumn("__left", F.struct(*left.columns))
    order = F.struct(F.col(right_time).alias("t"), *tie_breakers)
    kept = F.struct(*values).alias("__right")
    rights = right.select(*on, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), kept, order.alias("__order"))
    both = lefts.select(*names, "__side", "__left").unionByName(rights, allowMissingColumns=True).withColumn("__bucket", F.date_trunc(bucket, "__t"))
    inside = Window.partitionBy(*on, "__bucket").orderBy("__t", "__side", "__order").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("__near", F.last("__right", ignorenulls=True).over(inside)).filter("__side = 1")
    ends = both.groupBy(*on, "__bucket").agg(F.max_by("__right", "__order").alias("__last"))
    across = Window.partitionBy(*on).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*on, "__bucket", F.last("__last", ignorenulls=True).over(across).alias("__far"))
    joined = near.join(carried, [*on, "__bucket"], "left").withColumn("__hit", F.coalesce("__near", "__far"))
    return joined.select("__left.*", *[F.col("__hit").getField(v).alias(v) for v in values])


def interval_join(points: DataFrame, history: DataFrame, on: Sequence[str], point_time: str, start: str = "valid_from", end: str = "valid_to", how: str = "inner") -> DataFrame:
    """Points with the intervals of their key in force at the point's time.

    The key makes it an equi-join with a residual range condition.
    """
    h = history.select(*[F.col(c).alias(f"__h_{c}") for c in history.columns])
    same = [F.col(k) == F.col(f"__h_{k}") for k in on]
    held = (F.col(f"__h_{start}") <= F.col(point_time)) & (F.col(f"__h_{end}").isNull() | (F.col(point_time) < F.col(f"__h_{end}")))
    condition = held
    for s in same:
        condition = condition & s
    rest = [F.col(f"__h_{c}").alias(c) for c in history.columns if c not in on and c not in points.columns]
    return points.join(h, condition, how).select(*points.columns, *rest)


def disjoint_interval_join(points: DataFrame, history: DataFrame, on: Sequence[str], point_time: str, tie_breakers: Sequence[str] = (), start: str = "valid_from", end: str = "valid_to", bucket: str = "day") -> DataFrame:
    """The same (inner) where the intervals of a key don't overlap, as those of ``intervals``.

    The last interval that has begun is the only one that can hold, so this is
    an as-of join: linear, and even if one key has all rows.
    """
    h = history.select(*on, *[F.col(c).alias(f"__h_{c}") for c in history.columns if c not in on])
    rest = [c for c in history.columns if c not in on and c not in points.columns]
    values = list(dict.fromkeys(f"__h_{c}" for c in (start, end, *rest)))
    met = asof_join(points, h, on, point_time, f"__h_{start}", values, [f"__h_{c}" for c in tie_breakers], bucket)
    held = F.col(f"__h_{start}").isNotNull() & (F.col(f"__h_{end}").isNull() | (F.col(point_time) < F.col(f"__h_{end}")))
    return met.filter(held).select(*points.columns, *[F.col(f"__h_{c}").alias(c) for c in rest])


def freshness(sources: DataFrame, items: DataFrame, as_of: str, source: str = "source_id", seen: str = "ingested_at", expected: str = "expected_minutes") -> DataFrame:
    """Age of each source at ``as_of`` against its expected interval (T6); without data the status is unknown."""
    last = known_at(items, seen, as_of).groupBy(source).agg(F.max(seen).alias("last_seen"))
    age = ((F.unix_micros(instant(as_of)) - F.unix_micros("last_seen")) / F.lit(60_000_000)).alias("age_minutes")
    rows = sources.join(last, source, "left").select(*sources.columns, "last_seen", age)
    return rows.withColumn("status", F.when(F.col("last_seen").isNull(), "unknown").when(F.col("age_minutes") > F.col(expected), "stale").otherwise("fresh"))


def overall_freshness(statuses: DataFrame) -> DataFrame:
    """One row: unknown if nothing was checked or a source is unknown, else stale or fresh."""
    n = statuses.agg(F.count(F.lit(1)).alias("checked_sources"), F.count_if(F.col("status") == "stale").alias("stale_sources"), F.count_if(F.col("status") == "unknown").alias("unknown_sources"))
    return n.withColumn("status", F.when((F.col("checked_sources") == 0) | (F.col("unknown_sources") > 0), "unknown").when(F.col("stale_sources") > 0, "stale").otherwise("fresh"))


def due_sources(sources: DataFrame, as_of: str) -> DataFrame:
    """Enabled sources never fetched, or whose interval has passed since the last fetch."""
    next_due = F.timestamp_micros(F.unix_micros("last_fetch") + F.col("interval_minutes").cast("long") * 60_000_000)
    return sources.filter(F.col("enabled") & (F.col("last_fetch").isNull() | (next_due <= instant(as_of))))


def deadlines(df: DataFrame, date_col: str, as_of: str, within_days: int) -> DataFrame:
    """Rows whose date is at or after ``as_of`` and at most ``within_days`` ahead, with days_left."""
    left = F.datediff(F.col(date_col), F.lit(as_of).cast("date"))
    return df.withColumn("days_left", left).filter(F.col("days_left").between(0, within_days))


def outcomes_due(items: DataFrame, outcomes: DataFrame, key: str, horizon: str, as_of: str) -> DataFrame:
    """Items whose horizon has passed and that have no outcome yet."""
    return items.filter(F.col(horizon) <= instant(as_of)).join(outcomes.select(key).distinct(), key, "left_anti")


def precedence(keys: DataFrame, on: str, value: str, tiers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Each key's value from the first tier that has one, and that tier's name."""
    out, names = keys.select(on), []
    for i, (name, frame) in enumerate(tiers):
        out = out.join(frame.select(on, F.col(value).alias(f"__v{i}")), on, "left")
        names.append(name)
    picked = [F.col(f"__v{i}") for i in range(len(names))]
    tier = F.lit("missing")
    for v, name in reversed(list(zip(picked, names, strict=True))):
        tier = F.when(v.isNotNull(), name).otherwise(tier)
    return out.select(on, F.coalesce(*picked).alias(value), tier.alias("tier"))


def provenance(start: DataFrame, hops: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Walk links back to their source: each hop joins (frame, own column, frame's key)."""
    out = start
    for frame, own, key in hops:
        out = out.join(frame, F.col(own) == F.col(key), "left")
    return out
