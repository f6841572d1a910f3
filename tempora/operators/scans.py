"""Running state over long histories of raw rows (F12, W9, W11, N3): scans by time buckets with carried prefixes.

A running maximum, a change-point sum and an exponential mean are all made by
joining what a stretch of rows does to what came before it, whatever that is. So
every key's history is cut into time buckets. A window inside a bucket has the
running state as if the bucket were all; one row for each key and bucket carries
what came before; both are put together row by row. A key that holds half of all
rows is sorted by as many tasks as it has buckets. Rows with equal times are told
apart by ``ties``; rows without a time come before all others, in a bucket of
their own; null keys are one key; null values change nothing and see the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of the buckets that can be asked for.
_SECONDS = {"hour": 3600, "day": 86_400, "week": 7 * 86_400, "month": 31 * 86_400}


def _dealt(df: DataFrame, keys: Sequence[str], time_col: str, ties: Sequence[str], bucket: str):
    dealt = df.withColumn("__bucket", F.date_trunc(bucket, time_col))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(time_col, *ties).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return dealt, inside, across


def _joined(rows: DataFrame, carried: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of their key's and bucket's row."""
    given = carried.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__b"), *names)
    same = F.col("__bucket").eqNullSafe(F.col("__b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(given, same).drop("__b", *[f"__k{i}" for i in range(len(keys))])


def running_max(df: DataFrame, keys: Sequence[str], time_col: str, ties: Sequence[str], value: str, name: str = "peak", bucket: str = "day") -> DataFrame:
    """Every row with the highest value of its key so far, itself included."""
    dealt, inside, across = _dealt(df, keys, time_col, ties, bucket)
    ends = dealt.groupBy(*keys, "__bucket").agg(F.max(value).alias("__most"))
    carried = ends.withColumn("__far", F.max("__most").over(across))
    rows = _joined(dealt.withColumn("__near", F.max(value).over(inside)), carried, keys, ["__far"])
    return rows.withColumn(name, F.greatest("__near", "__far")).select(*df.columns, name)


def running_total(df: DataFrame, keys: Sequence[str], time_col: str, ties: Sequence[str], values: Sequence[str], names: Sequence[str], bucket: str = "day") -> DataFrame:
    """Every row with the sums of its key's values before it, itself left out; zero where there are none."""
    dealt, _, across = _dealt(df, keys, time_col, ties, bucket)
    before = Window.partitionBy(*keys, "__bucket").orderBy(time_col, *ties).rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(*keys, "__bucket").agg(*[F.sum(v).alias(f"__t{i}") for i, v in enumerate(values)])
    carried = ends.select(*keys, "__bucket", *[F.sum(f"__t{i}").over(across).alias(f"__far{i}") for i in range(len(values))])
    near = dealt.withColumns({f"__near{i}": F.sum(v).over(before) for i, v in enumerate(values)})
    rows = _joined(near, carried, keys, [f"__far{i}" for i in range(len(values))])
    total = lambda i: F.coalesce(f"__near{i}", F.lit(0)) + F.coalesce(f"__far{i}", F.lit(0))
    return rows.select(*df.columns, *[total(i).alias(n) for i, n in enumerate(names)])


def raw_drawdown(df: DataFrame, keys: Sequence[str], time_col: str, ties: Sequence[str], value: str, bucket: str = "day") -> DataFrame:
    """Distance of every raw row's value from the highest so far."""
    peaks = running_max(df, keys, time_col, ties, value, "peak", bucket)
    return peaks.withColumn("drawdown", F.try_divide(F.col(value), F.col("peak")) - 1)


def change_sum(df: DataFrame, keys: Sequence[str], time_col: str, ties: Sequence[str], value: str, expected: float, drift: float, name: str = "change_sum", bucket: str = "day") -> DataFrame:
    """Every row with the one-sided change-point sum S = max(0, S + value - expected - drift) of its key.

    Over a bucket with the total P, S becomes max(S + P, C), where C is the sum
    that starts at zero; so what a bucket inherits is the largest C of an earlier
    one plus all that followed it.
    """
    dealt, inside, across = _dealt(df.withColumn("__step", F.coalesce(F.col(value) - F.lit(expected + drift), F.lit(0.0))), keys, time_col, ties, bucket)
    walked = dealt.withColumn("__sum", F.sum("__step").over(inside))
    walked = walked.withColumn("__own", F.col("__sum") - F.least(F.lit(0.0), F.min("__sum").over(inside)))
    last = F.struct(F.col(time_col), *[F.col(t) for t in ties])
    ends = walked.groupBy(*keys, "__bucket").agg(F.sum("__step").alias("__total"), F.max_by("__own", last).alias("__c"))
    upto = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = ends.withColumn("__all", F.sum("__total").over(upto))
    carried = summed.withColumn("__in", F.coalesce(F.col("__all") - F.col("__total") + F.max(F.col("__c") - F.col("__all")).over(across), F.lit(0.0)))
    rows = _joined(walked, carried, keys, ["__in"])
    return rows.withColumn(name, F.greatest(F.col("__in") + F.col("__sum"), F.col("__own"))).select(*df.columns, name)


def decayed_mean(df: DataFrame, keys: Sequence[str], time_col: str, ties: Sequence[str], value: str, seconds: float, name: str = "decayed_mean", bucket: str = "day") -> DataFrame:
    """Every row with the exponential mean of its key's values so far (W9): a value's weight falls by e in ``seconds``.

    Rows need not be evenly spaced. Weights are told from the bucket's begin, so
    a bucket must not be longer than 500 times ``seconds``. Rows without a time
    have no mean.
    """
    if _SECONDS[bucket] > 500 * seconds:
        raise ValueError("choose shorter buckets for weights that fall so fast")
    dealt, inside, _ = _dealt(df, keys, time_col, ties, bucket)
    age = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / F.lit(seconds * 1e6)
    weight = F.when(F.col(value).isNotNull(), F.exp(age(F.col(time_col), F.col("__bucket"))))
    weighed = dealt.withColumns({"__w": weight, "__wx": weight * F.col(value)})
    ends = weighed.groupBy(*keys, "__bucket").agg(F.coalesce(F.sum("__w"), F.lit(0.0)).alias("w"), F.coalesce(F.sum("__wx"), F.lit(0.0)).alias("wx")).filter("__bucket IS NOT NULL")
    listed = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__bucket", "w", "wx"))).alias("all"))  # one entry for each bucket

    def strung(done: Column, b: Column) -> Column:
        """Weights carried to the begin of the next bucket in the list."""
        fade = F.exp(-age(b["__bucket"], done["at"]))
        w, wx = F.coalesce(done["w"] * fade, F.lit(0.0)), F.coalesce(done["wx"] * fade, F.lit(0.0))
        now = F.struct(b["__bucket"].alias("__bucket"), w.alias("__w_in"), wx.alias("__wx_in"))
        return F.struct(b["__bucket"].alias("at"), (w + b["w"]).alias("w"), (wx + b["wx"]).alias("wx"), F.concat(done["found"], F.array(now)).alias("found"))

    nothing = F.expr("named_struct('at', CAST(NULL AS timestamp), 'w', CAST(NULL AS double), 'wx', CAST(NULL AS double), 'found', CAST(array() AS array<struct<__bucket: timestamp, __w_in: double, __wx_in: double>>))")
    carried = listed.select(*keys, F.explode(F.aggregate("all", nothing, strung, lambda d: d["found"])).alias("c")).select(*keys, "c.*")
    near = weighed.withColumns({"__nw": F.coalesce(F.sum("__w").over(inside), F.lit(0.0)), "__nwx": F.coalesce(F.sum("__wx").over(inside), F.lit(0.0))})
    far = carried.unionByName(dealt.filter("__bucket IS NULL").select(*keys, "__bucket").distinct().withColumns({"__w_in": F.lit(None).cast("double"), "__wx_in": F.lit(None).cast("double")}))
    rows = _joined(near, far, keys, ["__w_in", "__wx_in"])
    mean = F.try_divide(F.col("__wx_in") + F.col("__nwx"), F.col("__w_in") + F.col("__nw"))
    return rows.withColumn(name, mean).select(*df.columns, name)
