"""Personal state and portfolio arithmetic.

Missing values are never zero: every total carries the number of rows without a
value and a status. Amounts are summed as decimals, so that a sum does not
depend on the order of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.temporal import preceding

MONEY = "decimal(20,8)"


def money(value: Column) -> Column:
    return value.cast(MONEY)


def total(df: DataFrame, keys: Sequence[str], value: str, where: Column | None = None, name: str = "value") -> DataFrame:
    """Sum of a value for each key (F1, F2) with missing_count and status; ``where`` restricts what is summed."""
    v = F.col(value) if where is None else F.when(where, F.col(value))
    missing = F.count_if(F.col(value).isNull() if where is None else where & F.col(value).isNull())
    out = df.groupBy(*keys).agg(F.sum(money(v)).cast("double").alias(name), missing.alias("missing_count"))
    return out.withColumn("status", F.when(F.col("missing_count") > 0, "incomplete").otherwise("complete"))


def weights(df: DataFrame, owner: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    """Share of each class of ``by`` in the owner's total (F3-F5); a total of zero gives null and a status.

    Classes are summed first; the window sees one row for each class.
    """
    sums = df.groupBy(*owner, *by).agg(F.sum(money(F.col(value))).alias("value"), F.count_if(F.col(value).isNull()).alias("missing_count"))
    all_ = F.sum("value").over(Window.partitionBy(*owner) if owner else Window.partitionBy(F.lit(0)))
    share = F.try_divide(F.col("value").cast("double"), all_.cast("double"))
    status = F.when(F.col("missing_count") > 0, "incomplete").when(share.isNull(), "no_total").otherwise("complete")
    return sums.select(*owner, *by, F.col("value").cast("double").alias("value"), share.alias("weight"), "missing_count", status.alias("status"))


def filtered_share(df: DataFrame, owner: Sequence[str], where: Column, value: str) -> DataFrame:
    """Share of the rows that ``where`` picks (F6); a zero total gives null and a status."""
    out = df.groupBy(*owner).agg(F.sum(money(F.when(where, F.col(value)).otherwise(0))).cast("double").alias("part"), F.sum(money(F.col(value))).cast("double").alias("total"))
    return out.withColumn("share", F.try_divide("part", "total")).withColumn("status", F.when(F.col("share").isNull(), "no_total").otherwise("complete"))


def concentration(shares: DataFrame, owner: Sequence[str], weight: str = "weight") -> DataFrame:
    """Herfindahl index: the sum of squared weights."""
    return shares.groupBy(*owner).agg(F.sum(F.col(weight) * F.col(weight)).alias("hhi"), F.count(F.lit(1)).alias("classes"))


def runway(liquid: Column, burn: Column, same_currency: Column | None = None) -> tuple[Column, Column]:
    """Months that liquid assets last, and a status (F8). A burn that is not positive has no runway."""
    known = liquid.isNotNull() & burn.isNotNull() & (F.lit(True) if same_currency is None else same_currency)
    return F.when(known & (burn > 0), liquid / burn), F.when(~known, "UNKNOWN_DATA").when(burn <= 0, "INVALID_BURN").otherwise("OK")


def strict_runway(liquid: Column, burn: Column) -> Column:
    """The same, but a burn that is not positive fails the query."""
    return F.when(F.assert_true(burn > 0, F.lit("burn must be positive")).isNull(), liquid / burn)


def cashflow_range(streams: DataFrame, owner: str, burn: str) -> DataFrame:
    """Low, base and high monthly income of active streams, less the burn."""
    on = F.col("active")
    sums = [F.sum(F.when(on, F.col(c)).otherwise(0.0)).alias(c) for c in ("low", "base", "high")]
    return streams.groupBy(owner).agg(*sums, F.max(burn).alias(burn)).select(owner, *[(F.col(c) - F.col(burn)).alias(f"net_{c}") for c in ("low", "base", "high")])


def mark_to_market(positions: DataFrame, shocks: DataFrame, on: str, value: str) -> DataFrame:
    """Values after a shock for each class (F10); a class without a shock keeps its value."""
    joined = positions.join(shocks, on, "left")
    return joined.withColumn("shocked", F.col(value) * (1 + F.coalesce("shock", F.lit(0.0))))


def drawdown(df: DataFrame, key: str, time_col: str, value: str) -> DataFrame:
    """Distance of a value from its highest so far."""
    peak = F.max(value).over(Window.partitionBy(key).orderBy(time_col).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("peak", peak).withColumn("drawdown", F.try_divide(F.col(value), F.col("peak")) - 1)


def bucket_stress(buckets: DataFrame, owner: Sequence[str], bucket: str, value: str, move: float) -> DataFrame:
    """The owner's total if one bucket after another moves by ``move`` (F13). One row for each bucket, no cross join."""
    w = Window.partitionBy(*owner) if owner else Window.partitionBy(F.lit(0))
    return buckets.withColumn("total", F.sum(value).over(w)).withColumn("stressed_total", F.col("total") + F.col(value) * move).withColumn("loss_share", F.try_divide(F.col(value) * move, F.col("total")))


def concentration_checks(positions: DataFrame, owner: Sequence[str], asset: str, value: str, stable: Sequence[str], most_single: float, most_stable: float) -> DataFrame:
    """Share of the largest single asset and of stablecoins of each owner, against limits (F13). A zero total is unknown."""
    sums = positions.groupBy(*owner, asset).agg(F.sum(money(F.col(value))).cast("double").alias("v"))
    out = sums.groupBy(*owner).agg(F.max_by(asset, F.struct("v", asset)).alias("top_asset"), F.max("v").alias("top"), F.sum(F.when(F.col(asset).isin(*stable), F.col("v")).otherwise(0.0)).alias("stable"), F.sum("v").alias("all"))
    single, coins = F.try_divide("top", "all"), F.try_divide("stable", "all")
    status = F.when(single.isNull(), "UNKNOWN_DATA").when((single > most_single) & (coins > most_stable), "BOTH").when(single > most_single, "SINGLE_ASSET").when(coins > most_stable, "STABLECOIN").otherwise("PASS")
    return out.select(*owner, "top_asset", single.alias("top_share"), coins.alias("stable_share"), status.alias("status"))


def pivot_matrix(df: DataFrame, row: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    """Matrix of the maxima of a value (P4). The columns are given, so no job looks for them."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.max(value))


def mutations(versions: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Audit rows of a versioned value: previous and new value of each change (P2). The first of ``order`` is a time."""
    rows = preceding(versions, [key], order[0], order[1:], value, "previous_value").withColumnRenamed(value, "new_value")
    return rows.filter(F.col("previous_value").isNull() | (F.col("previous_value") != F.col("new_value")))
