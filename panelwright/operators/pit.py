"""Point-in-time reads of bitemporal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(df: DataFrame, as_of: Column | str, knowledge: str = "filed") -> DataFrame:
    """Rows known on a date; the filter reaches the scan."""
    return df.where(F.col(knowledge) <= (F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of))


def latest(df: DataFrame, key: list[str], as_of: str, ties: list[str], knowledge: str = "filed", first: bool = False, originals: str | None = None) -> DataFrame:
    """Of each key the newest row known on as_of (first: the oldest; originals: the flag of rows to leave out)."""
    seen = visible(df, as_of, knowledge)
    if originals:
        seen = seen.where(~F.col(originals))
    order = [F.col(knowledge).asc() if first else F.col(knowledge).desc(), *(F.col(t).desc() for t in ties)]
    return seen.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def by_priority(df: DataFrame, key: list[str], priority: Column, *ties: Column) -> DataFrame:
    """One row per key, of the source that comes first."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(priority, *ties))).where("_n = 1").drop("_n")


def grid(df: DataFrame, key: list[str], dates: DataFrame, ties: list[str], knowledge: str = "filed") -> DataFrame:
    """latest() for every as_of of a table of dates in one plan: each row holds from its knowledge date until the next."""
    order = Window.partitionBy(*key).orderBy(F.col(knowledge), *(F.col(t) for t in ties))
    spans = df.withColumn("_until", F.lead(knowledge).over(order))
    # Rows that hold on no date between two grid dates are dropped before the join.
    return spans.where(F.col("_until").isNull() | (F.col("_until") > F.col(knowledge))).join(dates, (F.col(knowledge) <= F.col("as_of")) & (F.col("_until").isNull() | (F.col("as_of") < F.col("_until")))).drop("_until")


def asof_back(targets: DataFrame, prices: DataFrame, key: str, at: str, value: str, max_stale_days: int, bucket_days: int | None = None) -> DataFrame:
    """For each target the last positive value at or before its date, at most so many days old: value and its date. Rows are
    dealt by key and bucket of days, so that a long or hot key isn't one task; the last value of each bucket is carried over to
    the buckets after it that it isn't too old for."""
    days = bucket_days or max(1, max_stale_days)
    bucket = F.floor(F.unix_date(F.col(at).cast("date")) / days)
    left = targets.select(key, at, bucket.alias("_b"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<d:date,x:double>").alias("_v"), F.struct(*targets.columns).alias("_id"))
    known = prices.where(F.col(value) > 0).select(key, at, bucket.alias("_b"), F.struct(F.col(at).cast("date").alias("d"), F.col(value).cast("double").alias("x")).alias("_v"))
    last = known.groupBy(key, "_b").agg(F.max_by("_v", at).alias("_v"), F.max(at).alias(at))  # a row for each key and bucket
    carried = last.select(key, at, F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + -(-max_stale_days // days))).alias("_b"), "_v") if max_stale_days else None
    seen = known.unionByName(carried) if carried is not None else known
    both = left.unionByName(seen.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key, "_b").orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    fresh = F.datediff(F.col(at), F.col("_v.d")) <= max_stale_days
    return held.select("_id.*", F.when(fresh, F.col("_v.x")).alias(value), F.when(fresh, F.col("_v.d")).alias("found_date"))


def asof_forward(targets: DataFrame, calendar: DataFrame, at: str) -> DataFrame:
    """The first calendar date at or after each distinct target date. Only distinct dates meet."""
    days = targets.select(at).distinct()
    both = days.select(F.col(at).alias("d"), F.lit(0).alias("_kind")).union(calendar.select(F.col("date").alias("d"), F.lit(1).alias("_kind")).distinct())
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("d").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("trade_date", F.last(F.when(F.col("_kind") == 1, F.col("d")), ignorenulls=True).over(w)).where("_kind = 0").select(F.col("d").alias(at), "trade_date")


def newest(df: DataFrame, key: list[str], order: str, *values: str) -> DataFrame:
    return df.groupBy(*key).agg(*(F.max_by(v, order).alias(v) for v in values), F.max(order).alias(order))


def nearest_snapshot(df: DataFrame, key: list[str], as_of: str, at: str = "snapshot_date") -> DataFrame:
    """Of each key the newest row at or before as_of, else the oldest after it."""
    day = F.lit(as_of).cast("date")
    before = F.col(at) <= day
    order = Window.partitionBy(*key).orderBy(before.desc(), F.when(before, F.col(at)).desc(), F.col(at))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
