"""Ranks and quantiles of cross-sections of any size. Where a group may be huge, no task gathers it: rows are ranged over
partitions by group and value, numbered there, and shifted by what the partitions before hold of the group; quantiles are
read off by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.sources.scratch import stored

#: Groups that hold more than one in so many of all rows are joined by broadcast; there are at most so many.
HEAVY = 1000
#: Up to so many groups, what each has is broadcast to its rows.
FEW_GROUPS = 100_000


def placed(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds _place, the row's number in its group (from 1, in the given order, which should tell all rows apart), and _size, the
    group's number of rows. The order is fixed by storing it."""
    groups = [F.col(c) for c in by]
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    # monotonically_increasing_id() is the partition, shifted by 33 bits, plus the row in it.
    held = stored(ranged.withColumn("_m", F.monotonically_increasing_id()), "placed").withColumn("_p", F.shiftright("_m", 33))
    pieces = held.groupBy("_p", *by).agg(F.min("_m").alias("_first"), F.count("*").alias("_c"))  # a row for each group and partition that holds of it
    own = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = pieces.select(F.col("_p").alias("_q"), *(F.col(c).alias(f"_by_{c}") for c in by), (F.lit(1) + before - F.col("_first")).alias("_shift"), F.sum("_c").over(own).alias("_size"))
    same = F.col("_p") == F.col("_q")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return held.join(shifts, same).select(*df.columns, (F.col("_m") + F.col("_shift")).alias("_place"), "_size")


def ordinal_rank(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    return placed(df, by, order).withColumnRenamed("_place", name).drop("_size")


def quantile_bucket(df: DataFrame, by: list[str], value: str, tie: str, n: int, name: str) -> DataFrame:
    """floor(ordinal rank * n / (N + 1)), within 0..n-1."""
    bucket = F.least(F.floor(F.col("_place") * n / (F.col("_size") + 1)), F.lit(n - 1)).cast("int")
    return placed(df, by, [F.col(value), F.col(tie)]).withColumn(name, bucket).drop("_place", "_size")


def _with_groups(df: DataFrame, groups: DataFrame, by: list[str], size: str | None = None) -> DataFrame:
    """df with the columns of its group (left join); the heavy ones are broadcast, so that none fills a task. groups are stored;
    without a size they are one row for each group of df, broadcast while they are few."""
    if size is None:
        return df.join(F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups, by, "left")
    heavy = F.col(size) * HEAVY > df.count()
    more = [c for c in groups.columns if c not in by]
    marked = df.join(F.broadcast(groups.where(heavy).withColumn("_hot", F.lit(True))), by, "left")
    rest = marked.where("_hot IS NULL").drop("_hot", *more).join(groups.where(~heavy), by, "left")
    return marked.where("_hot").drop("_hot").unionByName(rest)


def winsorised(df: DataFrame, by: list[str], value: str, tie: str, name: str, cut: float = 0.01) -> DataFrame:
    """Clipped to the cut and 1 - cut linear quantiles of the group, which are read off at their two places; groups under three
    values are untouched; null stays null."""
    spots = placed(df.where(F.col(value).isNotNull()), by, [F.col(value), F.col(tie)])
    at = lambda q: F.lit(q) * (F.col("_size") - 1)
    ends = {"_lo": at(cut), "_hi": at(1 - cut)}
    near = [(F.col("_place") - F.floor(p)).isin(1, 2) for p in ends.values()]
    parts = []
    for n, p in ends.items():
        low, high = (F.max(F.when(F.col("_place") == F.floor(p) + k, F.col(value))) for k in (1, 2))
        rest = F.max(p - F.floor(p))
        parts.append((low + F.when(rest > 0, (high - low) * rest).otherwise(0.0)).alias(n))
    bounds = stored(spots.where((F.col("_size") >= 3) & (near[0] | near[1])).groupBy(*by).agg(*parts), "winsor-bounds")
    x = F.col(value)
    clipped = F.when(F.col("_lo").isNull() | x.isNull(), x).otherwise(F.least(F.greatest(x, F.col("_lo")), F.col("_hi")))
    return _with_groups(df, bounds, by).withColumn(name, clipped).drop("_lo", "_hi")


def average_rank(df: DataFrame, by: list[str], value: str, tie: str, name: str) -> DataFrame:
    """Ascending rank with ties averaged; value isn't null. Only rows with ties look their value up."""
    spots = stored(placed(df, by, [F.col(value), F.col(tie)]), "ranked")
    ties = spots.groupBy(*by, value).agg(F.count("*").alias("_ties"), ((F.min("_place") + F.max("_place")) / 2).alias("_mean")).where("_ties > 1")
    met = _with_groups(spots, stored(ties, "ranked-ties"), [*by, value], "_ties")
    return met.withColumn(name, F.coalesce("_mean", F.col("_place").cast("double"))).select(*df.columns, name)


def largest(df: DataFrame, by: list[str]) -> int:
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
