"""Table workbench: find, where, computed columns, group-by and column status, in that order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from panelwright.functions.scalars import finite
from panelwright.sources.scratch import stored


def find(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any column contains the text, in either case."""
    return df.where(F.lower(F.concat_ws("\u0001", *(F.col(f"`{c}`").cast("string") for c in df.columns))).contains(text.lower()))


@contextmanager
def forgiving(spark: SparkSession) -> Iterator[None]:
    """Expressions made within give null for a bad cell or a division by 0, whatever the session does else. Spark decides
    that when it resolves an expression, so a DataFrame built within keeps it."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def where(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which a predicate holds; null, and what can't be computed for a row, is false."""
    with forgiving(df.sparkSession):
        return df.where(F.coalesce(F.expr(predicate), F.lit(False)))


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds _i, the row number over the whole table in the given order, without gathering it: rows are ranged over
    partitions, numbered there, and shifted by what the partitions before hold. The order is fixed by storing it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id() is the partition, shifted by 33 bits, plus the row in it.
    held = stored(ranged.withColumn("_m", F.monotonically_increasing_id()), "workbench-order").withColumns({"_p": F.shiftright("_m", 33), "_k": F.col("_m").bitwiseAND((1 << 33) - 1)})
    sizes = held.groupBy("_p").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    return held.join(F.broadcast(offsets), "_p").withColumn("_i", F.col("_k") + F.col("_o")).drop("_m", "_p", "_k", "_o")


def running_sum(df: DataFrame, value: Column, name: str, chunk: int = 100_000) -> DataFrame:
    """Adds the sum of value over all rows up to this one (df has _i): sums of chunks, then within a chunk."""
    parts = df.withColumns({"_b": F.floor(F.col("_i") / chunk), "_x": value})
    sums = parts.groupBy("_b").agg(F.sum("_x").alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    offsets = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    own = F.coalesce(F.sum("_x").over(Window.partitionBy("_b").orderBy("_i")), F.lit(0))
    return parts.join(offsets, "_b").withColumn(name, own + F.col("_o")).drop("_b", "_x", "_o")


def with_function(df: DataFrame, name: str, fn: str, column: str, n: int = 1) -> DataFrame:
    """Adds Z, RANK, SHARE, CUM, LAG, PCT, MA or SD of a column over the whole table (df has _i). MA and SD need n values
    in the last n rows."""
    x = F.col(column)
    if fn in ("Z", "SHARE"):
        whole = F.broadcast(df.agg(F.avg(x).alias("_a"), F.stddev_samp(x).alias("_d"), F.sum(x).alias("_t")))  # one row
        value = F.when(F.col("_d") > 0, (x - F.col("_a")) / F.col("_d")) if fn == "Z" else x / F.nullif(F.col("_t"), F.lit(0))
        return df.join(whole).withColumn(name, value).drop("_a", "_d", "_t")
    if fn == "RANK":  # ties in the order of rows
        known = df.where(x.isNotNull()).select(x.alias("_v"), F.col("_i").alias("_row"))
        places = numbered(known, [F.col("_v").desc(), F.col("_row")]).select(F.col("_row").alias("_i"), (F.col("_i") + 1).alias(name))
        return df.join(places, "_i", "left")
    if fn == "CUM":  # a null adds nothing
        return running_sum(df, x, "_u").withColumn(name, F.coalesce("_u", F.lit(0.0))).drop("_u")
    if fn in ("LAG", "PCT"):
        past = df.select((F.col("_i") + n).alias("_i"), x.alias("_w"))
        value = F.col("_w") if fn == "LAG" else F.when(F.col("_w") != 0, x / F.col("_w") - 1)
        return df.join(past, "_i", "left").withColumn(name, value).drop("_w")
    # Chunks of rows, each with the n - 1 rows before it, which other chunks hold too.
    chunk = max(100_000, n)
    own = F.floor(F.col("_i") / chunk)
    shared = df.withColumn("_b", F.explode(F.sequence(own, F.floor((F.col("_i") + n - 1) / chunk))))
    last = Window.partitionBy("_b").orderBy("_i").rowsBetween(1 - n, 0)
    value = F.when(F.count(x).over(last) == n, (F.avg(x) if fn == "MA" else F.stddev_samp(x)).over(last))
    return shared.withColumn(name, value).where(F.col("_b") == own).drop("_b")


CALL = re.compile(r"\b(Z|RANK|SHARE|CUM|LAG|PCT|MA|SD)\(\s*(\w+)\s*(?:,\s*(\d+)\s*)?\)")


def formula(df: DataFrame, name: str, text: str, order: list[Column]) -> DataFrame:
    """A computed column: SQL with column functions such as Z(price) or MA(price, 3); what isn't finite is null. The text goes
    to Spark's own expression parser; nothing is evaluated in Python. A division by 0 or a bad cell gives null."""
    calls = list(dict.fromkeys(m.groups() for m in CALL.finditer(text)))
    out = stored(numbered(df, order), "workbench-rows") if calls else df
    for k, (fn, column, n) in enumerate(calls):
        out = with_function(out, f"__f{k}", fn, column, int(n or 1))
    sql = CALL.sub(lambda m: f"__f{calls.index(m.groups())}", text)
    with forgiving(df.sparkSession):
        made = out.withColumn(name, finite(F.expr(sql).cast("double")))
    return made.drop("_i", *(f"__f{k}" for k in range(len(calls))))


def grouped(df: DataFrame, by: str, kind: str = "sum") -> DataFrame:
    """n and one aggregate of every numeric column."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != by]
    how = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count}[kind]
    return df.groupBy(by).agg(F.count("*").alias("n"), *(how(c).alias(c) for c in numbers))


def column_status(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    return df.agg(F.sum(x).alias("sum"), F.avg(x).alias("avg"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def sorted_by(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Blanks come last either way."""
    return df.orderBy(F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last())


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def nearest_on_line(df: DataFrame, by: list[str], key: str, value: str, k: int) -> DataFrame:
    """Of every row the k rows of its group (by) nearest in value, ties by the smaller key: other and place, from 1. In the
    order of their values the nearest of a row are among the k before, the k after and the first k of its own value, so no pairs
    are made: the plan is linear in the rows. key is unique in a group; values aren't null."""
    own = F.struct(F.col(key).alias("other"), F.col(value).alias("_v"))
    # Either way from a row, equal values come in the order of their keys.
    up = Window.partitionBy(*by).orderBy(F.col(value).asc(), key)
    down = Window.partitionBy(*by).orderBy(F.col(value).desc(), key)
    same = Window.partitionBy(*by, value).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = [F.lead(own, i).over(w) for w in (up, down) for i in range(1, k + 1)] + [F.nth_value(own, i).over(same) for i in range(1, k + 2)]
    met = df.withColumn("_near", F.array_distinct(F.array_compact(F.array(*near))))
    gap = lambda x: F.round(F.abs(x["_v"] - F.col(value)), 9)
    others = F.filter("_near", lambda x: x["other"] != F.col(key))
    ranked = F.array_sort(F.transform(others, lambda x: F.struct(gap(x).alias("gap"), x["other"].alias("other"))))
    each = met.select(*df.columns, F.posexplode(F.slice(ranked, 1, k)).alias("_i", "_x"))
    return each.select(*df.columns, F.col("_x.other").alias("other"), (F.col("_i") + 1).alias("place"))


def top_quota(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """Where df has more than n rows: n places split over groups in proportion to their rows, at least one each (a half goes to
    the even number), then the first n by group and order."""
    counts = df.groupBy(by).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    share = F.greatest(F.lit(1), F.bround(F.col("_c") * n / F.col("_t")))
    quota = counts.join(F.broadcast(total)).select(by, F.when(F.col("_t") > n, share).otherwise(F.col("_c")).alias("_q"))  # total: one row
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.join(quota, by).where(F.col("place") <= F.col("_q")).drop("_q").orderBy(by, *order).limit(n)
