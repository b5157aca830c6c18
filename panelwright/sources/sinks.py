"""Writers that are safe to run again, and guards before writing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    """Hadoop's file system of a path, so any store that Spark reads, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def marks(spark: SparkSession, path: str) -> list[str]:
    """Names of the empty files in a folder, in order."""
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def mark(spark: SparkSession, path: str) -> bool:
    """Creates an empty file, in one step; False if it is there."""
    fs, p = _fs(spark, path)
    return fs.createNewFile(p)


#: Up to so many new keys (or partitions), the table's keys are reduced to these where they are read.
FEW_KEYS, FEW_PARTITIONS = 1_000_000, 1000


def same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    """Equal keys, nulls included."""
    out = F.lit(True)
    for c in key:
        out &= a[c].eqNullSafe(b[c])
    return out


def _held(new: DataFrame, table: DataFrame, key: list[str], partition: str | None) -> DataFrame:
    """The table's keys that may be among those of new (stored). The range of the new keys is pushed to the scan, and the values
    of the partition too; of few new keys, only these are left, without moving the table."""
    ends = new.agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in key for n, f in (("lo", F.min), ("hi", F.max), ("any", F.count)))).first()
    held = table.select(*key)
    for c in key:
        fits = F.col(c).between(F.lit(ends[f"lo_{c}"]), F.lit(ends[f"hi_{c}"])) if ends[f"any_{c}"] else F.lit(False)
        held = held.where(fits if ends[f"any_{c}"] == ends["n"] else fits | F.col(c).isNull())
    if partition:
        values = [r[0] for r in new.select(partition).distinct().limit(FEW_PARTITIONS + 1).collect()]
        if len(values) <= FEW_PARTITIONS and None not in values:
            held = held.where(F.col(partition).isin(values))
    if ends["n"] <= FEW_KEYS:
        keys = F.broadcast(new.select(*key))
        held = held.join(keys, same(held, keys, key), "left_semi")
    return held


def _firsts(df: DataFrame, key: list[str], first_by: list[str] | None) -> DataFrame:
    order = first_by or [c for c in df.columns if c not in key]
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*key).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_r"))
    return picked.select(*key, "_r.*").select(df.columns)


def _write(df: DataFrame, path: str, partition: str | None, mode: str) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append_new(df: DataFrame, path: str, key: list[str], first_by: list[str] | None = None, partition: str | None = None) -> int:
    """Append the rows whose key the table lacks; of equal new keys the first by first_by (by default by all columns)
    stays, the same on every run. Of the table, only what the new keys may meet is read: rows within their range, partitions
    that they fall into (partition is a column of the key). Returns how many were added."""
    spark = df.sparkSession
    fresh = stored(_firsts(df, key, first_by), "append-new")
    if exists(spark, path):
        held = _held(fresh, spark.read.parquet(path), key, partition)
        fresh = stored(fresh.join(held, same(fresh, held, key), "left_anti"), "append-new")
    added = fresh.count()
    if added:
        _write(fresh, path, partition, "append")
    return added


#: Ends the mark of a batch that had nothing to add.
NOTHING = ".nothing"


def batches(spark: SparkSession, path: str) -> DataFrame | None:
    """What append_batch() has written and marked as done; None before the first batch."""
    done = [b for b in marks(spark, f"{path}/_done") if not b.endswith(NOTHING)]
    return spark.read.option("basePath", path).parquet(*(f"{path}/batch={b}" for b in done)).drop("batch") if done else None


def append_batch(df: DataFrame, path: str, key: list[str], batch: str, partition: str | None = None) -> int:
    """append_new() for a batch of a name: its rows lie in a folder of that name and count once it is marked as done. A batch
    that is done is skipped; one that was cut off is written anew."""
    spark = df.sparkSession
    if {batch, batch + NOTHING} & set(marks(spark, f"{path}/_done")):
        return 0
    fresh = stored(_firsts(df, key, None), "append-batch")
    table = batches(spark, path)
    if table is not None:
        held = _held(fresh, table, key, partition)
        fresh = stored(fresh.join(held, same(fresh, held, key), "left_anti"), "append-batch")
    added = fresh.count()
    if added:
        _write(fresh, f"{path}/batch={batch}", partition, "overwrite")
    mark(spark, f"{path}/_done/{batch}{'' if added else NOTHING}")
    return added


def append_vintage(balance: DataFrame, path: str, period: str, released: Column) -> int:
    """One vintage of a wide balance as rows (period, series, value, knowledge_date), appended once per release."""
    names = [c for c in balance.columns if c != period]
    rows = balance.select(F.col(period).alias("period"), *(F.col(n).cast("double") for n in names)).unpivot("period", names, "series", "value").withColumn("knowledge_date", released)
    return append_new(rows, path, ["period", "series", "knowledge_date"])


def write_snapshot(df: DataFrame, path: str, date: str = "as_of") -> None:
    """Partitioned by date; a rerun replaces just its own dates."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def latest_prior(spark: SparkSession, path: str, as_of: str, date: str = "as_of") -> DataFrame:
    """The newest snapshot strictly before a date."""
    table = spark.read.parquet(path)
    before = table.where(F.col(date) < F.lit(as_of).cast("date"))
    last = before.agg(F.max(date).alias("_d"))
    return before.join(F.broadcast(last), F.col(date) == F.col("_d")).drop("_d")  # last: one row


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def coverage(df: DataFrame, symbol: str, value: str, wanted: int) -> float:
    """Share of the wanted symbols that have a value."""
    return df.where(F.col(value).isNotNull()).agg(F.count_distinct(symbol)).first()[0] / max(1, wanted)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that was published."""
    return spark.read.parquet(f"{path}/{marks(spark, f'{path}/_published')[-1].partition('-')[2]}")


def publish(df: DataFrame, path: str, symbol: str, value: str, wanted: int, least: float = 0.8, keep: int = 2) -> bool:
    """Replace the table only when coverage suffices; else the old one stays. The new version is written beside the old, and
    what was written is checked; one mark then makes it the current one. A write that fails leaves the old version in place. The
    last keep versions stay, for who still reads them."""
    spark, version = df.sparkSession, f"version_{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    if coverage(spark.read.parquet(f"{path}/{version}"), symbol, value, wanted) < least:
        remove(spark, f"{path}/{version}")
        return False
    folder = f"{path}/_published"
    number = int(marks(spark, folder)[-1].partition("-")[0]) + 1 if marks(spark, folder) else 1
    mark(spark, f"{folder}/{number:012d}-{version}")
    for old in marks(spark, folder)[:-keep]:
        remove(spark, f"{folder}/{old}")
        remove(spark, f"{path}/{old.partition('-')[2]}")
    return True


def dense_symbols(df: DataFrame, symbol: str, date: str, value: str, least: float = 0.5) -> DataFrame:
    """Symbols with values on at least such a share of the dates."""
    days = df.agg(F.count_distinct(date).alias("_n"))
    counts = df.where(F.col(value).isNotNull()).groupBy(symbol).agg(F.count_distinct(date).alias("_k"))
    kept = counts.join(F.broadcast(days)).where(F.col("_k") >= F.col("_n") * least).select(symbol)  # days: one row
    return df.join(kept, symbol, "left_semi")


def fresh_symbols(df: DataFrame, symbol: str, date: str, stale_days: int, last: DataFrame | None = None) -> DataFrame:
    """Symbols whose last date is at most so many days before the last of all, or before that of last (one row, last)."""
    end = df.agg(F.max(date).alias("last")) if last is None else last
    seen = df.groupBy(symbol).agg(F.max(date).alias("_seen")).join(F.broadcast(end)).where(F.col("_seen") >= F.date_sub("last", stale_days))  # end: one row
    return df.join(seen.select(symbol), symbol, "left_semi")
