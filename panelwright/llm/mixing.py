"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the budget over what it holds. Every document draws its number
of copies from a Poisson distribution with that mean, by inverting the distribution at a uniform number hashed from
seed and id, so that a rerun draws the same; it is exploded by that count, and the copies are shuffled globally by
another hash. Nothing is grouped by source but its totals, so a source may hold any share of the rows.

Defined results: a null source is a source of its own; null ids draw as one id; rows that repeat an id draw alike;
empty and null texts weigh nothing but are drawn at their source's rate; sources absent from the weights, or with
weight 0, or holding no characters, get rate 0 (drawn never) unless default targets are used; an empty table stays
empty; a very long text counts only by its length. replicate() and mixed() replace columns that clash with the ones they
add; mixed_documents() adds none, so a user's rate, copies, replica or shuffle_key comes through as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Up to so many sources the table of rates is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Larger rates are drawn as sums of Poisson draws with at most this mean.
LARGEST_MEAN = 16.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def source_rates(docs: DataFrame, weights: dict | None, alpha: float, epochs: float, source_col: str, size: Column) -> DataFrame:
    """source, chars, docs, rate. weights: target share by source; None: shares in proportion to size^alpha."""
    held = stored(docs.groupBy(F.col(source_col).alias("_source")).agg(F.sum(size).alias("chars"), F.count("*").alias("docs")), "mix-sources")
    if weights is None:
        target = F.when(F.col("chars") > 0, F.pow(F.col("chars").cast("double"), F.lit(alpha))).otherwise(0.0)
    else:
        target = F.lit(0.0)
        for name, share in weights.items():
            target = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(target)
    sized = held.withColumn("target", target)
    whole = sized.agg(F.sum(F.col("chars").cast("double")).alias("chars"), F.sum("target").alias("target")).first()  # two numbers
    if not whole.chars or not whole.target:
        return sized.select("_source", "chars", "docs", F.lit(0.0).alias("rate"))
    rate = F.when(F.col("chars") > 0, F.col("target") / whole.target * whole.chars * epochs / F.col("chars")).otherwise(0.0)
    return stored(sized.select("_source", "chars", "docs", rate.alias("rate")), "mix-rates")


def _with_tables(rates: DataFrame) -> DataFrame:
    """Adds parts and cdf: the cumulated Poisson probabilities of rate / parts."""
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1))
    cut = rates.withColumn("parts", parts.cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    terms = (F.col("mean") + 12 * F.sqrt("mean") + 24).cast("int")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["cdf"], F.array(acc["c"] + p)).alias("cdf"))

    return cut.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda a: a["cdf"])).select("_source", "rate", "parts", "cdf")


def _drawn(docs: DataFrame, weights: dict | None, alpha: float, epochs: float, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Every copy of every document: its columns and __pw_rate, __pw_copies, __pw_replica and __pw_key."""
    size = F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0))
    rates = source_rates(docs, weights, alpha, epochs, source_col, size)
    tables = _with_tables(rates).withColumnsRenamed({"_source": "__pw_source", "rate": "__pw_rate", "parts": "__pw_parts", "cdf": "__pw_cdf"})
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        tables = F.broadcast(tables)
    joined = docs.join(tables, docs[source_col].eqNullSafe(F.col("__pw_source")))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    copies = F.aggregate(
        F.sequence(F.lit(1), F.col("__pw_parts")),
        F.lit(0),
        lambda acc, i: acc + F.size(F.filter("__pw_cdf", lambda c: c <= uniform(F.lit(str(seed)), ident, i.cast("string")))),
    )
    counted = joined.withColumn("__pw_copies", copies).where("__pw_copies > 0")
    exploded = counted.withColumn("__pw_replica", F.explode(F.sequence(F.lit(0), F.col("__pw_copies") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), ident, F.col("__pw_replica").cast("string")).cast("binary"))
    return exploded.withColumn("__pw_key", key).drop("__pw_source", "__pw_parts", "__pw_cdf")


def replicate(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Every copy of every document: the columns of docs, rate, copies, replica (from 0) and shuffle_key."""
    added = {"__pw_rate": "rate", "__pw_copies": "copies", "__pw_replica": "replica", "__pw_key": "shuffle_key"}
    return _drawn(docs.drop(*added.values()), weights, alpha, epochs, seed, id_col, source_col, text_col).withColumnsRenamed(added)


def shuffled(df: DataFrame, partitions: int | None = None, key: str = "shuffle_key") -> DataFrame:
    """Global shuffle: rows go to partitions by the hash key and are ordered by it within them."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.col(key)).sortWithinPartitions(key)


def mixed(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    return shuffled(replicate(docs, **options))


def mixed_documents(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The same rows in the same order as mixed(), with just the columns of docs."""
    return shuffled(_drawn(docs, weights, alpha, epochs, seed, id_col, source_col, text_col), key="__pw_key").select(docs.columns)
