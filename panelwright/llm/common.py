"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D, just what bytes.split() splits on.
SPACES = " \t\n\x0b\x0c\r"
#: A bitmap has about so many bits for each key, but 2^MOST_BITS at most, which are 16 MB: what is broadcast is bounded.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 15, 27


@dataclass(frozen=True)
class Bitmap:
    rows: DataFrame
    bits: int


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one is taken if driver and
    executors are one process; on a cluster that would be lost, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="panelwright-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: later steps survive lost executors
    without recomputing what lies before."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(text: Column) -> Column:
    """Text, with null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def crc_part(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def spread(df: DataFrame) -> DataFrame:
    """The same rows on all cores, where the scan has fewer partitions than there are cores; a large input stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def give_back() -> None:
    """Returns what a task has freed to the system: workers live on, and what they keep adds up with later stages' needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others do without
    if trim:
        trim(0)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)
            del batch
        give_back()

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(text: str | None, lower: bool) -> np.ndarray:
    """64-bit hashes of the words of one text, in order."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    acc = np.full(n, np.uint64(width))
    for j in range(width):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return acc


def maybe_filter(keys: DataFrame, *cols: Column) -> Bitmap:
    """A bitmap over the hashes of keys, sized by their number. keys are counted, so they should be stored."""
    bits = min(MOST_BITS, max(LEAST_BITS, (keys.count() * BITS_A_KEY).bit_length()))
    h = F.xxhash64(*cols).bitwiseAND((1 << bits) - 1)
    bucket, bit = F.shiftright("__pw_h", 15).alias("__pw_bucket"), F.col("__pw_h").bitwiseAND(32767)
    return Bitmap(keys.select(h.alias("__pw_h")).groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias("__pw_bits")), bits)


def _looked_up(df: DataFrame, bitmap: Bitmap, cols: tuple[Column, ...], how: str) -> tuple[DataFrame, Column]:
    h = F.xxhash64(*cols).bitwiseAND((1 << bitmap.bits) - 1)
    at = F.col("__pw_h").bitwiseAND(32767)
    byte = F.conv(F.hex(F.substring("__pw_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn("__pw_h", h).withColumn("__pw_bucket", F.shiftright("__pw_h", 15)).join(F.broadcast(bitmap.rows), "__pw_bucket", how)
    return joined, F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1


def flag_maybe(df: DataFrame, bitmap: Bitmap, *cols: Column) -> DataFrame:
    """Adds __pw_maybe: whether the key may be in the bitmap. It is true for all that are, and for some others."""
    joined, met = _looked_up(df, bitmap, cols, "left")
    return joined.withColumn("__pw_maybe", F.coalesce(met, F.lit(False))).drop("__pw_h", "__pw_bucket", "__pw_bits")


def select_maybe(df: DataFrame, bitmap: Bitmap, *cols: Column) -> DataFrame:
    """Rows of df whose key may be in the bitmap: all that are, and some others. An exact join must follow."""
    joined, met = _looked_up(df, bitmap, cols, "inner")
    return joined.where(met).drop("__pw_h", "__pw_bucket", "__pw_bits")


def without(rows: DataFrame, gone: DataFrame, key: str, match: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows but for those that match() takes out. Only rows whose key may be among those of gone (stored, with a column of
    that name) go through match(), which may shuffle them; all others stay where they are read."""
    flagged = flag_maybe(rows, maybe_filter(gone, F.col(key)), F.col(key))
    some = match(flagged.where("__pw_maybe").drop("__pw_maybe"))
    return flagged.where("NOT __pw_maybe").select(rows.columns).unionByName(some.select(rows.columns))


#: Groups that hold more than one in so many of all rows; there are at most so many of them.
HEAVY = 1000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, prune: bool = True, how: str = "inner") -> DataFrame:
    """rows with the columns of their group; rows without a group go (with how = left they stay, with nulls), with prune most of them where they are read. groups has
    one row for each key and in size its number of rows; both should be stored. Heavy groups, of which there are at most
    HEAVY, are broadcast, so that no key of theirs fills a task; a group that is joined by shuffle holds at most one in HEAVY
    of the rows."""
    heavy = F.col(size) * HEAVY > rows.count()
    keys = [F.col(c) for c in on]
    more = [c for c in groups.columns if c not in on]
    kept = select_maybe(rows, maybe_filter(groups, *keys), *keys) if prune else rows
    # An outer join, as an anti join would be moved before the pruning.
    marked = kept.join(F.broadcast(groups.where(heavy).withColumn("__pw_hot", F.lit(True))), on, "left")
    rest = marked.where("__pw_hot IS NULL").drop("__pw_hot", *more).join(groups.where(~heavy), on, how)
    return marked.where("__pw_hot").drop("__pw_hot").unionByName(rest)
