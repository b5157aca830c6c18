"""Exact de-duplication by progressive refinement.

Texts are compared after deleting white space. Rows are grouped by length, the survivors by a hash of a
prefix, and only what still shares both is hashed in full. Texts never leave their scan: what is shuffled is
a row of a few numbers for each document, and each round aggregates before it shuffles.

Defined results: a null text counts as empty; empty texts equal each other; of equal texts the longest original
stays, then the smallest id (a null id after all others); rows that repeat both id and text carry the
same decision, and drop_exact_copies() leaves one of them; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, flag_maybe, join_groups, maybe_filter, select_maybe, stored, text_of, without

PREFIX_CHARS = 96


def normalised(text: Column) -> Column:
    out = text_of(text)
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def full_hash(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, norm = F.col(text_col), normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.length(text_of(text)).alias("_chars"),
        F.octet_length(norm).alias("_bytes"),
        F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("_prefix"),
        text.alias("_text"),
    )


def keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, bytes and prefix_hash of each row, and the full hash of its text, for reports that show it."""
    return _keyed(docs, id_col, text_col).select(F.col("_id").alias(id_col), F.col("_bytes").alias("bytes"), F.col("_prefix").alias("prefix_hash"), full_hash(F.col("_text")).alias("text_sha256"))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, bytes and prefix_hash (the keys of the first
    rounds), full_hash (null where they have told the text from all others without it)."""
    keyed = _keyed(docs, id_col, text_col)
    light = stored(keyed.drop("_text"), "exact-keys")
    same_length = stored(light.groupBy("_bytes").count().where("count > 1").select("_bytes"), "exact-lengths")
    # Rows of a length that no other row has go no further. The bitmap spares a join by length, which would put a
    # common length into one task; the count by length and prefix that follows decides.
    again = select_maybe(light, maybe_filter(same_length, F.col("_bytes")), F.col("_bytes"))
    same_prefix = again.groupBy("_bytes", "_prefix").count().where("count > 1").select("_bytes", "_prefix")
    same_prefix = stored(same_prefix, "exact-prefixes")
    key = (F.col("_bytes"), F.col("_prefix"))
    # The bitmap parts the rows: what it knows is hashed in full, and that decides. It spares a join by length and prefix, which
    # would put a common text, or all empty ones, into one task; rows that it knows by chance are groups of one.
    surviving = maybe_filter(same_prefix, *key)
    read = select_maybe(keyed, surviving, *key)
    survivors = stored(read.select("_id", "_chars", *key, full_hash(F.col("_text")).alias("_hash")), "exact-full")
    groups = survivors.groupBy("_bytes", "_hash").agg(F.count("*").alias("group_size"), F.max(F.struct("_chars", F.bitwise_not("_id").alias("x"), "_id")).alias("_best"))
    groups = stored(groups.select("_bytes", "_hash", "group_size", F.col("_best._id").alias("keep_id")), "exact-groups")
    decided = join_groups(survivors, groups, ["_bytes", "_hash"], "group_size")
    out = ["_id", "_bytes", "_prefix", "keep_id", "group_size", "full_hash"]
    alone = flag_maybe(light, surviving, *key).where("NOT __pw_maybe").select("_id", "_bytes", "_prefix", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(None).cast("string").alias("full_hash"))
    result = decided.withColumnRenamed("_hash", "full_hash").select(out).unionByName(alone.select(out))
    return result.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_bytes").alias("bytes"), F.col("_prefix").alias("prefix_hash"), "full_hash")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, one row of each."""
    found = stored(exact_copies(docs, id_col, text_col).where("group_size > 1"), "exact-found")
    gone = found.where(~F.col("kept")).select(id_col, F.col("full_hash").alias("__pw_gone")).distinct()
    named = stored(gone, "exact-gone").withColumnRenamed(id_col, "__pw_id")
    same = lambda df, hash_: df[id_col].eqNullSafe(F.col("__pw_id")) & (F.col("__pw_hash") == F.col(hash_))

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("__pw_hash", full_hash(F.col(text_col)))

    def drop_gone(df: DataFrame) -> DataFrame:
        return hashed(df).join(named, same(df, "__pw_gone"), "left_anti")

    rest = without(docs, named.withColumnRenamed("__pw_id", id_col), id_col, drop_gone)
    twice = found.where("kept").groupBy(F.col(id_col).alias("__pw_id"), F.col("full_hash").alias("__pw_twice")).count().where("count > 1").drop("count")
    twice = stored(twice, "exact-twice")  # rows given more than once

    def drop_repeats(df: DataFrame) -> DataFrame:
        both = hashed(df)
        again = both.join(twice, same(df, "__pw_twice"), "left_semi").dropDuplicates([id_col, "__pw_hash"])
        return both.join(twice, same(df, "__pw_twice"), "left_anti").unionByName(again)

    return without(rest, twice.withColumnRenamed("__pw_id", id_col), id_col, drop_repeats)
