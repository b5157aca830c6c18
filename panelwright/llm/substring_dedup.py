"""Repeated passages by sliding spans of content-defined units.

Sentences are cut into units after every word whose hash is a multiple of CUT, so that a passage pasted in mid-sentence
has the same inner units wherever it stands. Every run of consecutive units is hashed: from each unit the shortest run
onwards, and up to each unit the shortest run back, with at least two units and MIN_WORDS words. A longer run is repeated
only where all runs within it are, and it is covered by the shortest ones that begin at its units, together with those
that end at its last ones; so the shortest runs remove just the units that all runs would. The words before the first
and after the last cut of a passage stay. Runs are joined globally; the first place of a run (least id, then position)
stays, and units that any other place covers are removed.

A run's first place is found by an aggregate, so a passage shared by any number of documents gathers in no task.

Defined results: sentences end with . ! ? or a line break; letter case and white space don't count; a null text is
empty; texts with fewer units or words have no run and stay as they are; a very long text is treated like any other, in
time and memory linear in it; rows with a null id are neither compared nor changed; rows that repeat an id count as one
document, so what they share with each other stays, but each text is cut at its own offsets; an empty table stays empty;
offsets are in code points; a column called spans is replaced, all others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flag_maybe, join_groups, map_batches, maybe_filter, mix64, stored, text_of

MIN_WORDS, MIN_UNITS = 20, 2
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
#: One word in so many ends a unit.
CUT = 8
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def units(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, words and hash of each unit; the last unit of a sentence holds its rest."""
    start, end, words, hashes = [], [], [], []
    for m in SENTENCE.finditer(text):
        at, held = m.start(), []
        for w in WORD.finditer(text, m.start(), m.end()):
            word = w[0].lower().encode("utf-8", "surrogatepass")
            held.append(word)
            if xxhash.xxh3_64_intdigest(word) % CUT == 0 or w.end() == m.end():
                start.append(at)
                end.append(w.end())
                words.append(len(held))
                hashes.append(xxhash.xxh3_64_intdigest(b" ".join(held)))
                at, held = w.end(), []
        if held:
            start.append(at)
            end.append(m.end())
            words.append(len(held))
            hashes.append(xxhash.xxh3_64_intdigest(b" ".join(held)))
    return np.array(start, np.int64), np.array(end, np.int64), np.array(words, np.int64), np.array(hashes, np.uint64)


def runs(text: str | None, min_words: int = MIN_WORDS, min_units: int = MIN_UNITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, start, end of each run, and whether an equal run stands earlier in the text."""
    start, end, words, hashes = units(text or "")
    n = len(start)
    none = np.zeros(0, np.int64)
    if n < min_units:
        return none, none, none, none.astype(bool)
    total = np.concatenate([[0], np.cumsum(words)])
    i = np.arange(n)
    last = np.maximum(i + min_units - 1, np.searchsorted(total, total[:-1] + min_words) - 1)
    first = np.minimum(i - min_units + 1, np.searchsorted(total, total[1:] - min_words, "right") - 1)
    a = np.concatenate([i[last < n], first[first >= 0]])
    b = np.concatenate([last[last < n], i[first >= 0]])
    pairs = np.unique(a * n + b)
    a, b = pairs // n, pairs % n
    if not len(a):
        return none, none, none, none.astype(bool)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(BASE))]))
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(INVERSE))]))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes) * power[:n])])
    found = mix64((prefix[b + 1] - prefix[a]) * back[a] + (b - a).astype(np.uint64))
    again = np.ones(len(a), bool)
    again[np.unique(found, return_index=True)[1]] = False
    return found.view(np.int64), start[a], end[b], again


def _runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash (of the text), run, start, end, again: a row for each run."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = [runs(t) for t in batch.column(2).to_pylist()]
        at = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])
        if len(at):
            h, s, e, again = (np.concatenate([m[k] for m in made]) for k in range(4))
            columns = [*(batch.column(k).take(pa.array(at)) for k in range(2)), pa.array(h), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(again)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "run", "start", "end", "again"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    known = docs.where(F.col(id_col).isNotNull()).select(id_col, F.xxhash64(text_of(text)), text)
    return map_batches(known, run, f"id {kind}, hash long, run long, start int, end int, again boolean")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash (of the text) and spans (array of start, end; merged, in order) of what is to be removed, for texts that
    have any."""
    all_runs = stored(_runs(docs, id_col, text_col), "span-runs")
    counted = all_runs.groupBy("run").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    repeated = stored(counted.where("n > 1").select("run", "first", "n"), "span-repeated")
    later = join_groups(all_runs, repeated, ["run"], "n").where((F.col("id") != F.col("first")) | F.col("again")).select("id", "hash", "start", "end")
    # Runs of a text that overlap or touch are one span: a new one begins where all before have ended.
    ordered = Window.partitionBy("id", "hash").orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = later.repartition("id", "hash").withColumn("fresh", F.coalesce((F.col("start") > before + 1).cast("int"), F.lit(1)))
    merged = fresh.withColumn("span", F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("id", "hash", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = merged.groupBy("id", "hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return spans.withColumnRenamed("id", id_col)


def _rest(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Texts without the spans; a text without spans (null) is whole. Linear in text and spans."""
    out = []
    for text, a, b in zip(texts, starts, ends, strict=True):
        out.append(text if a is None else "".join(text[i:j] for i, j in zip([0, *b], [*a, len(text)], strict=True)))
    return pd.Series(out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated units cut from the text, and spans (null where nothing was cut)."""
    spans = stored(repeated_spans(docs, id_col, text_col), "spans").withColumnsRenamed({id_col: "__pw_id", "hash": "__pw_hash"})
    # Only texts that the bitmap of cut documents may know are shuffled; the join decides.
    flagged = flag_maybe(docs.drop("spans"), maybe_filter(spans, F.col("__pw_id")), F.col(id_col))
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    text = text_of(F.col(text_col))
    whole = flagged.where("NOT __pw_maybe").withColumn("spans", none).withColumn(text_col, text)
    same = (F.col(id_col) == F.col("__pw_id")) & (F.xxhash64(text) == F.col("__pw_hash"))
    joined = flagged.where("__pw_maybe").join(spans.hint("merge"), same, "left").drop("__pw_id", "__pw_hash")
    cut = joined.withColumn(text_col, F.pandas_udf(_rest, "string")(text, F.col("spans.start"), F.col("spans.end")))
    return whole.unionByName(cut).drop("__pw_maybe")
