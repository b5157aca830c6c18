"""Quality rules: an isolation forest on rule statistics.

Each document gives a few statistics (words, symbols, repeated lines and windows, capitals). Random trees split
random statistics at random values; rows that end after short paths differ from the rest. Trees are grown, as the
method wants it, on SUBSAMPLE rows each, out of SAMPLE chosen by a hash; the path-length threshold is calibrated on
all labelled rows: the best gain of rejected bad over rejected good rows, with at most MOST_GOOD of the good ones
rejected. Statistics and scores cover all rows.

Defined results: null and empty texts have no words and fail the base rules; rows without words get statistics of
0; a very long text is measured whole; repeated rows get the same verdict, and an id with several labelled texts is
calibrated on by one of them, the least by its counts; other columns are ignored; without labels of both kinds, the threshold is the score that the share
DEFAULT_SHARE of all rows exceeds; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, crc_part, map_batches, stored, windows

SAMPLE, SUBSAMPLE, TREES, BUCKETS = 16_384, 256, 150, 10_000
MOST_GOOD, DEFAULT_SHARE = 0.02, 0.05
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_distinct", "n_marks")


def rule_counts(text: str | None) -> list[int]:
    """The values of COUNTS for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass").split()
    n = len(raw)
    repeated = 0
    if n >= 3:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, n)
        _, at, times = np.unique(windows(hashes, 3), return_inverse=True, return_counts=True)
        again = times[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        repeated = int(covered.sum())
    seen, lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    blank = sum(map(text.count, SPACES))
    return [n, len(text) - blank, sum(map(text.count, SYMBOLS)), dup, repeated, lines, sum(map(bytes.isupper, raw)), len(set(raw)), text.count("!") + text.count("?")]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = np.array([rule_counts(t) for t in batch.column(1).to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], ["id", *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), run, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """By how much each statistic is beyond its customary limit."""
    words, lines = np.maximum(c["n_words"], 1).astype(float), np.maximum(c["n_lines"], 1)
    length = c["word_chars"] / words
    beyond = lambda ratio, limit: np.maximum(0.0, ratio - limit)
    return np.column_stack([
        beyond(c["n_symbols"] / words, 0.1),
        beyond(c["n_dup_lines"] / lines, 0.3),
        beyond(c["n_repeat_words"] / words, 0.2),
        beyond(c["n_capitals"] / words, 0.2),
        beyond(c["n_marks"] / words, 0.1),
        beyond(length, 10.0) + beyond(3.0, length),
        beyond(0.35, c["n_distinct"] / words),
    ])


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n < 3 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Trees as arrays: feature (-1: leaf), cut, left and right child, and the length of a path ending there."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = SUBSAMPLE, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(size, len(rows))
        deepest = max(1, math.ceil(math.log2(max(2, self.size))) + 2)
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], deepest, rng) for _ in range(trees)] if self.size > 1 else []

    @staticmethod
    def _grow(rows: np.ndarray, deepest: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []

        def grow(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + average_path(len(part))])
            low, high = part.min(0), part.max(0)
            if depth < deepest and len(part) > 1 and len(able := np.flatnonzero(high > low)):
                f = int(rng.choice(able))
                cut = rng.uniform(low[f], high[f])
                below = part[:, f] <= cut
                if 0 < below.sum() < len(part):
                    nodes[at][:2] = f, cut
                    nodes[at][2:4] = grow(part[below], depth + 1), grow(part[~below], depth + 1)
            return at

        grow(rows, 0)
        table = np.array(nodes)
        return table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for rows that are soon alone."""
        if not self.trees or not len(rows):
            return np.full(len(rows), 0.5)
        total = np.zeros(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := np.flatnonzero(feature[at] >= 0)).size:
                f = feature[at[inner]]
                at[inner] = np.where(rows[inner, f] <= cut[at[inner]], left[at[inner]], right[at[inner]])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(average_path(self.size), 1e-9))


def cumulated(scores: DataFrame) -> DataFrame:
    """score, good and bad: how many rows of each have at least that score. scores: score (0 to 1) and _good (1 or 0). Equal
    scores are counted first; what lies above a bucket of scores is known from BUCKETS totals, so that no task orders all."""
    counts = scores.groupBy("score").agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad"))
    counts = stored(counts.withColumn("bucket", F.floor(F.col("score") * BUCKETS)), "quality-scores")
    above, good, bad = [], 0, 0
    for r in counts.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy(F.desc("bucket")).collect():  # at most BUCKETS + 1
        above.append((r.bucket, good, bad))
        good, bad = good + r.good, bad + r.bad
    above = F.broadcast(scores.sparkSession.createDataFrame(above, "bucket long, _more_good long, _more_bad long"))
    w = Window.partitionBy("bucket").orderBy(F.desc("score"))
    return counts.join(above, "bucket").select("score", *((F.sum(c).over(w) + F.col(f"_more_{c}")).alias(c) for c in ("good", "bad")))


def threshold_of(scores: DataFrame, most_good: float = MOST_GOOD) -> float | None:
    """The score above which rejecting gains most, over all rows of scores (score, _good)."""
    sums = cumulated(scores)
    total = sums.agg(F.max("good").alias("good"), F.max("bad").alias("bad"), F.max("score").alias("top")).first()
    if not total.good or not total.bad:
        return None
    fp, tp = F.col("good") / total.good, F.col("bad") / total.bad
    best = sums.where(fp <= most_good).agg(F.max_by("score", F.struct(tp - fp, "score"))).first()[0]
    if best is None:
        return float(total.top)
    under = sums.where(F.col("score") < best).agg(F.max("score")).first()[0]
    return best - 1e-9 if under is None else (best + under) / 2


def quantile_of(scores: DataFrame, share: float) -> float | None:
    """The score that this share of all rows exceeds, between two rows in proportion; null without rows."""
    sums = cumulated(scores.withColumn("_good", F.lit(1)))
    n = sums.agg(F.max("good")).first()[0]
    if not n:
        return None
    place = (n - 1) * share
    at = [sums.where(F.col("good") > k).agg(F.max("score")).first()[0] for k in (math.floor(place), math.ceil(place))]
    return at[0] + (at[1] - at[0]) * (place - math.floor(place))


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return features({c: np.asarray(batch[c]) for c in COUNTS})


def judged(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, the counts, base_failed, anomaly (the forest's score), kept."""
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    stats = stored(statistics(docs, id_col, text_col).withColumn("base_failed", failed), "quality-stats")
    usable = stats.where(~F.col("base_failed"))
    sample = usable.orderBy(F.xxhash64("id"), "id", *COUNTS).limit(SAMPLE).toArrow()  # bounded by SAMPLE
    rows = _matrix(sample)
    forest = Forest(rows)

    def rate(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(forest.score(_matrix(batch))), batch["_good"]], ["score", "_good"])

    scored = lambda df: map_batches(df.select(*COUNTS, "_good"), rate, "score double, _good int")
    cut = None
    if labels is not None:
        known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.min(label_col).cast("int") > 0).cast("int").alias("_good"))
        met = usable.join(known, F.col("id") == F.col("_id")).groupBy("id").agg(F.min(F.struct(*COUNTS, "_good")).alias("c"))  # a row an id
        cut = threshold_of(scored(met.select("c.*")))
    if cut is None:
        cut = quantile_of(scored(usable.withColumn("_good", F.lit(1))), DEFAULT_SHARE)
        cut = 1.0 if cut is None else cut

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        score = forest.score(_matrix(batch))
        kept = ~np.asarray(batch["base_failed"].to_numpy(zero_copy_only=False)) & (score <= cut)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(kept)], [*batch.schema.names, "anomaly", "kept"])

    kind = stats.schema["id"].dataType.simpleString()
    out = map_batches(stats, run, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean")
    return out.withColumnRenamed("id", id_col)


def calibration_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where(crc_part(F.col(id_col), 4) != 2)
