"""Position folds and what follows from them, for many series and parameter sets at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions below SMALL are none; a change of less than STEP isn't traded.
SMALL, STEP = 0.001, 0.01


def target(z: Column, entry: Column, saturation: Column, leverage: Column, sign: int = -1) -> Column:
    """Nothing inside the dead zone, a linear ramp to full size at saturation, against (or with) the signal; null without a
    signal."""
    size = F.least(F.greatest((F.abs(z) - entry) / (saturation - entry), F.lit(0.0)), F.lit(1.0))
    return F.signum(z) * size * leverage * sign


def _walk(rows: Iterator[tuple | None]) -> Iterator[tuple[list[float], list[str | None]]]:
    """Position and reason of each row of key, target, price, stop and longest hold (those of a series' first row count), series
    after series. A row without a target keeps the position; a stop against the entry price or the longest hold closes it; a
    flip of sign closes it before it opens the other side. Yields after each batch, which ends where rows gives None."""
    last: object = None
    pos, entry, since, t, stop, max_hold = 0.0, None, 0, 0, 0.0, 0
    positions, reasons = [], []
    for row in rows:
        if row is None:
            yield positions, reasons
            positions, reasons = [], []
            continue
        key, want, price, own_stop, own_hold = row
        reason = None
        if key != last:
            last, pos, entry, since, t, stop, max_hold = key, 0.0, None, 0, 0, own_stop, own_hold
        else:
            t += 1
        if t and want is not None and want == want:
            gain = pos * (price - entry) / max(1e-4, abs(entry)) if abs(pos) > SMALL else 0.0
            if abs(pos) > SMALL and gain <= -stop:
                pos, reason = 0.0, "stop"
            elif abs(pos) > SMALL and t - since >= max_hold:
                pos, reason = 0.0, "max_hold"
            else:
                flip = abs(pos) > SMALL and abs(want) > SMALL and (want > 0) != (pos > 0)
                pos = 0.0 if flip else pos
                if abs(want - pos) > STEP:
                    opened = abs(pos) < SMALL and abs(want) > SMALL
                    reason = "flip" if flip else "entry" if opened else "exit" if abs(want) < SMALL else "scale_in" if abs(want) > abs(pos) else "scale_out"
                    if opened:
                        entry, since = price, t
                    pos = want
                elif flip:
                    reason = "flip"
        positions.append(pos)
        reasons.append(reason)


def fold(df: DataFrame, by: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Positions by an ordered state machine over each series with each parameter set, in time linear in its rows. df:
    target, price and the parameters stop and max_hold; the columns to keep come along. Series are dealt by their keys and
    sorted; a task walks its rows in one stream and holds a batch and the state of one series."""
    out = [*by, order, *keep]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in out)
    wide = df.select(*dict.fromkeys([*out, "target", "price", "stop", "max_hold"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = []

        def rows() -> Iterator[tuple | None]:
            for batch in batches:
                met.append(batch)
                keys = zip(*(batch[c].to_pylist() for c in by), strict=True)
                yield from zip(keys, *(batch[c].to_pylist() for c in ("target", "price", "stop", "max_hold")), strict=True)
                yield None

        for pos, reason in _walk(rows()):
            batch = met.pop()
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in out), pa.array(pos, pa.float64()), pa.array(reason, pa.string())], [*out, "pos", "reason"])

    return wide.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, f"{kinds}, pos double, reason string")


def pnl(df: DataFrame, by: list[str], order: str, cost_bps: float = 5.0) -> DataFrame:
    """pos of the row before times ret, less cost on what is traded; equity is the running sum."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.coalesce(F.lag("pos").over(w), F.lit(0.0))
    turn = F.abs(F.col("pos") - before)
    cost = F.when(turn > SMALL, turn * cost_bps / 1e4).otherwise(0.0)
    out = df.withColumns({"turn": turn, "pnl": before * F.coalesce("ret", F.lit(0.0)) - cost})
    return out.withColumn("equity", F.sum("pnl").over(w))


def trades(df: DataFrame, by: list[str], order: str, cost_bps: float = 5.0) -> DataFrame:
    """Runs of one position as trades: entry_at, exit_at (null if open), side, rows (held), pnl: position times the returns
    after entry up to the row of exit, less cost both ways; open ones up to the last row, less cost one way."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = df.withColumns({"_i": F.row_number().over(w), "_sum": F.sum(F.coalesce("ret", F.lit(0.0))).over(w), "_before": F.coalesce(F.lag("pos").over(w), F.lit(0.0))})
    whole = Window.partitionBy(*by)
    marked = marked.withColumns({"_last": F.max("_i").over(whole), "_end": F.last("_sum").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    changed = marked.where("pos <> _before")
    found = changed.withColumns({"exit_at": F.lead(order).over(w), "_exit": F.lead("_i").over(w), "_exit_sum": F.lead("_sum").over(w)}).where("pos <> 0")
    open_ = F.col("exit_at").isNull()
    gain = F.col("pos") * (F.coalesce("_exit_sum", "_end") - F.col("_sum")) - F.when(open_, 1).otherwise(2) * cost_bps / 1e4
    held = F.coalesce("_exit", "_last") - F.col("_i")
    return found.select(*by, F.col(order).alias("entry_at"), "exit_at", F.signum("pos").alias("side"), held.alias("rows"), gain.alias("pnl"))


def metrics(df: DataFrame, by: list[str], order: str, per_year: float) -> DataFrame:
    """Sharpe, total, CAGR, additive maximum drawdown, and number, share of winners and mean rows held of the trades."""
    w = Window.partitionBy(*by).orderBy(order)
    sd = F.stddev_samp("pnl")
    rows = df.withColumn("_dd", F.col("equity") - F.max("equity").over(w)).groupBy(*by).agg(
        F.when(sd > 0, F.avg("pnl") / sd * per_year**0.5).otherwise(0.0).alias("sharpe"), F.sum("pnl").alias("total"), (F.exp(F.sum("pnl") / (F.count("*") / per_year)) - 1).alias("cagr"),
        F.min("_dd").alias("max_dd"), F.count("*").alias("n"),
    )
    made = trades(df, by, order).groupBy(*by).agg(F.count("*").alias("n_trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("rows").alias("avg_hold"))
    return rows.join(made, by, "left").fillna(0, ["n_trades", "win_rate", "avg_hold"])


def _starts(seed: str, runs: int, blocks: int) -> np.ndarray:
    """The hashes of run and block number that starts are taken from."""
    number = lambda run, b: int(hashlib.md5(f"{seed}:{run}:{b}".encode()).hexdigest()[:8], 16)
    return np.array([[number(run, b) for b in range(blocks)] for run in range(runs)], np.int64).reshape(runs, blocks)


def bootstrap(df: DataFrame, by: list[str], order: str, runs: int, block: int, seed: str) -> DataFrame:
    """Totals of runs that chain blocks of consecutive rows to the length of the series, the last one cut short; starts are
    hashed from run and block number. A series, bounded by its dates, is a row of its values, so that its runs are drawn where
    it is, by lookups in its running sums; nothing is joined."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = np.zeros((runs, 0), np.int64)
        names = None
        for batch in batches:
            names = names or [*batch.schema.names[:-1], "run", "total"]
            for k in range(batch.num_rows):
                values = batch.column(len(by))[k].values.to_numpy(zero_copy_only=False)
                n = len(values)
                blocks = -(-n // block)
                if blocks > drawn.shape[1]:
                    drawn = _starts(seed, runs, blocks)
                at = drawn[:, :blocks] % max(1, n - block)
                sums = np.concatenate([[0.0], np.cumsum(values)])
                ends = at + np.minimum(block, n - np.arange(blocks) * block)
                total = (sums[ends] - sums[at]).sum(1)
                key = [pa.repeat(c[k], runs) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*key, pa.array(np.arange(runs, dtype=np.int32)), pa.array(total)], names)

    point = F.struct(F.col(order).alias("at"), F.coalesce(F.col("pnl").cast("double"), F.lit(0.0)).alias("pnl"))
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(point)).alias("points")).select(*by, F.col("points.pnl").alias("points"))
    return rows.mapInArrow(draw, f"{kinds}, run int, total double")


def histogram(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    bin_ = F.when(high > low, F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    return df.withColumn("bin", bin_).groupBy(*by, "bin").agg(F.count("*").alias("n"))
