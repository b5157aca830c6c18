"""Correlations of all pairs of series in blocks that emit what a screen keeps, and the spreads of the pairs it keeps.

Each two blocks of series meet in one task, as matrices; a series travels once for each block, not for each partner. A
task emits at most the strongest pairs, or one summary, never all of its pairs: as the strongest of the whole are among the
strongest of each task, and summaries add up, that loses nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Series of a side of a block; of a screen's, which is worked off in tiles of TILE series a side; pairs held before they are cut.
BLOCK, WIDE, TILE, HELD = 256, 4096, 512, 100_000


def series_rows(df: DataFrame, key: str, date: str, value: str, *keep: str) -> DataFrame:
    """A row for each series, of at most one value a date: key, keep, days and xs. Its length is bounded by the calendar."""
    known = df.where(F.col(value).isNotNull())
    point = F.struct(F.unix_date(F.to_date(date)).alias("d"), F.col(value).cast("double").alias("x"))
    rows = known.groupBy(F.col(key).alias("key"), *keep).agg(F.sort_array(F.collect_list(point)).alias("points"))
    return rows.select("key", *keep, F.col("points.d").alias("days"), F.col("points.x").alias("xs"))


def _dealt(series: DataFrame, group: str | None, block: int) -> DataFrame:
    """Each series once for each block of its group, with the two blocks that meet there."""
    if group:
        sized = series.join(series.groupBy(group).agg(F.ceil(F.count("*") / block).alias("_blocks")), group)
    else:
        sized = series.withColumn("_blocks", F.lit(-(-series.count() // block) or 1))
    met = sized.withColumn("_i", F.pmod(F.xxhash64("key"), F.col("_blocks"))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return met.withColumns({"_lo": F.least("_i", "_j"), "_hi": F.greatest("_i", "_j")}).drop("_blocks", "_j")


def block_correlations(rows: pd.DataFrame, least: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a task in the order of their keys, and of the pairs with so many common dates: places, correlation and n."""
    rows = rows.sort_values("key", kind="stable", ignore_index=True)
    days, xs = (np.concatenate([np.asarray(v) for v in rows[c]]) for c in ("days", "xs"))
    _, day = np.unique(days, return_inverse=True)
    at = np.repeat(np.arange(len(rows)), [len(v) for v in rows["days"]])
    x, has = np.zeros((2, day.max() + 1, len(rows)))
    x[day, at], has[day, at] = xs, 1.0
    x -= has * (x.sum(0) / np.maximum(has.sum(0), 1))  # around its own mean, so that sums of squares don't cancel
    i, j = np.flatnonzero(rows["_i"] == rows["_lo"]), np.flatnonzero(rows["_i"] == rows["_hi"])
    of = lambda p, q: p[:, i].T @ q[:, j]
    n, sx, sy = of(has, has), of(x, has), of(has, x)
    with np.errstate(all="ignore"):
        corr = (of(x, x) - sx * sy / n) / np.sqrt((of(x * x, has) - sx * sx / n) * (of(has, x * x) - sy * sy / n))
    ok = (n >= least) & np.isfinite(corr)
    if (rows["_lo"] == rows["_hi"]).all():
        ok &= i[:, None] < j
    p, q = np.nonzero(ok)
    return rows, i[p], j[q], corr[p, q], n[p, q].astype(np.int64)


def _tiles(rows: pd.DataFrame, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places p and q of the series of each tile, and the correlation and number of common dates of each p with each q; nan where
    there is none, fewer than least, or the pair is in another tile. Series without gaps come first, as their sums need fewer
    products."""
    days, xs = (np.concatenate([np.asarray(v) for v in rows[c]]) for c in ("days", "xs"))
    _, day = np.unique(days, return_inverse=True)
    at = np.repeat(np.arange(len(rows)), [len(v) for v in rows["days"]])
    x, has = np.zeros((2, day.max() + 1, len(rows)))
    x[day, at], has[day, at] = xs, 1.0
    count = has.sum(0)
    x -= has * (x.sum(0) / np.maximum(count, 1))
    whole = count == len(x)
    square = x * x
    size = square.sum(0)
    alone = bool((rows["_lo"] == rows["_hi"]).all())
    cut = lambda own: [part[k : k + TILE] for part in (np.flatnonzero(own & whole), np.flatnonzero(own & ~whole)) for k in range(0, len(part), TILE)]
    left, right = (cut((rows["_i"] == rows[c]).to_numpy()) for c in ("_lo", "_hi"))
    for i, p in enumerate(left):
        for j, q in enumerate(right):
            if alone and j < i:
                continue
            of = lambda u, v: u[:, p].T @ v[:, q]  # noqa: B023, E731
            # Over its own dates a series sums to 0: a sum is needed only where the other one has gaps.
            gaps_p, gaps_q = not whole[p[0]], not whole[q[0]]
            n = of(has, has) if gaps_p and gaps_q else np.broadcast_to(count[p][:, None] if gaps_p else count[q], (len(p), len(q)))
            sxy, sxx, syy = of(x, x), size[p][:, None], size[q]
            sx, sy = of(x, has) if gaps_q else 0.0, of(has, x) if gaps_p else 0.0
            with np.errstate(all="ignore"):
                if gaps_q:
                    sxx = of(square, has) - sx * sx / n
                if gaps_p:
                    syy = of(has, square) - sy * sy / n
                if gaps_p and gaps_q:
                    sxy -= sx * sy / n
                corr = sxy / np.sqrt(sxx * syy)
            corr[~((n >= least) & np.isfinite(corr))] = np.nan
            if alone and i == j:
                corr[np.tril_indices(len(p), 0, len(q))] = np.nan
            yield p, q, corr, n


def _strongest(least: int, floor: float, top: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable", ignore_index=True)
        basket = rows["kind"].to_numpy() == "basket"
        keys, homes = rows["key"].to_numpy(), rows["home"].tolist()

        def cut(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            """The strongest of each kind, in order."""
            p, q, corr, n = (np.concatenate(c) for c in zip(*found, strict=True))
            # A basket stands before a stock; of the same kind, the smaller key stands first.
            swap = np.where(basket[p] == basket[q], p > q, basket[q])
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            kind = basket[p].astype(int) + basket[q]
            mixed = np.flatnonzero(kind == 1)
            own = [x for x in mixed.tolist() if homes[q[x]] is not None and keys[p[x]] in homes[q[x]]]
            order = np.lexsort((q, p, -np.round(np.abs(corr), 9)))
            order = order[~np.isin(order, own)]
            place = pd.Series(kind[order]).groupby(kind[order]).cumcount().to_numpy() if len(order) else order
            order = order[place < top]
            return p[order], q[order], corr[order], n[order]

        none = np.zeros(0, np.int64)
        found, held, bar = [(none, none, np.zeros(0), none)], 0, floor
        for p, q, corr, n in _tiles(rows, least):
            size = np.abs(corr)
            stocks = not (basket[p].any() or basket[q].any())
            # Under the bar, so many pairs of stocks are stronger already. Rounding is left to the few that come near it.
            u, v = np.nonzero(size >= (bar if stocks else floor) - 1e-8)
            some = np.round(size[u, v], 9) >= (bar if stocks else floor)
            u, v = u[some], v[some]
            found.append((p[u], q[v], corr[u, v], n[u, v].astype(np.int64)))
            held += len(u)
            if held > HELD:
                found = [cut(found)]
                held = 0
                sizes = np.round(np.abs(found[0][2][~(basket[found[0][0]] | basket[found[0][1]])]), 9)
                bar = sizes[top - 1] if len(sizes) >= top else floor
        p, q, corr, n = cut(found)
        kind = np.where(basket[q], "basket-basket", np.where(basket[p], "basket-stock", "stock-stock"))
        return pd.DataFrame({"kind": kind, "a": keys[p], "b": keys[q], "corr": corr, "n": n})

    return run


def strongest_pairs(series: DataFrame, least: int = 30, floor: float = 0.4, top: int = 500, block: int | None = None) -> DataFrame:
    """kind, a, b, corr and n of the pairs with so many common dates and abs(corr) of at least floor, at most top of each kind,
    strongest first: stock-stock and basket-basket (a < b), and basket-stock (a the basket), but for a basket's own stocks.
    series: series_rows() with kind (basket or stock) and home, the baskets of a stock."""
    kind = series.schema["key"].dataType.simpleString()
    dealt = _dealt(series, None, block or max(BLOCK, min(WIDE, -(-series.count() // 8))))
    found = dealt.groupBy("_lo", "_hi").applyInPandas(_strongest(least, floor, top), f"kind string, a {kind}, b {kind}, corr double, n long")
    found = found.repartition("kind", "a")  # the screen runs once: each kind below reads the same exchange
    best = [found.where(F.col("kind") == k).orderBy(F.round(F.abs("corr"), 9).desc(), "a", "b").limit(top) for k in ("stock-stock", "basket-stock", "basket-basket")]
    return best[0].unionByName(best[1]).unionByName(best[2])


def _summary(least: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, p, q, corr, _ = block_correlations(rows, least)
        p, q = np.minimum(p, q), np.maximum(p, q)  # the rows are in the order of their keys; those of two blocks may meet the other way round
        names = rows["key"].tolist()
        out = {"group": [key[0]], "n": [len(corr)], "total": [corr.sum()]}
        for name, sign in (("low", 1), ("high", -1)) if len(corr) else ():
            near = np.round(corr, 9) * sign
            tied = np.flatnonzero(near == near.min())
            at = tied[np.lexsort((q[tied], p[tied]))[0]]
            out |= {f"{name}_corr": [(corr * sign).min() * sign], f"{name}_pair": [f"{names[p[at]]}-{names[q[at]]}"], f"{name}_a": [names[p[at]]], f"{name}_b": [names[q[at]]]}
        return pd.DataFrame(out, columns=["group", "n", "total", *(f"{e}_{c}" for e in ("low", "high") for c in ("corr", "pair", "a", "b"))])

    return run


def group_summary(series: DataFrame, group: str, least: int, block: int | None = None) -> DataFrame:
    """Over the pairs of series of each group: number, mean, lowest and highest correlation, and whose they are (smaller key
    first). Of correlations that are the same to nine places, the pair with the smallest keys is named."""
    kind, of = (series.schema[c].dataType.simpleString() for c in (group, "key"))
    ends = ", ".join(f"{e}_corr double, {e}_pair string, {e}_a {of}, {e}_b {of}" for e in ("low", "high"))
    schema = f"group {kind}, n long, total double, {ends}"
    first = lambda e, sign: F.min_by(f"{e}_pair", F.when(F.col(f"{e}_pair").isNotNull(), F.struct(F.round(F.col(f"{e}_corr"), 9) * sign, f"{e}_a", f"{e}_b")))
    found = _dealt(series, group, block or BLOCK).groupBy(group, "_lo", "_hi").applyInPandas(_summary(least), schema)
    return found.groupBy(F.col("group").alias(group)).agg(
        F.sum("n").alias("n_pairs"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean_corr"), F.min("low_corr").alias("min_corr"), F.max("high_corr").alias("max_corr"),
        first("low", 1).alias("min_pair"), first("high", -1).alias("max_pair"),
    ).where("n_pairs > 0")


def spread_signals(pairs: DataFrame, returns: DataFrame, last: int = 26, recent: int = 13, top: int = 100) -> DataFrame:
    """Of each pair the z of its cumulated return spread over the last dates of the calendar, which side to buy (the laggard) and
    to sell, and the recent spread return; the top of each kind by z. pairs: strongest_pairs(), few, so broadcast. returns: kind
    (basket or stock), key, date, ret. On dates that lack either return the spread stands still."""
    back = F.row_number().over(Window.orderBy(F.col("date").desc()))
    calendar = returns.select("date").distinct().withColumn("back", back)  # one row a date
    leg = lambda side: returns.select(F.col("kind").alias(f"_{side}"), F.col("key").alias(side), "date", F.col("ret").alias(f"r{side}"))
    sides = F.split("kind", "-")
    named = F.broadcast(pairs.select("kind", "a", "b", sides[0].alias("_a"), sides[1].alias("_b")))
    legs = leg("a").join(named, ["_a", "a"]).join(leg("b"), ["_b", "b", "date"]).where("ra IS NOT NULL AND rb IS NOT NULL")
    legs = legs.join(F.broadcast(calendar), "date")
    step = lambda k: F.coalesce(F.sum(F.when(F.col("back") == k, F.col("ra") - F.col("rb"))), F.lit(0.0))
    before = F.coalesce(F.sum(F.when(F.col("back") > last, F.col("ra") - F.col("rb"))), F.lit(0.0))
    # The spread at each of the last dates, oldest first, is what came before and the steps so far.
    sums = legs.groupBy("kind", "a", "b").agg(before.alias("before"), F.array(*(step(k) for k in range(last, 0, -1))).alias("steps"))
    level = F.expr(f"transform(sequence(1, {last}), i -> before + aggregate(slice(steps, 1, i), 0D, (acc, x) -> acc + x))")
    at = sums.withColumn("levels", level).withColumn("mean", F.aggregate("levels", F.lit(0.0), lambda acc, x: acc + x) / last)
    sd = F.sqrt(F.aggregate("levels", F.lit(0.0), lambda acc, x: acc + (x - F.col("mean")) * (x - F.col("mean"))) / (last - 1))
    z = F.try_divide(F.col("levels")[last - 1] - F.col("mean"), sd)
    moved = F.col("levels")[last - 1] - F.col("levels")[last - 1 - recent]
    up: Column = F.col("signed") > 0
    rated = at.withColumns({"sd": sd, "signed": z, "recent": moved}).where("sd > 1e-12").join(F.broadcast(pairs.select("kind", "a", "b", "corr")), ["kind", "a", "b"])
    out = rated.select("kind", "a", "b", F.when(up, F.col("b")).otherwise(F.col("a")).alias("buy"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("sell"), F.abs("signed").alias("z"), "corr", "recent")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.round("z", 9).desc(), "a", "b"))  # few pairs are left
    return out.withColumn("place", place).where(F.col("place") <= top)
