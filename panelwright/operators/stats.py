"""Information coefficients, HAC statistics and regressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import windows as win
from panelwright.functions.scalars import finite
from panelwright.sources.scratch import stored

from . import cross_section


#: Names on a date beyond which its ranks are numbered over ranges of values, not in one task.
HUGE_DATE = 1_000_000


def daily_ic(signal: DataFrame, forward: DataFrame, min_names: int = 20, key: str = "ticker", date: str = "date", huge: int = HUGE_DATE) -> DataFrame:
    """Spearman correlation of signal (value) and forward return (fwd) on each date and horizon."""
    joined = signal.select(key, date, "value").join(forward.select(key, date, "horizon", "fwd"), [key, date]).where(F.col("value").isNotNull() & F.col("fwd").isNotNull())
    by = [date, "horizon"]
    joined = stored(joined, "daily-ic")
    if cross_section.largest(joined, by) > huge:
        ranked = cross_section.average_rank(joined, by, "value", key, "a")
        ranked = cross_section.average_rank(ranked, by, "fwd", key, "b")
    else:
        ranked = joined.select(*by, win.average_rank(F.col("value"), *by).alias("a"), win.average_rank(F.col("fwd"), *by).alias("b"))
    out = ranked.groupBy(*by).agg(F.corr("a", "b").alias("ic"), F.count("*").alias("n_names"))
    return out.where((F.col("n_names") >= min_names) & F.col("ic").isNotNull() & ~F.isnan("ic"))


def newey_west(df: DataFrame, by: list[str], order: str, value: str, lags: Column | int, most: int) -> DataFrame:
    """t of the mean with Bartlett weights: by, n, mean, nw_t. most: the largest lag that may be asked for."""
    group = Window.partitionBy(*by)
    w = group.orderBy(order)
    x = df.select(*by, order, F.col(value).alias("_x"), (lags if isinstance(lags, Column) else F.lit(lags)).alias("_l")).withColumn("_n", F.count("_x").over(group)).withColumn("_d", F.col("_x") - F.avg("_x").over(group))
    used = F.least("_l", F.col("_n") - 1)
    products = [F.sum(F.when(F.lit(k) <= used, 2 * (1 - F.lit(k) / (used + 1)) * F.col("_d") * F.col(f"_p{k}"))).alias(f"g{k}") for k in range(1, most + 1)]
    x = x.withColumns({f"_p{k}": F.lag("_d", k).over(w) for k in range(1, most + 1)})
    sums = x.groupBy(*by).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.sum(F.col("_d") * F.col("_d")).alias("g0"), *products)
    gamma0 = F.col("g0") / F.col("n")
    var = gamma0 + sum((F.coalesce(F.col(f"g{k}"), F.lit(0.0)) for k in range(1, most + 1)), F.lit(0.0)) / F.col("n")
    var = F.when(var <= 0, gamma0).otherwise(var)
    return sums.select(*by, "n", "mean", F.when((F.col("n") < 2) | (var <= 0), 0.0).otherwise(F.col("mean") / F.sqrt(var / F.col("n"))).alias("nw_t"))


def ic_summary(ics: DataFrame, most_lag: int, by: str = "horizon", date: str = "date") -> DataFrame:
    """Per horizon: mean, sd, t, hit rate, breadth and Newey-West t with the horizon as lag."""
    basic = ics.groupBy(by).agg(F.stddev_samp("ic").alias("sd_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"), F.avg("n_names").alias("breadth"))
    nw = newey_west(ics, [by], date, "ic", F.col(by), most_lag)
    return nw.join(basic, by).select(by, F.col("n").alias("n_dates"), F.col("mean").alias("mean_ic"), "sd_ic", F.when(F.col("sd_ic") > 0, F.col("mean") / F.col("sd_ic") * F.sqrt("n")).otherwise(0.0).alias("t_stat"), "nw_t", "hit_rate", "breadth")


def ols_hac(wide: DataFrame, by: list[str], order: str, y: str, xs: list[str], lags: int = 4, least: int = 80) -> DataFrame:
    """OLS with a constant per entity, HAC t-values, r2, adjusted r2, variance shares and n_drivers. Of each entity, drivers
    that half of its rows lack are left out first; then rows that lack any other; then drivers that don't vary over what is
    left. A driver left out has beta and t 0. Values that aren't finite are missing. Spark sums the moments and the lagged
    score products; only a k x k solve for each entity runs in Python."""
    names = ["const", *xs]
    k = len(names)
    clean = wide.select(*by, order, finite(F.col(y).cast("double")).alias("_y"), *(finite(F.col(x).cast("double")).alias(f"_x{i}") for i, x in enumerate(xs)))
    clean = stored(clean, "ols-rows")  # it is read for the dense test, the variances, the moments and the scores
    dense = clean.groupBy(*by).agg(*((F.avg(F.col(f"_x{i}").isNotNull().cast("double")) >= 0.5).alias(f"_in{i}") for i in range(k - 1)))
    present = clean.join(dense, by).select(*by, order, "_y", *(F.when(F.col(f"_in{i}"), F.col(f"_x{i}")).otherwise(0.0).alias(f"_x{i}") for i in range(k - 1))).dropna()
    varied = present.groupBy(*by).agg(*((F.stddev_samp(f"_x{i}") > 1e-9).alias(f"_in{i}") for i in range(k - 1)))
    used = [F.when(F.col(f"_in{i}"), F.col(f"_x{i}")).otherwise(0.0) for i in range(k - 1)]
    drivers = sum((F.col(f"_in{i}").cast("int") for i in range(k - 1)), F.lit(0))
    rows = present.join(varied, by).select(*by, order, "_y", F.array(F.lit(1.0), *used).alias("_x"), drivers.alias("n_drivers")).where("n_drivers > 0")
    outer = [F.sum(F.col("_x")[i] * F.col("_x")[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
    inner = [F.sum(F.col("_x")[i] * F.col("_y")).alias(f"v{i}") for i in range(k)]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n_obs"), F.max("n_drivers").alias("n_drivers"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), *outer, *inner).where(F.col("n_obs") >= least)

    def gram(p: pd.DataFrame) -> np.ndarray:
        g = np.empty((len(p), k, k))
        for i in range(k):
            for j in range(i, k):
                g[:, i, j] = g[:, j, i] = p[f"m{i}_{j}"]
        return g

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                inverse = np.linalg.pinv(gram(p))
                beta = np.einsum("nij,nj->ni", inverse, p[[f"v{i}" for i in range(k)]].to_numpy())
                yield p[[*by, "n_obs", "n_drivers"]].assign(beta=list(beta), inverse=[list(m) for m in inverse])

    key = ", ".join(f"{c} {wide.schema[c].dataType.simpleString()}" for c in by)
    solved = sums.mapInPandas(solve, f"{key}, n_obs long, n_drivers int, beta array<double>, inverse array<array<double>>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    # A coefficient is a weighted sum of y, with weights from the inverse; its variance is that of these weights' scores.
    scored = rows.drop("n_drivers").join(solved, by).withColumn("_e", F.col("_y") - dot(F.col("_x"), F.col("beta")))
    scored = scored.withColumn("_s", F.transform("inverse", lambda row: dot(row, F.col("_x")) * F.col("_e")))
    w = Window.partitionBy(*by).orderBy(order)
    scored = scored.withColumns({f"_s{m}": F.lag("_s", m).over(w) for m in range(1, lags + 1)})

    def variance(j: int) -> Column:
        own = F.sum(F.col("_s")[j] * F.col("_s")[j])
        return own + sum((2 * (1 - m / (lags + 1)) * F.coalesce(F.sum(F.col("_s")[j] * F.col(f"_s{m}")[j]), F.lit(0.0)) for m in range(1, lags + 1)), F.lit(0.0))

    out = scored.groupBy(*by).agg(
        F.max("n_obs").alias("n_obs"), F.max("n_drivers").alias("n_drivers"), F.first("beta").alias("beta"), F.sum(F.col("_e") * F.col("_e")).alias("sse"), F.var_pop("_y").alias("var_y"),
        F.array(*(variance(j) for j in range(k))).alias("var"), F.array(F.lit(0.0), *(F.var_samp(F.col("_x")[i]) for i in range(1, k))).alias("vx"),
    )
    sst = F.col("var_y") * F.col("n_obs")
    r2 = F.when(sst > 0, 1 - F.col("sse") / sst).otherwise(0.0)
    share = lambda i: F.when(F.col("var_y") > 0, F.col("beta")[i] * F.col("beta")[i] * F.col("vx")[i] / F.col("var_y")).otherwise(0.0)
    columns = {"r2": r2, "r2_adj": 1 - (1 - r2) * (F.col("n_obs") - 1) / F.greatest(F.col("n_obs") - 1 - F.col("n_drivers"), F.lit(1))}
    for i, name in enumerate(names):
        columns |= {f"beta_{name}": F.col("beta")[i], f"t_{name}": F.when(F.col("var")[i] > 0, F.col("beta")[i] / F.sqrt(F.col("var")[i])).otherwise(0.0)}
        columns |= {f"varshare_{name}": share(i)} if i else {}
    best = F.array_max(F.array(*(F.struct(share(i).alias("share"), F.lit(-i).alias("place"), F.lit(names[i]).alias("name")) for i in range(1, k))))
    return out.withColumns(columns | {"dominant": best["name"]}).drop("beta", "sse", "var_y", "var", "vx")


#: Series of a side of a block of correlations.
BLOCK = 256


def _block_correlations(least: int):  # noqa: ANN202
    """Correlations of all series of one side of a block with all of the other, by matrix products of their moments."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = rows["_lo"].iloc[0], rows["_hi"].iloc[0]
        names, at = np.unique(rows["a"].to_numpy(), return_inverse=True)
        _, day = np.unique(rows["_t"].to_numpy(), return_inverse=True)
        x, has = np.zeros((2, day.max() + 1, len(names)))
        x[day, at], has[day, at] = rows["x"].to_numpy(), 1.0
        side = np.zeros(len(names), np.int64)
        side[at] = rows["_i"].to_numpy()
        # Around each series' own mean, so that sums of squares don't cancel.
        x -= has * (x.sum(0) / np.maximum(has.sum(0), 1))
        i, j = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        of = lambda p, q: p[:, i].T @ q[:, j]
        n, sx, sy = of(has, has), of(x, has), of(has, x)
        with np.errstate(all="ignore"):
            corr = (of(x, x) - sx * sy / n) / np.sqrt((of(x * x, has) - sx * sx / n) * (of(has, x * x) - sy * sy / n))
        ok = (n >= least) & np.isfinite(corr)
        if lo == hi:
            ok &= np.arange(len(i))[:, None] < np.arange(len(j))
        p, q = np.nonzero(ok)
        a, b = names[i[p]], names[j[q]]
        first = np.array(a < b, bool)
        return pd.DataFrame({"a": np.where(first, a, b), "b": np.where(first, b, a), "corr": corr[p, q], "n": n[p, q].astype(np.int64)})

    return run


def all_correlations(df: DataFrame, key: str, date: str, value: str, least: int, block: int | None = None) -> DataFrame:
    """a < b, corr, n for all pairs of series with so many common dates. Series are hashed to blocks, and each two blocks are
    a task that holds their values only; a value travels once for each block, not for each partner."""
    x = df.where(F.col(value).isNotNull()).select(F.col(key).alias("a"), F.col(date).cast("timestamp").alias("_t"), F.col(value).cast("double").alias("x"))
    blocks = -(-x.select("a").distinct().count() // (block or BLOCK)) or 1
    mine = F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int")
    met = x.withColumn("_i", mine).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    paired = met.select("a", "_t", "x", "_i", F.least("_i", "_j").alias("_lo"), F.greatest("_i", "_j").alias("_hi"))
    kind = df.schema[key].dataType.simpleString()
    return paired.groupBy("_lo", "_hi").applyInPandas(_block_correlations(least), f"a {kind}, b {kind}, corr double, n long")
