"""Basket and driver analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import windows as win
from panelwright.functions.scalars import clip, finite


def basket_mean(returns: DataFrame, least: int = 2) -> DataFrame:
    """Equal-weight mean return of each basket and date (returns: ticker, basket, date, ret)."""
    names = returns.groupBy("basket").agg(F.count_distinct("ticker").alias("n_names")).where(F.col("n_names") >= least)
    return returns.join(names, "basket").groupBy("basket", "date").agg(F.avg("ret").alias("ret"), F.count("ret").alias("n"))


def winsorised_basket_mean(returns: DataFrame, sigmas: float = 3.0, least: int = 100) -> DataFrame:
    """Names clipped at so many sample sigmas over their history first; baskets need so many observations."""
    w = Window.partitionBy("ticker")
    mu, sd = F.avg("ret").over(w), F.stddev_samp("ret").over(w)
    clipped = returns.withColumn("ret", F.when(sd > 0, clip(F.col("ret"), mu - sigmas * sd, mu + sigmas * sd)).otherwise(F.col("ret")))
    out = clipped.groupBy("basket", "date").agg(F.avg("ret").alias("ret"))
    enough = out.where("ret IS NOT NULL").groupBy("basket").agg(F.count("*").alias("n_obs")).where(F.col("n_obs") >= least)
    return out.join(enough, "basket")


def leave_one_out(returns: DataFrame) -> DataFrame:
    """Adds loo: the basket's mean without the name, from one sum and count."""
    w = Window.partitionBy("basket", "date")
    n = F.count("ret").over(w) - F.col("ret").isNotNull().cast("int")
    return returns.withColumn("loo", F.when(n > 0, (F.sum("ret").over(w) - F.coalesce("ret", F.lit(0.0))) / n))


def home_correlations(returns: DataFrame, least: int) -> DataFrame:
    """Of each name: correlation with its own basket without it and with every other basket; rank 1 is the highest."""
    own = leave_one_out(returns).groupBy("ticker", "basket").agg(F.corr("ret", "loo").alias("corr"), F.count(F.when(F.col("ret").isNotNull() & F.col("loo").isNotNull(), 1)).alias("n")).withColumn("other", F.col("basket"))
    means = returns.groupBy(F.col("basket").alias("other"), "date").agg(F.avg("ret").alias("mean"))
    cross = returns.join(means, "date").where("other <> basket").groupBy("ticker", "basket", "other").agg(F.corr("ret", "mean").alias("corr"), F.count(F.when(F.col("ret").isNotNull() & F.col("mean").isNotNull(), 1)).alias("n"))
    both = own.unionByName(cross).where((F.col("n") >= least) & F.col("corr").isNotNull())
    return both.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("corr").desc(), "other")))


def top_baskets(home: DataFrame) -> DataFrame:
    """home_corr, the best three baskets, whether home is the best, and by how much it isn't."""
    out = home.groupBy("ticker", "basket").agg(
        F.max(F.when(F.col("other") == F.col("basket"), F.col("corr"))).alias("home_corr"),
        *(F.max(F.when(F.col("place") == k, F.col(c))).alias(f"top{k}_{n}") for k in (1, 2, 3) for c, n in (("other", "basket"), ("corr", "corr"))),
    )
    return out.withColumns({"is_home_top": F.col("top1_basket") == F.col("basket"), "delta": F.col("top1_corr") - F.col("home_corr")})


def single_factor(returns: DataFrame, least: int, long: int = 60, short: int = 20) -> tuple[DataFrame, DataFrame]:
    """Each name on its leave-one-out basket: fit (alpha, beta, r2, n) and last-rows residual z."""
    both = leave_one_out(returns).where("ret IS NOT NULL AND loo IS NOT NULL")
    fit = both.groupBy("ticker").agg(F.regr_slope("ret", "loo").alias("beta"), F.regr_intercept("ret", "loo").alias("alpha"), F.regr_r2("ret", "loo").alias("r2"), F.count("*").alias("n_obs")).where(F.col("n_obs") >= least)
    res = both.join(fit, "ticker").withColumn("res", F.col("ret") - F.col("alpha") - F.col("beta") * F.col("loo")).withColumn("back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc())))
    z = lambda k: (F.sum(F.when(F.col("back") <= k, F.col("res"))) / (F.stddev_samp("res") * k**0.5)).alias(f"z_{k}")
    return fit, res.groupBy("ticker").agg(z(long), z(short))


def regimes(betas: DataFrame, key: list[str], least: int, limit: float = 2.0) -> DataFrame:
    """The current rolling beta against its own history."""
    known = betas.where("beta IS NOT NULL").groupBy(*key).agg(F.max_by("beta", "date").alias("current"), F.avg("beta").alias("mean"), F.stddev_samp("beta").alias("sd"), F.count("*").alias("n")).where(F.col("n") >= least)
    z = F.when(F.col("sd") > 0, (F.col("current") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return known.withColumn("z", z).withColumn("flag", F.abs("z") > limit)


def driver_betas(returns: DataFrame, drivers: DataFrame, n: int, more: int = 30) -> DataFrame:
    """entity, symbol, date, beta: the rolling beta over n common dates of each entity on each driver, for pairs with at least
    more common dates than that. returns: entity, date, ret; drivers: symbol, date, change."""
    both = returns.where("ret IS NOT NULL").join(drivers.where("change IS NOT NULL").select("symbol", "date", "change"), "date")
    pair = Window.partitionBy("entity", "symbol")
    both = both.withColumn("_n", F.count("*").over(pair)).where(F.col("_n") >= n + more)
    return both.select("entity", "symbol", "date", win.rolling_beta(F.col("ret"), F.col("change"), pair.orderBy("date"), n).alias("beta"))


def regime_alerts(betas: DataFrame, key: str, least: int = 100, limit: float = 2.0) -> DataFrame:
    """The pairs of key and symbol whose current beta is over so many deviations off its history, with direction, and place: of a
    key's alerts the strongest is 1."""
    found = regimes(betas, [key, "symbol"], least, limit).where("flag AND sd > 0").drop("flag")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.abs(F.round("z", 9)).desc(), "symbol"))
    return found.withColumns({"direction": F.when(F.col("z") > 0, "increased").otherwise("decreased"), "place": place})


def diagnostics(constituents: DataFrame, returns: DataFrame, least: int = 100, sigmas: float = 3.0) -> DataFrame:
    """A row for each basket (constituents: ticker, basket): its names, how many have returns (returns: ticker, date, ret), on how
    many dates its mean of winsorised returns is known (0 for baskets of under two such names), and what that allows."""
    clean = returns.select("ticker", "date", finite(F.col("ret")).alias("ret"))
    priced = constituents.join(returns.select("ticker").distinct().withColumn("_priced", F.lit(1)), "ticker", "left")
    sizes = priced.groupBy("basket").agg(F.count("*").alias("n_names"), F.count("_priced").alias("n_priced"))
    dates = winsorised_basket_mean(clean.join(constituents, "ticker"), sigmas, 1).where("ret IS NOT NULL").groupBy("basket").agg(F.count("*").alias("_n"))
    alone = F.col("n_priced") < 2
    out = sizes.join(dates, "basket", "left").withColumn("n_obs", F.when(alone, 0).otherwise(F.coalesce("_n", F.lit(0))).cast("long"))
    return out.drop("_n").withColumn("note", F.when(alone, "singleton or no prices").when(F.col("n_obs") < least, "too few clean obs").otherwise("ok"))


def pair_spreads(returns: DataFrame, pairs: DataFrame, n: int, corr_n: int) -> DataFrame:
    """Cumulated return spread of each pair (a, b) on common dates, its rolling z and the rolling correlation."""
    a = returns.select(F.col("ticker").alias("a"), "date", F.col("ret").alias("ra"))
    b = returns.select(F.col("ticker").alias("b"), "date", F.col("ret").alias("rb"))
    legs = pairs.join(a, "a").join(b, ["b", "date"]).where("ra IS NOT NULL AND rb IS NOT NULL")
    w = win.series(["a", "b"])
    out = legs.withColumn("spread", F.col("ra") - F.col("rb")).withColumn("cum", F.sum("spread").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumns({"z": win.rolling_z(F.col("cum"), w, n), "corr": win.rolling_corr(F.col("ra"), F.col("rb"), w, corr_n)})


def pair_stats(spreads: DataFrame, per_year: float) -> DataFrame:
    """Per pair, from monthly spreads: sums over one and three months, latest z and correlation, its range, vol and Sharpe."""
    back = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.col("date").desc()))
    recent = lambda n: F.sum(F.when(F.col("_back") <= n, F.col("spread")))
    return spreads.withColumn("_back", back).groupBy("a", "b").agg(
        recent(1).alias("ret_1m"), recent(3).alias("ret_3m"), F.max_by("z", "date").alias("z_now"), F.max_by("corr", "date").alias("corr_now"), F.min("corr").alias("corr_min"), F.max("corr").alias("corr_max"),
        (F.stddev_samp("spread") * per_year**0.5).alias("ann_vol"), F.when(F.stddev_samp("spread") > 0, F.avg("spread") / F.stddev_samp("spread") * per_year**0.5).alias("sharpe"), F.count("*").alias("n"),
    )


#: Windows of an attribution: the last so many rows of a series; ytd: those of its last year.
SPANS = {"1m": 4, "3m": 13, "ytd": None, "1y": 52}


def windowed(returns: DataFrame, spans: dict[str, int | None], by: str = "entity", date: str = "date") -> DataFrame:
    """Each row once for each window that it belongs to (column window). A series shorter than a window is all in it."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.col(date).desc()))
    last = F.max(date).over(Window.partitionBy(by))
    inside = [F.when(F.year(date) == F.year("_last") if n is None else F.col("_back") <= n, F.lit(name)) for name, n in spans.items()]
    marked = returns.where("ret IS NOT NULL").withColumns({"_back": back, "_last": last})
    return marked.withColumn("window", F.explode(F.array_compact(F.array(*inside)))).drop("_back", "_last")


def contributions(returns: DataFrame, drivers: DataFrame, betas: DataFrame, spans: dict[str, int | None] = SPANS) -> DataFrame:
    """entity, window, symbol, contribution: beta times the driver's changes summed over the window's dates.
    returns: entity, date, ret; drivers: symbol, date, change; betas: entity, symbol, beta (missing ones count as 0)."""
    dates = windowed(returns, spans).select("entity", "window", "date")
    moved = dates.join(drivers, "date").groupBy("entity", "window", "symbol").agg(F.sum("change").alias("moved"))
    known = betas.select("entity", "symbol", F.coalesce(F.when(~F.isnan("beta"), F.col("beta")), F.lit(0.0)).alias("beta"))
    return known.join(moved, ["entity", "symbol"]).select("entity", "window", "symbol", (F.col("beta") * F.coalesce("moved", F.lit(0.0))).alias("contribution"))


def attribution(returns: DataFrame, parts: DataFrame, spans: dict[str, int | None] = SPANS) -> DataFrame:
    """Per entity and window: actual return, factor (all contributions together), top driver, idiosyncratic part and its
    share. parts: contributions()."""
    actual = windowed(returns, spans).groupBy("entity", "window").agg(F.sum("ret").alias("actual"), F.count("*").alias("n"))
    factor = parts.groupBy("entity", "window").agg(F.sum("contribution").alias("factor"), F.max_by("symbol", F.struct(F.abs("contribution"), "symbol")).alias("top_driver"))
    out = actual.join(factor, ["entity", "window"], "left").withColumn("factor", F.coalesce("factor", F.lit(0.0)))
    out = out.withColumn("idio", F.col("actual") - F.col("factor"))
    return out.withColumn("idio_share", F.when(F.abs("actual") > 1e-6, F.col("idio") / F.col("actual")))


def graph_momentum(trailing: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean trailing return of a basket's suppliers (up) and customers (down), its own left out; null without edges.
    trailing: basket, date, ret; edges: src feeds dst."""
    known = trailing.where("ret IS NOT NULL")
    links = edges.where("src <> dst").distinct()
    up = known.join(links, known.basket == F.col("src")).select(F.col("dst").alias("basket"), "date", F.lit("up").alias("side"), "ret")
    down = known.join(links, known.basket == F.col("dst")).select(F.col("src").alias("basket"), "date", F.lit("down").alias("side"), "ret")
    sides = up.unionByName(down).groupBy("basket", "date").pivot("side", ["up", "down"]).agg(F.avg("ret"))
    return trailing.select("basket", "date", F.col("ret").alias("own")).join(sides, ["basket", "date"], "left")


def dispersion(parts: DataFrame) -> DataFrame:
    """abs idio / (abs factor + abs idio)."""
    total = F.abs("factor") + F.abs("idio")
    return parts.withColumn("dispersion", F.when(total > 0, F.abs("idio") / total))
