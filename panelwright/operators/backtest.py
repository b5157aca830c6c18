"""Walk-forward long/short evaluation, all periods in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import windows as win

from panelwright.sources.scratch import stored

from .pit import asof_back
from .stats import newey_west


def rebalances(calendar: DataFrame, every: int) -> DataFrame:
    """period, signal_date, entry, exit: every nth date, entered a date later, left a date after the next rebalance."""
    w = Window.orderBy("date")  # distinct dates
    days = calendar.select("date").distinct().withColumn("_i", F.row_number().over(w)).withColumn("entry", F.lead("date").over(w))
    rebs = days.where(F.pmod(F.col("_i") - 1, F.lit(every)) == 0)
    return rebs.select(F.floor((F.col("_i") - 1) / every).cast("int").alias("period"), F.col("date").alias("signal_date"), "entry", F.lead("entry").over(w).alias("exit")).where("entry IS NOT NULL AND exit IS NOT NULL")


def ranked_periods(signals: DataFrame, prices: DataFrame, periods: DataFrame, quantiles: int, min_names: int, max_stale_days: int, max_abs_return: float) -> DataFrame:
    """One row per period and name with its return and quantile, in periods broad enough; and how many were dropped."""
    # periods: at most a row for each trading date
    base = signals.where(F.col("value").isNotNull()).select("ticker", F.col("date").alias("signal_date"), "value").join(F.broadcast(periods), "signal_date")
    size = F.count("*").over(Window.partitionBy("period"))
    base = base.withColumn("n_cross", size).where(F.col("n_cross") >= min_names)
    entry = asof_back(base.withColumn("date", F.col("entry")), prices, "ticker", "date", "close", max_stale_days).withColumnRenamed("close", "p0").drop("found_date", "date")
    both = asof_back(entry.withColumn("date", F.col("exit")), prices, "ticker", "date", "close", max_stale_days).withColumnRenamed("close", "p1").drop("found_date", "date")
    priced = both.where("p0 IS NOT NULL AND p1 IS NOT NULL").withColumn("ret", F.col("p1") / F.col("p0") - 1)
    priced = priced.withColumn("n_priced", size).where(F.abs("ret") <= max_abs_return)
    kept = priced.withColumn("n_ranked", size).where(F.col("n_ranked") >= min_names)
    return kept.withColumn("q", win.quantile_bucket(F.col("value"), quantiles, "period"))


def walk_forward(signals: DataFrame, prices: DataFrame, every: int = 1, quantiles: int = 3, min_names: int = 20, min_book: int = 5, max_stale_days: int = 70, max_abs_return: float = 3.0, cost_bps: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """period returns and books. Turnover is measured against the books of the last period that traded: which periods
    trade doesn't depend on turnover, so they are numbered first and each book is anti-joined with the one before."""
    periods = rebalances(prices, every)
    ranked = stored(ranked_periods(signals, prices, periods, quantiles, min_names, max_stale_days, max_abs_return), "walk-ranked")
    legs = ranked.groupBy("period", "signal_date").agg(
        F.avg(F.when(F.col("q") == quantiles - 1, F.col("ret"))).alias("long_ret"), F.avg(F.when(F.col("q") == 0, F.col("ret"))).alias("short_ret"),
        F.count(F.when(F.col("q") == quantiles - 1, 1)).alias("n_long"), F.count(F.when(F.col("q") == 0, 1)).alias("n_short"), F.count("*").alias("n_ranked"),
    )
    traded = legs.where((F.col("n_long") >= min_book) & (F.col("n_short") >= min_book)).withColumn("k", F.row_number().over(Window.orderBy("period")))  # one row a period
    leg = F.when(F.col("q") == quantiles - 1, "long").when(F.col("q") == 0, "short")
    books = ranked.withColumn("leg", leg).where("leg IS NOT NULL").join(F.broadcast(traded.select("period", "k")), "period").select("k", "leg", "ticker")
    fresh = books.join(books.withColumn("k", F.col("k") + 1), ["k", "leg", "ticker"], "left_anti").groupBy("k").agg(F.count(F.when(F.col("leg") == "long", 1)).alias("new_long"), F.count(F.when(F.col("leg") == "short", 1)).alias("new_short"))
    out = traded.join(fresh, "k", "left").withColumn("turnover", (F.coalesce("new_long", F.lit(0)) / F.col("n_long") + F.coalesce("new_short", F.lit(0)) / F.col("n_short")) / 2)
    out = out.withColumns({"ls_gross": F.col("long_ret") - F.col("short_ret"), "cost": F.col("turnover") * 2 * cost_bps / 1e4}).withColumn("ls_net", F.col("ls_gross") - F.col("cost"))
    return out.select("k", "period", F.col("signal_date").alias("date"), "long_ret", "short_ret", "ls_gross", "turnover", "cost", "ls_net", "n_long", "n_short", "n_ranked"), ranked.join(F.broadcast(traded.select("period")), "period", "left_semi")


def quantile_means(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy((F.col("q") + 1).alias("quantile")).agg(F.avg("ret").alias("mean_period_ret"), F.count("*").alias("n_obs"))


def summary(periods: DataFrame, per_year: float) -> DataFrame:
    """One row of annualised figures."""
    w = Window.orderBy("k")  # one row a period
    level = periods.withColumn("cum", win.running_product(1 + F.col("ls_net"), w))
    dd = level.withColumn("dd", win.drawdown(F.col("cum"), w)).agg(F.min("dd").alias("max_drawdown"))
    sharpe = lambda c: F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c) * per_year**0.5).otherwise(0.0)
    main = periods.agg(
        F.count("*").alias("n_periods"), (F.avg("ls_net") * per_year).alias("ann_ret_net"), (F.avg("ls_gross") * per_year).alias("ann_ret_gross"), (F.stddev_samp("ls_net") * per_year**0.5).alias("ann_vol"),
        sharpe("ls_net").alias("sharpe_net"), sharpe("ls_gross").alias("sharpe_gross"), F.avg("turnover").alias("avg_turnover"), F.avg("cost").alias("avg_cost"),
        F.percentile("n_long", F.lit(0.5)).alias("median_n_long"), F.percentile("n_short", F.lit(0.5)).alias("median_n_short"), F.min("n_long").alias("min_n_long"), F.min("n_short").alias("min_n_short"),
    )
    nw = newey_west(periods.withColumn("one", F.lit(1)), ["one"], "k", "ls_net", 1, 1).select(F.col("nw_t").alias("nw_t_net"))
    always = F.lit(True)
    return main.join(F.broadcast(dd), always, "left").join(F.broadcast(nw), always, "left")  # one row each at most


def subsamples(periods: DataFrame, col: str = "ls_gross", per_year: float = 12.0, embargo: int = 1) -> DataFrame:
    """The full sample, thirds and halves, with embargoed rows cut at inner edges: start, end, n, mean, sharpe, hit_rate. On
    every row also worst_sharpe, the least of the windows (but the full one) with three rows, and stable: whether all these
    have a mean of the full sample's sign. A window that the embargo leaves empty has n = 0, mean 0 and no dates."""
    numbered = periods.select("date", F.col(col).alias("x"), (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))  # a row a period
    cuts = [("full", 1, 1), *((f"third {i}/3", i, 3) for i in (1, 2, 3)), *((f"half {i}/2", i, 2) for i in (1, 2))]
    table = numbered.sparkSession.createDataFrame(cuts, "window string, part int, parts int")
    table = table.join(F.broadcast(numbered.agg(F.count("*").alias("total"))))  # one row
    low = F.bround((F.col("part") - 1) * F.col("total") / F.col("parts")) + F.when(F.col("part") > 1, embargo).otherwise(0)
    high = F.bround(F.col("part") * F.col("total") / F.col("parts")) - F.when(F.col("part") < F.col("parts"), embargo).otherwise(0)
    inside = F.broadcast(table.select("window", low.alias("low"), high.alias("high"))).join(numbered, (F.col("i") >= F.col("low")) & (F.col("i") < F.col("high")), "left")
    sd = F.stddev_samp("x")
    out = inside.groupBy("window").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("x").alias("n"), F.coalesce(F.avg("x"), F.lit(0.0)).alias("mean"),
        F.when(sd > 0, F.avg("x") / sd * per_year**0.5).otherwise(0.0).alias("sharpe"), F.coalesce(F.avg((F.col("x") > 0).cast("double")), F.lit(0.0)).alias("hit_rate"),
    )
    every = Window.partitionBy()  # six rows
    usable = (F.col("window") != "full") & (F.col("n") >= 3)
    sign = F.max(F.when(F.col("window") == "full", F.signum("mean"))).over(every)
    agree = F.min(F.when(usable, (F.signum("mean") == sign).cast("int"))).over(every)
    return out.withColumns({"worst_sharpe": F.coalesce(F.min(F.when(usable, F.col("sharpe"))).over(every), F.lit(0.0)), "stable": F.coalesce(agree == 1, F.lit(False)) & (sign != 0)})
