"""Physical balances, concentration and trade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bloc_sums(series: DataFrame, signs: DataFrame, by: list[str], series_col: str = "series", value: str = "value") -> DataFrame:
    """bloc = sum of added less subtracted series; null where one is missing. signs: bloc, series, sign."""
    need = signs.groupBy("bloc").agg(F.count("*").alias("_need"))
    joined = series.join(signs, series_col).groupBy("bloc", *by).agg(F.sum(F.col("sign") * F.col(value)).alias("_v"), F.count(value).alias("_k"))
    return joined.join(need, "bloc").select("bloc", *by, F.when(F.col("_k") == F.col("_need"), F.col("_v")).alias(value))


def status(period: Column, last_supply: Column, last_demand: Column) -> Column:
    """hist, est or fcst, by the last historical periods of both sides."""
    return F.when((period <= last_supply) & (period <= last_demand), "hist").when((period <= last_supply) | (period <= last_demand), "est").otherwise("fcst")


def stock_model(df: DataFrame, by: list[str], observed: str, implied: str) -> DataFrame:
    """OLS of observed on implied: slope, intercept, sigma = sqrt(sse / (n - 2)), n of three at least."""
    known = df.where(F.col(observed).isNotNull() & F.col(implied).isNotNull())
    out = known.groupBy(*by).agg(F.regr_slope(observed, implied).alias("slope"), F.regr_intercept(observed, implied).alias("intercept"), F.regr_syy(observed, implied).alias("syy"), F.regr_sxy(observed, implied).alias("sxy"), F.count("*").alias("n")).where("n >= 3")
    sse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return out.withColumn("sigma", F.sqrt(sse / (F.col("n") - 2))).select(*by, "slope", "intercept", "sigma", "n")


def variance_bridge(df: DataFrame, now: Column, base: Column, sign: Column, by: str = "bloc", value: str = "value") -> DataFrame:
    """Mean of each bloc now and in the base period, and its signed part in the change of the balance."""
    out = df.groupBy(by).agg(F.avg(F.when(now, F.col(value))).alias("now"), F.avg(F.when(base, F.col(value))).alias("base"), F.max(sign).alias("sign"))
    return out.withColumn("delta", (F.col("now") - F.col("base")) * F.col("sign"))


def projection_band(df: DataFrame, by: list[str], order: str, predicted: Column, sigma: Column, days: Column, start: Column) -> DataFrame:
    """level: start plus running predicted * days; band: root of the running sum of (sigma * days)^2."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({"level": start + F.sum(predicted * days).over(w), "band": F.sqrt(F.sum(F.pow(sigma * days, 2)).over(w))})


def concentration(df: DataFrame, by: list[str], value: str = "production") -> DataFrame:
    """Per group: total, HHI in points and top-3 share, over positive holders."""
    w = Window.partitionBy(*by)
    shares = df.where(F.col(value) > 0).withColumn("share", F.col(value) / F.sum(value).over(w))
    ranked = shares.withColumn("_r", F.row_number().over(w.orderBy(F.col(value).desc(), "country")))
    return ranked.groupBy(*by).agg(F.sum(value).alias("total"), F.sum(F.pow(100 * F.col("share"), 2)).alias("hhi"), F.sum(F.when(F.col("_r") <= 3, F.col("share"))).alias("top3"), F.count("*").alias("n"))


def with_outlook(totals: DataFrame, reserves: DataFrame, by: list[str]) -> DataFrame:
    """Adds yoy (total against the year before) and reserve_years (reserves over the total)."""
    before = totals.select(*by, (F.col("year") + 1).alias("year"), F.col("total").alias("_before"))
    out = totals.join(before, [*by, "year"], "left").join(reserves, by, "left")
    return out.withColumns({"yoy": F.col("total") / F.nullif(F.col("_before"), F.lit(0.0)) - 1, "reserve_years": F.col("reserves") / F.nullif(F.col("total"), F.lit(0.0))}).drop("_before")


def with_shares(df: DataFrame, by: list[str], value: str = "production") -> DataFrame:
    """share of the group's total and rank in it."""
    w = Window.partitionBy(*by)
    return df.withColumns({"share": F.col(value) / F.sum(value).over(w), "rank": F.rank().over(w.orderBy(F.col(value).desc()))})


def top_and_other(df: DataFrame, by: list[str], n: int, value: str = "production", name: str = "country") -> DataFrame:
    """The n largest of each group and one row OTH with the rest."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), name)
    place = F.row_number().over(w)
    named = df.withColumn("_r", place).withColumn("holder", F.when(F.col("_r") <= n, F.col(name).cast("string")).otherwise("OTH"))
    return named.groupBy(*by, "holder").agg(F.sum(value).alias(value))


def mirror_trade(flows: DataFrame, least_total: float, least_share: float, keep: int) -> DataFrame:
    """Destination shares of what a country sends of a commodity: self and zero flows dropped, small totals dropped, the
    largest few with a share worth naming kept."""
    real = flows.where((F.col("src") != F.col("dst")) & (F.col("value") > 0))
    w = Window.partitionBy("commodity", "src")
    out = real.withColumn("total", F.sum("value").over(w)).where(F.col("total") >= least_total).withColumn("share", F.col("value") / F.col("total"))
    out = out.withColumn("place", F.row_number().over(w.orderBy(F.col("value").desc(), "dst")))
    return out.where((F.col("place") <= keep) & (F.col("share") >= least_share))


def outage(df: DataFrame, country: Column, percent: float, by: list[str], value: str = "production") -> DataFrame:
    """What the world loses when a country loses so many percent, and by how much the others must grow."""
    sums = df.groupBy(*by).agg(F.sum(value).alias("world"), F.sum(F.when(country, F.col(value))).alias("own"))
    lost = F.coalesce("own", F.lit(0.0)) * percent / 100
    rest = F.col("world") - F.coalesce("own", F.lit(0.0))
    return sums.withColumns({"lost_share": lost / F.col("world"), "uplift": F.when(rest > 0, lost / rest)})


def chokepoints(routes: DataFrame) -> DataFrame:
    """Volume and share of the routes that pass each point (routes: commodity, volume, via)."""
    total = routes.groupBy("commodity").agg(F.sum("volume").alias("total"))
    through = routes.select("commodity", "volume", F.explode(F.array_distinct("via")).alias("point")).groupBy("commodity", "point").agg(F.sum("volume").alias("volume"))
    return through.join(total, "commodity").withColumn("share", F.col("volume") / F.col("total"))


def latest_covered_year(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Newest year with so many countries."""
    return df.groupBy(*by, "year").agg(F.count_distinct("country").alias("n")).where(F.col("n") >= least).groupBy(*by).agg(F.max("year").alias("year"))


def near_curated(points: DataFrame, curated: DataFrame, reach: float) -> DataFrame:
    """Points without a curated point of the same kind within reach (degrees): cells of that size meet their nine neighbours
    only. Both: id, kind, lon, lat."""
    cell = lambda c: F.floor(F.col(c) / reach)
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = curated.select("kind", F.col("lon").alias("clon"), F.col("lat").alias("clat"), F.explode(around).alias("o"), cell("lon").alias("x0"), cell("lat").alias("y0")).select("kind", "clon", "clat", (F.col("x0") + F.col("o.i")).alias("cx"), (F.col("y0") + F.col("o.j")).alias("cy"))
    own = points.withColumns({"cx": cell("lon"), "cy": cell("lat")})
    close = own.join(near, ["kind", "cx", "cy"]).where(F.sqrt(F.pow(F.col("lon") - F.col("clon"), 2) + F.pow(F.col("lat") - F.col("clat"), 2)) <= reach)
    return points.join(close.select("id").distinct(), "id", "left_anti")


def site_dedup(sites: DataFrame, cell: float = 0.1) -> DataFrame:
    """Largest capacity of each cell, kind and commodity; then one row per cell and kind, other commodities collected."""
    at = sites.withColumns({"cx": F.round(F.col("lon") / cell), "cy": F.round(F.col("lat") / cell)})
    best = at.groupBy("cx", "cy", "kind", "commodity").agg(F.max("capacity").alias("capacity"), F.max_by("id", F.struct("capacity", "id")).alias("id"))
    one = best.groupBy("cx", "cy", "kind").agg(F.max_by(F.struct("id", "commodity", "capacity"), F.struct("capacity", "id")).alias("m"), F.collect_set("commodity").alias("every"))
    return one.select("cx", "cy", "kind", "m.*", F.array_sort(F.array_except("every", F.array("m.commodity"))).alias("also"))


def shared_capacity(df: DataFrame, key: list[str], least: int = 3, value: str = "capacity") -> DataFrame:
    """A value that the same key gives so often is a group total: nulled."""
    n = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn(value, F.when(n < least, F.col(value)))


def monthly_balance(wide: DataFrame, supply_hist: Column, demand_hist: Column, period: str = "month") -> DataFrame:
    """Per month end, where supply and demand are known: implied build (supply less demand), build (change of stocks a day
    since the month before, null without it), unexplained (implied less build), prices as given, and status: hist up to the
    last historical demand, est up to the last historical supply, else fcst. wide: month, supply, demand, stocks and
    prices."""
    known = wide.where(F.col("supply").isNotNull() & F.col("demand").isNotNull())
    before = wide.select(F.last_day(F.add_months(period, 1)).alias(period), F.col("stocks").alias("_before"))
    out = known.join(before, period, "left")
    build = (F.col("stocks") - F.col("_before")) / F.dayofmonth(F.last_day(period))
    out = out.withColumns({"implied": F.col("supply") - F.col("demand"), "build": build})
    kind = F.when(F.col(period) <= demand_hist, "hist").when(F.col(period) <= supply_hist, "est").otherwise("fcst")
    return out.withColumns({"unexplained": F.col("implied") - F.col("build"), "status": kind}).drop("_before")


def weekly_bridge(raw: DataFrame, date: str = "date") -> DataFrame:
    """Per week with all flows and stocks exactly seven days before: flows in thousands, modelled build (production +
    imports - exports - refinery inputs), build of all, of commercial and of strategic stocks a day, and adjustment: what the
    model lacks. raw: production, imports, exports, refinery_inputs, stocks_total, stocks_comm, stocks_spr."""
    flows, stocks = ("production", "imports", "exports", "refinery_inputs"), ("stocks_total", "stocks_comm", "stocks_spr")
    before = raw.select(F.date_add(date, 7).alias(date), *(F.col(c).alias(f"_{c}") for c in stocks))
    both = raw.dropna(subset=["stocks_total", *flows]).join(before, date).where(F.col("_stocks_total").isNotNull())
    out = both.withColumns({c: F.col(c) / 1000 for c in flows} | {f"build_{c[7:]}": (F.col(c) - F.col(f"_{c}")) / 7000 for c in stocks})
    modelled = F.col("production") + F.col("imports") - F.col("exports") - F.col("refinery_inputs")
    out = out.withColumns({"modelled_build": modelled, "build": F.col("build_total"), "stocks_comm": F.col("stocks_comm") / 1000})
    return out.withColumn("adjustment", F.col("build") - F.col("modelled_build")).select(date, *flows, "modelled_build", "build", "adjustment", "build_comm", "build_spr", "stocks_comm")


def world_table(production: DataFrame, refining: DataFrame, reserves: DataFrame, by: list[str], holder: str = "country") -> DataFrame:
    """Per group and holder of any: production, refining and reserves, each with its share of the world, and the years that
    reserves last at today's production. Inputs: by, holder and a column of their name."""
    out = production.join(refining, [*by, holder], "full_outer").join(reserves, [*by, holder], "full_outer")
    world = Window.partitionBy(*by)
    names = ("production", "refining", "reserves")
    out = out.withColumns({f"{n}_share": F.col(n) / F.nullif(F.sum(n).over(world), F.lit(0.0)) for n in names})
    return out.withColumn("reserve_years", F.col("reserves") / F.nullif(F.col("production"), F.lit(0.0)))


def country_metric(shares: DataFrame, by: list[str], holder: str = "country", top: int = 10) -> DataFrame:
    """Of the stages (column stage) of each holder the largest share, and the top holders by it. shares: by, holder, stage,
    share."""
    best = shares.groupBy(*by, holder).agg(F.max("share").alias("share"), F.max_by("stage", F.struct("share", "stage")).alias("stage"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("share").desc(), holder)))
    return placed.where(F.col("place") <= top)
