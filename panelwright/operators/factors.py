"""Fundamental factors and the peer-neutral composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import windows as win
from panelwright.functions.scalars import count_of, effective_tax_rate, mean_of, weighted_mean


#: Days that an annual period may last.
ANNUAL_DAYS = (350, 380)


def value_factors(annual: DataFrame, close: str = "close") -> DataFrame:
    """mcap, ev, ebitda, fcf, fcf_yield, ev_ebitda. Missing debt and cash count as 0 in EV, nothing else does."""
    c = F.col
    mcap = F.when((c(close) > 0) & (c("shares") > 0), c(close) * c("shares"))
    ebitda = c("net_income") + c("interest_expense") + c("tax_expense") + c("depreciation")
    fcf = c("operating_cash_flow") - c("capex")
    out = annual.withColumns({"mcap": mcap, "ebitda": ebitda, "fcf": fcf})
    out = out.withColumn("ev", c("mcap") + F.coalesce("long_term_debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0)))
    return out.withColumns({"fcf_yield": c("fcf") / c("mcap"), "ev_ebitda": F.when(c("ebitda") > 0, c("ev") / c("ebitda"))})


def quality_factors(annual: DataFrame) -> DataFrame:
    """roic and accruals."""
    c = F.col
    capital = F.coalesce("stockholders_equity", F.lit(0.0)) + F.coalesce("long_term_debt", F.lit(0.0))
    rate = effective_tax_rate(c("tax_expense"), c("net_income"))
    return annual.withColumns({"roic": F.when(capital > 0, c("operating_income") * (1 - rate) / capital), "accruals": F.when(c("total_assets") > 0, (c("net_income") - c("operating_cash_flow")) / c("total_assets"))})


def margin_stability(annual: DataFrame, by: list[str], last: int = 8, least: int = 3, cap: float = 1e6) -> DataFrame:
    """1 / population sd of the margins of the last years; the cap where they don't vary. Years without positive revenue
    have no margin, but count among the last."""
    w = Window.partitionBy(*by).orderBy(F.col("fy").desc())
    known = annual.where(F.col("revenue").isNotNull() & F.col("operating_income").isNotNull())
    recent = known.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= last) & (F.col("revenue") > 0))
    margins = recent.withColumn("margin", F.col("operating_income") / F.col("revenue"))
    out = margins.groupBy(*by).agg(F.count("margin").alias("n_margins"), F.stddev_pop("margin").alias("sd"))
    return out.where(F.col("n_margins") >= least).withColumn("margin_stability", F.when(F.col("sd") <= 1e-6, cap).otherwise(1 / F.col("sd")))


def latest_annual(facts: DataFrame, dates: DataFrame, concepts: list[str], key: str = "cik") -> DataFrame:
    """For each key and as_of the annual bundle: revenue, the anchor, with its period_end and filed, and the value that was
    newest then of every other concept. facts: key, concept, period_start (null for stocks), period_end, filed, value. Flows
    count where their period is of annual length (ANNUAL_DAYS); stocks at any time. A flow belongs to the bundle only if it is
    of the anchor's period, a stock if its period_end isn't after it. A fact holds from when it is filed until a newer
    one is, so a row meets just the dates in between."""
    flow = F.col("period_start").isNotNull()
    length = F.datediff("period_end", "period_start")
    usable = facts.where(~flow | length.between(*ANNUAL_DAYS)).withColumn("is_flow", flow)
    # In the order of filing, the best so far is the latest period, as last filed; a row that isn't better never holds.
    w = Window.partitionBy(key, "concept").orderBy("filed", "period_end")
    best = F.max(F.struct("period_end", "filed")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    newest = usable.withColumn("_best", best).where((F.col("_best.period_end") == F.col("period_end")) & (F.col("_best.filed") == F.col("filed")))
    held = newest.withColumn("_until", F.lead("filed").over(w))
    grid = F.broadcast(dates)  # the as_of grid that a caller lists
    seen = held.join(grid, (F.col("filed") <= F.col("as_of")) & (F.col("_until").isNull() | (F.col("as_of") < F.col("_until"))))
    anchor = seen.where(F.col("concept") == concepts[0]).select(key, "as_of", F.col("period_end").alias("_end"), F.col("filed").alias("_filed"))
    fits = F.when(F.col("is_flow"), F.col("period_end") == F.col("_end")).otherwise(F.col("period_end") <= F.col("_end"))
    both = seen.join(anchor, [key, "as_of"]).where(fits)
    out = both.groupBy(key, "as_of", "_filed", "_end").pivot("concept", concepts).agg(F.max("value"))
    return out.withColumnsRenamed({"_filed": "filed", "_end": "period_end"})


def with_q4(quarters: DataFrame, years: DataFrame, key: str = "cik") -> DataFrame:
    """Quarters and derived Q4 = year - (Q1 + Q2 + Q3), where three distinct quarters are known; Q4 is filed with the year."""
    three = quarters.where(F.col("fp").isin("Q1", "Q2", "Q3")).groupBy(key, "fy").agg(F.sum("eps").alias("_sum"), F.count_distinct("fp").alias("_k")).where("_k = 3")
    q4 = years.join(three, [key, "fy"]).select(key, "fy", F.lit("Q4").alias("fp"), "period_end", "filed", (F.col("eps") - F.col("_sum")).alias("eps"), F.lit(True).alias("derived"))
    known = quarters.where(F.col("fp") != "Q4").select(key, "fy", "fp", "period_end", "filed", "eps", F.lit(False).alias("derived"))
    return known.unionByName(q4)


def sue(quarters: DataFrame, key: str = "cik", last: int = 8, least: int = 5) -> DataFrame:
    """Standardised surprise: eps less eps of the same quarter a year before, over the population sd of
    the last such differences of that quarter, before this one."""
    w = Window.partitionBy(key, "fp").orderBy("period_end")
    yoy = F.when(F.year("period_end") - F.year(F.lag("period_end").over(w)) == 1, F.col("eps") - F.lag("eps").over(w))
    before = w.rowsBetween(-last, -1)
    out = quarters.withColumn("yoy", yoy).withColumn("_sd", F.stddev_pop("yoy").over(before)).withColumn("_n", F.count("yoy").over(before))
    return out.withColumn("sue", F.when((F.col("_n") >= least) & (F.col("_sd") > 0), F.col("yoy") / F.col("_sd"))).drop("_sd", "_n")


def neutral_z(df: DataFrame, x: Column, date: str, basket: str, super_basket: str, least: int = 8) -> tuple[Column, Column]:
    """z within the basket where it is large enough, else the super-basket, else all; and the level used."""
    size = lambda *by: F.count(x).over(Window.partitionBy(*by))
    level = F.when(size(date, basket) >= least, "basket").when(size(date, super_basket) >= least, "super").otherwise("global")
    z = F.when(level == "basket", win.zscore(x, date, basket)).when(level == "super", win.zscore(x, date, super_basket)).otherwise(win.zscore(x, date))
    return z, level


def composite(df: DataFrame, families: dict[str, list[tuple[str, int]]], weights: dict[str, float], date: str = "as_of", key: str = "ticker", least: int = 8, cut: float = 0.01) -> DataFrame:
    """Orient, winsorise, z within peers, mean of a family, weighted mean of the families present (two at least), rank.
    Runs over every date in one plan."""
    columns = [(name, sign) for members in families.values() for name, sign in members]
    out = df.withColumns({f"_w_{n}": win.winsorised(F.col(n) * s, date, cut=cut) for n, s in columns})
    out = out.withColumns({f"z_{n}": neutral_z(out, F.col(f"_w_{n}"), date, "basket", "super_basket", least)[0] for n, _ in columns})
    out = out.withColumns({f"score_{f}": mean_of(*(F.col(f"z_{n}") for n, _ in members)) for f, members in families.items()})
    scores = [F.col(f"score_{f}") for f in families]
    out = out.withColumn("n_families", count_of(*scores)).withColumn("composite", F.when(F.col("n_families") >= 2, weighted_mean([(F.col(f"score_{f}"), weights[f]) for f in families])))
    rank = F.row_number().over(Window.partitionBy(date, F.col("composite").isNull()).orderBy(F.col("composite").desc(), key))
    out = out.withColumn("rank", F.when(F.col("composite").isNotNull(), rank))
    pctl = win.average_rank(F.col("composite"), date) / F.count("composite").over(Window.partitionBy(date))
    return out.withColumn("pctl", pctl).drop(*(f"_w_{n}" for n, _ in columns))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "ticker", top: float = 0.9, jump: float = 0.5) -> DataFrame:
    """entrants and exits of the top decile and moves of at least half the ranking, with gain in points."""
    joined = before.select(key, F.col("pctl").alias("p0")).join(after.select(key, F.col("pctl").alias("p1")), key, "full_outer")
    was, now = F.coalesce(F.col("p0") >= top, F.lit(False)), F.coalesce(F.col("p1") >= top, F.lit(False))
    gain = (F.col("p1") - F.col("p0")) * 100
    kinds = F.filter(F.array(F.when(now & ~was, F.lit("entrant")), F.when(was & ~now, F.lit("exit")), F.when(F.abs(gain) >= jump * 100, F.lit("jump"))), lambda x: x.isNotNull())
    return joined.select(key, "p0", "p1", gain.alias("gain"), F.explode(kinds).alias("kind"))


def universe(listed: DataFrame, mapping: DataFrame, history: DataFrame, dates: DataFrame, least_days: int, stale_days: int, key: str = "ticker") -> DataFrame:
    """At each as_of the names that are listed, mapped, and have so many dates of history, the last of them recent: as_of,
    key, the mapping's columns, n_days, last_date. history: key, date (distinct). Counts come from a running number of
    each name's dates, of which each date of the grid takes the latest, so history isn't multiplied by the grid."""
    w = Window.partitionBy(key).orderBy("date")
    running = history.withColumns({"n_days": F.row_number().over(w), "_next": F.lead("date").over(w)})
    grid = F.broadcast(dates)  # the as_of grid that a caller lists
    seen = running.join(grid, (F.col("date") <= F.col("as_of")) & (F.col("_next").isNull() | (F.col("as_of") < F.col("_next"))))
    enough = seen.where((F.col("n_days") >= least_days) & (F.col("date") > F.date_sub("as_of", stale_days))).withColumnRenamed("date", "last_date").drop("_next")
    return enough.join(listed, key, "left_semi").join(mapping, key)
