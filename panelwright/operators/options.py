"""Option chains as tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PI2 = math.sqrt(2 * math.pi)
# Coefficients of a published rational approximation of the normal tail, good to about 1e-14, and where it
# gives way to a continued fraction.
TAIL_OVER = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_UNDER = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_FAR, TAIL_SHIFT, TAIL_SCALE = 7.07106781186547, 0.65, 2.506628274631
GREEKS = ("delta", "gamma", "vega", "theta", "rho", "vanna", "volga")


def _horner(a, coefficients: tuple[float, ...]):  # noqa: ANN001, ANN202
    return reduce(lambda acc, c: acc * a + c, coefficients[1:], coefficients[0])


def _far(a):  # noqa: ANN001, ANN202
    return a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + TAIL_SHIFT))))


def normal_tail(a: Column) -> Column:
    """The normal probability above a, for a >= 0."""
    e = F.exp(-a * a / 2)
    return F.when(a > 37, 0.0).when(a < TAIL_FAR, e * _horner(a, TAIL_OVER) / _horner(a, TAIL_UNDER)).otherwise(e / _far(a) / TAIL_SCALE)


def norm_cdf(x: Column) -> Column:
    tail = normal_tail(F.abs(x))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def greeks(chain: DataFrame) -> DataFrame:
    """Adds price, delta, gamma, vega, theta (a year), rho, vanna and volga to rows of spot, strike, t, rate, div, vol, type.
    Without time or vol the price is the discounted intrinsic value. What several greeks share is computed once, in
    projections of their own, so that none of them becomes too large to be compiled."""
    s, k, t, r, q, v = (F.col(c) for c in ("spot", "strike", "t", "rate", "div", "vol"))
    c = F.col
    alive = F.greatest(t, F.lit(0.0))
    out = chain.withColumns({"_live": (t > 0) & (v > 0), "_sign": F.when(c("type") == "c", 1.0).otherwise(-1.0), "_dq": F.exp(-q * alive), "_dr": F.exp(-r * alive), "_root": v * F.sqrt(alive)})
    out = out.withColumn("_d1", F.when(c("_live"), (F.ln(s / k) + (r - q + v * v / 2) * t) / c("_root")))
    out = out.withColumn("_d2", c("_d1") - c("_root"))
    out = out.withColumns({"_u1": normal_tail(F.abs("_d1")), "_pdf": F.exp(-c("_d1") * c("_d1") / 2) / PI2})
    out = out.withColumn("_u2", normal_tail(F.abs("_d2")))
    side = lambda d, u: F.when(c("_sign") * c(d) > 0, 1 - c(u)).otherwise(c(u))
    out = out.withColumns({"_fs": s * c("_dq"), "_fk": k * c("_dr"), "_n1": side("_d1", "_u1"), "_n2": side("_d2", "_u2")})
    sign, fs, fk, n1, n2, live = (c(f"_{x}") for x in ("sign", "fs", "fk", "n1", "n2", "live"))
    vega = fs * c("_pdf") * F.sqrt(alive)
    zero = lambda x: F.when(live, x).otherwise(0.0)
    made = {
        "price": F.when(live, sign * (fs * n1 - fk * n2)).otherwise(F.greatest(sign * (fs - fk), F.lit(0.0))),
        "delta": F.when(live, sign * c("_dq") * n1).otherwise(F.when(sign * (s - k) > 0, sign).otherwise(0.0)),
        "gamma": zero(c("_dq") * c("_pdf") / (s * c("_root"))),
        "vega": zero(vega),
        "theta": zero(-fs * c("_pdf") * v / (2 * F.sqrt(alive)) - sign * r * fk * n2 + sign * q * fs * n1),
        "rho": zero(sign * t * fk * n2),
        "vanna": zero(-c("_dq") * c("_pdf") * c("_d2") / v),
        "volga": zero(vega * c("_d1") * c("_d2") / v),
    }
    return out.select(*(x for x in chain.columns if x not in made), *(x.alias(n) for n, x in made.items()))


def _cdf(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    e = np.exp(-a * a / 2)
    tail = np.where(a < TAIL_FAR, e * _horner(a, TAIL_OVER) / _horner(a, TAIL_UNDER), e / _far(a) / TAIL_SCALE)
    return np.where(x > 0, 1 - tail, tail)


def implied_vol(chain: DataFrame, price: str = "mid") -> DataFrame:
    """Adds iv: bisection over whole batches; null outside the no-arbitrage bounds."""

    def solve(p: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, q: pd.Series, call: pd.Series) -> pd.Series:
        p, s, k, t, r, q = (x.to_numpy(float) for x in (p, s, k, t, r, q))
        sign = np.where(call.to_numpy(bool), 1.0, -1.0)
        fs, fk = s * np.exp(-q * t), k * np.exp(-r * t)
        low, high = np.full(len(p), 1e-4), np.full(len(p), 6.0)
        with np.errstate(all="ignore"):
            ok = (t > 0) & (p > np.maximum(sign * (fs - fk), 0) + 1e-10) & (p < np.where(sign > 0, fs, fk))
            root, ahead = np.sqrt(t), np.log(fs / fk)
            for _ in range(60):
                v = (low + high) / 2
                d1 = ahead / (v * root) + v * root / 2
                over = sign * (fs * _cdf(sign * d1) - fk * _cdf(sign * (d1 - v * root))) > p
                low, high = np.where(over, low, v), np.where(over, v, high)
        return pd.Series(np.where(ok & (high < 5.999), (low + high) / 2, np.nan)).where(lambda x: x.notna(), None)

    return chain.withColumn("iv", F.pandas_udf(solve, "double")(price, "spot", "strike", "t", "rate", "div", F.col("type") == "c"))


def mid_price(bid: str = "bid", ask: str = "ask", last: str = "last") -> Column:
    """Mid of a two-sided quote that isn't crossed, else the last price."""
    b, a, x = F.col(bid), F.col(ask), F.col(last)
    return F.when((b > 0) & (a > 0) & (a >= b), (b + a) / 2).otherwise(F.when(x > 0, x))


def quoted(chain: DataFrame) -> DataFrame:
    """Adds mid and iv (from the mid) to quotes."""
    return implied_vol(chain.withColumn("mid", mid_price()))


def strike_vols(chain: DataFrame) -> DataFrame:
    """A row for each strike of a quoted chain, with the forward, the mids of both sides (cm, pm) and iv: the vol of the side out
    of the money, else of the other."""
    is_call = F.col("type") == "c"
    pick = lambda x, side: F.max(F.when(is_call if side == "c" else ~is_call, F.col(x)))
    two_sided = (F.col("bid") > 0) & (F.col("ask") >= F.col("bid"))
    strikes = chain.withColumns({"fwd": F.col("spot") * F.exp((F.col("rate") - F.col("div")) * F.col("t")), "_ok": two_sided}).groupBy("symbol", "dte", "t", "strike").agg(
        F.max("spot").alias("spot"), F.max("fwd").alias("fwd"), pick("iv", "c").alias("civ"), pick("iv", "p").alias("piv"),
        pick("mid", "c").alias("cm"), pick("mid", "p").alias("pm"), pick("_ok", "c").alias("c_ok"), pick("_ok", "p").alias("p_ok"),
    )
    above = F.col("strike") >= F.col("fwd")
    return strikes.withColumns({"iv": F.when(above, F.coalesce("civ", "piv")).otherwise(F.coalesce("piv", "civ")), "_ok": F.when(above, F.col("c_ok")).otherwise(F.col("p_ok"))})


#: Levels of moneyness at which vols are read off, as fractions of spot.
LEVELS = (0.8, 0.9, 0.95, 1.0, 1.05, 1.1, 1.2)


def moneyness_vols(strikes: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Per symbol and dte the vol at each level of moneyness (m80 for 0.8, ...), interpolated between the last strike at or below
    it and the first above that have a vol; null outside the listed strikes. strikes: strike_vols(). Levels are rows among the
    strikes, so that one window in the order of the strikes meets both neighbours of all of them."""
    names = [f"m{round(m * 100)}" for m in levels]
    level = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(m).alias("m")) for n, m in zip(names, levels, strict=True))))
    asked = strikes.groupBy("symbol", "dte").agg(F.max("spot").alias("spot")).select("symbol", "dte", "spot", level.alias("x"))
    asked = asked.select("symbol", "dte", (F.col("spot") * F.col("x.m")).alias("k"), F.lit(None).cast("double").alias("iv"), F.col("x.name").alias("name"))
    listed = strikes.where("iv IS NOT NULL").select("symbol", "dte", F.col("strike").alias("k"), "iv", F.lit(None).cast("string").alias("name"))
    w = Window.partitionBy("symbol", "dte").orderBy("k", F.col("name").asc_nulls_first())
    point = F.when(F.col("iv").isNotNull(), F.struct("k", "iv"))
    lo = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first(point, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    met = listed.unionByName(asked).withColumns({"lo": lo, "hi": hi}).where("name IS NOT NULL")
    vol = F.col("lo.iv") + (F.col("hi.iv") - F.col("lo.iv")) * (F.col("k") - F.col("lo.k")) / (F.col("hi.k") - F.col("lo.k"))
    return met.withColumn("vol", vol).groupBy("symbol", "dte").pivot("name", names).agg(F.max("vol"))


def surface(strikes: DataFrame) -> DataFrame:
    """Per symbol, dte and t, from strike_vols(): forward, ATM vol at the forward, interpolated between the strikes around
    it, straddle (call and put mid at the strike nearest the forward) and vols at 90 and 110 % moneyness by the nearest
    strike. Strikes without a two-sided quote count only where fewer than two others have a vol."""
    has = F.col("iv").isNotNull()
    fresh = F.sum((has & F.col("_ok")).cast("int")).over(Window.partitionBy("symbol", "dte", "t"))
    strikes = strikes.withColumn("_in", has & (F.col("_ok") | (fresh < 2)))
    at = F.struct("strike", "iv")
    g = strikes.groupBy("symbol", "dte", "t").agg(
        F.max("spot").alias("spot"), F.max("fwd").alias("fwd"),
        F.max_by(at, F.when(F.col("_in") & (F.col("strike") <= F.col("fwd")), F.col("strike"))).alias("lo"),
        F.min_by(at, F.when(F.col("_in") & (F.col("strike") > F.col("fwd")), F.col("strike"))).alias("hi"),
        F.min_by(F.col("cm") + F.col("pm"), F.struct(F.abs(F.col("strike") - F.col("fwd")), "strike")).alias("straddle"),
        *(F.min_by("iv", F.when(has, F.struct(F.abs(F.col("strike") / F.col("fwd") - m), "strike"))).alias(n) for m, n in ((0.9, "vol_90"), (1.1, "vol_110"))),
    )
    between = F.col("lo.iv") + (F.col("hi.iv") - F.col("lo.iv")) * (F.col("fwd") - F.col("lo.strike")) / (F.col("hi.strike") - F.col("lo.strike"))
    return g.select("symbol", "dte", "t", "spot", "fwd", F.coalesce(between, F.col("lo.iv"), F.col("hi.iv")).alias("atm"), "straddle", "vol_90", "vol_110", (F.col("vol_90") - F.col("vol_110")).alias("skew"))


def nearest_target(df: DataFrame, by: list[str], days: str, targets: list[int]) -> DataFrame:
    """For each target the row nearest in days, within max(5, 45 %)."""
    spread = df.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).withColumn("_gap", F.abs(F.col(days) - F.col("target")))
    close = spread.where(F.col("_gap") <= F.greatest(F.lit(5.0), F.col("target") * 0.45))
    return close.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "target").orderBy("_gap", days))).where("_n = 1").drop("_n", "_gap")


def vol_monitor(surfaces: DataFrame, realised: DataFrame) -> DataFrame:
    """Per symbol: ATM vol nearest 30 and 90 days (null where both are one expiry), slope, realised vols rv10, rv20 and
    rv60, premium and ratio of the near vol over rv20, the move to expiry it implies and the straddle over spot."""
    near = lambda d: F.min_by(F.struct("dte", "atm", "straddle", "spot"), F.struct(F.abs(F.col("dte") - d), "dte"))
    picked = surfaces.where("atm IS NOT NULL").groupBy("symbol").agg(near(30).alias("a"), near(90).alias("b"))
    apart = F.col("a.dte") != F.col("b.dte")
    out = picked.join(realised, "symbol", "left").withColumns({"iv_30": F.col("a.atm"), "iv_90": F.when(apart, F.col("b.atm"))})
    rv = F.when(F.col("rv20") != 0, F.col("rv20"))
    return out.select(
        "symbol", "iv_30", F.col("a.dte").alias("dte_30"), "iv_90", "rv10", "rv20", "rv60", (F.col("iv_90") - F.col("iv_30")).alias("slope"), (F.col("iv_30") - rv).alias("premium"),
        (F.col("iv_30") / rv).alias("ratio"), (F.col("iv_30") * F.sqrt(F.col("a.dte") / 365)).alias("move"), (F.col("a.straddle") / F.col("a.spot")).alias("straddle"),
    )


def chain_edge(chain: DataFrame, fair_vol: Column, within: float = 0.2) -> DataFrame:
    """mid less the price at fair_vol, for strikes within so much of spot. chain is quoted."""
    close = chain.where(F.abs(F.col("strike") / F.col("spot") - 1) <= within).withColumn("vol", fair_vol)
    return greeks(close).withColumnRenamed("price", "fair").withColumn("edge", F.col("mid") - F.col("fair"))


# Templates of legs; type (u: the underlying), strike as a multiple of spot, quantity, later expiry or not.
TEMPLATES = {
    "Long call": [("c", 1.0, 1, 0)],
    "Long put": [("p", 1.0, 1, 0)],
    "Covered call": [("u", 1.0, 1, 0), ("c", 1.05, -1, 0)],
    "Protective put": [("u", 1.0, 1, 0), ("p", 0.95, 1, 0)],
    "Collar": [("u", 1.0, 1, 0), ("p", 0.95, 1, 0), ("c", 1.05, -1, 0)],
    "Long straddle": [("c", 1.0, 1, 0), ("p", 1.0, 1, 0)],
    "Short straddle": [("c", 1.0, -1, 0), ("p", 1.0, -1, 0)],
    "Long strangle": [("p", 0.95, 1, 0), ("c", 1.05, 1, 0)],
    "Short strangle": [("p", 0.92, -1, 0), ("c", 1.08, -1, 0)],
    "Bull call spread": [("c", 1.0, 1, 0), ("c", 1.07, -1, 0)],
    "Bear put spread": [("p", 1.0, 1, 0), ("p", 0.93, -1, 0)],
    "Call butterfly": [("c", 0.95, 1, 0), ("c", 1.0, -2, 0), ("c", 1.05, 1, 0)],
    "Iron condor": [("p", 0.9, 1, 0), ("p", 0.95, -1, 0), ("c", 1.05, -1, 0), ("c", 1.1, 1, 0)],
    "Risk reversal": [("p", 0.95, -1, 0), ("c", 1.05, 1, 0)],
    "Call ratio 1x2": [("c", 1.0, 1, 0), ("c", 1.07, -2, 0)],
    "Put backspread 1x2": [("p", 1.0, -1, 0), ("p", 0.93, 2, 0)],
    "Call calendar": [("c", 1.0, -1, 0), ("c", 1.0, 1, 1)],
    "Diagonal": [("c", 1.05, -1, 0), ("c", 1.0, 1, 1)],
}
#: How many expiries later a leg with the offset is.
LATER = 2


def template_rows() -> list[tuple]:
    return [(name, n, *leg) for name, legs in TEMPLATES.items() for n, leg in enumerate(legs, 1)]


def leg_match(chain: DataFrame, base: int = 0, tasks: int | None = None) -> DataFrame:
    """Every template for every symbol, at the base-th expiry (from 0; later legs LATER on, at most the last): each leg at the
    nearest listed strike, entered at the ask if bought and the bid if sold, else at mid, else at the model's price. chain:
    quoted, with price and vol of the model. tasks: over how many the symbols are dealt; legs stay where their symbol is."""
    # The underlying is met on either side, at the first expiry: it comes out of the same pass over a symbol's quotes.
    rows = [(name, leg, ty, m, q, later, side) for name, leg, ty, m, q, later in template_rows() for side in ("cp" if ty == "u" else ty)]
    legs = F.broadcast(chain.sparkSession.createDataFrame(rows, "template string, leg int, kind string, multiple double, qty int, later int, type string"))
    if tasks:
        chain = chain.repartition(tasks, "symbol")
    ranks = F.dense_rank().over(Window.partitionBy("symbol").orderBy("dte")) - 1
    whole = Window.partitionBy("symbol")
    ranked = chain.withColumn("_e", ranks).withColumns({"_n": F.max("_e").over(whole), **{f"_{c}": F.max(c).over(whole) for c in ("spot", "rate", "div")}})
    stock = F.col("kind") == "u"
    expiry = F.when(stock, 0).otherwise(F.least(F.col("_n"), F.lit(base) + F.col("later") * LATER))
    met = ranked.join(legs, "type").where(F.col("_e") == expiry).withColumn("_gap", F.struct(F.abs(F.col("strike") - F.col("spot") * F.col("multiple")), "strike"))
    side = F.when(F.col("qty") > 0, F.col("ask")).otherwise(F.col("bid"))
    entry = F.coalesce(F.when(side > 0, side), F.col("mid"), F.col("price"))
    own = {"dte": F.lit(0), "t": F.lit(0.0), "spot": F.col("_spot"), "strike": F.lit(0.0), "rate": F.col("_rate"), "div": F.col("_div"), "vol": F.lit(0.0), "entry": F.col("_spot")}
    quote = {c: F.col(c) for c in ("dte", "t", "spot", "strike", "rate", "div")} | {"vol": F.coalesce("iv", "vol"), "entry": entry}
    made = met.groupBy("symbol", "template", "leg", "kind", "qty").agg(F.min_by(F.struct(*(F.when(stock, own[c]).otherwise(quote[c]).alias(c) for c in quote)), "_gap").alias("m"))
    return made.select("symbol", "template", "leg", F.col("kind").alias("type"), "qty", "m.*")


def _valued(legs: DataFrame) -> DataFrame:
    """greeks() of legs, of which the underlying (type u) is worth spot, with delta 1."""
    stock = F.col("type") == "u"
    out = greeks(legs.withColumn("strike", F.when(stock, F.col("spot")).otherwise(F.col("strike"))))
    flat = {g: F.when(stock, 1.0 if g == "delta" else 0.0).otherwise(F.col(g)) for g in GREEKS}
    return out.withColumns({"price": F.when(stock, F.col("spot")).otherwise(F.col("price")), **flat})


def _moved(legs: DataFrame, days: Column, spot: Column, vol_shift: Column) -> DataFrame:
    later = F.greatest(F.lit(0.0), F.col("t") - days / 365)
    return legs.withColumns({"spot": spot, "t": later, "vol": F.greatest(F.col("vol") + vol_shift, F.lit(1e-4))})


def leg_greeks(legs: DataFrame, multiplier: float = 100.0, by: tuple[str, ...] = ("book",)) -> DataFrame:
    """Per leg its value, gain over entry and greeks, times quantity; the rows with a null leg are the books' totals.
    legs: book, leg, type, strike, t, qty, vol, entry, spot, rate, div. by, here and below: the columns that tell a book; where
    legs are already dealt by one of them, they stay there."""
    m = F.col("qty") * multiplier
    values = ("value", "pnl", *GREEKS)
    rows = _valued(legs).select(*by, "leg", (m * F.col("price")).alias("value"), (m * (F.col("price") - F.col("entry"))).alias("pnl"), *((m * F.col(g)).alias(g) for g in GREEKS))
    each = rows.groupBy(*by, "leg").agg(*(F.sum(c).alias(c) for c in values))
    books = each.groupBy(*by).agg(*(F.sum(c).alias(c) for c in values), F.collect_list(F.struct("leg", *values)).alias("_legs"))
    total = F.array(F.struct(F.lit(None).cast(legs.schema["leg"].dataType).alias("leg"), *values))
    return books.select(*by, F.explode(F.concat("_legs", total)).alias("x")).select(*by, "x.*")


def risk_grid(legs: DataFrame, spots: list[float], vols: list[float], days: float = 0.0, multiplier: float = 100.0, by: tuple[str, ...] = ("book",)) -> DataFrame:
    """P&L and greeks of each book in every cell of spot moves and vol shifts."""
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("spot_move"), F.lit(b).alias("vol_shift")) for a in spots for b in vols)))
    moved = legs.withColumn("cell", cells).select("*", "cell.*").drop("cell")
    priced = _valued(_moved(moved, F.lit(days), F.col("spot") * (1 + F.col("spot_move")), F.col("vol_shift")))
    m = F.col("qty") * multiplier
    return priced.groupBy(*by, "spot_move", "vol_shift").agg(F.sum(m * (F.col("price") - F.col("entry"))).alias("pnl"), *(F.sum(m * F.col(g)).alias(g) for g in ("delta", "gamma", "vega", "theta")))


def sigma_split(legs: DataFrame, sigmas: list[float], multiplier: float = 100.0, by: tuple[str, ...] = ("book",)) -> DataFrame:
    """What one-day moves of so many sigmas (at the mean vol of a book's options) do: P&L, the parts of delta and gamma, and
    what these leave."""
    option = F.col("type") != "u"
    daily = F.coalesce(F.avg(F.when(option, F.col("vol"))).over(Window.partitionBy(*by)), F.lit(0.3))
    cells = legs.withColumn("_sigma", daily).withColumn("sigma", F.explode(F.array(*map(F.lit, [0.0, *sigmas]))))
    cells = cells.withColumn("move", F.col("sigma") * F.col("spot") * F.col("_sigma") / math.sqrt(252))
    m = F.col("qty") * multiplier
    sums = _valued(_moved(cells, F.lit(0.0), F.col("spot") + F.col("move"), F.lit(0.0))).groupBy(*by, "sigma").agg(
        F.sum(m * F.col("price")).alias("value"), F.sum(m * F.col("delta")).alias("delta"), F.sum(m * F.col("gamma")).alias("gamma"), F.max("move").alias("move"),
    )
    still = lambda c: F.max(F.when(F.col("sigma") == 0, F.col(c))).over(Window.partitionBy(*by))
    out = sums.withColumns({"v0": still("value"), "d0": still("delta"), "g0": still("gamma")}).where("sigma <> 0")
    out = out.withColumns({"pnl": F.col("value") - F.col("v0"), "delta_part": F.col("d0") * F.col("move"), "gamma_part": F.col("g0") * F.col("move") * F.col("move") / 2})
    return out.select(*by, "sigma", "move", "pnl", "delta_part", "gamma_part", (F.col("pnl") - F.col("delta_part") - F.col("gamma_part")).alias("rest"))


def _each(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of each run, one run after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)


def _left_at(leg: dict[str, np.ndarray], s: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Price and delta of legs at spots s with so much time left, as greeks() has them."""
    sign, k, v = np.where(leg["type"] == "c", 1.0, -1.0), leg["strike"], np.maximum(leg["vol"], 1e-4)
    stock, live = leg["type"] == "u", (left > 0) & (leg["type"] != "u")
    price, delta = np.maximum(sign * (s - k), 0), np.where(sign * (s - k) > 0, sign, 0.0)
    x, y, t, r, q, g, z = (a[live] for a in (s, k, left, leg["rate"], leg["div"], sign, v))
    root = z * np.sqrt(t)
    d1 = (np.log(x / y) + (r - q + z * z / 2) * t) / root
    n1, n2, paid = _cdf(g * d1), _cdf(g * (d1 - root)), np.exp(-q * t)
    price[live], delta[live] = g * (x * paid * n1 - y * np.exp(-r * t) * n2), g * paid * n1
    return np.where(stock, s, price), np.where(stock, 1.0, delta)


LEG_FIELDS = ("type", "strike", "t", "qty", "vol", "entry", "spot", "rate", "div")
CURVE = "straight boolean, slope double, _m double, _w double, s array<double>, pnl array<double>, below array<double>"


def expiry_curve(legs: DataFrame, low: float = 0.02, high: float = 4.0, steps: int = 1199, multiplier: float = 100.0, by: tuple[str, ...] = ("book",)) -> DataFrame:
    """P&L of each book at the spots that decide its profile when its first option expires: at zero, at every strike that
    expires then, and far out, where delta is the slope of the upper tail. Where a later leg is left, which is worth its model
    price then, a grid from low to high times spot is added; all other books are straight in between. A book is a row of its
    legs, and its points are priced where it is. Columns: by, straight, slope (of the tail, to a millionth), _m and _w (of the
    lognormal spot: risk-neutral drift, mean vol of the legs), and of the points s in order pnl (to a millionth, lest noise
    crosses zero) and below: the probability of less than s."""
    kinds = ", ".join(f"{c} {legs.schema[c].dataType.simpleString()}" for c in by)
    names = [*by, "straight", "slope", "_m", "_w", "s", "pnl", "below"]

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part.slice(i, 2048) for part in batches for i in range(0, part.num_rows, 2048)):
            packed = batch.column(len(by))
            fields, n = packed.flatten(), batch.num_rows
            leg = {c: fields.field(i).to_numpy(zero_copy_only=False) for i, c in enumerate(LEG_FIELDS)}
            leg = {c: x.astype(str) if c == "type" else x.astype(float) for c, x in leg.items()}
            sizes = np.diff(packed.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            book, option = np.repeat(np.arange(n), sizes), leg["type"] != "u"
            number = np.bincount(book[option], minlength=n)
            h, last = np.full(n, np.inf), np.full(n, -np.inf)
            np.minimum.at(h, book[option], leg["t"][option])
            np.maximum.at(last, book[option], leg["t"][option])
            h = np.where(number > 0, h, 0.0)
            straight = last <= h + 1e-9
            v = np.where(number > 0, np.bincount(book[option], leg["vol"][option], n) / np.maximum(number, 1), 0.3)
            s0, carry = (np.maximum.reduceat(x, starts) for x in (leg["spot"], leg["rate"] - leg["div"]))
            mu, width = np.log(s0) + (carry - v * v / 2) * h, v * np.sqrt(np.maximum(h, 1e-6))
            first = option & (leg["t"] <= h[book] + 1e-9)
            bent = np.flatnonzero(~straight)
            grid = s0[bent, None] * (low + np.arange(steps + 1) * (high - low) / steps)
            at = np.concatenate([np.arange(n), book[first], np.repeat(bent, steps + 1), np.arange(n)])
            s = np.concatenate([np.full(n, 1e-6), leg["strike"][first], grid.ravel(), s0 * 50])
            far = np.arange(len(s)) >= len(s) - n
            order = np.lexsort((s, far, at))
            at, s, far = at[order], s[order], far[order]
            new = np.append(True, (at[1:] != at[:-1]) | (s[1:] != s[:-1]) | (far[1:] != far[:-1]))
            at, s, far = at[new], s[new], far[new]
            cell, point = _each(starts[at], sizes[at]), np.repeat(np.arange(len(at)), sizes[at])
            left = np.where(first, 0.0, np.maximum(leg["t"] - h[book], 0.0))
            worth, delta = _left_at({c: x[cell] for c, x in leg.items()}, s[point], left[cell])
            times = leg["qty"][cell] * multiplier
            sums = lambda x: np.round(np.bincount(point, x, len(at)), 6) + 0.0
            pnl, slope = sums(times * (worth - leg["entry"][cell])), sums(times * delta)
            with np.errstate(all="ignore"):
                below = _cdf((np.log(s) - mu[at]) / width[at])
            near = ~far
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at[near], minlength=n))]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[near])) for x in (s, pnl, below)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, (straight, slope[far], mu, width)), *lists], names)

    packed = legs.groupBy(*by).agg(F.collect_list(F.struct(*LEG_FIELDS)).alias("legs"))
    return packed.mapInArrow(price, f"{kinds}, {CURVE}")


def expiry_profile(curve: DataFrame) -> DataFrame:
    """Per book: the best and the worst P&L, null where a tail has no bound (unlimited_profit, unlimited_loss), breakevens in
    order, and the probability of a profit, both tails included. curve: expiry_curve()."""
    by = curve.columns[: curve.columns.index("straight")]
    made = ["max_profit", "max_loss", "unlimited_profit", "unlimited_loss", "breakevens", "p_profit"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for part in batches if part.num_rows):
            n = batch.num_rows
            straight, slope, mu, width = (batch[c].to_numpy(zero_copy_only=False) for c in ("straight", "slope", "_m", "_w"))
            s, pnl, below = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("s", "pnl", "below"))
            sizes = np.diff(batch["s"].offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            book, ends = np.repeat(np.arange(n), sizes), starts + sizes - 1
            before = np.maximum(np.arange(len(s)) - 1, 0)
            inner = np.ones(len(s), bool)
            inner[starts] = False
            p0, x0, n0 = pnl[before], s[before], below[before]
            crossed = inner & (p0 * pnl < 0)
            with np.errstate(all="ignore"):
                cross = np.where(crossed, x0 - p0 * (s - x0) / (pnl - p0), x0)
                at = _cdf((np.log(cross) - mu[book]) / width[book])
            met = crossed | (inner & (p0 == 0))
            mass = np.where(crossed, np.where(pnl > 0, below - at, at - n0), np.where(inner & (np.maximum(p0, pnl) > 0), below - n0, 0.0))
            # Beyond the last point a straight book goes on with the slope of the tail.
            end, under = pnl[ends], below[ends]
            out = straight & (slope != 0) & (end * slope <= 0)
            with np.errstate(all="ignore"):
                beyond = s[ends] - end / slope
                above = _cdf((np.log(beyond) - mu) / width)
            tail = np.where(out, np.where(slope > 0, 1 - above, above - under), np.where(end > 0, 1 - under, 0.0))
            owner, value = np.concatenate([book[met], np.flatnonzero(out)]), np.concatenate([cross[met], beyond[out]])
            order = np.lexsort((value, owner))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32())
            best, worst = np.maximum.reduceat(pnl, starts), np.minimum.reduceat(pnl, starts)
            columns = [pa.array(best, mask=slope > 0), pa.array(worst, mask=slope < 0), pa.array(slope > 0), pa.array(slope < 0)]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(value[order])), pa.array(np.bincount(book, mass, n) + tail)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *columns], [*by, *made])

    kinds = ", ".join(f"{c} {curve.schema[c].dataType.simpleString()}" for c in by)
    return curve.mapInArrow(rate, f"{kinds}, max_profit double, max_loss double, unlimited_profit boolean, unlimited_loss boolean, breakevens array<double>, p_profit double")
