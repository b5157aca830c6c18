"""The remaining joins, classifications, signal stacks and functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import scalars
from panelwright.functions import windows as win
from panelwright.operators import balance, baskets, panel, signals, workbench
from panelwright.sources import panels as src
from panelwright.sources import readers
from panelwright.sources.panels import with_sql
from panelwright.sources.scratch import scratch_path, stored

from . import basket_plans, scores, series
from .registry import query, take


@query("join_inner_equi",
    "SELECT o_orderkey, c_custkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey "
    "WHERE o_totalprice > 100000")
def inner(spark, d):  # noqa: ANN001, ANN201
    o, c = src.table(spark, d, "orders"), src.table(spark, d, "customer")
    return o.where("o_totalprice > 100000").join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_custkey", "o_totalprice", "c_mktsegment")


@query("join_left_wide",
    "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT "
    "JOIN region ON n_regionkey = r_regionkey")
def left_wide(spark, d):  # noqa: ANN001, ANN201
    s, n, r = (src.table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("s_suppkey", "n_name", "r_name")


@query("join_full",
    "WITH a AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_shipdate < DATE '1998-07-01' "
    "GROUP BY ALL), b AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_shipdate >= DATE '1998-07-01' GROUP BY ALL) "
    "SELECT l_suppkey, l_partkey, a.n AS n0, b.n AS n1 FROM a FULL JOIN b USING (l_suppkey, l_partkey)")
def full(spark, d):  # noqa: ANN001, ANN201
    """What each supplier shipped of each part in the two halves of the time."""
    li, key = src.table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"]
    half = lambda cond, name: li.where(cond).groupBy(*key).agg(F.count("*").alias(name))
    return half("l_shipdate < DATE '1998-07-01'", "n0").join(half("l_shipdate >= DATE '1998-07-01'", "n1"), key, "full_outer")


#: Names that a name is paired with at a time.
TILE = 64


@query("join_self_pairs", with_sql("px", "bk", more=basket_plans.RB) +
    "SELECT a.ticker AS a, b.ticker AS b, a.date, round(a.ret - b.ret, 6) AS gap FROM rb a "
    "JOIN rb b ON a.date = b.date AND a.basket = b.basket AND a.ticker < b.ticker WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL")
def self_pairs(spark, d):  # noqa: ANN001, ANN201
    """Quadratic by nature. Parts are as many as the session says and aren't merged for being small: their pairs aren't. The names
    of a basket's date are cut into sorted tiles, and a name meets one tile at a time: names come in runs and repeat soon, so
    that they take next to no room in a file. What a task holds is a tile's pairs, linear in the basket."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = basket_plans.returns(spark, d).where("ret IS NOT NULL AND basket IS NOT NULL AND date IS NOT NULL").repartition(parts, "basket", "date")
    names = r.groupBy("basket", "date").agg(F.sort_array(F.collect_list(F.struct("ticker", "ret"))).alias("names"))
    at = names.select("basket", "date", "names", F.explode(F.sequence(F.lit(1), F.size("names"), F.lit(TILE))).alias("at"))
    tiles = at.select("basket", "date", F.slice("names", F.col("at"), TILE).alias("tile"))
    met = tiles.hint("merge").join(r, ["basket", "date"]).where(F.col("ticker") < F.element_at("tile", -1)["ticker"])
    both = met.select("date", "ticker", "ret", F.explode("tile").alias("b")).where("ticker < b.ticker")
    pairs = both.select(F.col("ticker").alias("a"), F.col("b.ticker").alias("b"), "date", (F.col("ret") - F.col("b.ret")).alias("gap"))
    return take(pairs, "a b date", "gap")


@query("join_prior_years", with_sql("px", more="m AS (SELECT ticker, year(date)::INT AS y, month(date)::INT AS m, close FROM px)") +
    "SELECT a.ticker, a.y AS year, a.m AS month, count(b.close) AS n_years, round(avg(b.close), 6) AS norm FROM m a "
    "JOIN m b ON a.ticker = b.ticker AND a.m = b.m AND b.y BETWEEN a.y - 5 AND a.y - 1 GROUP BY ALL HAVING count(*) >= 3")
def prior(spark, d):  # noqa: ANN001, ANN201
    m = src.monthly_prices(spark, d).select("ticker", F.year("date").alias("year"), F.month("date").alias("month"), "close")
    return take(panel.prior_years(m, ["ticker"], "year", "month", "close").where("n_years IS NOT NULL"), "ticker year month n_years", "norm")


@query("agg_group_corr", with_sql("px", "bk", more=
    f"{basket_plans.RB}, bd AS (SELECT basket, super_basket, date, avg(ret) AS ret FROM rb WHERE ret IS NOT NULL "
    f"GROUP BY ALL), gp AS (SELECT a.super_basket AS ga, b.super_basket AS gb, a.basket AS a, b.basket AS b, corr(a.ret, b.ret) AS c "
    f"FROM bd a JOIN bd b ON a.date = b.date AND a.basket < b.basket GROUP BY ALL)") + "SELECT least(ga, gb) AS ga, greatest(ga, gb) AS gb, count(*) AS n, round(avg(c), 6) AS mean_corr FROM gp GROUP BY 1, 2")
def group_corr(spark, d):  # noqa: ANN001, ANN201
    pairs = basket_plans.basket_correlations(spark, d)
    g = src.baskets(spark, d).select("basket", "super_basket").distinct()
    named = pairs.join(g.withColumnsRenamed({"basket": "a", "super_basket": "x"}), "a").join(g.withColumnsRenamed({"basket": "b", "super_basket": "y"}), "b")
    return take(named.groupBy(F.least("x", "y").alias("ga"), F.greatest("x", "y").alias("gb")).agg(F.count("*").alias("n"), F.avg("corr").alias("mean_corr")), "ga gb n", "mean_corr")


@query("agg_var_share", with_sql("px", "bk", more=f"{basket_plans.RB}, {basket_plans.LOO}, {basket_plans.FIT}") +
    "SELECT ticker, round(pow(regr_slope(ret, loo), 2) * var_samp(loo) / var_pop(ret), 6) AS varshare FROM bt GROUP BY ticker "
    "HAVING count(*) >= 40")
def var_share(spark, d):  # noqa: ANN001, ANN201
    both = baskets.leave_one_out(basket_plans.returns(spark, d)).where("ret IS NOT NULL AND loo IS NOT NULL")
    share = F.pow(F.regr_slope("ret", "loo"), 2) * F.var_samp("loo") / F.var_pop("ret")
    return take(both.groupBy("ticker").agg(share.alias("varshare"), F.count("*").alias("n")).where("n >= 40"), "ticker", "varshare")


WEEK = (
    "w AS (SELECT symbol, isoyear(date)::INT AS y, least(weekofyear(date), 52)::INT AS wk, max_by(value, date) AS v FROM drv "
    "GROUP BY ALL), n AS (SELECT a.symbol, a.y, a.wk, avg(b.v) AS norm, stddev_pop(b.v) AS sd FROM w a "
    "JOIN w b ON a.symbol = b.symbol AND a.wk = b.wk AND b.y BETWEEN a.y - 5 AND a.y - 1 GROUP BY ALL HAVING count(*) >= 3)"
)


@query("proj_weekly_z", with_sql("drv", more=WEEK) + "SELECT symbol, y AS year, wk AS week, round((v - norm) / nullif(sd, 0), 6) AS z FROM w JOIN n USING (symbol, y, wk)")
def weekly_z(spark, d):  # noqa: ANN001, ANN201
    w = src.weekly_drivers(spark, d).groupBy("symbol", F.extract(F.lit("YEAROFWEEK"), "date").alias("year"), F.least(F.weekofyear("date"), F.lit(52)).alias("week")).agg(F.max_by("value", "date").alias("value"))
    out = panel.prior_years(w, ["symbol"], "year", "week", "value").where("n_years IS NOT NULL")
    return take(out.withColumn("z", scalars.ratio(F.col("value") - F.col("norm"), F.col("norm_sd"))), "symbol year week", "z")


@query("agg_tail_stats", with_sql("drv") +
    "SELECT symbol, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM (SELECT * FROM drv "
    "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 156) GROUP BY symbol")
def tail_stats(spark, d):  # noqa: ANN001, ANN201
    tail = workbench.top_per_group(src.weekly_drivers(spark, d), ["symbol"], [F.desc("date")], 156)
    return take(tail.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")), "symbol n", "mean sd")


US = {"ECONOMY": "production", "LARGE": "imports", "MEDIUM": "exports", "PROMO": "refinery_inputs", "STANDARD": "stocks_total", "SMALL": "stocks_comm"}
RAW = "rw AS (SELECT date, " + ", ".join(f"max(value) FILTER (symbol = '{k}') AS {v}" for k, v in US.items()) + " FROM drv GROUP BY date), rq AS (SELECT *, stocks_total - stocks_comm AS stocks_spr FROM rw)"


@query(
    "ts_us_weekly",
    with_sql("drv", more=RAW + """, br AS (SELECT a.date, a.production / 1000 AS production, a.imports / 1000 AS imports, a.exports / 1000 AS exports, a.refinery_inputs / 1000 AS refinery_inputs, (a.stocks_total - b.stocks_total) / 7000 AS build, (a.stocks_comm - b.stocks_comm) / 7000 AS build_comm, (a.stocks_spr - b.stocks_spr) / 7000 AS build_spr, a.stocks_comm / 1000 AS stocks_comm
    FROM rq a JOIN rq b ON b.date = a.date - 7 WHERE a.production IS NOT NULL AND a.imports IS NOT NULL AND a.exports IS NOT NULL AND a.refinery_inputs IS NOT NULL AND a.stocks_total IS NOT NULL AND b.stocks_total IS NOT NULL), b2 AS (SELECT *, production + imports - exports - refinery_inputs AS modelled_build FROM br)""")
    + "SELECT date, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("production", "imports", "exports", "refinery_inputs", "modelled_build", "build", "build_comm", "build_spr", "stocks_comm")) + ", round(build - modelled_build, 6) + 0.0 AS adjustment FROM b2",
)
def us_weekly(spark, d):  # noqa: ANN001, ANN201
    """Flows, stock changes against exactly seven days before, and what they leave unexplained."""
    raw = src.weekly_drivers(spark, d).groupBy("date").pivot("symbol", list(US)).agg(F.max("value")).withColumnsRenamed(US)
    out = balance.weekly_bridge(raw.withColumn("stocks_spr", F.col("stocks_total") - F.col("stocks_comm")))
    return out.select("date", *((F.round(c, 6) + 0.0).alias(c) for c in out.columns if c != "date"))


STAGES = """rf AS (SELECT p_type AS commodity, c_nationkey AS country, year(l_shipdate)::INT AS year, sum(l_quantity) AS refining FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
rv AS (SELECT p_type AS commodity, n_nationkey AS country, y AS year, sum(p_size * (1 + n_nationkey) * 10.0::DOUBLE) AS reserves FROM part, nation, (SELECT DISTINCT year FROM prod) t(y) WHERE (n_nationkey + y) % 3 > 0 GROUP BY ALL),
wt AS (SELECT commodity, country, year, production, refining, reserves FROM prod FULL JOIN rf USING (commodity, country, year) FULL JOIN rv USING (commodity, country, year)),
ws AS (SELECT *, production / nullif(sum(production) OVER w, 0) AS production_share, refining / nullif(sum(refining) OVER w, 0) AS refining_share, reserves / nullif(sum(reserves) OVER w, 0) AS reserves_share FROM wt WINDOW w AS (PARTITION BY commodity, year))"""


def stages(spark, d):  # noqa: ANN001, ANN201
    """Every commodity, country and year: what is produced, what its customers take (refining), and reserves."""
    key = ["commodity", "country", "year"]
    li, part, o, c = (src.table(spark, d, t) for t in ("lineitem", "part", "orders", "customer"))
    sold = li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    refining = sold.groupBy(F.col("p_type").alias("commodity"), F.col("c_nationkey").alias("country"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("refining"))
    production = src.production(spark, d)
    sizes = part.groupBy(F.col("p_type").alias("commodity")).agg(F.sum("p_size").alias("size"))
    nations, years = src.table(spark, d, "nation").select(F.col("n_nationkey").alias("country")), production.select("year").distinct()
    held = sizes.join(F.broadcast(nations)).join(F.broadcast(years)).where((F.col("country") + F.col("year")) % 3 > 0)  # 25 nations, a row a year
    reserves = held.select(*key, (F.col("size") * (1 + F.col("country")) * 10.0).alias("reserves"))
    return balance.world_table(production, refining, reserves, ["commodity", "year"])


@query("agg_world_table", with_sql("prod", more=STAGES) +
    "SELECT commodity, country, year, round(production, 4) AS production, round(refining, 4) AS refining, round(reserves, 4) AS reserves, "
    "round(production_share, 8) AS production_share, round(refining_share, 8) AS refining_share, round(reserves_share, "
    "8) AS reserves_share, round(reserves / nullif(production, 0), 4) AS reserve_years FROM ws")
def world_table(spark, d):  # noqa: ANN001, ANN201
    t = stages(spark, d)
    return t.select("commodity", "country", "year", *(F.round(c, 4).alias(c) for c in ("production", "refining", "reserves", "reserve_years")), *(F.round(f"{c}_share", 8).alias(f"{c}_share") for c in ("production", "refining", "reserves")))


@query(
    "agg_country_metric",
    with_sql("prod", more=STAGES +
        ", ul AS (SELECT * FROM (UNPIVOT (SELECT commodity, country, year, production_share AS production, refining_share AS refining, "
        "reserves_share AS reserves FROM ws) ON production, refining, reserves INTO NAME stage VALUE share)), bs AS (SELECT commodity, "
        "year, country, max(share) AS share, arg_max(stage, (share, stage)) AS stage FROM ul GROUP BY ALL)")
    +
        "SELECT commodity, year, country, stage, round(share, 6) AS share, row_number() OVER (PARTITION BY commodity, year "
        "ORDER BY share DESC, country)::INT AS place FROM bs QUALIFY place <= 10",
)
def country_metric(spark, d):  # noqa: ANN001, ANN201
    """The ten countries of each commodity and year by the stage they hold most of."""
    named = {f"{c}_share": c for c in ("production", "refining", "reserves")}
    long = stages(spark, d).drop(*named.values()).withColumnsRenamed(named).unpivot(["commodity", "year", "country"], list(named.values()), "stage", "share").where("share IS NOT NULL")
    return take(balance.country_metric(long, ["commodity", "year"]), "commodity year country stage place", "share")


@query("sort_nulls_last", with_sql("px", more="r AS (SELECT ticker, date, close / lag(close, 6) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM px)") + "SELECT ticker, date, round(ret, 6) AS ret FROM r ORDER BY ret DESC NULLS LAST")
def nulls_last(spark, d):  # noqa: ANN001, ANN201
    r = src.monthly_prices(spark, d).withColumn("ret", win.simple_return(F.col("close"), win.series("ticker"), 6))
    return take(workbench.sorted_by(r, "ret", False), "ticker date", "ret")


@query("win_row_number", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS n FROM orders")
def row_number(spark, d):  # noqa: ANN001, ANN201
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return src.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("n"))


@query("agg_family_coverage", with_sql("px", "annual", "bk", more=f"{scores.PRICE}, {scores.VALUE}, {scores.QUALITY}, {scores.COMPOSITE}") +
    "SELECT as_of, count(*) AS n, count(m) AS momentum, count(v) AS value, count(q) AS quality, count(composite) AS ranked FROM comp "
    "GROUP BY as_of")
def family_coverage(spark, d):  # noqa: ANN001, ANN201
    return scores._scored(spark, d).groupBy("as_of").agg(F.count("*").alias("n"), F.count("score_momentum").alias("momentum"), F.count("score_value").alias("value"), F.count("score_quality").alias("quality"), F.count("composite").alias("ranked"))


def _recent(spark, d):  # noqa: ANN001, ANN202
    """ticker, basket, r3: return over the last three months of each name's prices."""
    return panel.returns_summary(src.monthly_prices(spark, d), "ticker", "date", "close", {"r3": 3}).select("ticker", "r3").join(src.baskets(spark, d), "ticker")


R3 = (
    "lp AS (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back "
    "FROM px), r3 AS (SELECT ticker, basket, super_basket, max(close) FILTER (back = 1) / max(close) FILTER (back = 4) - 1 AS r3 FROM lp "
    "JOIN bk USING (ticker) GROUP BY ALL)"
)
RESID = (
    f"{basket_plans.RB}, {basket_plans.LOO}, {basket_plans.FIT}, rs AS (SELECT ticker, ret - alpha - beta * loo AS res, "
    f"row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM bt "
    f"JOIN fit USING (ticker)), rz AS (SELECT ticker, sum(res) FILTER (back <= 12) / (stddev_samp(res) * sqrt(12)) AS z FROM rs "
    f"GROUP BY ticker)"
)


def _signal_sql(kind: str, measure: str, limit: float, scale: str, side: str) -> str:
    return f"SELECT node, '{kind}' AS type, coalesce(abs({measure}) > {limit}, false) AS firing, round(CASE WHEN {measure} IS NULL THEN 0 ELSE least(abs({measure}) / {scale}, 1) END, 5) AS score, CASE WHEN coalesce(abs({measure}) > {limit}, false) THEN sign({side})::INT ELSE 0 END AS direction FROM w"


NODE = f"""{RESID}, {R3}, {basket_plans.WEEKLY}, {basket_plans.PARTS},
bm1 AS (SELECT basket AS g, date, avg(ret) AS y FROM rb GROUP BY ALL), mk1 AS (SELECT date, avg(ret) AS x FROM rb GROUP BY ALL), bx1 AS (SELECT g, date, y, x FROM bm1 JOIN mk1 USING (date) WHERE y IS NOT NULL AND x IS NOT NULL),
rb1 AS (SELECT g, date, CASE WHEN count(*) OVER w = 24 THEN covar_samp(y, x) OVER w / nullif(var_samp(x) OVER w, 0) END AS beta FROM bx1 WINDOW w AS (PARTITION BY g ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
rg1 AS (SELECT g, coalesce((arg_max(beta, date) - avg(beta)) / nullif(stddev_samp(beta), 0), 0) AS z FROM rb1 WHERE beta IS NOT NULL GROUP BY g HAVING count(*) >= 30),
pp AS (SELECT a.g AS a, b.g AS b, a.date, a.y - b.y AS spread FROM bx1 a JOIN bx1 b ON a.date = b.date AND b.g = a.g + 1), pc1 AS (SELECT *, sum(spread) OVER (PARTITION BY a, b ORDER BY date) AS cum FROM pp),
pz1 AS (SELECT a, b, date, CASE WHEN count(*) OVER w = 12 THEN coalesce((cum - avg(cum) OVER w) / nullif(stddev_samp(cum) OVER w, 0), 0) END AS z FROM pc1 WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
pl1 AS (SELECT a, b, arg_max(z, date) AS z FROM pz1 WHERE z IS NOT NULL GROUP BY a, b), ps AS (SELECT a AS node, -z AS z, b AS other FROM pl1 UNION ALL SELECT b, z, a FROM pl1),
pw AS (SELECT node, arg_max(z, (abs(z), -other)) AS pair_z FROM ps GROUP BY node),
st1 AS (SELECT basket AS node, count(*) FILTER (abs(z) > 1.5) AS n_stretched, count(*) FILTER (z > 1.5) - count(*) FILTER (z < -1.5) AS balance, greatest(2, 0.2 * count(*)) AS scale FROM bk LEFT JOIN rz USING (ticker) GROUP BY basket),
mo AS (SELECT basket AS node, avg(r3) AS momentum FROM r3 GROUP BY basket), gp AS (SELECT entity AS node, idio AS gap FROM att WHERE span = '1m'), ds AS (SELECT entity AS node, abs(idio) / nullif(abs(factor) + abs(idio), 0) AS dispersion FROM att WHERE span = '3m'),
w AS (SELECT st1.*, pair_z, gap, rg1.z AS regime_z, dispersion, momentum FROM st1 LEFT JOIN pw USING (node) LEFT JOIN gp USING (node) LEFT JOIN rg1 ON rg1.g = node LEFT JOIN ds USING (node) LEFT JOIN mo USING (node))"""


@query(
    "pipe_basket_signals",
    with_sql("px", "bk", "drv", more=NODE)
    + " UNION ALL ".join(_signal_sql(*x) for x in (("pair", "pair_z", 1.5, "3.0", "pair_z"), ("residual", "n_stretched", 1.5, "scale", "balance"), ("gap", "gap", 0.02, "0.15", "-gap"), ("regime", "regime_z", 2.0, "4.0", "0"), ("dispersion", "dispersion", 0.5, "1.0", "0"), ("momentum", "momentum", 0.1, "0.3", "momentum"))).replace("SELECT node,", "SELECT node AS basket,"),
)
def basket_signals(spark, d):  # noqa: ANN001, ANN201
    """All six signals of every nation at its last date."""
    r = basket_plans.returns(spark, d)
    means = r.groupBy(F.col("basket").alias("ticker"), "date").agg(F.avg("ret").alias("ret")).where("ret IS NOT NULL")
    pairs = means.select(F.col("ticker").alias("a")).distinct().withColumn("b", F.col("a") + 1)  # neighbours; b may not exist
    spreads = baskets.pair_spreads(means, pairs, 12, 24).where("z IS NOT NULL").groupBy("a", "b").agg(F.max_by("z", "date").alias("z"))
    # The side to buy is the one that lags: a where the spread is low.
    sides = spreads.select(F.col("a").alias("basket"), (-F.col("z")).alias("z"), F.col("b").alias("other")).union(spreads.select("b", "z", "a"))
    pair = sides.groupBy("basket").agg(F.max_by("z", F.struct(F.abs("z"), -F.col("other"))).alias("pair_z"))
    z = baskets.single_factor(r, 40, 12, 3)[1].select("ticker", F.col("z_12").alias("z"))
    count = lambda hit: F.count(F.when(hit, 1))
    stretched = src.baskets(spark, d).join(z, "ticker", "left").groupBy("basket").agg(
        count(F.abs("z") > 1.5).alias("n_stretched"), (count(F.col("z") > 1.5) - count(F.col("z") < -1.5)).alias("stretch_balance"), F.greatest(F.lit(2.0), F.count("*") * 0.2).alias("stretch_scale")
    )
    both = means.withColumnRenamed("ret", "y").join(r.groupBy("date").agg(F.avg("ret").alias("x")), "date").withColumnRenamed("ticker", "basket")
    betas = both.withColumn("beta", win.rolling_beta(F.col("y"), F.col("x"), win.series("basket"), 24))
    regime = baskets.regimes(betas, ["basket"], 30).select("basket", F.col("z").alias("regime_z"))
    parts = stored(basket_plans.dispersed(spark, d).withColumnRenamed("entity", "basket"), "signal-parts")
    gap = parts.where("window = '1m'").select("basket", F.col("idio").alias("gap"))
    dispersion = parts.where("window = '3m'").select("basket", "dispersion")
    momentum = _recent(spark, d).groupBy("basket").agg(F.avg("r3").alias("momentum"))
    wide = stretched
    for more in (pair, gap, regime, dispersion, momentum):
        wide = wide.join(more, "basket", "left")
    return signals.stack(wide, ["basket"], signals.BASKET_SIGNALS).withColumn("score", F.round("score", 5))


# A name's idiosyncratic part: what its basket and the driver model of the basket's nation don't explain over 13 weeks.
STOCK = f"""{RESID}, {R3}, sw0 AS (SELECT l_suppkey AS ticker, (l_shipdate::DATE + ((5 - dayofweek(l_shipdate) + 7) % 7)::INT)::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS level FROM lineitem GROUP BY ALL),
sw AS (SELECT ticker, date, ln(level / lag(level) OVER (PARTITION BY ticker ORDER BY date)) AS ret FROM sw0), {basket_plans.WEEKLY},
bl AS (SELECT * FROM (UNPIVOT (SELECT entity, {", ".join(f"beta_{x} AS {x}" for x in basket_plans.XS)} FROM ols) ON {", ".join(basket_plans.XS)} INTO NAME symbol VALUE beta)),
sb AS (SELECT ticker, basket, date, ret FROM sw JOIN bk USING (ticker) WHERE ret IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 13),
sa AS (SELECT ticker, sum(ret) AS actual FROM sb GROUP BY ticker), sf AS (SELECT ticker, sum(b.beta * change) AS factor FROM sb JOIN dr USING (date) JOIN bl b ON b.entity = basket AND b.symbol = dr.symbol GROUP BY ticker),
md AS (SELECT a.ticker, a.r3, list_sort(list(b.r3)) AS peers FROM r3 a JOIN r3 b ON a.basket = b.basket AND a.ticker <> b.ticker WHERE a.r3 IS NOT NULL AND b.r3 IS NOT NULL GROUP BY ALL),
w AS (SELECT bk.ticker AS node, z, CASE WHEN factor IS NOT NULL THEN abs(actual - factor) / nullif(abs(factor) + abs(actual - factor), 0) END AS dispersion, CASE WHEN len(peers) >= 3 THEN md.r3 - peers[len(peers) // 2 + 1] END AS gap FROM bk LEFT JOIN rz USING (ticker) LEFT JOIN sa USING (ticker) LEFT JOIN sf USING (ticker) LEFT JOIN md USING (ticker))"""


@query(
    "pipe_stock_signals",
    with_sql("px", "bk", "drv", more=STOCK) + " UNION ALL ".join(_signal_sql(*x) for x in (("residual", "z", 1.5, "3.0", "-z"), ("attribution", "dispersion", 0.6, "1.0", "0"), ("peer", "gap", 0.1, "0.3", "gap"))).replace("SELECT node,", "SELECT node AS ticker,"),
)
def stock_signals(spark, d):  # noqa: ANN001, ANN201
    """All three signals of every name at its last date."""
    z = baskets.single_factor(basket_plans.returns(spark, d), 40, 12, 3)[1].select("ticker", F.col("z_12").alias("residual_z"))
    li = src.table(spark, d, "lineitem")
    own = li.groupBy(F.col("l_suppkey").alias("ticker"), scalars.friday(F.to_date("l_shipdate")).alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("level"))
    own = own.withColumn("ret", win.log_return(F.col("level"), win.series("ticker"))).join(src.baskets(spark, d), "ticker")
    fits = basket_plans._fits(spark, d)
    betas = fits.select(F.col("entity").alias("basket"), F.explode(F.array(*(F.struct(F.lit(x).alias("symbol"), F.col(f"beta_{x}").alias("beta")) for x in basket_plans.XS))).alias("b")).select("basket", "b.*")
    named = src.baskets(spark, d).join(betas, "basket").select(F.col("ticker").alias("entity"), "symbol", "beta")
    returns = own.select(F.col("ticker").alias("entity"), "date", "ret")
    span = {"3m": 13}
    parts = baskets.contributions(returns, series.drivers(spark, d).select("symbol", "date", "change"), named, span)
    share = baskets.dispersion(baskets.attribution(returns, parts, span)).where("top_driver IS NOT NULL").select(F.col("entity").alias("ticker"), "dispersion")
    # The median of a name's peers from its place among all of its basket: one sort of each basket, no pairs.
    r3 = _recent(spark, d).where("r3 IS NOT NULL")
    basket = Window.partitionBy("basket")
    placed = r3.withColumns({"i": F.row_number().over(basket.orderBy("r3", "ticker")) - 1, "n": F.count("*").over(basket)})
    middle = F.floor((F.col("n") - 1) / 2)
    spots = placed.groupBy("basket").agg(F.max(F.when(F.col("i") == middle, F.col("r3"))).alias("low"), F.max(F.when(F.col("i") == middle + 1, F.col("r3"))).alias("high"))
    median = F.when(F.col("i") > middle, F.col("low")).otherwise(F.col("high"))
    gap = placed.join(spots, "basket").where("n >= 4").select("ticker", (F.col("r3") - median).alias("peer_gap"))
    wide = src.baskets(spark, d).select("ticker")
    for more in (z, share, gap):
        wide = wide.join(more, "ticker", "left")
    return signals.stack(wide, ["ticker"], signals.STOCK_SIGNALS).withColumn("score", F.round("score", 5))


@query(
    "join_consolidate",
    with_sql("px", "bk", "drv", more=
        f"{RESID}, {basket_plans.WEEKLY}, {basket_plans.PARTS}, lst AS (SELECT ticker, arg_max(close, date) AS last FROM px "
        f"GROUP BY ticker)")
    +
        "SELECT bk.ticker, bk.basket, n_name, fit.n_obs, round(last, 6) AS last, round(fit.beta, 6) AS beta, round(fit.r2, 6) AS r2, "
        "round(rz.z, 5) AS residual_z, round(a3.actual, 6) AS basket_actual, round(a3.factor, 6) AS basket_factor, round(a1.idio, "
        "6) AS implied_gap, "
        + ", ".join(f"round(ols.beta_{x}, 6) AS load_{x}" for x in basket_plans.XS)
    +
        " FROM bk LEFT JOIN nation ON n_nationkey = basket LEFT JOIN fit ON bk.ticker = fit.ticker LEFT JOIN rz ON bk.ticker = rz.ticker "
        "LEFT JOIN lst ON bk.ticker = lst.ticker LEFT JOIN att a3 ON a3.entity = basket AND a3.span = '3m' LEFT "
        "JOIN att a1 ON a1.entity = basket AND a1.span = '1m' LEFT JOIN ols ON ols.entity = basket",
)
def consolidate(spark, d):  # noqa: ANN001, ANN201
    """One wide row per name: basket, its own fit and residual, last price, and its basket's attribution over three months, gap
    between what drivers imply and what was over one, and loadings."""
    last = src.monthly_prices(spark, d).groupBy("ticker").agg(F.max_by("close", "date").alias("last"))
    fit, z = baskets.single_factor(basket_plans.returns(spark, d), 40, 12, 3)
    n = src.table(spark, d, "nation").select(F.col("n_nationkey").alias("basket"), "n_name")
    parts = stored(basket_plans.dispersed(spark, d).withColumnRenamed("entity", "basket"), "consolidated-parts")
    quarter = parts.where("window = '3m'").select("basket", F.col("actual").alias("basket_actual"), F.col("factor").alias("basket_factor"))
    month = parts.where("window = '1m'").select("basket", F.col("idio").alias("implied_gap"))
    loads = basket_plans._fits(spark, d).select(F.col("entity").alias("basket"), *(F.col(f"beta_{x}").alias(f"load_{x}") for x in basket_plans.XS))
    wide = src.baskets(spark, d).join(fit, "ticker", "left").join(z.select("ticker", F.round("z_12", 5).alias("residual_z")), "ticker", "left").join(last, "ticker", "left")
    for more in (n, quarter, month, loads):
        wide = wide.join(F.broadcast(more), "basket", "left")  # a row a basket
    return take(wide, "ticker basket n_name n_obs residual_z", "last beta r2 basket_actual basket_factor implied_gap " + " ".join(f"load_{x}" for x in basket_plans.XS))


@query("pipe_dispersion", with_sql("drv", more=f"{basket_plans.WEEKLY}, {basket_plans.PARTS}") +
    'SELECT entity, span AS "window", round(abs(idio) / nullif(abs(factor) + abs(idio), 0), 6) AS dispersion FROM att '
    'ORDER BY dispersion DESC')
def dispersion(spark, d):  # noqa: ANN001, ANN201
    return take(basket_plans.dispersed(spark, d), "entity window", "dispersion").orderBy(F.desc("dispersion"))


@query("src_prices_csv", "SELECT 'EVENTS' AS ticker, ts::DATE AS date, round(max(value), 4) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ts::DATE")
def prices_csv(spark, d):  # noqa: ANN001, ANN201
    """A price file with a bad row and a missing volume, read back."""
    path = scratch_path(spark, "prices-csv")
    e = src.table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.round(F.max("value"), 4).alias("close"), F.count("*").alias("n"))
    rows = e.select(F.col("date").cast("string").alias("date"), *(F.col("close").cast("string").alias(c) for c in ("open", "high", "low", "close")), F.col("n").cast("string").alias("volume"))
    rows.unionByName(rows.limit(1).withColumn("date", F.lit("not a date"))).write.csv(path, header=True)
    return readers.prices_csv(spark, path).select(F.lit("EVENTS").alias("ticker"), "date", "close", "volume")


@query("src_json_dir", "SELECT count(DISTINCT p_brand) AS n, sum(p_size)::BIGINT AS size FROM part")
def json_dir(spark, d):  # noqa: ANN001, ANN201
    """A folder of JSON files, one of each part of the table."""
    path = scratch_path(spark, "json-dir")
    src.table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_size").alias("size")).write.json(path)
    docs = readers.json_documents(spark, path)
    rows = docs.select(F.explode(F.split("payload", "\n")).alias("line")).where("line <> ''").select(F.from_json("line", "p_brand string, size long").alias("x"))
    return rows.agg(F.count_distinct("x.p_brand").alias("n"), F.sum("x.size").alias("size"))


@query("fn_math",
    "SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 6) AS ln, round(exp(-l_discount), 6) AS exp, round(sqrt(l_quantity), "
    "6) AS sqrt, floor(l_extendedprice)::BIGINT AS floor, round(pow(l_tax, 2), 8) AS pow, least(greatest(l_quantity, 5), 40) AS clip, "
    "sign(l_quantity - 25)::DOUBLE AS sign FROM lineitem")
def math(spark, d):  # noqa: ANN001, ANN201
    q = F.col("l_quantity")
    return src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.ln(q), 6).alias("ln"), F.round(F.exp(-F.col("l_discount")), 6).alias("exp"), F.round(F.sqrt(q), 6).alias("sqrt"), F.floor("l_extendedprice").alias("floor"), F.round(F.pow("l_tax", F.lit(2)), 8).alias("pow"), scalars.clip(q, 5.0, 40.0).alias("clip"), F.signum(q - 25).alias("sign"))


@query("fn_string",
    "SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, c_name LIKE '%1' AS ends, split_part(c_name, '#', 2) AS tail, "
    "regexp_replace(c_name, '[0-9]+', 'N') AS masked FROM customer")
def strings(spark, d):  # noqa: ANN001, ANN201
    n = F.col("c_name")
    return src.table(spark, d, "customer").select("c_custkey", F.upper(n).alias("up"), F.lower("c_mktsegment").alias("low"), F.endswith(n, F.lit("1")).alias("ends"), F.split_part(n, F.lit("#"), F.lit(2)).alias("tail"), F.regexp_replace(n, "[0-9]+", "N").alias("masked"))


@query("fn_array",
    "SELECT o_custkey, count(*) AS n, list_sort(list(DISTINCT o_orderpriority))[1] AS first, list_contains(list(o_orderpriority), "
    "'1-URGENT') AS urgent, len(list_filter(list(o_totalprice), lambda x: x > 150000)) AS large FROM orders GROUP BY o_custkey")
def arrays(spark, d):  # noqa: ANN001, ANN201
    a = src.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_list("o_orderpriority").alias("p"), F.collect_list("o_totalprice").alias("t"))
    return a.select("o_custkey", "n", F.array_min(F.array_distinct("p")).alias("first"), F.array_contains("p", "1-URGENT").alias("urgent"), F.size(F.filter("t", lambda x: x > 150000)).cast("long").alias("large"))


@query("fn_horizontal",
    "SELECT p_partkey, round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 6) AS mean, "
    "(a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS n, round((coalesce(a, 0) * 0.7 + coalesce(b, "
    "0) * 0.3) / nullif((a IS NOT NULL)::INT * 0.7 + (b IS NOT NULL)::INT * 0.3, 0), 6) AS weighted FROM (SELECT p_partkey, "
    "CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS a, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS b FROM part)")
def horizontal(spark, d):  # noqa: ANN001, ANN201
    k = F.col("p_partkey")
    p = src.table(spark, d, "part").withColumns({"a": F.when(k % 2 == 0, F.col("p_retailprice")), "b": F.when(k % 3 == 0, F.col("p_size").cast("double"))})
    a, b = F.col("a"), F.col("b")
    return take(p.withColumns({"mean": scalars.mean_of(a, b), "n": scalars.count_of(a, b), "weighted": scalars.weighted_mean([(a, 0.7), (b, 0.3)])}), "p_partkey n", "mean weighted")
