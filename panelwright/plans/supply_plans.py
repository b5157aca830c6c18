"""Balances, concentration, trade and sites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import scalars
from panelwright.operators import balance, panel
from panelwright.sources import panels as src
from panelwright.sources.panels import with_sql

from .registry import query, sql_take, take


def _blocs(spark):  # noqa: ANN001, ANN202
    rows = [("consumer", "ECONOMY", 1), ("consumer", "SMALL", 1), ("net", "LARGE", 1), ("net", "PROMO", -1)]
    return spark.createDataFrame(rows, "bloc string, series string, sign int")


BLOC = (
    "bs AS (SELECT * FROM (VALUES ('consumer', 'ECONOMY', 1), ('consumer', 'SMALL', 1), ('net', 'LARGE', 1), ('net', 'PROMO', "
    "-1)) v(bloc, series, sign)), ms AS (SELECT symbol AS series, last_day(date) AS month, sum(value) AS value FROM drv "
    "GROUP BY ALL), bl AS (SELECT bloc, month, CASE WHEN count(value) = max(need) THEN sum(sign * value) END AS value FROM bs "
    "JOIN ms USING (series) JOIN (SELECT bloc, count(*) AS need FROM bs GROUP BY bloc) USING (bloc) GROUP BY ALL)"
)


def _monthly(spark, d):  # noqa: ANN001, ANN202
    return src.weekly_drivers(spark, d).groupBy(F.col("symbol").alias("series"), F.last_day("date").alias("month")).agg(F.sum("value").alias("value"))


def _bloc_months(spark, d):  # noqa: ANN001, ANN202
    return balance.bloc_sums(_monthly(spark, d), _blocs(spark), ["month"])


@query("agg_bloc_sum", with_sql("drv", more=BLOC) + sql_take("bl", "bloc month", "value"))
def bloc_sum(spark, d):  # noqa: ANN001, ANN201
    return take(_bloc_months(spark, d), "bloc month", "value")


@query("class_status", with_sql("drv", more=BLOC) +
    "SELECT bloc, month, CASE WHEN month <= DATE '1997-12-31' AND month <= DATE '1998-03-31' THEN 'hist' WHEN month <= DATE '1997-12-31' "
    "OR month <= DATE '1998-03-31' THEN 'est' ELSE 'fcst' END AS status FROM bl")
def statuses(spark, d):  # noqa: ANN001, ANN201
    day = lambda x: F.lit(x).cast("date")
    return _bloc_months(spark, d).select("bloc", "month", balance.status(F.col("month"), day("1997-12-31"), day("1998-03-31")).alias("status"))


@query("agg_variance_bridge", with_sql("drv", more=BLOC) +
    "SELECT bloc, round(now, 6) AS now, round(base, 6) AS base, round((now - base) * "
    "CASE WHEN bloc = 'net' THEN -1 ELSE 1 END, 6) AS delta FROM (SELECT bloc, avg(value) FILTER (year(month) = 1998) AS now, "
    "avg(value) FILTER (year(month) = 1997) AS base FROM bl GROUP BY bloc)")
def bridge(spark, d):  # noqa: ANN001, ANN201
    sign = F.when(F.col("bloc") == "net", -1).otherwise(1)
    return take(balance.variance_bridge(_bloc_months(spark, d), F.year("month") == 1998, F.year("month") == 1997, sign), "bloc", "now base delta")


STOCK = (
    "pv AS (SELECT a.month, a.value AS observed, b.value AS implied, year(a.month)::INT AS y FROM bl a "
    "JOIN bl b ON a.month = b.month AND a.bloc = 'consumer' AND b.bloc = 'net'), fm AS (SELECT y, regr_slope(observed, implied) AS slope, "
    "regr_intercept(observed, implied) AS intercept, sqrt(greatest(regr_syy(observed, implied) - regr_slope(observed, "
    "implied) * regr_sxy(observed, implied), 0) / (count(*) - 2)) AS sigma, count(*) AS n FROM pv "
    "WHERE observed IS NOT NULL AND implied IS NOT NULL GROUP BY y HAVING count(*) >= 3)"
)


@query("agg_stock_model", with_sql("drv", more=f"{BLOC}, {STOCK}") + sql_take("fm", "y n", "slope intercept sigma"))
def stock_model(spark, d):  # noqa: ANN001, ANN201
    b = _bloc_months(spark, d)
    both = b.where("bloc = 'consumer'").select("month", F.col("value").alias("observed")).join(b.where("bloc = 'net'").select("month", F.col("value").alias("implied")), "month")
    return take(balance.stock_model(both.withColumn("y", F.year("month")), ["y"], "observed", "implied"), "y n", "slope intercept sigma")


@query("win_projection_band", with_sql("drv", more=BLOC) +
    "SELECT bloc, month, round(100 + sum(value * 0.001 * day(last_day(month))) OVER w, 6) AS level, "
    "round(sqrt(sum(pow(0.1 * day(last_day(month)), 2)) OVER w), 6) AS band FROM bl WHERE month > DATE '1998-06-30' AND value IS NOT NULL "
    "WINDOW w AS (PARTITION BY bloc ORDER BY month)")
def band(spark, d):  # noqa: ANN001, ANN201
    later = _bloc_months(spark, d).where("month > DATE '1998-06-30' AND value IS NOT NULL")
    days = scalars.days_in_month(F.col("month"))
    return take(balance.projection_band(later, ["bloc"], "month", F.col("value") * 0.001, F.lit(0.1), days, F.lit(100.0)), "bloc month", "level band")


SERIES = {"ECONOMY": "supply", "LARGE": "demand", "MEDIUM": "stocks"}
BALANCE = """mm AS (SELECT last_day(l_shipdate::DATE) AS month, sum(l_quantity) FILTER (p_type = 'ECONOMY') AS supply, sum(l_quantity) FILTER (p_type = 'LARGE') AS demand, sum(l_quantity) FILTER (p_type = 'MEDIUM') AS stocks, max(l_extendedprice) FILTER (p_type = 'PROMO') AS brent, max(l_extendedprice) FILTER (p_type = 'SMALL') AS wti FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


@query(
    "ts_balance_month",
        f"WITH {BALANCE}, mj AS (SELECT a.*, a.supply - a.demand AS implied, (a.stocks - b.stocks) / day(a.month) AS build FROM mm a LEFT "
        f"JOIN mm b ON last_day((date_trunc('month', b.month) + INTERVAL 1 MONTH)::DATE) = a.month "
        f"WHERE a.supply IS NOT NULL AND a.demand IS NOT NULL) "
        "SELECT month, round(supply, 3) AS supply, round(demand, 3) AS demand, round(implied, 3) AS implied, round(stocks, 1) AS stocks, "
        "round(build, 3) + 0.0 AS build, round(implied - build, 3) + 0.0 AS unexplained, round(brent, 2) AS brent, round(wti, 2) AS wti, "
        "CASE WHEN month <= DATE '1998-12-31' THEN 'hist' WHEN month <= DATE '2000-06-30' THEN 'est' ELSE 'fcst' END AS status FROM mj",
)
def balance_month(spark, d):  # noqa: ANN001, ANN201
    """Supply, demand, stocks and what they don't explain, prices and status of every month."""
    li = src.table(spark, d, "lineitem").join(src.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    of = lambda how, kind, c: how(F.when(F.col("p_type") == kind, F.col(c)))
    wide = li.groupBy(F.last_day(F.to_date("l_shipdate")).alias("month")).agg(*(of(F.sum, k, "l_quantity").alias(n) for k, n in SERIES.items()), *(of(F.max, k, "l_extendedprice").alias(n) for k, n in (("PROMO", "brent"), ("SMALL", "wti"))))
    day = lambda x: F.lit(x).cast("date")
    out = balance.monthly_balance(wide, day("2000-06-30"), day("1998-12-31"))
    places = {"supply": 3, "demand": 3, "implied": 3, "stocks": 1, "build": 3, "unexplained": 3, "brent": 2, "wti": 2}
    return out.select("month", "status", *((F.round(c, n) + 0.0).alias(c) for c, n in places.items()))


@query(
    "agg_concentration",
    with_sql("prod", more=
        "sh AS (SELECT *, production / sum(production) OVER w AS share, row_number() OVER (PARTITION BY commodity, year "
        "ORDER BY production DESC, country) AS r FROM prod WHERE production > 0 "
        "WINDOW w AS (PARTITION BY commodity, year)), cc AS (SELECT commodity, year, count(*) AS n, sum(production) AS total, "
        "sum(pow(100 * share, 2)) AS hhi, sum(share) FILTER (r <= 3) AS top3 FROM sh "
        "GROUP BY ALL), rs AS (SELECT p_type AS commodity, sum(p_size) * 1000.0 AS reserves FROM part GROUP BY ALL)")
    +
        "SELECT a.commodity, a.year, a.n, round(a.total, 4) AS total, round(a.hhi, 6) AS hhi, round(a.top3, 6) AS top3, "
        "round(a.total / b.total - 1, 6) + 0.0 AS yoy, round(reserves / a.total, 4) AS reserve_years FROM cc a LEFT "
        "JOIN cc b ON a.commodity = b.commodity AND b.year = a.year - 1 LEFT JOIN rs ON a.commodity = rs.commodity",
)
def concentration(spark, d):  # noqa: ANN001, ANN201
    """Holders' concentration, change of the total on the year before and the years that reserves last."""
    reserves = src.table(spark, d, "part").groupBy(F.col("p_type").alias("commodity")).agg((F.sum("p_size") * 1000.0).alias("reserves"))
    out = balance.with_outlook(balance.concentration(src.production(spark, d), ["commodity", "year"]), reserves, ["commodity"])
    return out.select("commodity", "year", "n", F.round("total", 4).alias("total"), F.round("hhi", 6).alias("hhi"), F.round("top3", 6).alias("top3"), (F.round("yoy", 6) + 0.0).alias("yoy"), F.round("reserve_years", 4).alias("reserve_years"))


@query("agg_topn_other", with_sql("prod", more="r AS (SELECT *, row_number() OVER (PARTITION BY commodity, year ORDER BY production DESC, country) AS k FROM prod)") +
    "SELECT commodity, year, CASE WHEN k <= 5 THEN country::VARCHAR ELSE 'OTH' END AS holder, round(sum(production), 4) AS production "
    "FROM r GROUP BY ALL")
def topn_other(spark, d):  # noqa: ANN001, ANN201
    return take(balance.top_and_other(src.production(spark, d), ["commodity", "year"], 5), "commodity year holder", "production", 4)


MIRROR = (
    "mt AS (SELECT *, sum(value) OVER (PARTITION BY commodity, src) AS total FROM trade "
    "WHERE src <> dst AND value > 0), mp AS (SELECT *, value / total AS share, row_number() OVER (PARTITION BY commodity, src "
    "ORDER BY value DESC, dst) AS place FROM mt WHERE total >= 20000)"
)


@query("agg_mirror_trade", with_sql("trade", more=MIRROR) + "SELECT commodity, src, dst, place::INT AS place, round(share, 6) AS share FROM mp WHERE place <= 4 AND share >= 0.03")
def mirror(spark, d):  # noqa: ANN001, ANN201
    return take(balance.mirror_trade(src.trade(spark, d), 20000.0, 0.03, 4), "commodity src dst place", "share")


@query("agg_outage", with_sql("prod") +
    "SELECT commodity, year, round(coalesce(sum(production) FILTER (country = 3), 0) * 0.4 / sum(production), 6) AS lost_share, "
    "round(coalesce(sum(production) FILTER (country = 3), 0) * 0.4 / (sum(production) - coalesce(sum(production) FILTER (country = 3), "
    "0)), 6) AS uplift FROM prod GROUP BY ALL")
def outage(spark, d):  # noqa: ANN001, ANN201
    return take(balance.outage(src.production(spark, d), F.col("country") == 3, 40.0, ["commodity", "year"]), "commodity year", "lost_share uplift")


@query("agg_latest_covered_year", with_sql("prod") +
    "SELECT commodity, max(year) AS year FROM (SELECT commodity, year FROM prod GROUP BY ALL HAVING count(DISTINCT country) >= 20) "
    "GROUP BY commodity")
def covered_year(spark, d):  # noqa: ANN001, ANN201
    return balance.latest_covered_year(src.production(spark, d), ["commodity"], 20)


VIA = "rt AS (SELECT commodity, value AS volume, [src % 4, dst % 4, 4] AS via FROM trade)"


@query("agg_chokepoint", with_sql("trade", more=VIA) +
    "SELECT commodity, point, round(sum(volume), 2) AS volume, round(sum(volume) / max(total), 6) AS share "
    "FROM (SELECT commodity, volume, unnest(list_distinct(via)) AS point FROM rt) JOIN (SELECT commodity, sum(volume) AS total FROM rt "
    "GROUP BY commodity) USING (commodity) GROUP BY ALL")
def chokepoint(spark, d):  # noqa: ANN001, ANN201
    routes = src.trade(spark, d).select("commodity", F.col("value").alias("volume"), F.array(F.pmod("src", F.lit(4)), F.pmod("dst", F.lit(4)), F.lit(4)).alias("via"))
    out = balance.chokepoints(routes)
    return out.select("commodity", "point", F.round("volume", 2).alias("volume"), F.round("share", 6).alias("share"))


@query("agg_route_share", with_sql("trade") + "SELECT commodity, src, dst, round(value / sum(value) OVER (PARTITION BY commodity), 8) AS share FROM trade")
def route_share(spark, d):  # noqa: ANN001, ANN201
    return take(balance.with_shares(src.trade(spark, d), ["commodity"], "value"), "commodity src dst", "share", 8)


@query("agg_country_sheet", with_sql("prod", "trade") +
    "SELECT country, commodity, round(sum(produced), 2) AS produced, round(sum(sent), 2) AS sent, round(sum(got), 2) AS got, "
    "round(sum(produced) + sum(got) - sum(sent), 2) + 0.0 AS consumption, round(sum(sent) - sum(got), 2) AS net "
    "FROM (SELECT country, commodity, production AS produced, 0 AS sent, 0 AS got FROM prod UNION ALL SELECT src, commodity, 0, value, 0 "
    "FROM trade UNION ALL SELECT dst, commodity, 0, 0, value FROM trade) GROUP BY ALL")
def country_sheet(spark, d):  # noqa: ANN001, ANN201
    p, t = src.production(spark, d), src.trade(spark, d)
    zero = F.lit(0.0)
    every = p.select("country", "commodity", F.col("production").alias("produced"), zero.alias("sent"), zero.alias("got"))
    every = every.unionByName(t.select(F.col("src").alias("country"), "commodity", zero.alias("produced"), F.col("value").alias("sent"), zero.alias("got")))
    every = every.unionByName(t.select(F.col("dst").alias("country"), "commodity", zero.alias("produced"), zero.alias("sent"), F.col("value").alias("got")))
    sums = every.groupBy("country", "commodity").agg(F.sum("produced").alias("produced"), F.sum("sent").alias("sent"), F.sum("got").alias("got"))
    made = {"net": F.col("sent") - F.col("got"), "consumption": F.col("produced") + F.col("got") - F.col("sent")}
    return take(sums.withColumns(made), "country commodity", "produced sent got net consumption", 2)


SITES = (
    "st AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 3600) / 100.0 AS lon, (s_suppkey * 53 % 1800) / 100.0 AS lat, "
    "'k' || (s_nationkey % 2) AS kind, 'c' || (s_nationkey % 3) AS commodity, s_acctbal AS capacity FROM supplier)"
)


def _sites(spark, d):  # noqa: ANN001, ANN202
    s = src.table(spark, d, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return s.select(k.alias("id"), (F.pmod(k * 37, F.lit(3600)) / 100).alias("lon"), (F.pmod(k * 53, F.lit(1800)) / 100).alias("lat"), F.concat(F.lit("k"), n % 2).alias("kind"), F.concat(F.lit("c"), n % 3).alias("commodity"), F.col("s_acctbal").alias("capacity"))


@query("join_anti_near", with_sql("bk", more=SITES) +
    "SELECT id, kind, lon, lat FROM st a WHERE id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM st b "
    "WHERE b.id % 5 = 0 AND a.kind = b.kind AND sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) <= 2)")
def anti_near(spark, d):  # noqa: ANN001, ANN201
    s = _sites(spark, d)
    return balance.near_curated(s.where("id % 5 <> 0"), s.where("id % 5 = 0"), 2.0).select("id", "kind", "lon", "lat")


@query(
    "agg_site_dedup",
    with_sql("bk", more=SITES +
        ", b AS (SELECT round(lon / 3.0) AS cx, round(lat / 3.0) AS cy, kind, commodity, max(capacity) AS capacity, arg_max(id, "
        "(capacity, id)) AS id FROM st GROUP BY ALL)")
    +
        "SELECT kind, arg_max(id, (capacity, id)) AS id, round(max(capacity), 2) AS capacity, "
        "array_to_string(list_sort(list(DISTINCT commodity)), ',') AS also FROM b GROUP BY cx, cy, kind",
)
def site_dedup(spark, d):  # noqa: ANN001, ANN201
    out = balance.site_dedup(_sites(spark, d), 3.0)
    every = F.array_sort(F.concat("also", F.array("commodity")))
    return out.select("kind", "id", F.round("capacity", 2).alias("capacity"), F.array_join(every, ",").alias("also"))


@query("agg_shared_capacity",
    "SELECT p_partkey, p_brand, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_type, p_size) < 2 THEN p_retailprice END AS capacity "
    "FROM part")
def shared(spark, d):  # noqa: ANN001, ANN201
    p = src.table(spark, d, "part").withColumn("capacity", F.col("p_retailprice"))
    return balance.shared_capacity(p, ["p_brand", "p_type", "p_size"], 2).select("p_partkey", "p_brand", "capacity")


RANGES = [(0, 3, "first"), (2, 8, "second"), (9, 14, "third"), (12, 12, "never"), (20, None, "last")]


@query("class_sic_range",
    "WITH r AS (SELECT * FROM (VALUES (0, 3, 'first', 0), (2, 8, 'second', 1), (9, 14, 'third', 2), (12, 12, 'never', 3), (20, NULL, "
    "'last', 4)) v(lo, hi, sector, o)) SELECT c_custkey, coalesce((SELECT arg_min(sector, o) FROM r "
    "WHERE c_nationkey >= lo AND (hi IS NULL OR c_nationkey <= hi)), 'Unclassified') AS sector FROM customer")
def sic_range(spark, d):  # noqa: ANN001, ANN201
    """Range lookup; of overlapping ranges the first wins; an open end matches all above."""
    ranges = spark.createDataFrame([(*r, k) for k, r in enumerate(RANGES)], "lo int, hi int, sector string, o int")
    c = src.table(spark, d, "customer")
    codes = c.select("c_nationkey").distinct()  # the lookup is done once per code
    met = codes.join(F.broadcast(ranges), (F.col("c_nationkey") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("c_nationkey") <= F.col("hi"))), "left")
    table = met.groupBy("c_nationkey").agg(F.coalesce(F.min_by("sector", "o"), F.lit("Unclassified")).alias("sector"))
    return c.join(table, "c_nationkey").select("c_custkey", "sector")


@query("class_super_group", with_sql("bk") +
    "SELECT ticker, CASE WHEN basket < 8 THEN 'upstream' WHEN basket < 16 THEN 'midstream' WHEN basket < 24 THEN 'downstream' ELSE "
    "'unmapped' END AS grp FROM bk")
def super_group(spark, d):  # noqa: ANN001, ANN201
    names = {k: ("upstream" if k < 8 else "midstream" if k < 16 else "downstream") for k in range(24)}
    mapping = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return src.baskets(spark, d).select("ticker", F.coalesce(F.try_element_at(mapping, F.col("basket")), F.lit("unmapped")).alias("grp"))


@query("proj_flagged_number",
    "SELECT p_partkey, CASE WHEN k = 0 THEN 0.0 WHEN k = 1 THEN NULL WHEN k = 3 THEN NULL ELSE p_size::DOUBLE END AS value, "
    "CASE k WHEN 0 THEN 'zero' WHEN 1 THEN 'withheld' WHEN 2 THEN 'lower_bound' WHEN 3 THEN 'na' ELSE 'value' END AS flag "
    "FROM (SELECT *, p_partkey % 5 AS k FROM part)")
def flagged(spark, d):  # noqa: ANN001, ANN201
    k = F.col("p_partkey") % 5
    cell = F.when(k == 0, "-").when(k == 1, "W").when(k == 2, F.concat(F.lit(">"), "p_size")).when(k == 3, F.col("p_name")).otherwise(F.concat(F.lit(" "), F.col("p_size"), F.lit(" ")))
    return src.table(spark, d, "part").select("p_partkey", scalars.flagged_number(cell).alias("x")).select("p_partkey", "x.value", "x.flag")
