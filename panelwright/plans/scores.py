"""Factors, composite ranking and walk-forward evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import windows as win
from panelwright.operators import backtest, factors, panel
from panelwright.sources import panels as src
from panelwright.sources.panels import with_sql

from .registry import query, sql_take, take

PRICE = (
    "yp AS (SELECT ticker, arg_max(close, date) AS close, year(date)::INT AS fy FROM px "
    "GROUP BY ticker, year(date)), av AS (SELECT a.*, close FROM annual a JOIN yp ON cik = ticker AND a.fy = yp.fy)"
)
VALUE = """val AS (SELECT cik, fy, CASE WHEN close > 0 AND shares > 0 THEN close * shares END AS mcap, net_income + interest_expense + tax_expense + depreciation AS ebitda, operating_cash_flow - capex AS fcf,
    CASE WHEN close > 0 AND shares > 0 THEN close * shares END + coalesce(long_term_debt, 0) - coalesce(cash, 0) AS ev FROM av)"""
QUALITY = """qual AS (SELECT cik, fy, revenue, operating_income, CASE WHEN coalesce(stockholders_equity, 0) + coalesce(long_term_debt, 0) > 0 THEN operating_income * (1 - CASE WHEN net_income + tax_expense > 0 THEN least(greatest(tax_expense / (net_income + tax_expense), 0), 0.5) ELSE 0.21 END)
    / (coalesce(stockholders_equity, 0) + coalesce(long_term_debt, 0)) END AS roic, CASE WHEN total_assets > 0 THEN (net_income - operating_cash_flow) / total_assets END AS accruals FROM annual)"""


def _priced(spark, d):  # noqa: ANN001, ANN202
    px = src.monthly_prices(spark, d)
    yearly = px.groupBy("ticker", F.year("date").alias("fy")).agg(F.max_by("close", "date").alias("close"))
    a = src.annual_facts(spark, d)
    return a.join(yearly, (a.cik == yearly.ticker) & (a.fy == yearly.fy)).select(a["*"], "close")


@query("proj_value", with_sql("px", "annual", more=f"{PRICE}, {VALUE}") +
    "SELECT cik, fy, round(mcap, 4) AS mcap, round(ev, 4) AS ev, round(fcf / mcap, 6) AS fcf_yield, "
    "round(CASE WHEN ebitda > 0 THEN ev / ebitda END, 4) AS ev_ebitda FROM val")
def value(spark, d):  # noqa: ANN001, ANN201
    v = factors.value_factors(_priced(spark, d))
    return v.select("cik", "fy", F.round("mcap", 4).alias("mcap"), F.round("ev", 4).alias("ev"), F.round("fcf_yield", 6).alias("fcf_yield"), F.round("ev_ebitda", 4).alias("ev_ebitda"))


@query("proj_ebitda_fcf", with_sql("px", "annual", more=f"{PRICE}, {VALUE}") + sql_take("val", "cik fy", "ebitda fcf", 5))
def ebitda(spark, d):  # noqa: ANN001, ANN201
    return take(factors.value_factors(_priced(spark, d)), "cik fy", "ebitda fcf", 5)


@query("proj_roic", with_sql("annual", more=QUALITY) + sql_take("qual", "cik fy", "roic"))
def roic(spark, d):  # noqa: ANN001, ANN201
    return take(factors.quality_factors(src.annual_facts(spark, d)), "cik fy", "roic")


@query("proj_accruals", with_sql("annual", more=QUALITY) + sql_take("qual", "cik fy", "accruals"))
def accruals(spark, d):  # noqa: ANN001, ANN201
    return take(factors.quality_factors(src.annual_facts(spark, d)), "cik fy", "accruals")


MARGIN = (
    "m0 AS (SELECT cik, operating_income / revenue AS m FROM (SELECT * FROM annual "
    "WHERE revenue IS NOT NULL AND operating_income IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cik ORDER BY fy DESC) <= 8) "
    "WHERE revenue > 0), ms AS (SELECT cik, count(*) AS n_margins, CASE WHEN stddev_pop(m) <= 1e-6 THEN 1e6 ELSE 1 / stddev_pop(m) END AS "
    "margin_stability FROM m0 GROUP BY cik HAVING count(*) >= 3)"
)


@query("agg_margin_stability", with_sql("annual", more=MARGIN) + sql_take("ms", "cik n_margins", "margin_stability", 4))
def margins(spark, d):  # noqa: ANN001, ANN201
    return take(factors.margin_stability(src.annual_facts(spark, d), ["cik"]), "cik n_margins", "margin_stability", 4)


GRID = ("1996-01-31", "1997-06-30", "1998-12-31")
# Yearly flows, and a half-year flow that must not count; cash and debt are stocks, restated in June by the year after.
BUNDLE = """fl AS (SELECT cik, 'revenue' AS concept, make_date(fy, 1, 1) AS period_start, period_end, filed, revenue AS value FROM annual
    UNION ALL SELECT cik, 'net_income', make_date(fy, 1, 1), period_end, (filed + (cik % 3)::INT)::DATE, net_income FROM annual
    UNION ALL SELECT cik, 'net_income', make_date(fy, 7, 1), period_end, (filed + 1)::DATE, net_income / 2 FROM annual
    UNION ALL SELECT cik, 'cash', NULL, period_end, filed, cash FROM annual UNION ALL SELECT cik, 'cash', NULL, make_date(fy + 1, 3, 31), make_date(fy + 1, 6, 15), cash * 2 FROM annual
    UNION ALL SELECT cik, 'long_term_debt', NULL, period_end, make_date(fy + 1, 6, 15), long_term_debt FROM annual),
ff AS (SELECT * FROM fl WHERE value IS NOT NULL AND (period_start IS NULL OR period_end - period_start BETWEEN 350 AND 380)),
sn AS (SELECT g.as_of, ff.* FROM ff JOIN (SELECT unnest([DATE '1996-01-31', DATE '1997-06-30', DATE '1998-12-31']) AS as_of) g ON filed <= as_of QUALIFY row_number() OVER (PARTITION BY cik, concept, as_of ORDER BY period_end DESC, filed DESC) = 1),
an AS (SELECT cik, as_of, period_end AS e, filed AS f FROM sn WHERE concept = 'revenue')"""


@query(
    "agg_latest_annual",
    with_sql("annual", more=BUNDLE) + "SELECT cik, as_of, f AS filed, e AS period_end, " + ", ".join(
        f"round(max(value) FILTER (concept = '{c}' AND CASE WHEN period_start IS NULL THEN period_end <= e ELSE period_end = e END), "
        f"4) AS {c}"for c in ("revenue", "net_income", "cash", "long_term_debt")) + " FROM sn JOIN an USING (cik, as_of) GROUP BY ALL",
)
def latest_annual(spark, d):  # noqa: ANN001, ANN201
    a = src.annual_facts(spark, d)
    year, none = F.make_date("fy", F.lit(1), F.lit(1)), F.lit(None).cast("date")
    june = F.make_date(F.col("fy") + 1, F.lit(6), F.lit(15))
    rows = (
        ("revenue", year, F.col("period_end"), F.col("filed"), F.col("revenue")),
        ("net_income", year, F.col("period_end"), F.date_add("filed", F.pmod("cik", F.lit(3)).cast("int")), F.col("net_income")),
        ("net_income", F.make_date("fy", F.lit(7), F.lit(1)), F.col("period_end"), F.date_add("filed", 1), F.col("net_income") / 2),
        ("cash", none, F.col("period_end"), F.col("filed"), F.col("cash")),
        ("cash", none, F.make_date(F.col("fy") + 1, F.lit(3), F.lit(31)), june, F.col("cash") * 2),
        ("long_term_debt", none, F.col("period_end"), june, F.col("long_term_debt")),
    )
    names = ("concept", "period_start", "period_end", "filed", "value")
    long = a.select("cik", F.explode(F.array(*(F.struct(*(x.alias(n) for n, x in zip(names, (F.lit(r[0]), *r[1:]), strict=True))) for r in rows))).alias("r")).select("cik", "r.*").where("value IS NOT NULL")
    dates = spark.createDataFrame([(x,) for x in GRID], "as_of string").select(F.col("as_of").cast("date"))
    return take(factors.latest_annual(long, dates, ["revenue", "net_income", "cash", "long_term_debt"]), "cik as_of filed period_end", "revenue net_income cash long_term_debt", 4)


@query(
    "agg_q4_derive",
    with_sql("eps", more=
        "y AS (SELECT cik, fy, sum(eps) AS eps, max(period_end) AS period_end, max(filed) AS filed FROM eps GROUP BY cik, fy "
        "HAVING count(*) = 4), t AS (SELECT cik, fy, sum(eps) AS s FROM eps WHERE fp <> 'Q4' GROUP BY cik, fy "
        "HAVING count(DISTINCT fp) = 3)")
    +
        "SELECT cik, fy, fp, filed, round(eps, 7) AS eps, false AS derived FROM eps WHERE fp <> 'Q4' UNION ALL "
        "SELECT y.cik, y.fy, 'Q4', filed, round(y.eps - s, 7), true FROM y JOIN t ON y.cik = t.cik AND y.fy = t.fy",
)
def q4(spark, d):  # noqa: ANN001, ANN201
    e = src.quarterly_eps(spark, d)
    years = e.groupBy("cik", "fy").agg(F.sum("eps").alias("eps"), F.max("period_end").alias("period_end"), F.max("filed").alias("filed"), F.count("*").alias("k")).where("k = 4").drop("k")
    return take(factors.with_q4(e, years), "cik fy fp filed derived", "eps", 7)


SUE = """s0 AS (SELECT *, CASE WHEN year(period_end) - year(lag(period_end) OVER w) = 1 THEN eps - lag(eps) OVER w END AS yoy FROM eps WINDOW w AS (PARTITION BY cik, fp ORDER BY period_end)),
sue AS (SELECT cik, fp, period_end, filed, yoy, CASE WHEN count(yoy) OVER w >= 5 THEN yoy / nullif(stddev_pop(yoy) OVER w, 0) END AS sue FROM s0 WINDOW w AS (PARTITION BY cik, fp ORDER BY period_end ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"""


@query("win_sue", with_sql("eps", more=SUE) + sql_take("sue", "cik fp period_end filed", "yoy sue", 7))
def sue(spark, d):  # noqa: ANN001, ANN201
    return take(factors.sue(src.quarterly_eps(spark, d)), "cik fp period_end filed", "yoy sue", 7)


@query("flt_recent_window", with_sql("eps", more=SUE) +
    "SELECT cik, max(filed) AS filed, round(arg_max(sue, filed), 4) AS sue FROM sue "
    "WHERE sue IS NOT NULL AND filed > DATE '2001-06-30' - 92 AND filed <= DATE '2001-06-30' GROUP BY cik")
def recent(spark, d):  # noqa: ANN001, ANN201
    day = F.lit("2001-06-30").cast("date")
    seen = factors.sue(src.quarterly_eps(spark, d)).where(F.col("sue").isNotNull() & (F.col("filed") > F.date_sub(day, 92)) & (F.col("filed") <= day))
    return take(seen.groupBy("cik").agg(F.max("filed").alias("filed"), F.max_by("sue", "filed").alias("sue")), "cik filed", "sue", 4)


@query("flt_period_len",
    "SELECT l_orderkey, l_linenumber, CASE WHEN n BETWEEN 350 AND 380 THEN 'annual' WHEN n BETWEEN 60 AND 100 THEN 'quarter' END AS kind "
    "FROM (SELECT l_orderkey, l_linenumber, abs(l_shipdate::DATE - o_orderdate::DATE) AS n FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey) WHERE n BETWEEN 350 AND 380 OR n BETWEEN 60 AND 100")
def period_len(spark, d):  # noqa: ANN001, ANN201
    n = F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")))
    both = src.table(spark, d, "lineitem").join(src.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("n", n)
    return both.withColumn("kind", F.when(F.col("n").between(350, 380), "annual").when(F.col("n").between(60, 100), "quarter")).where("kind IS NOT NULL").select("l_orderkey", "l_linenumber", "kind")


FAMILIES = {"momentum": [("mom", 1)], "value": [("cheap", 1)], "quality": [("roic", 1), ("accruals", -1)]}
WEIGHTS = {"momentum": 0.4, "value": 0.3, "quality": 0.3}


def _scored(spark, d):  # noqa: ANN001, ANN202
    """Every December: momentum, value and quality of every supplier, ranked."""
    px = src.monthly_prices(spark, d)
    mom = panel.momentum(px, 1, 12, "close").where(F.month("date") == 12).select("ticker", F.year("date").alias("fy"), F.col("momentum").alias("mom"))
    v = factors.quality_factors(factors.value_factors(_priced(spark, d))).select(F.col("cik").alias("ticker"), "fy", F.col("fcf_yield").alias("cheap"), "roic", "accruals")
    base = v.join(mom, ["ticker", "fy"], "left").join(src.baskets(spark, d), "ticker").withColumn("as_of", F.make_date("fy", F.lit(12), F.lit(31)))
    return factors.composite(base, FAMILIES, WEIGHTS)


def _z(x: str) -> str:
    one = lambda w: f"coalesce(({x} - avg({x}) OVER {w}) / nullif(stddev_samp({x}) OVER {w}, 0), 0)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN count({x}) OVER wb >= 8 THEN {one('wb')} WHEN count({x}) OVER ws >= 8 THEN {one('ws')} ELSE {one('wg')} END"


COMPOSITE = f"""mom0 AS (SELECT ticker, date, lag(close, 1) OVER w / lag(close, 12) OVER w - 1 AS mom FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)), mom AS (SELECT ticker, year(date)::INT AS fy, mom FROM mom0 WHERE mom IS NOT NULL AND month(date) = 12),
base AS (SELECT q.cik AS ticker, q.fy, v.fcf / v.mcap AS cheap, roic, -accruals AS acc, mom, basket, super_basket FROM qual q JOIN val v ON q.cik = v.cik AND q.fy = v.fy JOIN bk ON q.cik = bk.ticker LEFT JOIN mom ON q.cik = mom.ticker AND q.fy = mom.fy),
wz AS (SELECT ticker, fy, basket, super_basket, {", ".join(f"CASE WHEN count({c}) OVER w >= 3 THEN CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, quantile_cont({c}, 0.01) OVER w), quantile_cont({c}, 0.99) OVER w) END ELSE {c} END AS {c}" for c in ("cheap", "roic", "acc", "mom"))} FROM base WINDOW w AS (PARTITION BY fy)),
zz AS (SELECT ticker, fy, {", ".join(f"{_z(c)} AS z_{c}" for c in ("cheap", "roic", "acc", "mom"))} FROM wz WINDOW wb AS (PARTITION BY fy, basket), ws AS (PARTITION BY fy, super_basket), wg AS (PARTITION BY fy)),
fam AS (SELECT ticker, fy, z_mom AS m, z_cheap AS v, (coalesce(z_roic, 0) + coalesce(z_acc, 0)) / nullif((z_roic IS NOT NULL)::INT + (z_acc IS NOT NULL)::INT, 0) AS q FROM zz),
comp AS (SELECT ticker, make_date(fy, 12, 31) AS as_of, m, v, q, (m IS NOT NULL)::INT + (v IS NOT NULL)::INT + (q IS NOT NULL)::INT AS n_families, CASE WHEN (m IS NOT NULL)::INT + (v IS NOT NULL)::INT + (q IS NOT NULL)::INT >= 2 THEN (coalesce(m, 0) * 0.4 + coalesce(v, 0) * 0.3 + coalesce(q, 0) * 0.3) / ((m IS NOT NULL)::INT * 0.4 + (v IS NOT NULL)::INT * 0.3 + (q IS NOT NULL)::INT * 0.3) END AS composite FROM fam)"""


@query("pipe_composite", with_sql("px", "annual", "bk", more=f"{PRICE}, {VALUE}, {QUALITY}, {COMPOSITE}") +
    "SELECT ticker, as_of, n_families, round(composite, 5) AS composite, CASE WHEN composite IS NOT NULL THEN round((rank() OVER "
    "(PARTITION BY as_of ORDER BY composite) + (count(*) OVER (PARTITION BY as_of, "
    "composite) - 1) / 2) / count(composite) OVER (PARTITION BY as_of), 5) END AS pctl FROM comp")
def composite(spark, d):  # noqa: ANN001, ANN201
    return take(_scored(spark, d), "ticker as_of n_families", "composite pctl", 5)


@query("win_group_fallback", with_sql("px", "bk") +
    "SELECT ticker, date, CASE WHEN count(*) OVER (PARTITION BY date, basket) >= 8 THEN 'basket' WHEN count(*) OVER (PARTITION BY date, "
    "super_basket) >= 8 THEN 'super' ELSE 'global' END AS level FROM px JOIN bk USING (ticker)")
def fallback(spark, d):  # noqa: ANN001, ANN201
    both = src.monthly_prices(spark, d).join(src.baskets(spark, d), "ticker")
    return both.withColumn("level", factors.neutral_z(both, F.col("close"), "date", "basket", "super_basket")[1]).select("ticker", "date", "level")


RANKED = (
    "rkd AS (SELECT ticker, as_of, (rank() OVER (PARTITION BY as_of ORDER BY composite) + (count(*) OVER (PARTITION BY as_of, "
    "composite) - 1) / 2) / count(composite) OVER (PARTITION BY as_of) AS pctl FROM comp WHERE composite IS NOT NULL)"
)


@query(
    "pipe_snapshot_diff",
    with_sql("px", "annual", "bk", more=
        f"{PRICE}, {VALUE}, {QUALITY}, {COMPOSITE}, {RANKED}, dd AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, a.pctl AS p0, "
        f"b.pctl AS p1 FROM (SELECT * FROM rkd WHERE as_of = DATE '1996-12-31') a FULL JOIN (SELECT * FROM rkd "
        f"WHERE as_of = DATE '1997-12-31') b ON a.ticker = b.ticker)")
    +
        "SELECT ticker, kind, round((p1 - p0) * 100, 4) AS gain FROM (SELECT *, unnest(list_filter([CASE WHEN coalesce(p1 >= 0.9, "
        "false) AND NOT coalesce(p0 >= 0.9, false) THEN 'entrant' END, CASE WHEN coalesce(p0 >= 0.9, false) AND NOT coalesce(p1 >= 0.9, "
        "false) THEN 'exit' END, CASE WHEN abs(p1 - p0) * 100 >= 50 THEN 'jump' END], lambda x: x IS NOT NULL)) AS kind FROM dd)",
)
def snapshot_diff(spark, d):  # noqa: ANN001, ANN201
    scored = _scored(spark, d).where("composite IS NOT NULL").select("ticker", "as_of", "pctl")
    day = lambda y: scored.where(F.col("as_of") == F.lit(f"{y}-12-31").cast("date"))
    return take(factors.snapshot_diff(day(1996), day(1997)), "ticker kind", "gain", 4)


@query(
    "agg_family_corr",
    with_sql("px", "annual", "bk", more=
        f"{PRICE}, {VALUE}, {QUALITY}, {COMPOSITE}, pr AS (SELECT as_of, 'momentum-value' AS pair, m AS a, v AS b FROM comp UNION ALL "
        f"SELECT as_of, 'momentum-quality', m, q FROM comp UNION ALL SELECT as_of, 'value-quality', v, q "
        f"FROM comp), rr AS (SELECT as_of, pair, rank() OVER (PARTITION BY as_of, pair "
        f"ORDER BY a) + (count(*) OVER (PARTITION BY as_of, pair, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY as_of, pair "
        f"ORDER BY b) + (count(*) OVER (PARTITION BY as_of, pair, b) - 1) / 2 AS rb FROM pr WHERE a IS NOT NULL AND b IS NOT NULL)")
    + "SELECT as_of, pair, count(*) AS n, round(corr(ra, rb), 5) AS corr FROM rr GROUP BY ALL HAVING count(*) >= 10",
)
def family_corr(spark, d):  # noqa: ANN001, ANN201
    s = _scored(spark, d)
    names = list(FAMILIES)
    pairs = [F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(f"score_{a}").alias("a"), F.col(f"score_{b}").alias("b")) for i, a in enumerate(names) for b in names[i + 1 :]]
    long = s.select("as_of", F.explode(F.array(*pairs)).alias("x")).select("as_of", "x.*").where("a IS NOT NULL AND b IS NOT NULL")
    ranked = long.select("as_of", "pair", win.average_rank(F.col("a"), "as_of", "pair").alias("ra"), win.average_rank(F.col("b"), "as_of", "pair").alias("rb"))
    return take(ranked.groupBy("as_of", "pair").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("corr")).where("n >= 10"), "as_of pair n", "corr", 5)


@query(
    "pipe_universe",
        "WITH dy AS (SELECT l_suppkey AS ticker, l_shipdate::DATE AS date FROM lineitem "
        "GROUP BY ALL), gd AS (SELECT unnest([DATE '1997-06-30', DATE '1999-06-30', DATE '2001-06-30']) AS as_of), hs AS (SELECT as_of, "
        "ticker, count(*) AS n_days, max(date) AS last_date FROM dy JOIN gd ON date <= as_of GROUP BY ALL) "
        "SELECT as_of, ticker, s_nationkey AS cik, n_days, last_date FROM hs JOIN supplier ON ticker = s_suppkey "
        "WHERE n_days >= 60 AND last_date > as_of - 92 AND s_acctbal > 0",
)
def universe(spark, d):  # noqa: ANN001, ANN201
    """Suppliers on the list (a positive balance), with a nation to map to and enough recent history, at three dates."""
    li = src.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).distinct()
    s = src.table(spark, d, "supplier")
    listed, mapping = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker")), s.select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("cik"))
    dates = spark.createDataFrame([("1997-06-30",), ("1999-06-30",), ("2001-06-30",)], "as_of string").select(F.col("as_of").cast("date"))
    return factors.universe(listed, mapping, li, dates, 60, 92)


W = "OVER (PARTITION BY ticker ORDER BY date)"
FORWARD = f"""sig AS (SELECT ticker, date, value FROM (SELECT ticker, date, lag(close, 1) {W} / lag(close, 12) {W} - 1 AS value FROM px) WHERE value IS NOT NULL),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i, lead(date) OVER (ORDER BY date) AS entry FROM (SELECT DISTINCT date FROM px)),
reb AS (SELECT floor((i - 1) / 2)::INT AS period, date AS signal_date, entry, lead(entry) OVER (ORDER BY date) AS exit FROM cal WHERE (i - 1) % 2 = 0),
b0 AS (SELECT s.ticker, value, r.*, count(*) OVER (PARTITION BY period) AS n_cross FROM sig s JOIN reb r ON s.date = r.signal_date WHERE entry IS NOT NULL AND exit IS NOT NULL),
b1 AS (SELECT b.*, p.close AS p0 FROM (SELECT * FROM b0 WHERE n_cross >= 20) b ASOF JOIN px p ON b.ticker = p.ticker AND b.entry >= p.date WHERE b.entry - p.date <= 70),
b2 AS (SELECT b.*, p.close AS p1 FROM b1 b ASOF JOIN px p ON b.ticker = p.ticker AND b.exit >= p.date WHERE b.exit - p.date <= 70),
b3 AS (SELECT *, p1 / p0 - 1 AS ret, count(*) OVER (PARTITION BY period) AS n_ranked FROM b2 WHERE abs(p1 / p0 - 1) <= 3),
rkd AS (SELECT *, least(floor(row_number() OVER (PARTITION BY period ORDER BY value, ticker) * 3 / (count(*) OVER (PARTITION BY period) + 1)), 2)::INT AS q FROM b3 WHERE n_ranked >= 20),
legs AS (SELECT period, signal_date AS date, avg(ret) FILTER (q = 2) AS long_ret, avg(ret) FILTER (q = 0) AS short_ret, count(*) FILTER (q = 2) AS n_long, count(*) FILTER (q = 0) AS n_short, count(*) AS n_ranked FROM rkd GROUP BY ALL),
trd AS (SELECT *, row_number() OVER (ORDER BY period) AS k FROM legs WHERE n_long >= 5 AND n_short >= 5),
books AS (SELECT k, q, ticker FROM rkd JOIN trd USING (period) WHERE q <> 1),
fresh AS (SELECT k, count(*) FILTER (q = 2) AS new_long, count(*) FILTER (q = 0) AS new_short FROM books a WHERE NOT EXISTS (SELECT 1 FROM books b WHERE b.k = a.k - 1 AND b.q = a.q AND b.ticker = a.ticker) GROUP BY k),
per0 AS (SELECT t.*, (coalesce(new_long, 0) / n_long + coalesce(new_short, 0) / n_short) / 2 AS turnover, long_ret - short_ret AS ls_gross FROM trd t LEFT JOIN fresh USING (k)),
per AS (SELECT *, turnover * 2 * 60 / 1e4 AS cost, ls_gross - turnover * 2 * 60 / 1e4 AS ls_net FROM per0)"""


def _walk(spark, d):  # noqa: ANN001, ANN202
    px = src.monthly_prices(spark, d)
    signal = panel.momentum(px, 1, 12, "close").select("ticker", "date", F.col("momentum").alias("value"))
    return backtest.walk_forward(signal, px, every=2)


@query("pipe_walk_forward", with_sql("px", more=FORWARD) + sql_take("per", "period date n_long n_short n_ranked", "long_ret short_ret ls_gross cost ls_net"))
def walk(spark, d):  # noqa: ANN001, ANN201
    return take(_walk(spark, d)[0], "period date n_long n_short n_ranked", "long_ret short_ret ls_gross cost ls_net")


@query("pipe_turnover", with_sql("px", more=FORWARD) + sql_take("per", "period date", "turnover"))
def turnover(spark, d):  # noqa: ANN001, ANN201
    return take(_walk(spark, d)[0], "period date", "turnover")


@query("agg_quantile_means", with_sql("px", more=FORWARD) +
    "SELECT (q + 1)::INT AS quantile, count(*) AS n_obs, round(avg(ret), 6) AS mean_period_ret FROM rkd SEMI JOIN trd USING (period) "
    "GROUP BY q")
def quantiles(spark, d):  # noqa: ANN001, ANN201
    return take(backtest.quantile_means(_walk(spark, d)[1]), "quantile n_obs", "mean_period_ret")


@query(
    "agg_backtest_summary",
    with_sql("px", more=FORWARD +
        ", lv AS (SELECT k, exp(sum(ln(1 + ls_net)) OVER (ORDER BY k)) AS cum FROM per), dd AS (SELECT min(c) AS max_drawdown "
        "FROM (SELECT cum / max(cum) OVER (ORDER BY k) - 1 AS c FROM lv)), x AS (SELECT k, ls_net, ls_net - (SELECT avg(ls_net) "
        "FROM per) AS e FROM per), y AS (SELECT e, lag(e) OVER (ORDER BY k) AS e1 "
        "FROM x), nw AS (SELECT count(*) AS n, sum(e * e) / count(*) AS g0, sum(e * e1) / count(*) AS g1 FROM y)")
    +
        "SELECT count(*) AS n_periods, round(avg(ls_net) * 6, 6) AS ann_ret_net, round(stddev_samp(ls_net) * sqrt(6), 6) AS ann_vol, "
        "round(coalesce(avg(ls_net) / nullif(stddev_samp(ls_net), 0) * sqrt(6), 0), 6) AS sharpe_net, "
        "round(coalesce(avg(ls_gross) / nullif(stddev_samp(ls_gross), 0) * sqrt(6), 0), 6) AS sharpe_gross, round(avg(turnover), "
        "6) AS avg_turnover, "
        "round((SELECT max_drawdown FROM dd), 6) AS max_drawdown, round(avg(ls_net) / sqrt((SELECT "
        "CASE WHEN g0 + g1 <= 0 THEN g0 ELSE g0 + g1 END / n FROM nw)), 6) AS nw_t_net, median(n_long) AS median_n_long, "
        "min(n_short) AS min_n_short FROM per",
)
def summary(spark, d):  # noqa: ANN001, ANN201
    return take(backtest.summary(_walk(spark, d)[0], 6.0), "n_periods median_n_long min_n_short", "ann_ret_net ann_vol sharpe_net sharpe_gross avg_turnover max_drawdown nw_t_net")


@query(
    "agg_subsample",
    with_sql("px", more=FORWARD + """, nb AS (SELECT date, ls_gross AS x, row_number() OVER (ORDER BY date) - 1 AS i FROM per), nn AS (SELECT count(*) AS total FROM per),
    ct AS (SELECT w, round_even((p - 1) * total / ps, 0) + CASE WHEN p > 1 THEN 1 ELSE 0 END AS low, round_even(p * total / ps, 0) - CASE WHEN p < ps THEN 1 ELSE 0 END AS high FROM nn, (VALUES ('full', 1, 1), ('third 1/3', 1, 3), ('third 2/3', 2, 3), ('third 3/3', 3, 3), ('half 1/2', 1, 2), ('half 2/2', 2, 2)) v(w, p, ps)),
    ws AS (SELECT w, min(date) AS "start", max(date) AS "end", count(x) AS n, coalesce(avg(x), 0) AS mean, coalesce(avg(x) / nullif(stddev_samp(x), 0) * sqrt(6), 0) AS sharpe, coalesce(avg((x > 0)::INT), 0) AS hit_rate FROM ct LEFT JOIN nb ON i >= low AND i < high GROUP BY w),
    fu AS (SELECT sign(mean) AS s FROM ws WHERE w = 'full'), us AS (SELECT min(sharpe) AS worst, bool_and(sign(mean) = s) AND max(s) <> 0 AS stable FROM ws, fu WHERE w <> 'full' AND n >= 3)""")
    +
        'SELECT w AS "window", "start", "end", n, round(mean, 6) + 0.0 AS mean, round(sharpe, 6) + 0.0 AS sharpe, round(hit_rate, '
        '6) AS hit_rate, round(coalesce(worst, 0), 6) + 0.0 AS worst_sharpe, coalesce(stable, false) AS stable FROM ws, us',
)
def subsample(spark, d):  # noqa: ANN001, ANN201
    out = take(backtest.subsamples(_walk(spark, d)[0], per_year=6.0), "window start end n stable", "mean sharpe hit_rate worst_sharpe")
    return out.withColumns({c: F.col(c) + 0.0 for c in ("mean", "sharpe", "worst_sharpe")})
