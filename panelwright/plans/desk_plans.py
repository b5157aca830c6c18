"""Workbench, lab, option and source queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import windows as win
from panelwright.operators import lab, options, panel, workbench
from panelwright.sources import panels as src
from panelwright.sources import sinks
from panelwright.sources.panels import with_sql
from panelwright.sources.scratch import scratch_path, stored

from .registry import query, take


@query("flt_find_text",
    "SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(chr(1), p_partkey, p_name, p_brand, p_type, p_size, "
    "p_retailprice)), 'brand#1')")
def find(spark, d):  # noqa: ANN001, ANN201
    return workbench.find(src.table(spark, d, "part"), "Brand#1").select("p_partkey", "p_name")


@query("flt_where",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND try_cast(substr(o_orderpriority, o_orderkey % 2 + 1, "
    "1) AS INT) <= 2")
def where(spark, d):  # noqa: ANN001, ANN201
    """For odd keys the cell that is cast is no number; such rows are left out."""
    return workbench.where(src.table(spark, d, "orders"), "o_totalprice > 200000 AND CAST(substr(o_orderpriority, o_orderkey % 2 + 1, 1) AS INT) <= 2").select("o_orderkey", "o_totalprice")


@query("proj_formula", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) / nullif(l_tax, 0), 6) AS net FROM lineitem")
def formula(spark, d):  # noqa: ANN001, ANN201
    """Null where the tax is 0."""
    return take(workbench.formula(src.table(spark, d, "lineitem"), "net", "l_extendedprice * (1 - l_discount) / l_tax", []), "l_orderkey l_linenumber", "net", 6)


@query(
    "win_workbench",
        "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS z, "
        "row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::DOUBLE AS r, round(sum(p_retailprice) OVER (ORDER BY p_partkey), "
        "4) AS cum, round(CASE WHEN count(p_retailprice) OVER w = 3 THEN avg(p_retailprice) OVER w END, 6) AS ma, "
        "round(p_retailprice / lag(p_retailprice) OVER (ORDER BY p_partkey) - 1, 6) AS pct, "
    "round(p_retailprice / sum(p_retailprice) OVER (), 8) AS share FROM part WINDOW w AS (ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
)
def functions(spark, d):  # noqa: ANN001, ANN201
    out, order = src.table(spark, d, "part"), [F.col("p_partkey")]
    for name, text in (("z", "Z(p_retailprice)"), ("r", "RANK(p_retailprice)"), ("cum", "CUM(p_retailprice)"), ("ma", "MA(p_retailprice, 3)"), ("pct", "PCT(p_retailprice)"), ("share", "SHARE(p_retailprice)")):
        out = workbench.formula(out, name, text, order)
    return out.select("p_partkey", F.round("z", 6).alias("z"), "r", F.round("cum", 4).alias("cum"), F.round("ma", 6).alias("ma"), F.round("pct", 6).alias("pct"), F.round("share", 8).alias("share"))


@query("agg_group_user",
    "SELECT p_brand, count(*) AS n, sum(p_partkey)::BIGINT AS p_partkey, sum(p_size)::BIGINT AS p_size, round(sum(p_retailprice), "
    "4) AS p_retailprice FROM part GROUP BY p_brand")
def group_user(spark, d):  # noqa: ANN001, ANN201
    return take(workbench.grouped(src.table(spark, d, "part"), "p_brand", "sum"), "p_brand n p_partkey p_size", "p_retailprice", 4)


@query("agg_column_status",
    'SELECT round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS avg, min(o_totalprice) AS min, max(o_totalprice) AS max, '
    'count(o_totalprice) AS n FROM orders')
def column_status(spark, d):  # noqa: ANN001, ANN201
    s = workbench.column_status(src.table(spark, d, "orders"), "o_totalprice")
    return s.select(F.round("sum", 2).alias("sum"), F.round("avg", 4).alias("avg"), "min", "max", "n")


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_n(spark, d):  # noqa: ANN001, ANN201
    return src.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("top_per_group",
    "SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::INT AS place "
    "FROM supplier QUALIFY place <= 3")
def top_per_group(spark, d):  # noqa: ANN001, ANN201
    return workbench.top_per_group(src.table(spark, d, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 3).select("s_nationkey", "s_suppkey", "place")


@query("top_quota",
    "WITH q AS (SELECT p_brand, greatest(1, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 0)) AS q FROM part "
    "GROUP BY p_brand), t AS (SELECT p_brand, p_partkey, p_retailprice FROM part JOIN q USING (p_brand) "
    "QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= max(q) OVER (PARTITION BY p_brand)) "
    "SELECT p_brand, p_partkey FROM t ORDER BY p_brand, p_retailprice DESC, p_partkey LIMIT 100")
def top_quota(spark, d):  # noqa: ANN001, ANN201
    return workbench.top_quota(src.table(spark, d, "part"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 100).select("p_brand", "p_partkey")


@query("top_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 4500) DESC, c_custkey LIMIT 40")
def top_abs(spark, d):  # noqa: ANN001, ANN201
    return src.table(spark, d, "customer").orderBy(F.abs(F.col("c_acctbal") - 4500).desc(), "c_custkey").limit(40).select("c_custkey", "c_acctbal")


PEER = (
    "p3 AS (SELECT ticker, basket, date, close / lag(close, 3) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM px "
    "JOIN bk USING (ticker)), pr AS (SELECT * FROM p3 WHERE r IS NOT NULL)"
)


@query("top_peer_nearest", with_sql("px", "bk", more=PEER) +
    "SELECT a.ticker, a.date, b.ticker AS peer, row_number() OVER (PARTITION BY a.ticker, a.date "
    "ORDER BY round(abs(a.r - b.r), 9), b.ticker)::INT AS place FROM pr a JOIN pr b ON a.basket = b.basket AND a.date = b.date AND "
    "a.ticker <> b.ticker QUALIFY place <= 3")
def peers(spark, d):  # noqa: ANN001, ANN201
    """At every date the three names of the basket whose return over three months was nearest."""
    r = src.monthly_prices(spark, d).withColumn("r", win.simple_return(F.col("close"), win.series("ticker"), 3)).where("r IS NOT NULL").join(src.baskets(spark, d), "ticker")
    return workbench.nearest_on_line(r, ["basket", "date"], "ticker", "r", 3).select("ticker", "date", F.col("other").alias("peer"), "place")


@query("pick_nearest_target",
    "SELECT user_id, target, event_id FROM (SELECT user_id, event_id, (DATE '2024-03-01' - ts::DATE) AS days, unnest([10, 30]) AS target "
    "FROM events WHERE event_type = 'signup') WHERE abs(days - target) <= greatest(5, target * 0.45) "
    "QUALIFY row_number() OVER (PARTITION BY user_id, target ORDER BY abs(days - target), event_id) = 1")
def nearest_target(spark, d):  # noqa: ANN001, ANN201
    e = src.table(spark, d, "events").where("event_type = 'signup'").withColumn("days", F.datediff(F.lit("2024-03-01").cast("date"), F.to_date("ts")).cast("double") + F.col("event_id") * 1e-9)
    out = options.nearest_target(e, ["user_id"], "days", [10, 30])
    return out.select("user_id", "target", "event_id")


def _lab(spark, d):  # noqa: ANN001, ANN202
    w = win.series("ticker")
    px = src.monthly_prices(spark, d)
    z = px.withColumns({"price": F.col("close"), "ret": win.simple_return(F.col("close"), w), "z": F.round(win.rolling_z(F.col("close"), w, 12), 9)})
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("entry"), F.lit(b).alias("stop")) for a in (0.5, 1.0) for b in (0.2, 0.5))))
    p = z.withColumn("p", grid).select("ticker", "date", "price", "ret", "z", "p.*").withColumn("max_hold", F.lit(9))
    return p.withColumn("target", lab.target(F.col("z"), F.col("entry"), F.lit(2.0), F.lit(1.0)))


LAB = """zz AS (SELECT ticker, date, close AS price, close / lag(close) OVER v - 1 AS ret, round(CASE WHEN count(*) OVER w = 12 THEN coalesce((close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0), 0) END, 9) AS z
    FROM px WINDOW v AS (PARTITION BY ticker ORDER BY date), w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
lb AS (SELECT *, -sign(z) * least(greatest((abs(z) - entry) / (2.0 - entry), 0), 1) AS target, row_number() OVER (PARTITION BY ticker, entry, stop ORDER BY date) AS i
    FROM zz, (SELECT unnest([0.5, 1.0])::DOUBLE AS entry), (SELECT unnest([0.2, 0.5])::DOUBLE AS stop))"""
# The state machine as a recursion over the rows of every series: what is open before (p, e, s), then the new state.
FOLD = """, st AS (
    SELECT ticker, entry, stop, i, date, 0.0::DOUBLE AS pos, NULL::DOUBLE AS e, 0::BIGINT AS s, NULL::VARCHAR AS reason FROM lb WHERE i = 1
    UNION ALL
    SELECT ticker, entry, stop, i, date, pos, CASE WHEN abs(pos) < 0.001 THEN NULL WHEN opened THEN price ELSE e END, CASE WHEN opened THEN i ELSE s END, reason
    FROM (SELECT *, CASE WHEN target IS NULL THEN p WHEN stopped OR expired THEN 0 WHEN abs(target - p1) > 0.01 THEN target ELSE p1 END AS pos,
                 target IS NOT NULL AND NOT stopped AND NOT expired AND abs(p1) < 0.001 AND abs(target) > 0.001 AND abs(target - p1) > 0.01 AS opened,
                 CASE WHEN target IS NULL THEN NULL WHEN stopped THEN 'stop' WHEN expired THEN 'max_hold' WHEN flip THEN 'flip' WHEN abs(target - p1) <= 0.01 THEN NULL WHEN abs(p1) < 0.001 AND abs(target) > 0.001 THEN 'entry'
                      WHEN abs(target) < 0.001 THEN 'exit' WHEN abs(target) > abs(p1) THEN 'scale_in' ELSE 'scale_out' END AS reason
          FROM (SELECT *, CASE WHEN flip THEN 0 ELSE p END AS p1
                FROM (SELECT l.ticker, l.entry, l.stop, l.i, l.date, l.target, l.price, t.pos AS p, t.e, t.s,
                             abs(t.pos) > 0.001 AND t.pos * (l.price - t.e) / greatest(1e-4, abs(t.e)) <= -l.stop AS stopped, abs(t.pos) > 0.001 AND l.i - t.s >= 9 AS expired,
                             abs(t.pos) > 0.001 AND abs(l.target) > 0.001 AND sign(l.target) <> sign(t.pos) AS flip
                      FROM st t JOIN lb l ON l.ticker = t.ticker AND l.entry = t.entry AND l.stop = t.stop AND l.i = t.i + 1)))),
pn AS (SELECT st.*, coalesce(ret, 0) AS ret, coalesce(lag(pos) OVER w, 0) AS before FROM st JOIN lb USING (ticker, entry, stop, i) WINDOW w AS (PARTITION BY st.ticker, st.entry, st.stop ORDER BY st.i)),
pl AS (SELECT *, before * ret - CASE WHEN abs(pos - before) > 0.001 THEN abs(pos - before) * 5 / 1e4 ELSE 0 END AS pnl, sum(ret) OVER (PARTITION BY ticker, entry, stop ORDER BY i) AS total_ret FROM pn),
eq AS (SELECT *, sum(pnl) OVER (PARTITION BY ticker, entry, stop ORDER BY i) AS equity FROM pl),
ch AS (SELECT *, lead(date) OVER w AS exit_at, lead(i) OVER w AS exit_i, lead(total_ret) OVER w AS exit_ret FROM pl WHERE pos <> before WINDOW w AS (PARTITION BY ticker, entry, stop ORDER BY i)),
en AS (SELECT ticker, entry, stop, max(i) AS n, arg_max(total_ret, i) AS end_ret FROM pl GROUP BY ALL),
td AS (SELECT ticker, entry, stop, date AS entry_at, exit_at, sign(pos)::DOUBLE AS side, coalesce(exit_i, n) - i AS rows, pos * (coalesce(exit_ret, end_ret) - total_ret) - CASE WHEN exit_at IS NULL THEN 1 ELSE 2 END * 5 / 1e4 AS pnl
    FROM ch JOIN en USING (ticker, entry, stop) WHERE pos <> 0)"""
FOLDED = with_sql("px", more=LAB + FOLD).replace("WITH ", "WITH RECURSIVE ", 1)


@query("lab_target", with_sql("px", more=LAB) + "SELECT ticker, date, entry, stop, round(target, 6) + 0.0 AS target FROM lb")
def targets(spark, d):  # noqa: ANN001, ANN201
    return take(_lab(spark, d), "ticker date entry stop", "target").withColumn("target", F.col("target") + 0.0)


BY = ["ticker", "entry", "stop"]


def _folded(spark, d):  # noqa: ANN001, ANN202
    return lab.pnl(lab.fold(_lab(spark, d), BY, "date", keep=("ret",)), BY, "date")


@query("lab_position_fold", FOLDED + "SELECT ticker, entry, stop, date, round(pos, 6) + 0.0 AS pos, reason FROM st")
def fold(spark, d):  # noqa: ANN001, ANN201
    """Every series with every parameter set."""
    return lab.fold(_lab(spark, d), BY, "date").withColumn("pos", F.round("pos", 6) + 0.0)


@query("lab_pnl", FOLDED +
    "SELECT ticker, entry, stop, date, round(abs(pos - before), 6) AS turn, round(pnl, 6) + 0.0 AS pnl, round(equity, 6) + 0.0 AS equity "
    "FROM eq")
def pnl(spark, d):  # noqa: ANN001, ANN201
    out = take(_folded(spark, d), "ticker entry stop date", "turn pnl equity")
    return out.withColumns({c: F.col(c) + 0.0 for c in ("pnl", "equity")})


@query("lab_trades", FOLDED + "SELECT ticker, entry, stop, entry_at, exit_at, side, rows, round(pnl, 6) + 0.0 AS pnl FROM td")
def trades(spark, d):  # noqa: ANN001, ANN201
    return take(lab.trades(_folded(spark, d), BY, "date"), "ticker entry stop entry_at exit_at side rows", "pnl").withColumn("pnl", F.col("pnl") + 0.0)


@query(
    "lab_metrics",
    FOLDED + """, dd AS (SELECT ticker, entry, stop, min(equity - high) AS max_dd FROM (SELECT *, max(equity) OVER (PARTITION BY ticker, entry, stop ORDER BY i) AS high FROM eq) GROUP BY ALL),
    tw AS (SELECT ticker, entry, stop, count(*) AS n_trades, avg((pnl > 0)::INT) AS win_rate, avg(rows) AS avg_hold FROM td GROUP BY ALL)
    SELECT ticker, entry, stop, count(*) AS n, round(coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(12), 0), 5) + 0.0 AS sharpe, round(sum(pnl), 6) + 0.0 AS total, round(exp(sum(pnl) / (count(*) / 12)) - 1, 6) + 0.0 AS cagr, round(max(max_dd), 6) + 0.0 AS max_dd,
           coalesce(max(n_trades), 0) AS n_trades, round(coalesce(max(win_rate), 0), 6) AS win_rate, round(coalesce(max(avg_hold), 0), 6) AS avg_hold
    FROM eq JOIN dd USING (ticker, entry, stop) LEFT JOIN tw USING (ticker, entry, stop) GROUP BY ALL""",
)
def metrics(spark, d):  # noqa: ANN001, ANN201
    m = lab.metrics(_folded(spark, d), BY, "date", 12.0).withColumn("sharpe", F.round("sharpe", 5))
    out = take(m, "ticker entry stop n n_trades", "sharpe total cagr max_dd win_rate avg_hold")
    return out.withColumns({c: F.col(c) + 0.0 for c in ("sharpe", "total", "cagr", "max_dd")})


BOOT = """r AS (SELECT ticker, coalesce(ln(close / lag(close) OVER w), 0) AS pnl, row_number() OVER w - 1 AS i FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)), n AS (SELECT ticker, count(*) AS n FROM r GROUP BY ticker),
k AS (SELECT ticker, n, run, unnest(range(0, ceil(n / 4)::INT)) AS b FROM n, (SELECT unnest(range(0, 1000)) AS run)), sm AS (SELECT ticker, i, sum(pnl) OVER (PARTITION BY ticker ORDER BY i) AS c, pnl FROM r),
st AS (SELECT ticker, run, b, least(4, n - b * 4) AS len, ('0x' || substr(md5('7:' || run || ':' || b), 1, 8))::BIGINT % greatest(1, n - 4) AS i FROM k),
tot AS (SELECT st.ticker, run, sum(z.c - a.c + a.pnl) AS total FROM st JOIN sm a ON st.ticker = a.ticker AND st.i = a.i JOIN sm z ON st.ticker = z.ticker AND st.i + len - 1 = z.i GROUP BY ALL)"""


def _boot(spark, d):  # noqa: ANN001, ANN202
    r = src.monthly_prices(spark, d).withColumn("pnl", F.coalesce(win.log_return(F.col("close"), win.series("ticker")), F.lit(0.0)))
    return lab.bootstrap(r, ["ticker"], "date", 1000, 4, "7")


@query("lab_bootstrap", with_sql("px", more=BOOT) +
    "SELECT ticker, round(quantile_cont(total, 0.05), 6) AS p5, round(median(total), 6) AS p50, round(quantile_cont(total, 0.95), "
    "6) AS p95 FROM tot GROUP BY ticker")
def bootstrap(spark, d):  # noqa: ANN001, ANN201
    q = _boot(spark, d).groupBy("ticker").agg(*(F.percentile("total", F.lit(p)).alias(n) for p, n in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))))
    return take(q, "ticker", "p5 p50 p95")


@query("lab_histogram", with_sql("px", more=BOOT) +
    "SELECT ticker, bin, count(*) AS n FROM (SELECT ticker, least(floor((round(total, 9) - min(round(total, "
    "9)) OVER w) / (max(round(total, 9)) OVER w - min(round(total, 9)) OVER w) * 40), 39)::INT AS bin FROM tot "
    "WINDOW w AS (PARTITION BY ticker)) GROUP BY ALL")
def histogram(spark, d):  # noqa: ANN001, ANN201
    return lab.histogram(_boot(spark, d).withColumn("total", F.round("total", 9)), ["ticker"], "total", 40)


def chain(spark, d):  # noqa: ANN001, ANN201
    """An option chain from the parts: strikes around the retail price, three expiries, both types. The parts are dealt out
    before they are multiplied."""
    p = src.table(spark, d, "part").repartition("p_partkey")
    k = F.col("p_partkey")
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(days).alias("dte"), F.lit(c).alias("type")) for m in (0.8, 0.9, 1.0, 1.1, 1.2) for days in (30, 90, 365) for c in ("c", "p"))))
    rows = p.select(k.alias("symbol"), F.col("p_retailprice").alias("spot"), (0.15 + F.pmod(k, F.lit(20)) / 50).alias("base"), cells.alias("x")).select("symbol", "spot", "base", "x.*")
    return rows.select("symbol", "spot", (F.col("spot") * F.col("m")).alias("strike"), "dte", (F.col("dte") / 365).alias("t"), "type", F.lit(0.03).alias("rate"), F.lit(0.01).alias("div"), (F.col("base") + F.abs(F.col("m") - 1) * 0.2).alias("vol"))


def quotes_of(spark, d):  # noqa: ANN001, ANN201
    """The chain with bid, ask and last around the model's price; some strikes have only a last price."""
    c = options.greeks(chain(spark, d)).drop(*options.GREEKS)
    half, stale = F.col("price") * (0.01 + F.pmod("symbol", F.lit(3)) * 0.005), F.pmod(F.col("symbol") + F.col("dte"), F.lit(11)) == 0
    return c.withColumns({"bid": F.when(stale, 0.0).otherwise(F.col("price") - half), "ask": F.when(stale, 0.0).otherwise(F.col("price") + half), "last": F.col("price")})


def part_vols(spark, d):  # noqa: ANN001, ANN201
    """symbol, rv10, rv20, rv60: annualised volatility of the last so many daily returns of a part's shipped price."""
    li = src.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))
    return panel.realised_vol(li, "symbol", "date", "close", (10, 20, 60))


CHAIN = """ch0 AS (SELECT p_partkey AS symbol, p_retailprice AS spot, 0.15::DOUBLE + (p_partkey % 20) / 50.0::DOUBLE AS base, m::DOUBLE AS m, dte, type FROM part, (SELECT unnest([0.8, 0.9, 1.0, 1.1, 1.2]) AS m), (SELECT unnest([30, 90, 365]) AS dte), (SELECT unnest(['c', 'p']) AS type)),
ch AS (SELECT symbol, spot, spot * m AS strike, dte, dte / 365.0::DOUBLE AS t, type, 0.03::DOUBLE AS rate, 0.01::DOUBLE AS div, base + abs(m - 1) * 0.2::DOUBLE AS vol FROM ch0)"""


def _horner_sql(a: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {a} + {c}::DOUBLE)"
    return out


def tail_sql(a: str) -> str:
    far = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE)))))"
    return f"CASE WHEN {a} > 37 THEN 0 WHEN {a} < 7.07106781186547 THEN exp(-{a} * {a} / 2) * {_horner_sql(a, options.TAIL_OVER)} / {_horner_sql(a, options.TAIL_UNDER)} ELSE exp(-{a} * {a} / 2) / {far} / 2.506628274631::DOUBLE END"


def greeks_sql(name: str, source: str) -> str:
    """Common table expressions that end with name: the rows of source with price and greeks."""
    side = lambda d, u: f"CASE WHEN sg * {d} > 0 THEN 1 - {u} ELSE {u} END"
    return f"""{name}_0 AS (SELECT *, t > 0 AND vol > 0 AS live, CASE type WHEN 'c' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg, exp(-div * greatest(t, 0)) AS dq, exp(-rate * greatest(t, 0)) AS dr, vol * sqrt(greatest(t, 0)) AS root FROM {source}),
{name}_1 AS (SELECT *, CASE WHEN live THEN (ln(spot / strike) + (rate - div + vol * vol / 2) * t) / root END AS d1, CASE WHEN live THEN (ln(spot / strike) + (rate - div + vol * vol / 2) * t) / root - root END AS d2 FROM {name}_0),
{name}_2 AS (SELECT *, abs(d1) AS a1, abs(d2) AS a2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf FROM {name}_1),
{name}_3 AS (SELECT *, {tail_sql("a1")} AS u1, {tail_sql("a2")} AS u2 FROM {name}_2),
{name}_4 AS (SELECT *, spot * dq AS fs, strike * dr AS fk, {side("d1", "u1")} AS n1, {side("d2", "u2")} AS n2 FROM {name}_3),
{name} AS (SELECT * EXCLUDE (live, sg, dq, dr, root, d1, d2, a1, a2, pdf, u1, u2, fs, fk, n1, n2), CASE WHEN live THEN sg * (fs * n1 - fk * n2) ELSE greatest(sg * (fs - fk), 0) END AS price, CASE WHEN live THEN sg * dq * n1 WHEN sg * (spot - strike) > 0 THEN sg ELSE 0 END AS delta,
    CASE WHEN live THEN dq * pdf / (spot * root) ELSE 0 END AS gamma, CASE WHEN live THEN fs * pdf * sqrt(t) ELSE 0 END AS vega, CASE WHEN live THEN -fs * pdf * vol / (2 * sqrt(t)) - sg * rate * fk * n2 + sg * div * fs * n1 ELSE 0 END AS theta,
    CASE WHEN live THEN sg * t * fk * n2 ELSE 0 END AS rho, CASE WHEN live THEN -dq * pdf * d2 / vol ELSE 0 END AS vanna, CASE WHEN live THEN fs * pdf * sqrt(t) * d1 * d2 / vol ELSE 0 END AS volga FROM {name}_4)"""


# Quotes lie around the model's price, so the vol solved from a mid within the bounds is the model's vol.
QUOTED = f"""{CHAIN}, {greeks_sql("gk", "ch")},
qt AS (SELECT symbol, spot, strike, dte, t, type, rate, div, vol, price, CASE WHEN (symbol + dte) % 11 = 0 THEN 0 ELSE price - price * (0.01 + symbol % 3 * 0.005) END AS bid, CASE WHEN (symbol + dte) % 11 = 0 THEN 0 ELSE price + price * (0.01 + symbol % 3 * 0.005) END AS ask FROM gk),
iv AS (SELECT *, price AS mid, CASE WHEN price > greatest(CASE type WHEN 'c' THEN 1 ELSE -1 END * (spot * exp(-div * t) - strike * exp(-rate * t)), 0) + 1e-10 AND price < CASE type WHEN 'c' THEN spot * exp(-div * t) ELSE strike * exp(-rate * t) END THEN vol END AS iv FROM qt)"""
SURFACE = f"""{QUOTED}, sk AS (SELECT symbol, dte, t, strike, max(spot) AS spot, max(spot * exp((rate - div) * t)) AS fwd, max(iv) FILTER (type = 'c') AS civ, max(iv) FILTER (type = 'p') AS piv, sum(mid) AS cp, bool_and(bid > 0) AS ok FROM iv GROUP BY ALL),
s2 AS (SELECT *, CASE WHEN strike >= fwd THEN coalesce(civ, piv) ELSE coalesce(piv, civ) END AS v FROM sk), s3 AS (SELECT *, v IS NOT NULL AND (ok OR count(*) FILTER (v IS NOT NULL AND ok) OVER (PARTITION BY symbol, dte) < 2) AS used FROM s2),
s4 AS (SELECT symbol, dte, t, max(spot) AS spot, max(fwd) AS fwd, max(strike) FILTER (used AND strike <= fwd) AS k0, arg_max(v, strike) FILTER (used AND strike <= fwd) AS v0, min(strike) FILTER (used AND strike > fwd) AS k1, arg_min(v, strike) FILTER (used AND strike > fwd) AS v1,
    arg_min(cp, (abs(strike - fwd), strike)) AS straddle, arg_min(v, (abs(strike / fwd - 0.9), strike)) FILTER (v IS NOT NULL) AS vol_90, arg_min(v, (abs(strike / fwd - 1.1), strike)) FILTER (v IS NOT NULL) AS vol_110 FROM s3 GROUP BY ALL),
sf AS (SELECT *, coalesce(v0 + (v1 - v0) * (fwd - k0) / (k1 - k0), v0, v1) AS atm FROM s4)"""
PART_VOLS = """pc AS (SELECT l_partkey AS symbol, l_shipdate::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY ALL),
pr AS (SELECT symbol, ln(close / lag(close) OVER w) AS r, count(*) OVER v - row_number() OVER w AS back FROM pc WINDOW w AS (PARTITION BY symbol ORDER BY date), v AS (PARTITION BY symbol)),
rv AS (SELECT symbol, """ + ", ".join(f"CASE WHEN count(r) >= {n} THEN stddev_samp(r) FILTER (back < {n}) * sqrt(252) END AS rv{n}" for n in (10, 20, 60)) + " FROM pr GROUP BY symbol)"


@query("opt_price_greeks", f"WITH {CHAIN}, {greeks_sql('gk', 'ch')} SELECT symbol, dte, type, round(strike, 4) AS strike, " + ", ".join(f"round({c}, 3) + 0.0 AS {c}" for c in ("price", "vega", "theta", "rho", "volga")) + ", round(delta, 6) + 0.0 AS delta, round(gamma, 8) AS gamma, round(vanna, 6) + 0.0 AS vanna FROM gk")
def price_greeks(spark, d):  # noqa: ANN001, ANN201
    g = options.greeks(chain(spark, d))
    places = {"price": 3, "vega": 3, "theta": 3, "rho": 3, "volga": 3, "delta": 6, "gamma": 8, "vanna": 6}
    return g.select("symbol", "dte", "type", F.round("strike", 4).alias("strike"), *((F.round(c, n) + 0.0).alias(c) for c, n in places.items()))


@query("opt_iv_chain", f"WITH {QUOTED} SELECT symbol, dte, type, round(strike, 4) AS strike, round(mid, 3) AS mid, round(iv, 4) AS iv FROM iv")
def iv_chain(spark, d):  # noqa: ANN001, ANN201
    return options.quoted(quotes_of(spark, d)).select("symbol", "dte", "type", F.round("strike", 4).alias("strike"), F.round("mid", 3).alias("mid"), F.round("iv", 4).alias("iv"))


def surfaces(spark, d):  # noqa: ANN001, ANN201
    return options.surface(options.strike_vols(options.quoted(quotes_of(spark, d))))


#: Strikes at or below each level and above it, by comparison with every strike of the chain.
MONEYNESS = f"""lv AS (SELECT symbol, dte, 'm' || round(m * 100)::INT AS name, max(spot) * m AS k FROM s2, (SELECT unnest({list(options.LEVELS)})::DOUBLE AS m) GROUP BY symbol, dte, m),
lw AS (SELECT lv.symbol, lv.dte, lv.name, any_value(lv.k) AS k, max(strike) FILTER (strike <= lv.k) AS k0, arg_max(v, strike) FILTER (strike <= lv.k) AS v0, min(strike) FILTER (strike > lv.k) AS k1, arg_min(v, strike) FILTER (strike > lv.k) AS v1
    FROM lv LEFT JOIN s2 ON s2.symbol = lv.symbol AND s2.dte = lv.dte AND v IS NOT NULL GROUP BY ALL),
mv AS (SELECT symbol, dte, """ + ", ".join(f"round(max(v0 + (v1 - v0) * (k - k0) / (k1 - k0)) FILTER (name = 'm{round(m * 100)}'), 4) AS m{round(m * 100)}" for m in options.LEVELS) + " FROM lw GROUP BY ALL)"


@query(
    "opt_surface",
        f"WITH {SURFACE}, {MONEYNESS} SELECT mv.*, round(fwd, 4) AS fwd, round(atm, 5) AS atm, round(straddle, 3) AS straddle, "
        f"round(vol_90, 4) AS vol_90, round(vol_110, 4) AS vol_110, round(vol_90 - vol_110, 4) + 0.0 AS skew FROM sf "
        f"JOIN mv USING (symbol, dte)",
)
def surface(spark, d):  # noqa: ANN001, ANN201
    """Forward, vol at the forward and at seven levels of moneyness, straddle and skew."""
    strikes = stored(options.strike_vols(options.quoted(quotes_of(spark, d))), "strike-vols")
    places = {"fwd": 4, "atm": 5, "straddle": 3, "vol_90": 4, "vol_110": 4} | {f"m{round(m * 100)}": 4 for m in options.LEVELS}
    both = options.surface(strikes).join(options.moneyness_vols(strikes), ["symbol", "dte"])
    return both.select("symbol", "dte", *(F.round(c, n).alias(c) for c, n in places.items()), (F.round("skew", 4) + 0.0).alias("skew"))


@query(
    "opt_vol_monitor",
    f"""WITH {SURFACE}, {PART_VOLS}, vm AS (SELECT symbol, arg_min((dte, atm, straddle, spot), (abs(dte - 30), dte)) AS a, arg_min((dte, atm), (abs(dte - 90), dte)) AS b FROM sf GROUP BY symbol)
    SELECT symbol, a[1] AS dte_30, round(a[2], 5) AS iv_30, round(CASE WHEN a[1] <> b[1] THEN b[2] END, 5) AS iv_90, round(rv10, 5) AS rv10, round(rv20, 5) AS rv20, round(rv60, 5) AS rv60, round(CASE WHEN a[1] <> b[1] THEN b[2] - a[2] END, 5) + 0.0 AS slope,
    round(a[2] - nullif(rv20, 0), 5) + 0.0 AS premium, round(a[2] / nullif(rv20, 0), 4) AS ratio, round(a[2] * sqrt(a[1] / 365), 5) AS move, round(a[3] / a[4], 5) AS straddle FROM vm LEFT JOIN rv USING (symbol)""",
)
def vol_monitor(spark, d):  # noqa: ANN001, ANN201
    """ATM vol near 30 and 90 days against what was realised."""
    m = options.vol_monitor(surfaces(spark, d), part_vols(spark, d))
    out = take(m.withColumn("ratio", F.round("ratio", 4)), "symbol dte_30", "iv_30 iv_90 rv10 rv20 rv60 slope premium ratio move straddle", 5)
    return out.withColumns({c: F.col(c) + 0.0 for c in ("slope", "premium")})


FAIR = "coalesce(nullif(rv20, 0), 0.3)"


@query("opt_chain_edge",
    f"WITH {QUOTED}, {PART_VOLS}, fv AS (SELECT symbol, spot, strike, dte, t, type, rate, div, mid, {FAIR} AS vol FROM iv LEFT "
    f"JOIN rv USING (symbol) WHERE abs(strike / spot - 1) <= 0.15), {greeks_sql('fg', 'fv')} "
    f"SELECT symbol, dte, type, round(strike, 4) AS strike, round(mid, 3) AS mid, round(price, 3) AS fair, round(mid - price, "
    f"3) + 0.0 AS edge FROM fg")
def chain_edge(spark, d):  # noqa: ANN001, ANN201
    """Mid against the price at the vol realised over 20 returns (0.3 where there aren't as many)."""
    q = options.quoted(quotes_of(spark, d)).drop("price").join(part_vols(spark, d), "symbol", "left")
    e = options.chain_edge(q, F.coalesce(F.nullif(F.col("rv20"), F.lit(0.0)), F.lit(0.3)), 0.15)
    return e.select("symbol", "dte", "type", F.round("strike", 4).alias("strike"), F.round("mid", 3).alias("mid"), F.round("fair", 3).alias("fair"), (F.round("edge", 3) + 0.0).alias("edge"))


TEMPLATE_SQL = "tp AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k}, '{ty}', {m}::DOUBLE, {q}, {later})" for n, k, ty, m, q, later in options.template_rows()) + ") v(template, leg, type, multiple, qty, later))"
LEGS = f"""{QUOTED}, {TEMPLATE_SQL}, rk AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY dte) - 1 AS e FROM iv),
lg AS (SELECT symbol, template, leg, type, qty, dte, t, spot, strike, rate, div, coalesce(iv, vol) AS vol, CASE WHEN qty > 0 AND ask > 0 THEN ask WHEN qty < 0 AND bid > 0 THEN bid ELSE mid END AS entry FROM rk JOIN tp USING (type) WHERE e = least(2, later * 2)
    QUALIFY row_number() OVER (PARTITION BY symbol, template, leg ORDER BY abs(strike - spot * multiple), strike) = 1
    UNION ALL SELECT p_partkey, template, leg, type, qty, 0, 0, p_retailprice, 0, 0.03, 0.01, 0, p_retailprice FROM part, tp WHERE type = 'u')"""


#: Symbols of a task of legs: so few that what is sorted there (some 200 rows a symbol) stays in memory.
SYMBOLS = 8000


def legs(spark, d):  # noqa: ANN001, ANN201
    n = src.table(spark, d, "part").count() // SYMBOLS
    return options.leg_match(options.quoted(quotes_of(spark, d)), tasks=max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))


@query("opt_leg_match", f"WITH {LEGS} SELECT symbol, template, leg, type, qty, dte, round(strike, 4) AS strike, round(entry, 3) AS entry FROM lg")
def leg_match(spark, d):  # noqa: ANN001, ANN201
    """Every template on every symbol."""
    return legs(spark, d).select("symbol", "template", "leg", "type", "qty", "dte", F.round("strike", 4).alias("strike"), F.round("entry", 3).alias("entry"))


def books(spark, d):  # noqa: ANN001, ANN201
    """A book per symbol and template; its legs lie where its symbol is."""
    return legs(spark, d).withColumn("book", F.concat_ws(":", "symbol", "template"))


BOOK = ("symbol", "book")


def valued_sql(name: str, source: str) -> str:
    """Legs with price and greeks; the underlying is worth its spot."""
    flat = ", ".join(f"CASE WHEN type = 'u' THEN {1 if g == 'delta' else 0} ELSE {g} END AS {g}" for g in options.GREEKS)
    return f"""{name}_s AS (SELECT * REPLACE (CASE WHEN type = 'u' THEN spot ELSE strike END AS strike) FROM {source}), {greeks_sql(f"{name}_g", f"{name}_s")},
{name} AS (SELECT * REPLACE (CASE WHEN type = 'u' THEN spot ELSE price END AS price, {flat}) FROM {name}_g)"""


def _money(df, keys, places):  # noqa: ANN001, ANN202
    return df.select(*keys, *((F.round(c, n) + 0.0).alias(c) for c, n in places.items()))


def _money_sql(places: dict[str, int], how: str = "{}") -> str:
    return ", ".join(f"round({how.format(c)}, {n}) + 0.0 AS {c}" for c, n in places.items())


LEG_PLACES = {"value": 2, "pnl": 2, "delta": 3, "gamma": 4, "vega": 2, "theta": 2, "rho": 2, "vanna": 2, "volga": 1}


@query(
    "opt_leg_greeks",
    f"""WITH {LEGS}, {valued_sql("lv", "lg")}, lm AS (SELECT symbol || ':' || template AS book, leg, qty * 100 * price AS value, qty * 100 * (price - entry) AS pnl, {", ".join(f"qty * 100 * {g} AS {g}" for g in options.GREEKS)} FROM lv)
    SELECT book, leg, {_money_sql(LEG_PLACES, "sum({})")} FROM lm GROUP BY GROUPING SETS ((book, leg), (book))""",
)
def leg_greeks(spark, d):  # noqa: ANN001, ANN201
    """By leg, and each book's total (leg null)."""
    return _money(options.leg_greeks(books(spark, d), by=BOOK), ["book", "leg"], LEG_PLACES)


GRID_PLACES = {"pnl": 2, "delta": 3, "gamma": 4, "vega": 2, "theta": 2}


@query(
    "opt_risk_grid",
    f"""WITH {LEGS}, rg AS (SELECT * REPLACE (spot * (1 + spot_move) AS spot, greatest(vol + vol_shift, 1e-4) AS vol) FROM lg, (SELECT unnest([-0.1, 0.0, 0.1])::DOUBLE AS spot_move), (SELECT unnest([-0.05, 0.0, 0.05])::DOUBLE AS vol_shift)), {valued_sql("rv", "rg")}
    SELECT symbol || ':' || template AS book, spot_move, vol_shift, round(sum(qty * 100 * (price - entry)), 2) + 0.0 AS pnl, {_money_sql({k: v for k, v in GRID_PLACES.items() if k != "pnl"}, "sum(qty * 100 * {})")} FROM rv GROUP BY ALL""",
)
def risk_grid(spark, d):  # noqa: ANN001, ANN201
    return _money(options.risk_grid(books(spark, d), [-0.1, 0.0, 0.1], [-0.05, 0.0, 0.05], by=BOOK), ["book", "spot_move", "vol_shift"], GRID_PLACES)


SPLIT_PLACES = {"move": 4, "pnl": 2, "delta_part": 2, "gamma_part": 2, "rest": 2}


@query(
    "opt_sigma_split",
    f"""WITH {LEGS}, bo AS MATERIALIZED (SELECT symbol || ':' || template AS book, * FROM lg), sd AS (SELECT book, coalesce(avg(vol) FILTER (type <> 'u'), 0.3) AS sg1 FROM bo GROUP BY book),
    sc AS MATERIALIZED (SELECT * REPLACE (spot + move AS spot, greatest(vol, 1e-4) AS vol) FROM (SELECT bo.*, sigma, sigma * spot * sg1 / sqrt(252) AS move FROM bo JOIN sd USING (book), (SELECT unnest([0, -2, -1, 1, 2])::DOUBLE AS sigma))), {valued_sql("sv", "sc")},
    su AS MATERIALIZED (SELECT book, sigma, max(move) AS move, sum(qty * 100 * price) AS value, sum(qty * 100 * delta) AS delta, sum(qty * 100 * gamma) AS gamma FROM sv GROUP BY ALL),
    sp AS (SELECT s.book, s.sigma, s.move, s.value - z.value AS pnl, z.delta * s.move AS delta_part, z.gamma * s.move * s.move / 2 AS gamma_part FROM su s JOIN su z ON s.book = z.book AND z.sigma = 0 WHERE s.sigma <> 0)
    SELECT book, sigma, {_money_sql(SPLIT_PLACES).replace("round(rest,", "round(pnl - delta_part - gamma_part,")} FROM sp""",
)
def sigma_split(spark, d):  # noqa: ANN001, ANN201
    return _money(options.sigma_split(books(spark, d), [-2.0, -1.0, 1.0, 2.0], by=BOOK), ["book", "sigma"], SPLIT_PLACES)


PROFILE_PLACES = {"max_profit": 2, "max_loss": 2, "p_profit": 5, "first_breakeven": 3, "last_breakeven": 3}


def cdf_sql(z: str) -> str:
    return f"CASE WHEN {z} > 0 THEN 1 - ({tail_sql(f'abs({z})')}) ELSE {tail_sql(f'abs({z})')} END"


# Points: zero, the strikes that expire first, a grid where a later leg is left, and far out; then between each two points.
PROFILE = f"""bo AS MATERIALIZED (SELECT symbol || ':' || template AS book, * FROM lg),
hz AS MATERIALIZED (SELECT book, min(t) FILTER (type <> 'u') AS h, max(t) FILTER (type <> 'u') AS l, avg(vol) FILTER (type <> 'u') AS v, max(spot) AS s0, max(rate - div) AS drift FROM bo GROUP BY book),
pt AS (SELECT book, 1e-6::DOUBLE AS s, false AS far FROM hz UNION SELECT book, strike, false FROM bo JOIN hz USING (book) WHERE type <> 'u' AND t = h
    UNION SELECT book, s0 * (0.02::DOUBLE + i * 3.98::DOUBLE / 299), false FROM hz, (SELECT unnest(range(0, 300)) AS i) WHERE l > h UNION SELECT book, s0 * 50, true FROM hz),
ec AS MATERIALIZED (SELECT bo.* REPLACE (pt.s AS spot, greatest(bo.t - h, 0) AS t, greatest(vol, 1e-4) AS vol), far, l <= h AS straight, ln(s0) + (drift - v * v / 2) * h AS mu, v * sqrt(greatest(h, 1e-6)) AS sd FROM bo JOIN hz USING (book) JOIN pt USING (book)),
{valued_sql("ev", "ec")},
e1 AS MATERIALIZED (SELECT book, spot AS s, far, straight, mu, sd, round(sum(qty * 100 * (price - entry)), 6) + 0.0 AS pnl, round(sum(qty * 100 * delta), 6) + 0.0 AS slope FROM ev GROUP BY ALL),
e2 AS MATERIALIZED (SELECT *, (ln(s) - mu) / sd AS z FROM e1), e3 AS MATERIALIZED (SELECT *, {cdf_sql("z")} AS below FROM e2),
e4 AS MATERIALIZED (SELECT *, lag(pnl) OVER w AS p0, lag(s) OVER w AS x0, lag(below) OVER w AS n0, max(slope) FILTER (far) OVER (PARTITION BY book) AS tail, NOT far AND lead(s) OVER w IS NULL AS ends FROM e3 WINDOW w AS (PARTITION BY book, far ORDER BY s)),
e5 AS (SELECT book, s, pnl, below, p0, n0, mu, sd, tail, ends, CASE WHEN p0 = 0 THEN x0 WHEN p0 * pnl < 0 THEN x0 - p0 * (s - x0) / (pnl - p0) END AS be, CASE WHEN ends AND straight AND tail <> 0 AND pnl * tail <= 0 THEN s - pnl / tail END AS out FROM e4 WHERE NOT far),
e6 AS MATERIALIZED (SELECT *, (ln(be) - mu) / sd AS bz, (ln(out) - mu) / sd AS oz FROM e5), e7 AS MATERIALIZED (SELECT *, {cdf_sql("bz")} AS bn, {cdf_sql("oz")} AS o_n FROM e6),
e8 AS (SELECT *, CASE WHEN p0 * pnl < 0 THEN CASE WHEN pnl > 0 THEN below - bn ELSE bn - n0 END WHEN greatest(p0, pnl) > 0 AND p0 IS NOT NULL THEN below - n0 ELSE 0 END
    + CASE WHEN NOT ends THEN 0 WHEN out IS NULL THEN CASE WHEN pnl > 0 THEN 1 - below ELSE 0 END WHEN tail > 0 THEN 1 - o_n ELSE o_n - below END AS mass FROM e7)"""


@query(
    "opt_expiry_profile",
    f"""WITH {LEGS}, {PROFILE}
    SELECT book, count(be) + count(out) AS n_breakevens, max(tail) > 0 AS unlimited_profit, max(tail) < 0 AS unlimited_loss, CASE WHEN max(tail) <= 0 THEN round(max(pnl), 2) + 0.0 END AS max_profit, CASE WHEN max(tail) >= 0 THEN round(min(pnl), 2) + 0.0 END AS max_loss,
        round(sum(mass), 5) + 0.0 AS p_profit, round(least(min(be), min(out)), 3) + 0.0 AS first_breakeven, round(greatest(max(be), max(out)), 3) + 0.0 AS last_breakeven FROM e8 GROUP BY book""",
)
def expiry_profile(spark, d):  # noqa: ANN001, ANN201
    """Best, worst, breakevens and chance of a profit when the first option of a book expires."""
    p = options.expiry_profile(options.expiry_curve(books(spark, d), steps=299, by=BOOK))
    n = F.size("breakevens")
    ends = {"n_breakevens": n.cast("long"), "first_breakeven": F.get("breakevens", F.lit(0)), "last_breakeven": F.when(n > 0, F.get("breakevens", n - 1))}
    return _money(p.withColumns(ends), ["book", "n_breakevens", "unlimited_profit", "unlimited_loss"], PROFILE_PLACES)


RV = (10, 20, 60, 120)
QUOTES = """q0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM sc)"""


@query(
    "agg_quotes",
        "WITH sc AS (SELECT l_suppkey AS symbol, l_shipdate::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem "
        "GROUP BY ALL), "
        + QUOTES + " SELECT symbol, max(date) AS date, count(*) AS n, round(max(close) FILTER (back = 1) + 1e-9, 6) AS last, "
    + ", ".join(f"round(max(close) FILTER (back = 1) / max(close) FILTER (back = {k}) - 1, 6) AS {c}" for c, k in (("chg_1d", 2), ("chg_1m", 22), ("chg_1y", 253)))
    + ", round(max(close) FILTER (back <= 252) + 1e-9, 6) AS hi_52w, round(min(close) FILTER (back <= 252) + 1e-9, 6) AS lo_52w, "
    + ", ".join(f"round(CASE WHEN count(r) >= {k} THEN stddev_samp(r) FILTER (back <= {k}) * sqrt(252) END, 6) AS rv{k}" for k in RV)
    + " FROM q0 GROUP BY symbol HAVING count(*) >= 30",
)
def quotes(spark, d):  # noqa: ANN001, ANN201
    """Last price, changes over a day, a month and a year of rows, range of 252 rows, realised vols."""
    px = src.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))
    q = panel.quotes(px, "symbol", "date", "close", RV)
    # Cents by whole quantities may lie on a tie of any rounding, on either side of it by the order of sums: lifted off it.
    return take(q.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("last", "hi_52w", "lo_52w")}), "symbol date n last hi_52w lo_52w", "chg_1d chg_1m chg_1y " + " ".join(f"rv{k}" for k in RV))


@query("agg_trailing_dividend_yield", with_sql("daily", "act", more=
    "dv AS (SELECT ticker, max(date) AS last FROM act WHERE kind = 'dividend' GROUP BY ticker), s AS (SELECT a.ticker, sum(value) AS paid "
    "FROM act a JOIN dv USING (ticker) WHERE kind = 'dividend' AND date > last - 365 "
    "GROUP BY a.ticker), l AS (SELECT ticker, arg_max(close, date) AS spot FROM daily GROUP BY ticker)") + "SELECT ticker, round(paid / nullif(spot, 0), 6) AS dividend_yield FROM s JOIN l USING (ticker)")
def dividend_yield(spark, d):  # noqa: ANN001, ANN201
    paid = src.actions(spark, d).where("kind = 'dividend'")
    last = paid.groupBy("ticker").agg(F.max("date").alias("last"))
    sums = paid.join(last, "ticker").where(F.col("date") > F.date_sub("last", 365)).groupBy("ticker").agg(F.sum("value").alias("paid"))
    spot = src.daily_events(spark, d).groupBy("ticker").agg(F.max_by("close", "date").alias("spot"))
    return take(sums.join(spot, "ticker").withColumn("dividend_yield", F.col("paid") / F.nullif(F.col("spot"), F.lit(0.0))), "ticker", "dividend_yield")


@query(
    "agg_returns_summary",
    with_sql("px", "bk", more=
        "r AS (SELECT ticker, close, date, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back "
        "FROM px), y AS (SELECT ticker, arg_max(close, date) AS close FROM px JOIN (SELECT ticker, year(max(date)) AS last FROM px "
        "GROUP BY ticker) USING (ticker) WHERE year(date) < last GROUP BY ticker), s AS (SELECT r.ticker, "
        "max(r.close) FILTER (back = 1) AS last, max(r.close) FILTER (back = 1) / max(r.close) FILTER (back = 4) - 1 AS ret_3, "
        "max(r.close) FILTER (back = 1) / max(r.close) FILTER (back = 13) - 1 AS ret_12, "
        "max(r.close) FILTER (back = 1) / max(y.close) - 1 AS ytd FROM r LEFT JOIN y USING (ticker) GROUP BY r.ticker)")
    +
        "SELECT ticker, basket, round(last, 6) AS last, round(ret_3, 6) AS ret_3, round(ret_12, 6) AS ret_12, round(ytd, 6) AS ytd, "
        "round(avg(ret_12) OVER (PARTITION BY basket), 6) AS basket_12 FROM s JOIN bk USING (ticker)",
)
def returns_summary(spark, d):  # noqa: ANN001, ANN201
    """Last price, returns over 3 and 12 months and since the year began, and the mean 12-month return of the basket."""
    out = panel.returns_summary(src.monthly_prices(spark, d), "ticker", "date", "close", {"ret_3": 3, "ret_12": 12}).join(src.baskets(spark, d), "ticker")
    out = out.withColumn("basket_12", F.avg("ret_12").over(Window.partitionBy("basket")))
    return take(out, "ticker basket", "last ret_3 ret_12 ytd basket_12")


@query("src_json_props", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_props(spark, d):  # noqa: ANN001, ANN201
    return src.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("sink_json_doc", "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def json_doc(spark, d):  # noqa: ANN001, ANN201
    """A nested document per conversation, written as JSON files and read back from them."""
    doc = src.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    path = scratch_path(spark, "json-doc")
    sinks.write_json(doc, path)
    back = spark.read.schema(doc.schema).json(path)
    return back.select("conv_id", F.size("turns").cast("long").alias("n"), F.array_join("turns.role", ",").alias("roles"))
