"""Point-in-time reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import panel, pit
from panelwright.sources import panels as src
from panelwright.sources.panels import with_sql

from .registry import query, take

AS_OF = "1998-06-30"
GRID = [f"{y}-{m}" for y in (1996, 1997, 1998) for m in ("03-31", "06-30", "09-30", "12-31")]
TIES = ["t1", "t2", "t3", "t4"]


def _latest_sql(where: str, order: str) -> str:
    return with_sql("facts") + f"SELECT key, filed, value, is_amendment, t1 FROM facts WHERE filed <= DATE '{AS_OF}' {where} QUALIFY row_number() OVER (PARTITION BY key ORDER BY filed {order}, t1 DESC, t2 DESC, t3 DESC, t4 DESC) = 1"


@query("pit_facts_latest", _latest_sql("", "DESC"))
def facts_latest(spark, d):  # noqa: ANN001, ANN201
    return take(pit.latest(src.facts(spark, d), ["key"], AS_OF, TIES), "key filed value is_amendment t1")


@query("pit_facts_originals", _latest_sql("AND NOT is_amendment", "DESC"))
def facts_originals(spark, d):  # noqa: ANN001, ANN201
    return take(pit.latest(src.facts(spark, d), ["key"], AS_OF, TIES, originals="is_amendment"), "key filed value is_amendment t1")


@query("pit_facts_first", _latest_sql("", "ASC"))
def facts_first(spark, d):  # noqa: ANN001, ANN201
    return take(pit.latest(src.facts(spark, d), ["key"], AS_OF, TIES, first=True), "key filed value is_amendment t1")


@query(
    "pit_grid",
    with_sql("facts", more="g AS (SELECT unnest([" + ", ".join(f"DATE '{x}'" for x in GRID) + "]) AS as_of)")
    +
        "SELECT as_of, key, filed, value FROM g JOIN facts ON filed <= as_of QUALIFY row_number() OVER (PARTITION BY as_of, key "
        "ORDER BY filed DESC, t1 DESC, t2 DESC, t3 DESC, t4 DESC) = 1",
)
def facts_grid(spark, d):  # noqa: ANN001, ANN201
    dates = F.broadcast(spark.createDataFrame([(x,) for x in GRID], "as_of string").select(F.col("as_of").cast("date")))  # twelve rows
    return take(pit.grid(src.facts(spark, d), ["key"], dates, TIES), "as_of key filed value")


@query("pit_prices",
    "SELECT user_id AS ticker, ts::DATE AS date, event_type AS source, value FROM events "
    "QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 "
    "END, ts, event_id) = 1")
def prices_by_source(spark, d):  # noqa: ANN001, ANN201
    e = src.table(spark, d, "events").withColumns({"ticker": F.col("user_id"), "date": F.to_date("ts"), "source": F.col("event_type")})
    priority = F.when(F.col("source") == "view", 0).when(F.col("source") == "click", 1).otherwise(2)
    return take(pit.by_priority(e, ["ticker", "date"], priority, F.col("ts"), F.col("event_id")), "ticker date source value")


@query("pit_actions", with_sql("act") + "SELECT ticker, date, kind, value, event_id FROM act WHERE date <= (SELECT max(date) - 10 FROM act) AND kind = 'dividend'")
def actions_asof(spark, d):  # noqa: ANN001, ANN201
    a = src.actions(spark, d)
    day = F.broadcast(a.agg(F.date_sub(F.max("date"), 10).alias("as_of")))  # one row
    return take(a.join(day, F.col("date") <= F.col("as_of")).where("kind = 'dividend'"), "ticker date kind value event_id")


@query(
    "pit_macro",
        "WITH v AS (SELECT p_type AS series, date_trunc('month', l_shipdate)::DATE AS period, l_shipdate::DATE AS knowledge_date, "
        "sum(l_extendedprice) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) "
        f"SELECT series, period, knowledge_date, round(value, 4) AS value FROM v WHERE knowledge_date <= DATE '{AS_OF}' "
        f"QUALIFY row_number() OVER (PARTITION BY series, period ORDER BY knowledge_date DESC) = 1",
)
def macro_latest(spark, d):  # noqa: ANN001, ANN201
    li, part = src.table(spark, d, "lineitem"), src.table(spark, d, "part").select("p_partkey", "p_type")
    v = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("series"), F.trunc(F.to_date("l_shipdate"), "month").alias("period"), F.to_date("l_shipdate").alias("knowledge_date")).agg(F.sum("l_extendedprice").alias("value"))
    return take(pit.latest(v, ["series", "period"], AS_OF, [], "knowledge_date"), "series period knowledge_date", "value", 4)


@query("pit_latest_map",
    "SELECT o_custkey AS ticker, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS cik, max(o_orderdate)::DATE AS snapshot_date "
    "FROM orders GROUP BY ALL")
def latest_map(spark, d):  # noqa: ANN001, ANN201
    o = src.table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("ticker")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("cik"), F.to_date(F.max("o_orderdate")).alias("snapshot_date"))


@query(
    "pit_nearest_snapshot",
        "WITH s AS (SELECT DISTINCT o_custkey AS ticker, o_orderdate::DATE AS snapshot_date FROM orders) SELECT ticker, snapshot_date "
        "FROM s QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY (snapshot_date <= DATE '1995-01-01') DESC, "
        "CASE WHEN snapshot_date <= DATE '1995-01-01' THEN snapshot_date END DESC, snapshot_date) = 1",
)
def nearest(spark, d):  # noqa: ANN001, ANN201
    s = src.table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("snapshot_date")).distinct()
    return pit.nearest_snapshot(s, ["ticker"], "1995-01-01")


ASOF_SQL = """WITH t AS (SELECT event_id, user_id AS ticker, ts::DATE AS date FROM events WHERE event_type = 'purchase'),
p AS (SELECT user_id AS ticker, ts::DATE AS date, max_by(value, (ts, event_id)) AS close FROM events WHERE event_type = 'view' GROUP BY ALL)
"""


@query("pit_price_bounded", ASOF_SQL +
    "SELECT event_id, t.ticker, t.date, CASE WHEN t.date - p.date <= 3 THEN close END AS close, "
    "CASE WHEN t.date - p.date <= 3 THEN p.date END AS found_date FROM t ASOF LEFT JOIN (SELECT * FROM p "
    "WHERE close > 0) p ON t.ticker = p.ticker AND t.date >= p.date")
def bounded(spark, d):  # noqa: ANN001, ANN201
    e = src.table(spark, d, "events").withColumns({"ticker": F.col("user_id"), "date": F.to_date("ts")})
    quotes = e.where("event_type = 'view'").groupBy("ticker", "date").agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    return pit.asof_back(e.where("event_type = 'purchase'").select("event_id", "ticker", "date"), quotes, "ticker", "date", "close", 3)


@query("asof_forward",
    "WITH c AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5), "
    "t AS (SELECT DISTINCT l_shipdate::DATE AS signal_date FROM lineitem) SELECT signal_date, min(date) AS trade_date FROM t LEFT "
    "JOIN c ON date >= signal_date GROUP BY ALL")
def forward(spark, d):  # noqa: ANN001, ANN201
    calendar = src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).where(F.dayofweek("date").between(2, 6))
    return pit.asof_forward(src.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("signal_date")), calendar, "signal_date")


@query("grid_month_end", "SELECT max(o_orderdate::DATE) AS date FROM orders WHERE o_orderdate >= DATE '1994-01-01' GROUP BY date_trunc('month', o_orderdate)")
def months(spark, d):  # noqa: ANN001, ANN201
    return panel.month_ends(src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")), "1994-01-01")


@query("join_anti_missing",
    "SELECT c_custkey, c_nationkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders "
    "WHERE o_orderdate >= DATE '2001-01-01') ON c_custkey = o_custkey")
def missing(spark, d):  # noqa: ANN001, ANN201
    """Customers without an order in the last year."""
    recent = src.table(spark, d, "orders").where("o_orderdate >= DATE '2001-01-01'")
    return src.table(spark, d, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@query("join_semi_ids",
    "SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem "
    "WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey")
def live(spark, d):  # noqa: ANN001, ANN201
    returned = src.table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return src.table(spark, d, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("agg_coverage",
    "SELECT event_type AS kind, count(DISTINCT user_id) AS n_entities, min(ts)::DATE AS first_date, max(ts)::DATE AS last_date, "
    "count(*) AS n_rows FROM events GROUP BY 1")
def coverage(spark, d):  # noqa: ANN001, ANN201
    return src.table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count_distinct("user_id").alias("n_entities"), F.to_date(F.min("ts")).alias("first_date"), F.to_date(F.max("ts")).alias("last_date"), F.count("*").alias("n_rows"))
