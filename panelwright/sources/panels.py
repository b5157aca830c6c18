"""The test tables as panels, facts, events and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.scalars import friday


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date (month end), close: mean price of what a supplier shipped."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("ticker"), F.last_day(F.to_date("l_shipdate")).alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


def weekly_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (part type), date (Friday), value."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    joined = li.join(part, li.l_partkey == part.p_partkey)
    return joined.groupBy(F.col("p_type").alias("symbol"), friday(F.to_date("l_shipdate")).alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("value"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, basket (nation), super_basket (region)."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("ticker"), F.col("n_nationkey").alias("basket"), F.col("n_regionkey").alias("super_basket"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal: key, filed, value, is_amendment and tie-breaks."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.to_date("l_shipdate").alias("filed"), F.col("l_extendedprice").alias("value"), (F.col("l_returnflag") == "R").alias("is_amendment"),
        F.col("l_linenumber").alias("t1"), F.col("l_partkey").alias("t2"), F.col("l_suppkey").alias("t3"), F.col("l_quantity").alias("t4"),
    )


def quarterly_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cik, fp, fy, period_end, filed, eps."""
    li = table(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    end = F.last_day(F.add_months(F.trunc("d", "quarter"), 2))
    q = li.groupBy(F.col("l_suppkey").alias("cik"), end.alias("period_end")).agg(F.avg("l_extendedprice").alias("eps"))
    return q.select("cik", "period_end", F.year("period_end").alias("fy"), F.concat(F.lit("Q"), F.quarter("period_end")).alias("fp"), F.date_add("period_end", 40).alias("filed"), "eps")


def annual_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cik, fy, period_end, filed and one column per concept, from what a supplier shipped in a year."""
    li = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    gross = F.col("l_extendedprice")
    out = li.groupBy(F.col("l_suppkey").alias("cik"), year.alias("fy")).agg(
        F.sum(gross).alias("revenue"), F.sum(gross * (F.lit(0.3) - F.col("l_discount"))).alias("operating_income"), F.sum(gross * (F.lit(0.2) - F.col("l_discount") * 2)).alias("net_income"),
        F.sum(gross * F.col("l_tax")).alias("tax_expense"), F.sum(gross * F.lit(0.02)).alias("interest_expense"), F.sum(F.col("l_quantity") * 30).alias("depreciation"),
        F.sum(F.when(F.col("l_returnflag") != "R", gross * 0.25)).alias("operating_cash_flow"), F.sum(F.col("l_quantity") * 40).alias("capex"), F.sum(F.when(F.col("l_linestatus") == "O", gross * 0.5)).alias("long_term_debt"),
        F.sum(F.when(F.col("l_returnflag") == "A", gross * 0.1)).alias("cash"), F.sum(gross * 2).alias("total_assets"), F.sum(gross * 0.8).alias("stockholders_equity"), F.sum("l_quantity").alias("shares"),
    )
    return out.withColumn("period_end", F.make_date("fy", F.lit(12), F.lit(31))).withColumn("filed", F.date_add("period_end", 60))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker (user), date, close (the last known value of the day)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("ts", "event_id"))).alias("close"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, kind, value."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup"))
    return e.select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"), F.when(F.col("event_type") == "purchase", "dividend").otherwise("split").alias("kind"), "value", "event_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph of nations: each feeds the next and the one five on."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    return n.select("src", F.explode(F.array(F.pmod(F.col("src") + 1, F.lit(25)), F.pmod(F.col("src") + 5, F.lit(25)))).alias("dst"))


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commodity (part type), country (supplier's nation), year, production."""
    li, part, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = li.join(part.select("p_partkey", "p_type"), li.l_partkey == F.col("p_partkey")).join(s.select("s_suppkey", "s_nationkey"), li.l_suppkey == F.col("s_suppkey"))
    return joined.groupBy(F.col("p_type").alias("commodity"), F.col("s_nationkey").alias("country"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("production"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commodity, src (supplier's nation), dst (customer's nation), value."""
    li, part, s, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "orders", "customer"))
    joined = li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(part.select("p_partkey", "p_type"), li.l_partkey == F.col("p_partkey")).join(s.select("s_suppkey", "s_nationkey"), li.l_suppkey == F.col("s_suppkey"))
    return joined.groupBy(F.col("p_type").alias("commodity"), F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.sum("l_extendedprice").alias("value"))


#: The same panels as DuckDB common table expressions.
SQL = {
    "px": "px AS (SELECT l_suppkey AS ticker, last_day(l_shipdate::DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY ALL)",
    "drv": "drv AS (SELECT p_type AS symbol, (l_shipdate::DATE + ((5 - dayofweek(l_shipdate) + 7) % 7)::INT)::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)",
    "bk": "bk AS (SELECT s_suppkey AS ticker, n_nationkey AS basket, n_regionkey AS super_basket FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "facts": "facts AS (SELECT l_orderkey AS key, l_shipdate::DATE AS filed, l_extendedprice AS value, l_returnflag = 'R' AS is_amendment, l_linenumber AS t1, l_partkey AS t2, l_suppkey AS t3, l_quantity AS t4 FROM lineitem)",
    "eps": "eps0 AS (SELECT l_suppkey AS cik, last_day((date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH)::DATE) AS period_end, avg(l_extendedprice) AS eps FROM lineitem GROUP BY ALL), eps AS (SELECT cik, period_end, year(period_end)::INT AS fy, 'Q' || quarter(period_end) AS fp, (period_end + 40)::DATE AS filed, eps FROM eps0)",
    "annual": """annual0 AS (SELECT l_suppkey AS cik, year(l_shipdate)::INT AS fy, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (0.3 - l_discount)) AS operating_income, sum(l_extendedprice * (0.2 - l_discount * 2)) AS net_income,
        sum(l_extendedprice * l_tax) AS tax_expense, sum(l_extendedprice * 0.02) AS interest_expense, sum(l_quantity * 30) AS depreciation, sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * 0.25 END) AS operating_cash_flow,
        sum(l_quantity * 40) AS capex, sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice * 0.5 END) AS long_term_debt, sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * 0.1 END) AS cash,
        sum(l_extendedprice * 2) AS total_assets, sum(l_extendedprice * 0.8) AS stockholders_equity, sum(l_quantity) AS shares FROM lineitem GROUP BY ALL),
        annual AS (SELECT *, make_date(fy, 12, 31) AS period_end, (make_date(fy, 12, 31) + 60)::DATE AS filed FROM annual0)""",
    "daily": "daily AS (SELECT user_id AS ticker, ts::DATE AS date, max_by(value, (ts, event_id)) AS close FROM events GROUP BY ALL)",
    "act": "act AS (SELECT user_id AS ticker, ts::DATE AS date, CASE event_type WHEN 'purchase' THEN 'dividend' ELSE 'split' END AS kind, value, event_id FROM events WHERE event_type IN ('purchase', 'signup'))",
    "edges": "edges AS (SELECT n_nationkey AS src, unnest([(n_nationkey + 1) % 25, (n_nationkey + 5) % 25]) AS dst FROM nation)",
    "prod": "prod AS (SELECT p_type AS commodity, s_nationkey AS country, year(l_shipdate)::INT AS year, sum(l_quantity) AS production FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)",
    "trade": "trade AS (SELECT p_type AS commodity, s_nationkey AS src, c_nationkey AS dst, sum(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)",
}


def with_sql(*names: str, more: str = "") -> str:
    """WITH these panels (and more expressions)."""
    return "WITH " + ",\n".join([SQL[n] for n in names] + ([more] if more else "".split())) + "\n"
