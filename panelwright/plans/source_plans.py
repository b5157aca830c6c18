"""Sources and sinks exercised over whole tables: written to the shared folder, read back and compared by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.scalars import clean_number
from panelwright.sources import panels as src
from panelwright.sources import readers, sinks
from panelwright.sources.scratch import scratch_path
from panelwright.streaming.append import append_stream

from .registry import query, take


@query("src_parquet", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= DATE '1998-01-01'")
def parquet(spark, d):  # noqa: ANN001, ANN201
    return readers.parquet(spark, f"{d}/lineitem.parquet").where("l_shipdate >= DATE '1998-01-01'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("src_csv", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def csv(spark, d):  # noqa: ANN001, ANN201
    path = scratch_path(spark, "csv")
    src.table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice").write.csv(path, header=True)
    return readers.csv(spark, path, "p_partkey long, p_brand string, p_retailprice double")


@query("src_prices_wide",
    "WITH e AS (SELECT user_id AS ticker, ts::DATE AS date, CASE event_type WHEN 'purchase' THEN 'dividend' WHEN 'signup' THEN 'split' "
    "END AS kind, value FROM events) SELECT ticker, date, kind, round(sum(value), 6) AS value FROM e WHERE kind IS NOT NULL GROUP BY ALL "
    "HAVING sum(value) <> 0")
def prices_wide(spark, d):  # noqa: ANN001, ANN201
    e = src.table(spark, d, "events")
    on = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0))
    wide = e.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(F.min("value").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max("value").alias("close"), F.count("*").alias("volume"), on("purchase").alias("dividends"), on("signup").alias("splits"))
    return take(readers.prices_wide(wide)[1], "ticker date kind", "value")


@query("src_holdings", "SELECT upper('t' || s_suppkey) AS ticker, s_acctbal AS market_value FROM supplier WHERE s_nationkey % 2 = 0")
def holdings(spark, d):  # noqa: ANN001, ANN201
    s = src.table(spark, d, "supplier")
    raw = s.select(F.concat(F.lit("t"), "s_suppkey").alias("Ticker"), F.col("s_name").alias("Name"), F.when(F.col("s_nationkey") % 2 == 0, "Equity").otherwise("Cash").alias("Type"), F.lit("5 %").alias("Market Weight"), F.concat(F.lit("$ "), F.format_number("s_acctbal", 2)).alias("Market Value"))
    return readers.holdings(raw).select("ticker", "market_value")


@query("src_series_jsonl",
    "SELECT p_type AS series_id, strftime(last_day(l_shipdate::DATE), '%Y%m') AS period, round(sum(l_quantity), 4) AS value FROM lineitem "
    "JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def series_jsonl(spark, d):  # noqa: ANN001, ANN201
    li, part = src.table(spark, d, "lineitem"), src.table(spark, d, "part").select("p_partkey", "p_type")
    monthly = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("series_id"), F.date_format("l_shipdate", "yyyyMM").alias("period")).agg(F.round(F.sum("l_quantity"), 4).alias("value"))
    path = scratch_path(spark, "series")
    monthly.groupBy("series_id").agg(F.collect_list(F.array("period", F.col("value").cast("string"))).alias("data")).write.json(path)
    return readers.series_lines(spark, path, ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])


@query("src_facts_json",
    "SELECT l_suppkey AS cik, 'revenue' AS concept, 'Revenues' AS concept_used, l_orderkey || '-' || l_linenumber AS accession, "
    "l_shipdate::DATE AS filed, l_returnflag = 'R' AS is_amendment, l_extendedprice AS value FROM lineitem")
def facts_json(spark, d):  # noqa: ANN001, ANN201
    li = src.table(spark, d, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    item = F.struct(day.alias("start"), day.alias("end"), F.year("l_shipdate").alias("fy"), F.lit("FY").alias("fp"), F.when(F.col("l_returnflag") == "R", "10-K/A").otherwise("10-K").alias("form"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("accn"), day.alias("filed"), F.col("l_extendedprice").alias("val"))
    docs = li.groupBy("l_suppkey").agg(F.collect_list(item).alias("items"))
    payload = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.col("items").alias("USD")).alias("units")).alias("Revenues")).alias("us-gaap")).alias("facts")))
    documents = docs.select(F.concat(F.lit("CIK"), "l_suppkey").alias("key"), payload.alias("payload"))
    chains = spark.createDataFrame([("revenue", "SalesRevenueNet", 0), ("revenue", "Revenues", 1)], "concept string, tag string, place int")
    return readers.facts(documents, chains).select("cik", "concept", "concept_used", "accession", "filed", "is_amendment", "value")


@query("src_submissions", "SELECT c_custkey AS cik, c_name AS name, CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment || '|X' END AS tickers FROM customer")
def submissions(spark, d):  # noqa: ANN001, ANN201
    c = src.table(spark, d, "customer")
    tickers = F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit(""))).otherwise(F.array("c_mktsegment", F.lit(None).cast("string"), F.lit("X")))
    doc = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("cik"), F.col("c_name").alias("name"), tickers.alias("tickers")))
    return readers.submissions(c.select(F.current_date().alias("snapshot_date"), doc.alias("payload"))).select("cik", "name", "tickers")


@query("sink_append_new", "SELECT o_custkey, min(o_orderdate)::DATE AS first_date FROM orders GROUP BY o_custkey")
def append(spark, d):  # noqa: ANN001, ANN201
    """Two overlapping loads: keys already there are left alone."""
    path = scratch_path(spark, "append")
    firsts = src.table(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first_date"))
    sinks.append_new(firsts.where("o_custkey % 2 = 0"), path, ["o_custkey"])
    sinks.append_new(firsts, path, ["o_custkey"])
    return spark.read.parquet(path)


@query("sink_append_stream", "SELECT o_orderkey, year(o_orderdate)::INT AS year, o_custkey FROM orders")
def append_in_stream(spark, d):  # noqa: ANN001, ANN201
    """Orders that arrive in four files, a part of them twice; the stream runs, runs again, and is set up once more from the
    start, which adds nothing."""
    source, path = scratch_path(spark, "arriving"), scratch_path(spark, "appended")
    orders = src.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_custkey")
    orders.union(orders.where("o_custkey % 3 = 0")).repartition(4).write.parquet(source)
    first, again = scratch_path(spark, "checkpoint"), scratch_path(spark, "checkpoint")
    for checkpoint in (first, first, again):
        stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(source)
        append_stream(stream, path, ["o_orderkey", "year"], checkpoint, "year").awaitTermination()
    return sinks.batches(spark, path)


@query("sink_vintage",
    "SELECT p_brand AS period, 'n' AS series, count(*)::DOUBLE AS value FROM part GROUP BY 1 UNION ALL "
    "SELECT p_brand, 'size', sum(p_size)::DOUBLE FROM part GROUP BY 1")
def vintage(spark, d):  # noqa: ANN001, ANN201
    path = scratch_path(spark, "vintage")
    wide = src.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))
    for _ in range(2):  # the second time adds nothing
        sinks.append_vintage(wide, path, "p_brand", F.lit("1998-07-01").cast("date"))
    return spark.read.parquet(path).select("period", "series", "value")


@query("sink_snapshot", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1")
def snapshot(spark, d):  # noqa: ANN001, ANN201
    """Snapshots by year, written twice; the newest before 1997-06-30 is read."""
    path = scratch_path(spark, "snapshot")
    yearly = src.table(spark, d, "orders").groupBy(F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("as_of"), "o_orderpriority").agg(F.count("*").alias("n"))
    sinks.write_snapshot(yearly, path)
    sinks.write_snapshot(yearly.where("as_of >= DATE '1996-01-01'"), path)
    return sinks.latest_prior(spark, path, "1997-06-30").select("o_orderpriority", "n")


@query("guard_coverage",
    "WITH n AS (SELECT count(DISTINCT ts::DATE) AS n, max(ts::DATE) AS last FROM events "
    "WHERE event_type = 'view'), k AS (SELECT user_id AS ticker, count(DISTINCT ts::DATE) AS k, max(ts::DATE) AS seen FROM events "
    "WHERE event_type = 'view' GROUP BY 1) SELECT ticker, k FROM k, n WHERE k >= n * 0.3 AND seen >= last - 3")
def guard(spark, d):  # noqa: ANN001, ANN201
    """Symbols with enough dates and a recent one, published because they cover enough of all."""
    e = src.table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"), "value")
    kept = sinks.fresh_symbols(sinks.dense_symbols(e, "ticker", "date", "value", 0.3), "ticker", "date", 3, e.agg(F.max("date").alias("last")))
    path = scratch_path(spark, "guarded")
    wanted = e.select("ticker").distinct().count()
    if not sinks.publish(kept.groupBy("ticker").agg(F.count_distinct("date").alias("k")), path, "ticker", "k", wanted, 0.2):
        raise ValueError("too few symbols to publish")
    return sinks.published(spark, path)


@query("fn_clean_number", "SELECT s_suppkey, s_acctbal AS x FROM supplier")
def numbers(spark, d):  # noqa: ANN001, ANN201
    return src.table(spark, d, "supplier").select("s_suppkey", clean_number(F.concat(F.lit("$"), F.format_number("s_acctbal", 2))).alias("x"))
