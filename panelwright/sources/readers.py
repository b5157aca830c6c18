"""Readers: every one returns a DataFrame with a fixed schema and reads in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.scalars import clean_number

PRICES = "ticker string, date date, open double, high double, low double, close double, volume double"
FACTS = "struct<facts:map<string,map<string,struct<units:map<string,array<struct<start:string,end:string,fy:int,fp:string,form:string,accn:string,filed:string,val:double>>>>>>>"


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def json_documents(spark: SparkSession, path: str, column: str = "payload") -> DataFrame:
    """One row per file: key (from the file name), snapshot_date (from the modification time), the text. What doesn't parse
    becomes null further on and is dropped there."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return raw.select(name.alias("key"), F.to_date("_metadata.file_modification_time").alias("snapshot_date"), F.col("value").alias(column))


def facts(documents: DataFrame, chains: DataFrame, column: str = "payload") -> DataFrame:
    """Company facts as rows. chains: concept, tag, place (its order). Of each concept the first tag that a company has is
    taken; periods start at their start or, for instants, their end."""
    parsed = documents.select(F.regexp_extract("key", r"(\d+)", 1).cast("long").alias("cik"), F.from_json(column, FACTS)["facts"].alias("facts")).where("facts IS NOT NULL")
    tags = parsed.select("cik", F.explode("facts").alias("taxonomy", "tags")).select("cik", "taxonomy", F.explode("tags").alias("tag", "body"))
    met = tags.join(chains, "tag")
    first = met.groupBy("cik", "concept").agg(F.min("place").alias("place"))
    rows = met.join(first, ["cik", "concept", "place"]).select("cik", "taxonomy", "concept", F.col("tag").alias("concept_used"), F.explode("body.units").alias("unit", "items")).select("*", F.explode("items").alias("f")).drop("items")
    day = lambda c: F.try_to_date(c) if hasattr(F, "try_to_date") else F.to_date(c)
    return rows.select(
        "cik", "taxonomy", "concept", "concept_used", "unit", day(F.coalesce("f.start", "f.end")).alias("period_start"), day(F.col("f.end")).alias("period_end"), F.col("f.fy").alias("fy"), F.col("f.fp").alias("fp"),
        F.col("f.form").alias("form"), F.col("f.form").endswith("/A").alias("is_amendment"), F.col("f.accn").alias("accession"), day(F.col("f.filed")).alias("filed"), F.col("f.val").alias("value"),
    )


def submissions(documents: DataFrame, column: str = "payload") -> DataFrame:
    """One row per company; empty and null items of its lists are dropped, empty lists are null."""
    s = F.from_json(column, "struct<cik:string,name:string,sic:string,sicDescription:string,fiscalYearEnd:string,tickers:array<string>,exchanges:array<string>>")
    joined = lambda c: F.nullif(F.array_join(F.filter(F.col(f"s.{c}"), lambda x: x.isNotNull() & (x != "")), "|"), F.lit(""))
    return documents.select("snapshot_date", s.alias("s")).where("s.cik IS NOT NULL").select(F.col("s.cik").cast("long").alias("cik"), "snapshot_date", F.col("s.name").alias("name"), joined("tickers").alias("tickers"), joined("exchanges").alias("exchanges"), F.col("s.sic").alias("sic"), F.col("s.sicDescription").alias("sic_description"), F.col("s.fiscalYearEnd").alias("fiscal_year_end"))


def prices_wide(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A history with dividends and splits as prices and as events other than 0."""
    prices = wide.select("ticker", F.to_date("date").alias("date"), *(F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")))
    events = wide.select("ticker", F.to_date("date").alias("date"), F.col("dividends").cast("double").alias("dividend"), F.col("splits").cast("double").alias("split")).unpivot(["ticker", "date"], ["dividend", "split"], "kind", "value")
    return prices, events.where("value <> 0")


def prices_csv(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    """Per-ticker files named after their ticker; rows that don't parse are dropped, a missing volume is 0."""
    raw = spark.read.schema("date string, open string, high string, low string, close string, volume string").csv(path, header=True)
    number = lambda c: F.col(c).try_cast("double").alias(c)
    out = raw.select(F.upper(F.regexp_extract(F.col("_metadata.file_path"), r"([^/.]+)[^/]*$", 1)).alias("ticker"), F.col("date").try_cast("date").alias("date"), *(number(c) for c in ("open", "high", "low", "close")), F.coalesce(F.col("volume").try_cast("double"), F.lit(0.0)).alias("volume"))
    out = out.where("date IS NOT NULL AND close IS NOT NULL")
    return out.where(F.col("ticker").isin([t.upper() for t in tickers])) if tickers is not None else out


def holdings(raw: DataFrame) -> DataFrame:
    """Equity rows of a holdings table, whichever names its columns have, with numbers cleaned."""
    have = {c.lower(): c for c in raw.columns}
    pick = lambda *names: F.coalesce(*(F.col(f"`{have[n]}`") for n in names if n in have), F.lit(None).cast("string"))
    out = raw.select(F.upper(F.trim(pick("ticker", "symbol"))).alias("ticker"), pick("name").alias("name"), pick("asset class", "type").alias("asset_class"), pick("sector").alias("sector"), clean_number(pick("weight (%)", "market weight", "weight")).alias("weight"), clean_number(pick("shares", "quantity")).alias("shares"), clean_number(pick("market value")).alias("market_value"))
    return out.where((F.lower("asset_class") == "equity") & F.col("ticker").isNotNull() & ~F.col("ticker").isin("", "-"))


def series_lines(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """Lines of {series_id, data: [[period, value]..]} as rows of the wanted ids; raises where one is missing."""
    raw = spark.read.schema("series_id string, data array<array<string>>").json(path)
    rows = raw.where(F.col("series_id").isin(wanted)).select("series_id", F.explode("data").alias("x")).select("series_id", F.get("x", 0).alias("period"), F.get("x", 1).try_cast("double").alias("value"))
    missing = spark.createDataFrame([(w,) for w in wanted], "series_id string").join(rows, "series_id", "left_anti").collect()  # at most the wanted ids
    if missing:
        raise ValueError("missing series: " + ", ".join(sorted(r.series_id for r in missing)))
    return rows
