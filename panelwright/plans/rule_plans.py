"""Decision tables, text rules and integrity checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import scalars
from panelwright.operators import rules
from panelwright.sources import panels as src
from panelwright.sources.panels import with_sql

from .registry import query

# Texts of facility records, dealt out to the parts; some with odd spaces, control characters and capitals.
FACILITY_TYPES = ["Mine", "Smelter at mine site", "Refinery", "Plant", "Mill", "Quarry,  open pit", "Plant (refining)", "", "Processing plant", "Smel\x01ter"]
FACILITY_TEXTS = [
    "Copper ore", "Gold", "Alumina", "Bauxite and aluminum", "Iron ore concentrate", "ALUMINIUM", "Lithium carbonate", "Cobalt, nickel", "Nickel, smelter product", "Zinc oxide", "Tin and platinum", "Platinum, tin", "Uranium", "Rare earths",
    "Copper cathode, gold, copper", "Sand", "Steel", "Steel and iron ore", "Ferronickel", "Silver, copper", "Mixed\x01 metals, manganese", "Aluminum mine",
]


def listed_sql(values: list, key: str) -> str:
    """One of the values, dealt by a key."""
    each = ", ".join("NULL" if v is None else str(v) if not isinstance(v, str) else " || ".join(f"chr({ord(c)})" if ord(c) < 32 or ord(c) > 126 else f"'{c}'" for c in v).replace("' || '", "") if v else "''" for v in values)
    return f"[{each}][1 + {key} % {len(values)}]"


def listed(values: list, key):  # noqa: ANN001, ANN201
    return F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))))


def facility_texts(spark, d):  # noqa: ANN001, ANN201
    k = F.col("p_partkey")
    return src.table(spark, d, "part").select("p_partkey", listed(FACILITY_TYPES, k).alias("fac_type"), listed(FACILITY_TEXTS, F.floor(k / len(FACILITY_TYPES)) + F.col("p_size")).alias("commodity"))


def _clean_sql(x: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace(regexp_replace({x}, '[\\x{{2013}}\\x{{2014}}\\x{{96}}\\x{{97}}]', '-', 'g'), '[\\x00-\\x1f\\x7f-\\x{{9f}}\\x{{ad}}]', '', 'g'), '[\\s\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), '')"


#: Where each pattern is first found: what stands before it, counted.
_HITS = ", ".join(f"CASE WHEN regexp_matches(com, '{p}') THEN (length(regexp_replace(com, '(?s)(?:{p}).*', '')), '{n}') END" for n, p in rules.COMMODITIES.items())
_KINDS = " ".join(f"WHEN regexp_matches({ {'type': 'typ', 'commodity': 'com', 'primary': 'fst'}[r.field] }, '{r.pattern}') THEN '{r.answer}'" for r in rules.FACILITY_KINDS)


@query(
    "class_facility_kind",
    f"""WITH tx AS (SELECT p_partkey, {listed_sql(FACILITY_TYPES, "p_partkey")} AS t, {listed_sql(FACILITY_TEXTS, f"(p_partkey // {len(FACILITY_TYPES)} + p_size)")} AS c FROM part),
    cl AS (SELECT p_partkey, lower(coalesce({_clean_sql("t")}, '')) AS typ, lower(coalesce({_clean_sql("c")}, '')) AS com FROM tx),
    hi AS (SELECT *, list_transform(list_sort(list_filter([{_HITS}], lambda h: h IS NOT NULL)), lambda h: h[2]) AS hits FROM cl),
    kd AS (SELECT *, CASE {_KINDS} ELSE 'smelter' END AS kind FROM (SELECT *, coalesce(hits[1], '') AS fst FROM hi)),
    pm AS (SELECT *, CASE WHEN fst = 'aluminum' AND kind = 'mine' THEN 'bauxite' ELSE nullif(fst, '') END AS metal FROM kd)
    SELECT p_partkey, kind, metal, array_to_string(list_filter(hits[2:], lambda h: h <> metal), ',') AS also, fst NOT IN ('', {", ".join(f"'{x}'" for x in rules.UNWANTED)}) AND NOT regexp_matches(com, '{rules.OTHER_TRADE}') AND NOT (com LIKE '%steel%' AND com NOT LIKE '%iron ore%') AS wanted FROM pm""",
)
def kinds(spark, d):  # noqa: ANN001, ANN201
    """What kind of facility two texts tell of, and its commodities in the order in which they are named."""
    found = rules.facilities(facility_texts(spark, d))
    return found.select("p_partkey", "kind", F.col("primary").alias("metal"), F.array_join("also", ",").alias("also"), "wanted")


_STRIPS = {n: " OR ".join("(" + " AND ".join(f"{axis} {op} {v}" for axis, op, v in (("x[1]", ">", w), ("x[2]", ">", s), ("x[1]", "<", e), ("x[2]", "<", t)) if v is not None) + ")" for w, s, e, t in strips) for n, strips in rules.BORDERS.items()}


@query(
    "class_border",
    f"""WITH pts AS (SELECT s_suppkey, list_transform(range(0, 1 + s_suppkey % 3), lambda i: (-130 + (s_suppkey * 37 + i * 911) % 6100 / 100.0::DOUBLE, 24 + (s_suppkey * 53 + i * 677) % 2600 / 100.0::DOUBLE)) AS line FROM supplier)
    SELECT s_suppkey, 'USA' || CASE WHEN len(list_filter(line, lambda x: {_STRIPS["CAN"]})) > 0 THEN ',CAN' ELSE '' END || CASE WHEN len(list_filter(line, lambda x: {_STRIPS["MEX"]})) > 0 THEN ',MEX' ELSE '' END AS countries FROM pts""",
)
def border(spark, d):  # noqa: ANN001, ANN201
    """The countries that a line of one to three points touches."""
    k = F.col("s_suppkey")
    at = lambda start, step, turn, size: lambda i: start + (k * step + i * turn) % size / 100
    lon, lat = at(-130, 37, 911, 6100), at(24, 53, 677, 2600)
    line = F.transform(F.sequence(F.lit(0).cast("bigint"), k % 3), lambda i: F.struct(lon(i).alias("lon"), lat(i).alias("lat")))
    return src.table(spark, d, "supplier").select("s_suppkey", F.array_join(rules.border_countries(line, rules.BORDERS), ",").alias("countries"))


UNITS = ["Million metric tons", "metric tons", "kilograms", "thousand barrels", "Thousand metric tons", "kg gold", "t/yr", "t / year", "42-gallon barrels", "thousand carats", "cubic meters", "Metric\x02 tons", "", None, "tons"]


@query(
    "proj_unit_norm",
    f"""WITH un AS (SELECT p_partkey, (p_size - 3)::DOUBLE AS cap, lower(coalesce({_clean_sql("u")}, '')) AS u FROM (SELECT *, {listed_sql(UNITS, "p_partkey")} AS u FROM part)),
    ok AS (SELECT *, cap > 0 AND NOT regexp_matches(u, 'barrel|cubic|carat') AS good FROM un)
    SELECT p_partkey, CASE WHEN NOT good THEN NULL WHEN u LIKE 'kilograms%' OR u LIKE 'kg%' THEN cap / 1000 WHEN u LIKE 'thousand%' THEN cap WHEN u LIKE 't /%' OR u LIKE 't/yr%' OR u LIKE 'metric tons%' THEN cap / 1000 END AS capacity,
        CASE WHEN NOT good THEN NULL WHEN u LIKE 'kilograms%' OR u LIKE 'kg%' THEN 't/yr' WHEN u LIKE 'thousand%' OR u LIKE 't /%' OR u LIKE 't/yr%' OR u LIKE 'metric tons%' THEN 'kt/yr' END AS unit FROM ok""",
)
def unit_norm(spark, d):  # noqa: ANN001, ANN201
    cap = F.col("p_size").cast("double") - 3
    return src.table(spark, d, "part").select("p_partkey", scalars.unit_norm(cap, listed(UNITS, F.col("p_partkey"))).alias("x")).select("p_partkey", "x.capacity", "x.unit")


NAMES = ["ACME OIL LLC", "McGraw", "PG&E CO.", "(USA) STEEL, INC", "TC  ENERGY\u00a0LP", "a\x01b – c", "A&B  &C DEF&", "\u00ad\x85", "ÉLAN IV", "x—y\tz"]


@query(
    "proj_text_clean",
    f"""WITH tx AS (SELECT p_partkey, {listed_sql(NAMES, "p_partkey")} || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' || upper(p_name) END AS raw FROM part), cl AS (SELECT p_partkey, {_clean_sql("raw")} AS name FROM tx)
    SELECT p_partkey, name, CASE WHEN name <> upper(name) THEN name ELSE array_to_string(list_transform(string_split(name, ' '), lambda w: CASE WHEN trim(w, '.,()') IN ({", ".join(f"'{x}'" for x in scalars.KEEP_UPPER)}) OR length(trim(w, '.,()')) <= 2 AND contains(trim(w, '.,()'), '&') THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ') END AS title FROM cl""",
)
def text_clean(spark, d):  # noqa: ANN001, ANN201
    raw = F.concat(listed(NAMES, F.col("p_partkey")), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit(" "), F.upper("p_name"))))
    return src.table(spark, d, "part").select("p_partkey", scalars.clean_text(raw).alias("name"), scalars.smart_title(raw).alias("title"))


#: Producers with unknown countries, unsorted ranks and sums that are off; sites beyond the map; codes that aren't three digits.
CHECKED = """si AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 400 - 200)::DOUBLE AS lon, (s_suppkey * 13 % 200 - 100)::DOUBLE AS lat, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS capacity, CASE WHEN s_suppkey % 5 > 0 THEN 't/yr' END AS unit, CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey::VARCHAR ELSE lpad((s_suppkey % 1000)::VARCHAR, 3, '0') END AS iso FROM supplier),
hs AS (SELECT commodity, year, CASE WHEN country = 3 THEN 'OTH' ELSE 'N' || country END AS holder, production, production / sum(production) OVER w * CASE year WHEN 1996 THEN 1.04 WHEN 1997 THEN 1.1 ELSE 1 END AS share,
    row_number() OVER (PARTITION BY commodity, year ORDER BY CASE WHEN commodity = 'SMALL' THEN 1 ELSE -1 END * production, country) AS rank, sum(production) OVER w * CASE year WHEN 1998 THEN 1.02 WHEN 1999 THEN 1.05 ELSE 1 END AS whole FROM prod WINDOW w AS (PARTITION BY commodity, year)),
hg AS (SELECT commodity || ':' || year AS id, sum(share) AS shares, sum(production) / max(whole) - 1 AS off, abs(sum(production) - max(whole)) / max(whole) AS gap, min(CASE WHEN production > before THEN production END) AS up FROM (SELECT *, lag(production) OVER (PARTITION BY commodity, year ORDER BY rank) AS before FROM hs) GROUP BY commodity, year)"""


@query(
    "validate_rules",
    with_sql("prod", more=CHECKED)
    + """SELECT 'customer' AS rule, o_orderkey::VARCHAR AS id, NULL::DOUBLE AS number, o_custkey::VARCHAR AS text FROM orders ANTI JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'total', o_orderkey::VARCHAR, o_totalprice, NULL FROM orders WHERE o_totalprice NOT BETWEEN 0 AND 400000
    UNION ALL SELECT 'country', commodity || ':' || year || ':' || holder, NULL, holder FROM hs WHERE holder <> 'OTH' AND holder NOT IN (SELECT 'N' || n_nationkey FROM nation WHERE n_nationkey <> 11)
    UNION ALL SELECT 'lon', id::VARCHAR, lon, NULL FROM si WHERE lon NOT BETWEEN -180 AND 180 UNION ALL SELECT 'lat', id::VARCHAR, lat, NULL FROM si WHERE lat NOT BETWEEN -90 AND 90
    UNION ALL SELECT 'capacity_iff_unit', id::VARCHAR, NULL, CASE WHEN unit IS NULL THEN capacity::VARCHAR ELSE unit END FROM si WHERE (capacity IS NULL) <> (unit IS NULL) UNION ALL SELECT 'iso', id::VARCHAR, NULL, iso FROM si WHERE NOT regexp_full_match(iso, '[0-9]{3}')
    UNION ALL SELECT 'share_sum', id, round(shares, 6), NULL FROM hg WHERE shares NOT BETWEEN 0.95 AND 1.05 UNION ALL SELECT 'sorted', id, round(up, 6), NULL FROM hg WHERE up IS NOT NULL UNION ALL SELECT 'parts_sum', id, round(off, 6), NULL FROM hg WHERE gap > 0.03""",
)
def validate(spark, d):  # noqa: ANN001, ANN201
    """Every row and group that breaks an integrity rule, and what breaks it."""
    o, c, s, n = (src.table(spark, d, t) for t in ("orders", "customer", "supplier", "nation"))
    k, year = F.col("s_suppkey"), F.col("year")
    iso = F.when(k % 9 == 0, k.cast("string")).otherwise(F.lpad((k % 1000).cast("string"), 3, "0"))
    sites = s.select(k.alias("id"), (k * 7 % 400 - 200).cast("double").alias("lon"), (k * 13 % 200 - 100).cast("double").alias("lat"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("capacity"), F.when(k % 5 > 0, F.lit("t/yr")).alias("unit"), iso.alias("iso"))
    w = Window.partitionBy("commodity", "year")
    order = F.when(F.col("commodity") == "SMALL", 1).otherwise(-1) * F.col("production")
    held = src.production(spark, d).withColumns({
        "holder": F.when(F.col("country") == 3, "OTH").otherwise(F.concat(F.lit("N"), "country")),
        "share": F.col("production") / F.sum("production").over(w) * F.when(year == 1996, 1.04).when(year == 1997, 1.1).otherwise(1.0),
        "rank": F.row_number().over(w.orderBy(order, "country")),
        "whole": F.sum("production").over(w) * F.when(year == 1998, 1.02).when(year == 1999, 1.05).otherwise(1.0),
    })
    countries = n.where("n_nationkey <> 11").select(F.concat(F.lit("N"), "n_nationkey").alias("code"))
    by = ("commodity", "year")
    found = rules.violations(o, ["o_orderkey"], {"customer": rules.Known("o_custkey", c, "c_custkey"), "total": rules.Within("o_totalprice", 0, 400_000)})
    found = found.unionByName(rules.violations(held, [*by, "holder"], {
        "country": rules.Known("holder", countries, "code", ("OTH",)), "share_sum": rules.SumWithin(by, "share"), "sorted": rules.Falls(by, "rank", "production"), "parts_sum": rules.AddsUp(by, "production", "whole"),
    }))
    found = found.unionByName(rules.violations(sites, ["id"], {
        "lon": rules.Within("lon", -180, 180), "lat": rules.Within("lat", -90, 90), "capacity_iff_unit": rules.Together("capacity", "unit"), "iso": rules.Matches("iso", r"\d{3}"),
    }))
    return found.withColumn("number", F.round("number", 6))
