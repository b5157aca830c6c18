"""Rules as data: decision tables over texts, text normalisation, and integrity checks that are declared, not coded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import clean_text
from panelwright.sources.scratch import stored

#: Up to so many distinct texts, what they give is broadcast to the rows; beyond, it is joined.
FEW_TEXTS = 50_000


def per_distinct(df: DataFrame, columns: list[str], made: dict[str, Column]) -> DataFrame:
    """df with columns made of some of its text columns, computed once for each distinct combination of these."""
    texts = df.select(*columns).distinct()
    table = stored(texts.withColumns(made), "rules-texts")
    if table.count() <= FEW_TEXTS:
        table = F.broadcast(table)
    same = [df[c].eqNullSafe(table[c]) for c in columns]
    return df.join(table, same).select(*(df[c] for c in df.columns), *(table[c] for c in made))


@dataclass(frozen=True)
class When:
    """A row of a decision table: where the pattern is found in the field, the answer holds."""

    field: str
    pattern: str
    answer: str


def decided(table: list[When], fields: dict[str, Column], default: str | None = None) -> Column:
    """The answer of the first row that matches; nulls count as empty."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for row in table:
        out = out.when(F.regexp_like(F.coalesce(fields[row.field], F.lit("")), F.lit(row.pattern)), row.answer)
    return out.otherwise(F.lit(default))


def mentions(text: Column, patterns: dict[str, str]) -> Column:
    """The names whose pattern is found, in the order of their first places; of equal places the smaller name."""
    at = {name: F.regexp_instr(F.coalesce(text, F.lit("")), F.lit(p)) for name, p in patterns.items()}
    hits = F.array_compact(F.array(*(F.when(i > 0, F.struct(i.alias("at"), F.lit(n).alias("name"))) for n, i in at.items())))
    return F.transform(F.array_sort(hits), lambda x: x["name"])


# Patterns of commodities in facility records, those that are wanted, and what marks a record of another kind.
COMMODITIES = {
    "copper": r"copper", "cobalt": r"cobalt", "lithium": r"lithium", "nickel": r"nickel", "bauxite": r"bauxite", "alumina": r"alumina", "aluminum": r"alumin(?:i)?um", "iron_ore": r"iron ore", "gold": r"gold",
    "pgm": r"platinum|palladium", "tin": r"\btin\b", "zinc": r"zinc|\bzn\b", "manganese": r"manganese", "rare_earths": r"rare earth", "uranium": r"uranium", "lead": r"\blead\b", "silver": r"silver",
}
UNWANTED = ("lead", "silver")
OTHER_TRADE = "petrol|petroel|ferro|secondary|rolled|semimanuf|fluoride|fused"
# Which kind a facility is, the first row that matches.
FACILITY_KINDS = [
    When("type", "smelter", "smelter"),
    When("commodity", "smelter", "smelter"),
    When("type", "refin", "metal_refinery"),
    When("commodity", "refin", "metal_refinery"),
    When("type", "^(mine|quarry|mill)", "mine"),
    When("commodity", "ore|concentrate|mine", "mine"),
    When("primary", "^(bauxite|iron_ore|uranium)$", "mine"),
    When("primary", "^alumina$", "metal_refinery"),
    When("commodity", "metal|cathode|electrowinning|carbonate|oxide|compound", "metal_refinery"),
    When("primary", "^(gold|pgm|cobalt|lithium|rare_earths)$", "metal_refinery"),
]


def facilities(df: DataFrame, type_col: str = "fac_type", commodity_col: str = "commodity") -> DataFrame:
    """Adds kind (mine, smelter or metal_refinery), primary (the commodity that stands first), also (the others) and wanted: whether
    primary is one that is looked for and the record isn't of another trade. Mined aluminum is bauxite. Each distinct pair of
    texts is looked at once."""
    kind, com = F.lower(F.coalesce(clean_text(F.col(type_col)), F.lit(""))), F.lower(F.coalesce(clean_text(F.col(commodity_col)), F.lit("")))
    hits = mentions(com, COMMODITIES)
    first = F.get(hits, F.lit(0))
    decision = decided(FACILITY_KINDS, {"type": kind, "commodity": com, "primary": first}, "smelter")
    primary = F.when((first == "aluminum") & (decision == "mine"), "bauxite").otherwise(first)
    other = F.regexp_like(com, F.lit(OTHER_TRADE)) | (com.contains("steel") & ~com.contains("iron ore"))
    also = F.filter(F.slice(hits, 2, len(COMMODITIES)), lambda x: x != primary)
    wanted = F.coalesce(~other & ~first.isin(*UNWANTED), F.lit(False))
    return per_distinct(df, [type_col, commodity_col], {"kind": decision, "primary": primary, "also": also, "wanted": wanted})


def border_countries(points: Column, strips: dict[str, list[tuple[float | None, ...]]], home: str = "USA") -> Column:
    """home, and every country in one of whose strips (west, south, east, north; None is open) a point (lon, lat) lies, edges
    not included."""

    def within(west: float | None, south: float | None, east: float | None, north: float | None) -> Callable[[Column], Column]:
        def test(p: Column) -> Column:
            limits = [(west, p["lon"], 1), (south, p["lat"], 1), (east, p["lon"], -1), (north, p["lat"], -1)]
            inside = F.lit(True)
            for limit, x, side in limits:
                if limit is not None:
                    inside &= x > limit if side > 0 else x < limit
            return inside

        return test

    met = []
    for name, boxes in strips.items():
        inside = F.lit(False)
        for box in boxes:
            inside |= F.exists(points, within(*box))
        met.append(F.when(inside, F.lit(name)))
    return F.array_compact(F.array(F.lit(home), *met))


# Where a line of the United States has crossed a border.
BORDERS = {
    "CAN": [(-123.3, 49.05, -95.2, None), (-82.4, 42.9, -79.1, 49.0), (-74.6, 45.05, -71.6, None)],
    "MEX": [(None, None, -97.3, 25.8)],
}


# --- integrity


@dataclass(frozen=True)
class Known:
    """The column's values are among keys.key, or exempt."""

    column: str
    keys: DataFrame
    key: str
    exempt: tuple = ()


@dataclass(frozen=True)
class Within:
    """low <= column <= high (None is open); a null breaks it."""

    column: str
    low: float | str | None
    high: float | str | None


@dataclass(frozen=True)
class Matches:
    """The whole text matches; a null breaks it."""

    column: str
    pattern: str


@dataclass(frozen=True)
class Together:
    """Both columns are known, or neither."""

    a: str
    b: str


@dataclass(frozen=True)
class Falls:
    """In the order of a column, values of a group don't rise; a null counts as -1. One row for a group that breaks it."""

    by: tuple[str, ...]
    order: str
    column: str


@dataclass(frozen=True)
class AddsUp:
    """The parts of a group add up to its whole, within a share of it. Groups without a whole, or with 0, are passed over."""

    by: tuple[str, ...]
    part: str
    whole: str
    tolerance: float = 0.03


@dataclass(frozen=True)
class SumWithin:
    """The known values of a group add up to something from low to high; groups without any are passed over."""

    by: tuple[str, ...]
    part: str
    low: float = 0.95
    high: float = 1.05


Rule = Known | Within | Matches | Together | Falls | AddsUp | SumWithin


def _broken(rule: Rule, name: str) -> tuple[Column, Column, Column]:
    """Whether a row breaks the rule, and the number or the text that does."""
    none = F.lit(None)
    if isinstance(rule, Known):
        x = F.col(rule.column)
        fine = F.col(f"__known_{name}").isNotNull() | x.isin(*rule.exempt) if rule.exempt else F.col(f"__known_{name}").isNotNull()
        return ~F.coalesce(fine, F.lit(False)), none, x
    if isinstance(rule, Within):
        x = F.col(rule.column)
        fine = x.isNotNull()
        fine = fine if rule.low is None else fine & (x >= rule.low)
        return ~F.coalesce(fine if rule.high is None else fine & (x <= rule.high), F.lit(False)), x, none
    if isinstance(rule, Matches):
        return ~F.coalesce(F.regexp_like(rule.column, F.lit(f"^(?:{rule.pattern})$")), F.lit(False)), none, F.col(rule.column)
    return F.col(rule.a).isNull() != F.col(rule.b).isNull(), none, F.concat_ws(",", F.col(rule.a).cast("string"), F.col(rule.b).cast("string"))


def _exploded(df: DataFrame, id_cols: list[str], found: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    row = lambda n, x, t: F.struct(F.lit(n).alias("rule"), x.cast("double").alias("number"), t.cast("string").alias("text"))
    broken = F.array_compact(F.array(*(F.when(bad, row(n, x, t)) for n, bad, x, t in found)))
    id_ = F.concat_ws(":", *(F.col(c).cast("string") for c in id_cols))
    return df.select(id_.alias("id"), F.explode(broken).alias("x")).select("x.rule", "id", "x.number", "x.text")


def violations(df: DataFrame, id_cols: list[str], rules: dict[str, Rule]) -> DataFrame:
    """A row for each rule that a row or group of df breaks: rule, id (of the row or group), number and text (what breaks it). All
    rules on rows are one pass over df, all rules on groups of the same columns one more."""
    alone = {n: r for n, r in rules.items() if isinstance(r, Known | Within | Matches | Together)}
    grouped: dict[tuple[str, ...], dict[str, Rule]] = {}
    for n, r in rules.items():
        if n not in alone:
            grouped.setdefault(r.by, {})[n] = r
    out = []
    if alone:
        rows = df
        for n, r in alone.items():
            if isinstance(r, Known):
                keys = r.keys.select(F.col(r.key).alias(f"__known_{n}")).distinct()
                rows = rows.join(keys, F.col(r.column) == F.col(f"__known_{n}"), "left")
        out.append(_exploded(rows, id_cols, [(n, *_broken(r, n)) for n, r in alone.items()]))
    for by, own in grouped.items():
        rows, facts = df, []
        for n, r in own.items():
            if isinstance(r, Falls):
                x = F.coalesce(F.col(r.column).cast("double"), F.lit(-1.0))
                before = F.lag(x).over(Window.partitionBy(*by).orderBy(r.order))
                rows = rows.withColumn(f"__up_{n}", F.when(x > before, x))
                facts.append(F.min(f"__up_{n}").alias(f"__up_{n}"))
            else:
                facts.append(F.sum(r.part).alias(f"__sum_{n}"))
                if isinstance(r, AddsUp):
                    facts.append(F.max(r.whole).alias(f"__whole_{n}"))
        sums, found = rows.groupBy(*by).agg(*facts), []
        for n, r in own.items():
            if isinstance(r, Falls):
                found.append((n, F.col(f"__up_{n}").isNotNull(), F.col(f"__up_{n}"), F.lit(None)))
            elif isinstance(r, AddsUp):
                whole, total = F.nullif(F.col(f"__whole_{n}").cast("double"), F.lit(0.0)), F.coalesce(F.col(f"__sum_{n}"), F.lit(0.0))
                found.append((n, F.coalesce(F.abs(total - whole) / whole > r.tolerance, F.lit(False)), total / whole - 1, F.lit(None)))
            else:
                x = F.col(f"__sum_{n}")
                found.append((n, F.coalesce((x < r.low) | (x > r.high), F.lit(False)), x, F.lit(None)))
        out.append(_exploded(sums, list(by), found))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
