"""Null-aware scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x.isNotNull(), F.least(F.greatest(x, as_col(low)), as_col(high)))


def mean_of(*cols: Column) -> Column:
    """Mean of the columns that are not null."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return total / F.nullif(count_of(*cols).cast("double"), F.lit(0.0))


def count_of(*cols: Column) -> Column:
    return sum((c.isNotNull().cast("int") for c in cols), F.lit(0))


def weighted_mean(pairs: list[tuple[Column, float]]) -> Column:
    """Mean with the weights of the columns that are not null renormalised."""
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in pairs), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in pairs), F.lit(0.0))
    return total / F.nullif(weight, F.lit(0.0))


def friday(d: Column) -> Column:
    """The Friday that ends the week of a date."""
    return F.date_add(d, F.pmod(F.lit(5) - (F.dayofweek(d) - 1), F.lit(7)))


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def effective_tax_rate(tax: Column, net_income: Column, default: float = 0.21) -> Column:
    """tax / (net income + tax), within 0..0.5; the default where it is missing or pre-tax income isn't positive."""
    pretax = net_income + tax
    return F.when(pretax > 0, clip(tax / pretax, 0.0, 0.5)).otherwise(F.lit(default))


def clean_number(text: Column) -> Column:
    """A number out of text with currency signs, commas and percent signs; dashes and bad text are null."""
    bare = F.regexp_replace(F.trim(text), r"[$,%\s]", "")
    return F.when(bare.isin("", "-", "--"), None).otherwise(bare.try_cast("double"))


def flagged_number(text: Column) -> Column:
    """struct(value, flag): - is 0, W is withheld, > is a lower bound, anything else that is no number is na."""
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), ",", "")
    number = F.regexp_replace(bare, "^>", "").try_cast("double")
    value = F.when(bare.isin("-", "--", "—", "–"), 0.0).when(bare == "W", None).otherwise(number)
    flag = F.when(bare.isin("-", "--", "—", "–"), "zero").when(bare == "W", "withheld").when(number.isNull(), "na").when(bare.startswith(">"), "lower_bound").otherwise("value")
    return F.struct(value.alias("value"), flag.alias("flag"))


#: White space of any script, for Spark's regular expressions.
BLANKS = r"(?U)\s+"


def clean_text(text: Column) -> Column:
    """Long dashes become a hyphen, control characters and soft hyphens go, runs of white space become one space; trimmed; null
    where nothing is left."""
    dashed = F.regexp_replace(text.cast("string"), r"[\u2013\u2014\u0096\u0097]", "-")
    bare = F.regexp_replace(dashed, r"[\x00-\x1f\x7f-\u009f\u00ad]", "")
    return F.nullif(F.trim(F.regexp_replace(bare, BLANKS, " ")), F.lit(""))


# Words that stay in capitals.
KEEP_UPPER = (
    "USA", "US", "LLC", "LP", "LLP", "INC", "CO", "BP", "PBF", "HF", "CVR", "WRB",
    "NGL", "LNG", "ONEOK", "DCP", "MPLX", "TC", "EPL", "II", "III", "IV", "SA", "TX",
    "NV", "ANR", "KO", "WBI", "EQT", "UGI", "DTE", "CNG", "NGPL", "PG&E", "EQM",
)


def smart_title(text: Column) -> Column:
    """Cleaned text; if it is all in capitals, in title case but for the words of KEEP_UPPER and those of at most two characters
    with an ampersand (stops, commas and brackets around a word don't count)."""
    clean = clean_text(text)

    def title(w: Column) -> Column:
        core = F.btrim(w, F.lit(".,()"))
        stays = core.isin(*KEEP_UPPER) | ((F.char_length(core) <= 2) & core.contains("&"))
        return F.when(stays, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))

    return F.when(clean != F.upper(clean), clean).otherwise(F.array_join(F.transform(F.split(clean, " "), title), " "))


def unit_norm(capacity: Column, unit: Column) -> Column:
    """struct(capacity, unit): thousands and metric tons become kt/yr, kilograms t/yr; without a positive capacity, for volumes,
    carats and anything else both are null."""
    u = F.lower(F.coalesce(clean_text(unit), F.lit("")))
    starts = lambda *words: F.regexp_like(u, F.lit("^(" + "|".join(words) + ")"))
    lost = ~F.coalesce(capacity > 0, F.lit(False)) | F.regexp_like(u, F.lit("barrel|cubic|carat"))
    thousand = ~lost & starts("thousand")
    small = ~lost & ~thousand & (starts("t /", "t/yr", "metric tons", "kilograms", "kg"))
    name = F.when(thousand, "kt/yr").when(small & starts("kilograms", "kg"), "t/yr").when(small, "kt/yr")
    return F.struct(F.when(thousand, capacity.cast("double")).when(small, capacity / 1000.0).alias("capacity"), name.alias("unit"))


def tier(c: Column) -> Column:
    return F.when(c >= 0.55, "good").when(c >= 0.40, "ok").when(c.isNotNull(), "weak")
