"""Secret scans through a trigram inverted index, with DataFrame functions alone.

Each rule is a regular expression. Its syntax tree gives a Boolean trigram query: an OR of ANDs of lower-case trigrams of
which every match must hold one AND whole. Postings list, for each trigram that some rule asks for, the documents that
hold it. A rule's candidates come from intersecting postings, and only candidates are verified with the regular
expression; rules without mandatory trigrams scan every text.

Spans are found from a split: the pieces between matches and the matches themselves, in turn, give all offsets as a
running sum over a row for each match, so the work is linear in a text's length and number of matches.

Defined results: a null text is empty and has no span; a very long text, or one with very many matches, is treated like
any other and keeps all its spans (its matches are rows of one window, which may spill); offsets are in code points, end
exclusive; matches are leftmost and don't overlap within a kind, and are dropped afterwards if too short; kinds may
overlap each other; rows that repeat an id and text get the same spans, rows of one id with different texts each get their
own; an empty table gives no row; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_filter, select_maybe, stored, text_of


@dataclass(frozen=True)
class Rule:
    """kind; the regular expression, in syntax that Java, RE2 and Python share; the group whose length counts and the
    least length."""

    kind: str
    pattern: str
    group: int
    least: int


# The rules, base kinds first.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
BASE_KINDS = ("assign", "access", "hex")

#: Strings that a part of an expression may spell out before it counts as anything; ANDs that a query may have.
MOST_STRINGS, MOST_PARTS = 24, 64

Query = frozenset[frozenset[str]]
#: Holds for every text: one AND of nothing.
ALWAYS: Query = frozenset({frozenset()})


@dataclass(frozen=True)
class Spelled:
    """What the matches of a part of an expression look like: strings are all of them if exact, else the last two
    characters at most that any of them may end with; query holds for whatever contains one of them."""

    strings: frozenset[str]
    exact: bool
    query: Query = ALWAYS


ANYTHING = Spelled(frozenset({""}), False)
NOTHING_YET = Spelled(frozenset({""}), True)


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def _least(query: set[frozenset[str]]) -> Query:
    """Without the ANDs that a shorter one implies."""
    return frozenset(x for x in query if not any(y < x for y in query))


def _both(a: Query, b: Query) -> Query:
    """a AND b; where that has too many parts, the shorter of the two, which asks for less."""
    if len(a) * len(b) > MOST_PARTS:
        return min(a, b, key=lambda q: (frozenset() in q, len(q)))
    return _least({x | y for x, y in product(a, b)})


def _closed(part: Spelled) -> Spelled:
    """An exact part as an inexact one: its strings go into the query, their ends are kept."""
    if not part.exact:
        return part
    query = _both(part.query, _least({trigrams(s) for s in part.strings}))
    return Spelled(frozenset(s[-2:] for s in part.strings), False, query)


def _then(a: Spelled, b: Spelled) -> Spelled:
    if b.exact:
        if len(a.strings) * len(b.strings) <= MOST_STRINGS:
            joined = frozenset(x + y for x, y in product(a.strings, b.strings))
            if a.exact:
                return Spelled(joined, True, _both(a.query, b.query))
            query = _both(_both(a.query, b.query), _least({trigrams(s) for s in joined}))
            return Spelled(frozenset(s[-2:] for s in joined), False, query)
        b = _closed(b)
    return Spelled(b.strings, False, _both(_closed(a).query, b.query))


def _either(parts: list[Spelled]) -> Spelled:
    if all(p.exact for p in parts) and len(strings := frozenset().union(*(p.strings for p in parts))) <= MOST_STRINGS:
        return Spelled(strings, True)
    closed = [_closed(p) for p in parts]
    ends, query = frozenset().union(*(p.strings for p in closed)), _least(set().union(*(p.query for p in closed)))
    return Spelled(ends if len(ends) <= MOST_STRINGS else frozenset({""}), False, query if len(query) <= MOST_PARTS else ALWAYS)


def _class(items: list) -> Spelled:
    """A character class, in lower case; negated, named and large ones count as anything."""
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return ANYTHING
    return Spelled(frozenset(found), True) if len(found) <= MOST_STRINGS else ANYTHING


def _repeated(before: Spelled, once: Spelled, least: int, most: int) -> Spelled:
    """before, followed by least to most times once."""
    if (least, most) == (0, 1):
        return _then(before, _either([once, NOTHING_YET]))
    if not least:
        return _then(before, ANYTHING)
    for _ in range(min(least, 3)):
        before = _then(before, once)
    if least == most <= 3:
        return before
    # Either that was all, or something ends with once that begins we don't know where.
    so_far, later = _closed(before), _closed(_then(ANYTHING, once))
    ends = so_far.strings | later.strings
    return Spelled(ends if len(ends) <= MOST_STRINGS else frozenset({""}), False, so_far.query)


def _spelled(tree) -> Spelled:  # noqa: ANN001
    """What a parsed expression spells out. A part of a kind that isn't listed here counts as anything, which asks for
    no trigram and so loses no candidate."""
    out = NOTHING_YET
    for op, value in tree:
        if op is sre.MAX_REPEAT:
            out = _repeated(out, _spelled(value[2]), value[0], value[1])
            continue
        if op is sre.LITERAL:
            part = Spelled(frozenset({chr(value).lower()}), True)
        elif op is sre.IN:
            part = _class(value)
        elif op is sre.SUBPATTERN:
            part = _spelled(value[-1])
        elif op is sre.BRANCH:
            part = _either([_spelled(branch) for branch in value[1]])
        elif op is sre.AT:  # an anchor
            part = NOTHING_YET
        else:
            part = ANYTHING
        out = _then(out, part)
    return out


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """An OR of ANDs, derived from the rule's expression; empty: the rule has no mandatory trigram."""
    query = _closed(_spelled(sre_parser.parse(rule.pattern))).query
    return [] if frozenset() in query else sorted(query, key=sorted)


# Fixed value: letters of English prose, most frequent first.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def pivots(rules: tuple[Rule, ...]) -> list[str]:
    """Of each AND of the rules' queries the trigram that is likely to be rarest; other characters count as rarer than
    letters."""
    rarity = lambda t: (sum(FREQUENT.find(c) % (len(FREQUENT) + 1) for c in t), t)
    return sorted({max(part, key=rarity) for rule in rules for part in trigram_query(rule)})


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """trigram, id, hash: one row for each trigram that a rule asks for and each text that holds it. The rarest trigram
    of each AND is looked up first; a text without any of those satisfies no query and isn't posted."""
    first = pivots(rules)
    rest = sorted({t for rule in rules for part in trigram_query(rule) for t in part} - set(first))
    held = lambda wanted: F.filter(F.array(*map(F.lit, wanted)).cast("array<string>"), lambda t: F.contains("low", t))
    low = docs.select("id", "hash", F.lower("text").alias("low")).withColumn("rare", held(first))
    every = F.when(F.size("rare") > 0, F.concat("rare", held(rest)))
    return low.select("id", "hash", F.explode(every).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """id, hash, kind of the texts that satisfy a rule's trigram query: postings intersected by counting, for each part
    of a query, how many of its trigrams a text is posted under."""
    parts = [(rule.kind, k, t, len(part)) for rule in rules for k, part in enumerate(trigram_query(rule)) for t in sorted(part)]
    table = F.broadcast(index.sparkSession.createDataFrame(parts, "kind string, part int, trigram string, need int"))  # a row for each trigram of a rule
    met = index.join(table, "trigram").groupBy("id", "hash", "kind", "part", "need").agg(F.count_distinct("trigram").alias("met"))
    return met.where("met = need").select("id", "hash", "kind").distinct()


def _matches(df: DataFrame, rule: Rule, order: int) -> DataFrame:
    """A row for each match: at (its number), gap (characters since the match before), size, measured (of its group)."""
    text, whole = F.col("text"), f"({rule.pattern})"
    lengths = lambda parts: F.transform(parts, F.length)
    found = lambda group: lengths(F.regexp_extract_all(text, F.lit(whole), F.lit(group)))
    rows = F.arrays_zip(lengths(F.split(text, rule.pattern, -1)).alias("gap"), found(1).alias("size"), found(1 + rule.group).alias("measured"))
    out = df.select("id", "hash", F.posexplode(rows).alias("at", "m")).where("m.size IS NOT NULL")
    return out.select("id", "hash", F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), "at", "m.gap", "m.size", "m.measured")


def _spans(matches: DataFrame) -> DataFrame:
    """Offsets from the running sum of gaps and sizes. All of a text's rows share a partition, of which the window and
    both aggregates make use. Rows of repeated documents fall together."""
    dealt = matches.repartition("id", "hash").groupBy("id", "hash", "rank", "at").agg(*(F.min(c).alias(c) for c in ("kind", "least", "gap", "size", "measured")))
    upto = Window.partitionBy("id", "hash", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")).where("measured >= least")
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rank", "end", "kind")
    return placed.groupBy("id", "hash").agg(F.array_sort(F.collect_list(span)).alias("found"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash (of the text), found (array of start, rank, end, kind; in order): one row per distinct id and text."""
    base = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text")).withColumn("hash", F.xxhash64("text"))
    found = stored(candidates(postings(base, rules), rules), "secret-candidates")
    texts = found.select("id", "hash").distinct()
    # The bitmap spares shuffling texts that no rule asks for; the join decides.
    some = select_maybe(base, maybe_filter(texts, F.col("hash")), F.col("hash"))
    kinds = found.groupBy("id", "hash").agg(F.collect_set("kind").alias("kinds")).withColumnsRenamed({"id": "cid", "hash": "chash"})  # at most one a rule
    picked = some.join(kinds, F.col("id").eqNullSafe(F.col("cid")) & (F.col("hash") == F.col("chash")))
    picked = stored(picked.select("id", "hash", "text", "kinds").dropDuplicates(["id", "hash"]), "secret-texts")
    parts = []
    for order, rule in enumerate(rules):
        asked = picked.where(F.array_contains("kinds", rule.kind)) if trigram_query(rule) else base.where(F.regexp_like("text", F.lit(rule.pattern)))
        parts.append(_matches(asked, rule, order))
    return _spans(reduce(DataFrame.unionByName, parts))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id and found (empty where nothing was found)."""
    ids = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(F.col(text_col))).alias("hash"))
    hits = scan(docs, rules, id_col, text_col).withColumnsRenamed({"id": "hid", "hash": "hhash"})
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return ids.join(hits, F.col("id").eqNullSafe(F.col("hid")) & (F.col("hash") == F.col("hhash")), "left").select(F.col("id").alias(id_col), F.coalesce("found", empty).alias("found"))


def spelled(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The contract's columns in DuckDB SQL, every rule by a full scan."""
    parts = []
    for k, rule in enumerate(rules):
        p = rule.pattern.replace("'", "''")
        parts.append(f"""
    SELECT doc_id, {k} AS rank, '{rule.kind}' AS kind, start, start + length(m) AS stop
    FROM (SELECT doc_id, m, size, sum(gap + before) OVER (PARTITION BY doc_id ORDER BY i) AS start
          FROM (SELECT doc_id, i, m, size, length(g) AS gap, coalesce(lag(length(m)) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before
                FROM (SELECT doc_id, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS m, unnest(sized) AS size, unnest(gaps[:len(found)]) AS g
                      FROM (SELECT doc_id, regexp_extract_all(text, '({p})', 1) AS found,
                                   list_transform(regexp_extract_all(text, '({p})', {1 + rule.group}), lambda x: length(x)) AS sized,
                                   string_split_regex(text, '{p}') AS gaps FROM t) WHERE len(found) > 0)))
    WHERE size >= {rule.least}""")
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    return (
        "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ("
        + "\n    UNION ALL".join(parts)
        + f""")
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (kind IN ({base})), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (kind IS NOT NULL), '') AS spans
FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id"""
    )
