"""Repair of conversation structure by Four-Russians block tables.

A conversation's rows, in the order of their turns, become symbols: a row's role initial and whether it is truncated, or that it
must go. The cheapest edits that make the roles read (s?(ua)+)? follow an automaton of four states, so what lies behind a
place is a vector of four costs to go. Less its smallest entry it is one of a few normalised vectors, and what a block of
BLOCK symbols makes of each is tabulated once. Blocks are taken by lookup from the last to the first, which leaves the vector
behind each block. For the edits, blocks are then expanded from their last symbol backward: at each place inside, all edits on
some cheapest way are known, ties included, and the ASCII-least is taken. As each edit leads to one state, that is the least
string of edits. Expansions are remembered by block, state and vector.

Rows are dealt by ranges of (conversation, turn), not by conversation, so a conversation of any length is spread out. A task cuts
its stretch into segments; conversations that lie in one segment are repaired there. Of the others only symbols, a byte a row
as in the string of edits that is returned for them, meet in one task; their texts are edited where they are. Equal
rows are merged before, and duplicates found by pre-aggregated groups. The digest of a whole conversation is a chain by nature:
one task reads its segments in order, in bounded memory.

Defined results: null roles and texts are one space; null conversations are one conversation; rows of a turn are taken by
role and text, null turns first; equal rows are duplicates of one another; roles that don't start with s, u or a can only be
reroled or deleted; copies may repeat a row, and with 0 copies a row only makes its conversation known: one without rows has
zeros, no edits and no lines. An empty table has no conversations. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, flag_maybe, join_groups, maybe_filter, stored

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Symbols: a role initial of CLASSES (the last stands for all others) plus 4 where truncated, plus 8 where the row must go.
CLASSES = "sua"
GONE, PAD = 8, 9
#: States: nothing said, after s, after u, after a. Where an insertion leads, and where keeping a role does.
NEXT = (2, 2, 3, 2)
KEEP = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
SPOKEN = {2: "user", 3: "assistant"}
END = (0, 6, 3, 0)
BLOCK = 4
SEGMENT_ROWS, SEGMENT_CHARS = 1000, 1 << 20


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies: one row in twenty is dropped (no copies), another emptied, stripped of its
    sentence ends, repeated (two copies) or given to the user, by a hash of conversation and turn."""
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    conv, turn, role, text = spelled
    hit = F.crc32(F.concat_ws(":", conv, turn).cast("binary")) % 20
    new_text = F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"), new_text.alias("text"), copies.cast("long").alias("copies"))


# --- block tables


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a symbol, from those behind it."""
    if symbol == PAD:
        return after
    kind, late = symbol % 4, TRUNCATED * (symbol // 4 == 1)
    out = []
    for state in range(4):
        ways = [DELETE + after[state]]
        if symbol < GONE:
            ways.append(REROLE + late + after[NEXT[state]])
            if kind in KEEP[state]:
                ways.append(late + after[KEEP[state][kind]])
        out.append(min(ways))
    for state in (2, 3, 0, 1, 2):  # insertions go round between u and a
        out[state] = min(out[state], INSERT + out[NEXT[state]])
    return tuple(out)


@dataclass(frozen=True)
class Tables:
    """vectors: the normalised ones. For a vector behind a block, after and cost have the one before it and what was taken off."""

    vectors: list[tuple[int, ...]]
    after: np.ndarray
    cost: np.ndarray


@cache
def tables() -> Tables:
    vectors, place, steps = [END], {END: 0}, {}
    for v in vectors:  # grows while it is read
        for symbol in range(PAD + 1):
            out = _before(symbol, v)
            low = min(out)
            norm = tuple(x - low for x in out)
            if norm not in place:
                place[norm] = len(vectors)
                vectors.append(norm)
            steps[place[v], symbol] = place[norm], low
    one = np.array([[steps[v, s] for s in range(PAD + 1)] for v in range(len(vectors))])
    after, cost = np.arange(len(vectors))[:, None], np.zeros((len(vectors), 1), np.int64)
    for _ in range(BLOCK):  # a block's first symbol, its highest digit, is taken last
        cost = (cost[:, None, :] + one[after, :, 1].transpose(0, 2, 1)).reshape(len(vectors), -1)
        after = one[after, :, 0].transpose(0, 2, 1).reshape(len(vectors), -1)
    return Tables(vectors, after, cost)


@lru_cache(maxsize=100_000)
def expanded(block: int, state: int, vector: int) -> tuple[str, tuple[int, ...], int]:
    """The edits of a block that is entered in a state and has a vector behind it: letters, how many there are up to
    and with each symbol, and the state it is left in."""
    symbols = [block // 10**i % 10 for i in reversed(range(BLOCK))]
    togo = [tables().vectors[vector]]
    for symbol in reversed(symbols):
        togo.append(_before(symbol, togo[-1]))
    togo.reverse()
    letters, ends = "", []
    for symbol, now, then in zip(symbols, togo, togo[1:], strict=False):
        kind, late = symbol % 4, TRUNCATED * (symbol // 4 == 1)
        while symbol != PAD:
            if DELETE + then[state] == now[state]:
                letters += "D"
                break
            if INSERT + now[NEXT[state]] == now[state]:
                letters, state = letters + "I", NEXT[state]
                continue
            kept = KEEP[state].get(kind)
            if kept is not None and symbol < GONE and late + then[kept] == now[state]:
                letters, state = letters + "K", kept
            else:
                letters, state = letters + "R", NEXT[state]
            break
        ends.append(len(letters))
    return letters, tuple(ends), state


def cheapest(symbols: np.ndarray) -> tuple[int, str, np.ndarray, int]:
    """The cost, the letters of the cheapest edits, how many there are up to and with each symbol, and the last state."""
    own = np.minimum(symbols, GONE)
    blocks = np.concatenate([own, np.full(-len(own) % BLOCK, PAD, own.dtype)]).reshape(-1, BLOCK) @ 10 ** np.arange(BLOCK - 1, -1, -1)
    known, vector, cost, behind = tables(), 0, 0, []
    for block in blocks[::-1].tolist():
        behind.append(vector)
        cost += int(known.cost[vector, block])
        vector = int(known.after[vector, block])
    cost += known.vectors[vector][0]
    out, ends, state, n = [], [], 0, 0
    for block, vector in zip(blocks.tolist(), reversed(behind), strict=True):
        letters, to, state = expanded(block, state, vector)
        out.append(letters)
        ends += [n + x for x in to]
        n += len(letters)
    return cost, "".join(out) + "I" * (END[state] // INSERT), np.array(ends[: len(own)], np.int64), state


# --- rows to segments

PART = "at long, symbols string, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long"
LINE = "array<struct<role:string,text:string,n:long>>"


def _symbol(role: str, late: bool) -> int:
    return (CLASSES.find(role[:1]) if role[:1] else -1) % 4 + 4 * late


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Cuts a sorted stretch of rows into segments of one conversation each. The first and the last conversation of a
    stretch may go on elsewhere."""
    task = TaskContext.get()
    at = (task.partitionId() if task else 0) << 32
    out: list[dict] = []
    segment: dict | None = None
    first = True

    def close(whole: bool) -> None:
        symbols = segment.pop("codes")
        segment.pop("chars")
        out.append(segment | {"symbols": "".join(symbols), "whole": whole})

    for batch in batches:
        for row in batch.to_pylist():
            begins = segment is None or segment["c"] != row["c"]
            if begins or len(segment["rows"]) >= SEGMENT_ROWS or segment["chars"] >= SEGMENT_CHARS:
                if segment is not None:
                    close(begins and not first and not segment["cut"])
                    first &= not begins
                segment = {"c": row["c"], "conv_id": row["conv_id"], "at": at, "rows": [], "codes": [], "chars": 0, "cut": not begins}
                segment |= dict.fromkeys(("first_turn", "last_turn"), None) | dict.fromkeys(("turns", "blank", "duplicate", "truncated"), 0)
                at += 1
            if row["n"]:
                blank, again = row["blank"], row["seen"]
                late = row["late"] and not blank and not again
                own = _symbol(row["role"], late)
                gone = own % 4 + GONE
                # A blank row's copies are blank too.
                segment["codes"].append(chr(97 + (gone if blank or again else own)) + chr(97 + gone) * (row["n"] - 1))
                segment["blank"] += row["n"] * blank
                segment["duplicate"] += 0 if blank else row["n"] - (not again)
                segment["truncated"] += late
                segment["rows"].append({"role": row["role"], "text": row["text"], "n": row["n"]})
                segment["chars"] += len(row["text"]) + row["n"]
                if row["turn"] is not None:
                    segment["turns"] += row["turn"] != segment["last_turn"]
                    segment["first_turn"] = row["turn"] if segment["first_turn"] is None else segment["first_turn"]
                    segment["last_turn"] = row["turn"]
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if segment is not None:
        close(False)
        yield pa.RecordBatch.from_pylist(out, schema)


def _solved(batch: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Joins the parts of each conversation and finds its edits; pieces has the edits of each part, the state in which it
    starts and the number of lines before it."""
    out = []
    for row in batch.to_pylist():
        parts = row.pop("parts")
        symbols = np.frombuffer("".join(p["symbols"] for p in parts).encode(), np.uint8) - 97
        cost, audit, ends, _ = cheapest(symbols)
        kinds = symbols % 4
        pair = kinds[:-1] * 4 + kinds[1:]
        turns = [p for p in parts if p["turns"]]
        known = sum(p["turns"] for p in turns) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turns, turns[1:], strict=False))
        row |= {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated")}
        row |= {"gaps": turns[-1]["last_turn"] - turns[0]["first_turn"] + 1 - known if turns else 0, "illegal": int((~np.isin(pair, (1, 6, 9))).sum()), "cost": cost, "audit": audit}
        pieces, seen, start, lines, state = [], 0, 0, 0, 0
        for i, p in enumerate(parts):
            seen += len(p["symbols"])
            end = len(audit) if i + 1 == len(parts) else int(ends[seen - 1]) if seen else 0
            pieces.append({"at": p["at"], "audit": audit[start:end], "state": state, "line": lines})
            for letter, symbol in _walked(audit[start:end], p["symbols"]):
                state = _moved(state, letter, symbol)
            lines += end - start - audit.count("D", start, end)
            start = end
        out.append(row | {"pieces": pieces})
    yield pa.RecordBatch.from_pylist(out, schema)


def _walked(audit: str, symbols: str) -> Iterator[tuple[str, int]]:
    """Edits with the symbol that each is about; insertions have none."""
    rest = iter(symbols)
    for letter in audit:
        yield letter, -1 if letter == "I" else (ord(next(rest)) - 97) % 4


def _moved(state: int, letter: str, kind: int) -> int:
    return state if letter == "D" else KEEP[state][kind] if letter == "K" else NEXT[state]


def _edited(batch: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The lines of each segment after its edits."""
    out = []
    for row in batch.to_pylist():
        rows, state, lines = row.pop("rows"), row.pop("state"), []
        each = (r for r in rows for _ in range(r["n"]))
        for letter in row.pop("piece"):
            r = {"role": "", "text": ""} if letter == "I" else next(each)
            state = _moved(state, letter, _symbol(r["role"], False))
            if letter != "D":
                lines.append({"role": r["role"] if letter == "K" else SPOKEN[state], "text": r["text"]})
        out.append(row | {"lines": lines})
    yield pa.RecordBatch.from_pylist(out, schema)


def _mapped(df: DataFrame, f, schema: T.StructType) -> DataFrame:  # noqa: ANN001
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield from f(batch.slice(at, 500), arrow)

    return df.mapInArrow(run, schema)


REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


@dataclass(frozen=True)
class Repaired:
    """whole: a row for each conversation that lies in one segment, with c (its id as text), the columns of REPORT, at, line and
    lines (role and text). open_report and open_lines: the same of the others, with a row of lines for each segment; at
    orders these, and line is the number of lines before."""

    whole: DataFrame
    open_report: DataFrame
    open_lines: DataFrame

    @property
    def report(self) -> DataFrame:
        return self.whole.select("c", *REPORT).unionByName(self.open_report)

    @property
    def lines(self) -> DataFrame:
        return self.whole.select(self.open_lines.columns).unionByName(self.open_lines)


def _with_duplicates(rows: DataFrame) -> DataFrame:
    """rows with seen: whether role and text were in an earlier turn of the conversation."""
    firsts = rows.where("n > 0").groupBy("c", "key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("k")).where("k > 1")
    firsts = stored(firsts, "conversations-firsts")
    keys = (F.col("c"), F.col("key"))
    flagged = flag_maybe(rows, maybe_filter(firsts, *keys), *keys)
    some = join_groups(flagged.where("__pw_maybe").drop("__pw_maybe"), firsts, ["c", "key"], "k", prune=False, how="left")
    some = some.withColumn("seen", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))).drop("first", "k")
    return flagged.where("NOT __pw_maybe").drop("__pw_maybe").withColumn("seen", F.lit(False)).unionByName(some)


def repair(conversations: DataFrame, copies_col: str | None = None) -> Repaired:
    """conversations: conv_id, turn, role and text, and possibly how often each row is meant."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    copies = F.col(copies_col) if copies_col else F.lit(1).cast("long")
    there = copies > 0
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("c"), "conv_id",
        F.when(there, F.col("turn").cast("long")).alias("turn"), F.when(there, said("role")).otherwise("").alias("role"), F.when(there, said("text")).otherwise("").alias("text"), copies.alias("n"),
    )
    rows = rows.groupBy("c", "conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("key", F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = _with_duplicates(stored(rows, "conversations-rows"))
    shown = F.rtrim("text", F.lit(SPACES))
    rows = rows.select("c", "conv_id", "turn", "role", "text", "n", "seen", (shown == "").alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("late"))
    order: list[Column] = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.repartitionByRange(*order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    return _repair_dealt(dealt)


def _repair_dealt(dealt: DataFrame) -> Repaired:
    from pyspark.sql.pandas.types import to_arrow_schema

    id_field = dealt.schema["conv_id"]
    head = T.StructType([T.StructField("c", T.StringType()), id_field])
    with_ = lambda ddl: T.StructType([*head.fields, *T.StructType.fromDDL(ddl).fields])
    schema = with_(f"{PART}, whole boolean, rows {LINE}")
    arrow = to_arrow_schema(schema)
    segments = stored(dealt.mapInArrow(lambda batches: _segments(batches, arrow), schema), "conversations-segments")
    part = F.struct("at", "symbols", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated")
    counts = "blank long, duplicate long, truncated long, gaps long, illegal long, cost long, audit string"
    pieces = "pieces array<struct<at:long,audit:string,state:int,line:long>>"
    said = "at long, line long, lines array<struct<role:string,text:string>>"
    piece = [F.col("piece.line").alias("line"), F.col("piece.state").alias("state"), F.col("piece.audit").alias("piece")]
    own = segments.where("whole").select("c", "conv_id", "at", "rows", F.array(part).alias("parts"))
    own = _mapped(own, _solved, with_(f"at long, rows {LINE}, {counts}, {pieces}")).withColumn("piece", F.col("pieces")[0])
    own = _mapped(own.select("c", *REPORT, "at", "rows", *piece), _edited, with_(f"{counts}, {said}"))
    open_ = segments.where("NOT whole").groupBy("c", "conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    open_ = stored(_mapped(open_, _solved, with_(f"{counts}, {pieces}")), "conversations-open")
    cut = open_.select("c", F.explode("pieces").alias("piece")).select("c", F.col("piece.at").alias("at"), *piece)
    rest = segments.where("NOT whole").select("c", "conv_id", "at", "rows").join(cut, ["c", "at"])
    return Repaired(own, open_.select("c", *REPORT), _mapped(rest, _edited, with_(said)))


def messages(repaired: Repaired) -> DataFrame:
    """conv_id, turn (from 0 on), role and text of the repaired conversations."""
    each = repaired.lines.select("conv_id", "line", F.posexplode("lines").alias("i", "said"))
    return each.select("conv_id", (F.col("line") + F.col("i")).alias("turn"), "said.role", "said.text")


def _spelled() -> Column:
    return F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def digested(repaired: Repaired) -> DataFrame:
    """The columns of REPORT and digest, the SHA-256 of a conversation's lines, role:text joined by newlines."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, any_ = None, hashlib.sha256(), False
        for batch in batches:
            out = []
            for c, n, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state, any_ = c, hashlib.sha256(), False
                if n:
                    state.update((("\n" if any_ else "") + text).encode("utf-8", "surrogatepass"))
                    any_ = True
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["c", "digest"])
        if now is not None:
            yield pa.RecordBatch.from_pydict({"c": [now], "digest": [state.hexdigest()]})

    lines = repaired.open_lines.repartition("c").sortWithinPartitions("c", "at").select("c", F.size("lines").alias("n"), _spelled().alias("text"))
    open_ = repaired.open_report.join(lines.mapInArrow(chained, "c string, digest string"), "c")
    whole = repaired.whole.select(*REPORT, F.sha2(_spelled().cast("binary"), 256).alias("digest"))
    return whole.unionByName(open_.select(*REPORT, "digest"))
