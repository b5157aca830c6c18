"""Packing documents into sequences by best fit with several permitted lengths.

Documents are cut into pieces of at most the largest length; pieces go, largest first, into the open sequence that they
leave fullest. Where none has room, a sequence is opened. What it costs is its length, a quadratic part for attention
and a fixed part, so neither the longest nor the shortest length is always best: a block is packed by each opening
rule (the length that is cheapest a token for what can still fill it, and each permitted length as the least to open),
and the packing with the least total cost is taken. When a block is done, every sequence is cut down to the least length
that holds its contents. Blocks are partitions of bounded size, dealt out evenly, so no task grows with the input, and
only ids and lengths move.

Defined results: a null or empty text, or one without words, has just the end token; pieces of a document keep their
start; rows that repeat an id are packed as often as they are given, and their pieces look alike; a null id is packed like any
other; a very long text gives as many pieces as it needs; no token is dropped or padded into another's place; an empty
table gives no sequence; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

LENGTHS = (512, 1024, 2048, 4096)
#: What a sequence costs, in tokens: its length n, n * n / ATTENTION, and a fixed part.
ATTENTION, OVERHEAD = 8192, 128
#: Pieces that a block holds on average; a block of fewer is packed a little less tightly.
BLOCK = 50_000


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tokens: the words of the text and one end token."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = [len((t.as_py() or "").encode("utf-8", "surrogatepass").split()) + 1 for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["id", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), run, f"id {kind}, tokens long")


def cost(length: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return length + length * length / attention + overhead


def _fit(sizes: list[int], lengths: tuple[int, ...], opened: Callable[[int, int], int]) -> tuple[list[int], list[int]]:
    """Best fit of pieces in descending order: the sequence of each, and the length of each sequence, cut down to its
    contents. opened: the length to open for a piece, given its size and the tokens left after it."""
    left, seq, room = sum(sizes), [], []
    by_room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    some = 0  # bit r: a sequence with r tokens of room is open
    for size in sizes:
        left -= size
        if fitting := some >> size:
            r = size + (fitting & -fitting).bit_length() - 1
            at = by_room[r].pop()
            if not by_room[r]:
                some &= ~(1 << r)
        else:
            r = opened(size, left)
            at = len(room)
            room.append(0)
        seq.append(at)
        room[at] += size
        if r > size:
            by_room[r - size].append(at)
            some |= 1 << (r - size)
    return seq, [next(c for c in lengths if c >= used) for used in room]


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, attention: float = ATTENTION) -> tuple[list[int], list[int]]:
    """For pieces in descending order: the sequence of each, and the length of each sequence, by the cheapest of the
    opening rules; the first of them on a tie."""
    lengths = tuple(sorted(lengths))
    price = {c: cost(c, overhead, attention) for c in lengths}

    def cheapest(size: int, left: int) -> int:
        return min((c for c in lengths if c >= size), key=lambda c: (price[c] / min(c, size + left), c))

    def at_least(c: int) -> Callable[[int, int], int]:
        return lambda size, _: next(x for x in lengths if x >= size and x >= c)

    tried = [_fit(sizes, lengths, rule) for rule in (cheapest, *map(at_least, lengths))]
    return min(tried, key=lambda t: sum(price[c] for c in t[1]))


def packed(counts: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, attention: float = ATTENTION, block: int = BLOCK, id_col: str = "id") -> DataFrame:
    """One row per piece: block, sequence, length (of the sequence), used, slot, at (offset in it), id, start, tokens."""
    most = max(lengths)
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("tokens") - 1, F.lit(0)), F.lit(most).cast("long")))
    pieces = counts.select(F.col(id_col).alias("id"), "tokens", cut.alias("start")).select("id", "start", F.least(F.col("tokens") - F.col("start"), F.lit(most)).alias("tokens"))
    pieces = stored(pieces, "pack-pieces")
    blocks = max(1, -(-pieces.count() // block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None  # at most a block
        if rows is None:
            return
        rows = rows.sort_by([("tokens", "descending"), ("id", "ascending"), ("start", "ascending")])
        sizes = rows["tokens"].to_pylist()
        seq, length = pack(sizes, lengths, overhead, attention)
        slot, at, fill, count = [], [], [0] * len(length), [0] * len(length)
        for s, size in zip(seq, sizes, strict=True):
            slot.append(count[s])
            at.append(fill[s])
            count[s] += 1
            fill[s] += size
        k = TaskContext.get().partitionId()
        out = {"block": pa.array([k] * len(seq), pa.int32()), "sequence": pa.array(seq, pa.int32()), "length": pa.array([length[s] for s in seq], pa.int32()), "used": pa.array([fill[s] for s in seq], pa.int32()), "slot": pa.array(slot, pa.int32()), "at": pa.array(at, pa.int32())}
        table = pa.table(out | {"id": rows["id"], "start": rows["start"], "tokens": rows["tokens"]})
        yield from table.combine_chunks().to_batches()

    kind = pieces.schema["id"].dataType.simpleString()
    dealt = pieces.repartition(blocks)  # round robin over sorted rows: the same on every attempt, and even with equal rows
    return dealt.mapInArrow(run, f"block int, sequence int, length int, used int, slot int, at int, id {kind}, start long, tokens long")


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, attention: float = ATTENTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return packed(token_counts(docs, id_col, text_col), lengths, overhead, attention).withColumnRenamed("id", id_col)
