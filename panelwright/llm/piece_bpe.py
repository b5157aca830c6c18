"""SentencePiece BPE by backtracking: exactly the library's ids, without its merge queue.

The library merges the adjacent pair whose joined piece scores best, the leftmost of equals, until no pair joins to a piece.
A sequence of pieces is its result exactly if each two neighbours are: merged on their own, they come out as these two again.
(Up to the first merge across a boundary, what happens on both sides of it is what happens in the pair alone.) So the
pieces of any text are found from left to right: an Aho-Corasick automaton gives the pieces that start at a place, the longest
that is compatible with the piece before is taken, and where none is, the place is marked in a bitfield and the search goes
back. What leads to a place is unique, so a marked place is never tried again, and the work is linear in the text's length.
Characters that are no pieces stand alone, and become pieces of their bytes.

Texts are first cut between characters that no piece has side by side, as before space marks: nothing merges there. A word
between two cuts is encoded once for each worker and MEMO words.

Defined results: a null or empty text has no ids and decodes to the empty text; texts are read whole, whatever their length,
and a word's matches are found in stretches of STRETCH places; nulls, ties and repeated rows pass through row by row; all
other columns are kept, but for one of the name that is added; an empty table stays empty. Decoding takes any ids of the
model: null ids as none, ids out of range raise.
"""

from __future__ import annotations

import codecs
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, spread, text_of

SPACE = "▁"
#: What a worker remembers at most: words, and pairs of pieces.
MEMO = 400_000
STRETCH = 4096
#: Characters are told apart below MARK; it stands for the space mark, and OTHERS for all others.
MARK, OTHERS = 0x300, 0x301
#: Kinds of pieces as model files number them.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_BPE = 2


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("panelwright-each-byte", _each_byte)


def _points(text: str) -> np.ndarray:
    point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(point < MARK, point, np.where(point == ord(SPACE), np.uint32(MARK), np.uint32(OTHERS)))


@dataclass
class Model:
    """The pieces of a model file; small, so it is sent to the tasks whole."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool
    unknown_surface: str
    memo: dict[str, bytes] = field(default_factory=dict, repr=False)
    pairs: dict[tuple[int | None, int], bool] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("pieces", "scores", "kinds", "dummy_prefix", "unknown_surface")} | {"memo": {}, "pairs": {}}

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}

    @cached_property
    def bytes_ids(self) -> list[int]:
        at = {self.pieces[i]: i for i, k in enumerate(self.kinds) if k == BYTE}
        return [at[f"<0x{b:02X}>"] for b in range(256)]

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for p, i in self.ids.items():
            found.add_word(p, (len(p), i))
        found.make_automaton()
        return found

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def inside(self) -> np.ndarray:
        """Whether a piece has two characters side by side."""
        out = np.zeros((OTHERS + 1, OTHERS + 1), bool)
        for p in self.ids:
            at = _points(p)
            out[at[:-1], at[1:]] = True
        return out

    def surface(self, token: int) -> str:
        return self.pieces[token] if token >= 0 else chr(-1 - token)

    def merged(self, text: str) -> list[str]:
        """Merges in the order of their scores: for two pieces at most, so short."""
        parts = list(text)
        while True:
            best, at = -float("inf"), -1
            for i in range(len(parts) - 1):
                id_ = self.ids.get(parts[i] + parts[i + 1])
                if id_ is not None and self.scores[id_] > best:
                    best, at = self.scores[id_], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int | None, right: int) -> bool:
        """Whether two tokens stay as they are side by side; without a left one, whether a piece is what its text gives."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            both = [self.surface(x) for x in (left, right) if x is not None]
            known = self.pairs[left, right] = self.merged("".join(both)) == both
        return known

    def _matches(self, word: str, start: int, end: int) -> list[list[tuple[int, int]]]:
        """Length and id of the pieces that start at each place from start to end, ascending."""
        own: list[list[tuple[int, int]]] = [[] for _ in range(end - start)]
        for last, found in self.automaton.iter(word, start, min(len(word), end + self.longest)):
            at = last - found[0] + 1 - start
            if at < end - start:
                own[at].append(found)
        for i, found in enumerate(own):
            if not found or found[0][0] > 1:  # a character that is no piece
                found.insert(0, (1, -1 - ord(word[start + i])))
        return own

    def tokens(self, word: str) -> list[int]:
        """The ids of a word's pieces; a character that is none is a negative number."""
        n, pairs, stretches = len(word), self.pairs, {}
        failed = bytearray((n + 8) // 8)
        taken: list[tuple[int, int, int]] = []  # place, which of its pieces, its id
        at, k, before = 0, -2, None
        while at < n:
            here = stretches.get(at // STRETCH)
            if here is None:
                if len(stretches) > 2:
                    stretches.clear()
                first = at - at % STRETCH
                here = stretches[at // STRETCH] = self._matches(word, first, min(n, first + STRETCH))
            here = here[at % STRETCH]
            if k == -2:
                k = len(here) - 1
            while k >= 0:
                length, token = here[k]
                to = at + length
                if not failed[to >> 3] >> (to & 7) & 1:
                    fits = pairs.get((before, token))
                    if self.compatible(before, token) if fits is None else fits:
                        break
                k -= 1
            if k >= 0:
                taken.append((at, k, token))
                at, k, before = to, -2, token
                continue
            failed[at >> 3] |= 1 << (at & 7)
            if not taken:
                raise ValueError(f"no pieces for {word[:80]!r}")
            at, k, _ = taken.pop()
            k -= 1
            before = taken[-1][2] if taken else None
        return [x for _, _, x in taken]

    def word_ids(self, word: str) -> bytes:
        """The ids of a word as 32-bit integers."""
        out = self.tokens(word)
        if min(out) < 0:
            out = [i for x in out for i in ([x] if x >= 0 else [self.bytes_ids[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")])]
        return array("i", out).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        point = _points(text)
        starts = (np.flatnonzero(~self.inside[point[:-1], point[1:]]) + 1).tolist()
        memo, out = self.memo, []
        for a, b in zip([0, *starts], [*starts, len(text)], strict=True):
            word = text[a:b]
            ids = memo.get(word)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = self.word_ids(word)
                if b - a < 256:
                    memo[word] = ids
            out.append(ids)
        return b"".join(out)

    @cached_property
    def controls(self) -> frozenset[int]:
        return frozenset(i for i, k in enumerate(self.kinds) if k == CONTROL)

    @cached_property
    def surfaces(self) -> list[bytes]:
        """What each id adds to a text."""
        out = []
        for piece, kind in zip(self.pieces, self.kinds, strict=True):
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            else:
                out.append({NORMAL: piece.replace(SPACE, " "), UNKNOWN: self.unknown_surface, CONTROL: ""}[kind].encode())
        return out

    def decode(self, ids: list[int]) -> str:
        if ids and min(ids) < 0:
            raise IndexError(f"id out of range: {min(ids)}")
        out, start = [], 0
        # A control id adds nothing, but ends a run of bytes.
        for at in [*(i for i, x in enumerate(ids) if x in self.controls), len(ids)]:
            out.append(b"".join(map(self.surfaces.__getitem__, ids[start:at])).decode("utf-8", "panelwright-each-byte"))
            start = at + 1
        text = "".join(out)
        if self.dummy_prefix:
            first = next((x for x in ids if x not in self.controls), None)
            if first is not None and self.kinds[first] == NORMAL and self.pieces[first].startswith(SPACE):
                text = text[1:]
        return text


def load(path: str) -> Model:
    """A BPE model file with byte pieces that changes nothing of a text but its spaces; others raise."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as file:
        proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    norm, trainer = proto.normalizer_spec, proto.trainer_spec
    kinds = [p.type for p in proto.pieces]
    if trainer.model_type != _BPE or not trainer.byte_fallback or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("the model must be BPE with byte fallback, without unused or user-defined pieces")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
        raise ValueError("the model must keep texts as they are, with spaces as marks before words")
    return Model([p.piece for p in proto.pieces], [p.score for p in proto.pieces], kinds, norm.add_dummy_prefix, trainer.unk_surface)


def _with_column(df: DataFrame, name: str, source: str, kind: str, f) -> DataFrame:  # noqa: ANN001
    """df with one more column, made of batches of a source column; all others keep their places and values."""
    at = df.columns.index(source)
    kept = [i for i, c in enumerate(df.columns) if c != name]
    schema = df.select([df.columns[i] for i in kept]).withColumn(name, F.lit(None).cast(kind)).schema

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), f(batch.column(at))], schema.names)

    return map_batches(df, run, schema)


def encoded(docs: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(texts: pa.Array) -> pa.Array:
        own = shared.value
        raw = [own.encode(t or "") for t in texts.to_pylist()]
        ends = np.cumsum([0, *(len(r) // 4 for r in raw)])
        values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(raw))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return _with_column(spread(docs).withColumn(text_col, text_of(F.col(text_col))), ids_col, text_col, "array<int>", encode)


def decoded(docs: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text that each row's ids stand for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decode(ids: pa.ListArray) -> pa.Array:
        own, values = shared.value, ids.values.to_numpy(zero_copy_only=False)
        ends = ids.offsets.to_numpy()
        return pa.array([own.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)], pa.string())

    return _with_column(docs.withColumn(ids_col, F.coalesce(ids_col, F.array().cast("array<int>"))), text_col, ids_col, "string", decode)
