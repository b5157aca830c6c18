"""Language-model scores from an Elias-Fano n-gram trie of order 3.

The model is too large for one place, so nothing is broadcast. Texts are cut into batches of about BATCH_TOKENS tokens,
numbered against the batch's own sorted vocabulary and written once. Then batches ask and shards answer, twice:
word hashes are ranged over shards, which hold the first level of the trie and return a global id and the training
count of each; distinct n-grams are hashed over shards by their last two words, and each shard builds the other levels for
its training n-grams and returns, by successor search, the quantised value of the longest match and the back-off weight.
Requests are counted within a batch before they move, so a word or pair that is everywhere comes once from each batch. A
batch sends one row to each shard that it asks, so there are at most as many rows as shards and as distinct n-grams of the
batch: their number is bounded by the input's, and they only get shorter as the input grows.

With c the training counts, N their sum and V the distinct words, the score of u v w is a smoothed probability
p1 = (c(w) - D1) / N for known words and D1 V / N for all unknown ones together,
p2 = (c(v w) + K2 p1) / (c(v) + K2) and p3 = (c(u v w) + K3 p2) / (c(u v) + K3).
The trie holds it as back-off: with back1(v) = K2 / (c(v) + K2) and back2(u v) = K3 / (c(u v) + K3),
p2 = back1(v) (c(v w) / K2 + p1) and p3 = back2(u v) (c(u v w) / K3 + p2). These values and weights are what is stored;
scoring multiplies them, with the shorter n-gram's value where the longer one was never seen, and sees no counts but c(w).
What a shard needs of the first level to build a smoothed value, p1 and back1, comes with the requests in one byte each.

Defined results: a null text is empty and consists of the end token; rows with a null id are scored but not learned
from; rows that repeat an id are learned from as often as given; without training tokens, every token has p1 = 1;
an empty table gives no row; a very long text makes a batch of its own; other columns are ignored. Word hashes have 64 bits;
equal ones count as the same word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored
from .elias_fano import ABSENT, PAIR, Trie, changes, numbered, restored, sorted_places

BATCH_TOKENS, VOCABULARY_SHARD, NGRAM_SHARD = 2_000_000, 500_000, 1_000_000
D1, K2, K3 = 0.5, 8.0, 2.0
COARSE_STEPS = 28
#: Texts are split into words so many bytes at a time.
SPLIT_BYTES = 8_000_000
END = xxhash.xxh3_64_intdigest(b"\n")  # no word has a line break
BOS = 1
_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _zip(a: np.ndarray) -> bytes:
    """Compressed, byte by byte: the high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(np.frombuffer(np.ascontiguousarray(a).tobytes(), np.uint8).reshape(-1, a.dtype.itemsize).T)
    return _COMPRESSOR.compress(planes.tobytes())


def _unzip(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(_DECOMPRESSOR.decompress(data), np.uint8).reshape(size, -1)
    return np.frombuffer(np.ascontiguousarray(planes.T).tobytes(), dtype)


def _zip_ids(a: np.ndarray) -> bytes:
    """Ids, with 4 or 8 bytes each; the first byte says which."""
    narrow = a.max(initial=0) < 2**32
    return (b"\4" if narrow else b"\10") + _zip(a.astype(np.uint32 if narrow else np.uint64))


def _unzip_ids(data: bytes) -> np.ndarray:
    return _unzip(data[1:], np.uint32 if data[0] == 4 else np.uint64).astype(np.int64)


def _zip_codes(codes: np.ndarray) -> bytes:
    """Codes as numbers in the table of those that occur."""
    occurs = np.zeros(1 << 16, bool)
    occurs[codes] = True
    table, at = np.flatnonzero(occurs), (np.cumsum(occurs) - 1)[codes]
    small = len(table) <= 256
    head = bytes([1 if small else 2]) + len(table).to_bytes(4, "little") + table.astype(np.uint16).tobytes()
    return head + _zip(at.astype(np.uint8 if small else np.uint16))


def _unzip_codes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[1:5], "little")
    table = np.frombuffer(data[5 : 5 + 2 * n], np.uint16)
    return table[_unzip(data[5 + 2 * n :], np.uint8 if data[0] == 1 else np.uint16)]


def _cut(at: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The non-empty runs of a sorted array of part numbers."""
    ends = np.searchsorted(at, np.arange(parts + 1))
    for k in np.flatnonzero(ends[1:] > ends[:-1]):
        yield int(k), slice(ends[k], ends[k + 1])


def _hashed(texts: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of the words of each text, lower-cased, and then the end. A word is hashed once for each slice of texts."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPLIT_BYTES, "right")))
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, stop - at)))
        found = split.flatten().dictionary_encode()
        words = found.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
        distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        filled = np.array([bool(w) for w in words], bool)  # spaces at a text's ends leave empty strings there
        which, offsets = found.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        for begin, end in zip(offsets[:-1], offsets[1:], strict=True):
            mine = which[begin:end]
            mine = mine[filled[mine]]
            hashes = np.empty(len(mine) + 1, np.uint64)
            hashes[:-1] = distinct[mine]
            hashes[-1] = END
            yield hashes
        at = stop


def _vocabulary(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and the place of each hash among them."""
    found = pa.array(hashes).dictionary_encode()
    distinct = found.dictionary.to_numpy()
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[found.indices.to_numpy()]


def batches_of(docs: DataFrame, training: Column, id_col: str, text_col: str) -> DataFrame:
    """Tokenised batches: batch, ids, sizes, train, tokens (numbers in vocab), vocab (sorted hashes), counts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list = []
        total = 0

        def emit() -> pa.RecordBatch:
            nonlocal held, total, made
            ids, train, hashes = zip(*held, strict=True)
            sizes = np.array([len(h) for h in hashes], np.uint32)
            vocab, tokens = _vocabulary(np.concatenate(hashes))
            flags = np.array(train, bool)
            counts = np.bincount(tokens[np.repeat(flags, sizes)], minlength=len(vocab)).astype(np.uint32)
            out = {"batch": [(part << 24) + made], "ids": [list(ids)], "sizes": [_zip(sizes)], "train": [_zip(flags.view(np.uint8))], "tokens": [_zip(tokens.astype(np.uint32))], "vocab": [_zip(vocab)], "counts": [_zip(counts)], "n_tokens": [int(sizes.sum())], "n_train": [int(counts.sum())], "n_train_docs": [int(flags.sum())], "n_vocab": [len(vocab)]}
            held, total, made = [], 0, made + 1
            return pa.RecordBatch.from_pydict(out, schema=schema)

        schema = None
        for rb in rows:
            schema = schema or pa.schema([("batch", pa.int64()), ("ids", pa.list_(rb.schema.field(0).type)), *((c, pa.binary()) for c in ("sizes", "train", "tokens", "vocab", "counts")), *((c, pa.int64()) for c in ("n_tokens", "n_train", "n_train_docs", "n_vocab"))])
            for ident, hashes, flag in zip(rb.column(0).to_pylist(), _hashed(rb.column(1)), rb.column(2).to_pylist(), strict=True):
                held.append((ident, bool(flag), hashes))
                total += len(hashes)
                if total >= BATCH_TOKENS:
                    yield emit()
        if held:
            yield emit()

    rows = docs.select(id_col, F.col(text_col).cast("string"), F.coalesce(training, F.lit(False)))
    blobs = ", ".join(f"{c} binary" for c in ("sizes", "train", "tokens", "vocab", "counts"))
    return rows.mapInArrow(run, f"batch long, ids array<{kind}>, {blobs}, n_tokens long, n_train long, n_train_docs long, n_vocab long")


def _ask_words(shards: int):  # noqa: ANN202
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            for batch, vocab, counts in zip(*(rb.column(k).to_pylist() for k in range(3)), strict=True):
                hashes, n = _unzip(vocab, np.uint64), _unzip(counts, np.uint32)
                at = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
                out = [(k, batch, _zip(hashes[s]), _zip(n[s])) for k, s in _cut(at, shards)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "batch", "a", "b"])

    return run


ANSWER = "batch long, kind int, shard int, a binary, b binary, n_new long"


def _answer_words(shards: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        slices = [_unzip(x, np.uint64) for x in table["a"].to_pylist()]
        counts = np.concatenate([_unzip(x, np.uint32) for x in table["b"].to_pylist()])
        _, at = np.unique(np.concatenate(slices), return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.int64)
        ends = np.cumsum([len(s) for s in slices])[:-1]
        ids = [_zip_ids(x * shards + shard + 2) for x in np.split(at, ends)]
        found = [_zip_ids(x) for x in np.split(total[at], ends)]
        n = len(ids)
        new = [int((total > 0).sum())] + [0] * (n - 1)
        return pa.table({"batch": table["batch"], "kind": pa.array([0] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "a": pa.array(ids, pa.binary()), "b": pa.array(found, pa.binary()), "n_new": pa.array(new, pa.int64())})

    return run


class _Batch:
    """A batch and what the vocabulary shards said."""

    def __init__(self, row: dict, answers: pa.Table) -> None:
        self.row = row
        self.sizes, self.train = _unzip(row["sizes"], np.uint32).astype(np.int64), _unzip(row["train"], np.uint8).astype(bool)
        self.tokens = _unzip(row["tokens"], np.uint32).astype(np.int64)
        said = sorted((x["shard"], x["a"], x["b"]) for x in answers.to_pylist() if x["kind"] == 0)
        self.ids = np.concatenate([np.array([BOS]), *(_unzip_ids(a) for _, a, _ in said)])
        self.counts = np.concatenate([np.zeros(1), *(_unzip_ids(b) for _, _, b in said)])  # by local number + 1; 0 is the beginning

    def ngrams(self) -> tuple[np.ndarray, ...]:
        """Local numbers v, w of the distinct pairs, how many n-grams each has, u of the distinct n-grams, and where each token's n-gram is."""
        w = self.tokens + 1
        first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        v = np.concatenate([[0], w[:-1]])
        v[first] = 0
        u = np.concatenate([[0], v[:-1]])
        u[first] = 0
        n = len(self.ids)
        pair, at2 = numbered(v * n + w, n * n)
        key, at = numbered(at2 * n + u, len(pair) * n)
        return pair // n, pair % n, np.bincount(key // n, minlength=len(pair)), key % n, at

    def level1(self, n_total: int, n_docs: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """p1 and back1 by local number."""
        c = self.counts.copy()
        c[0] = n_docs
        if not n_total:
            return np.ones(len(c)), np.ones(len(c))
        return np.where(c > 0, c - D1, D1 * n_words) / n_total, K2 / (c + K2)

    def shards(self, v: np.ndarray, w: np.ndarray, lengths: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shard of each pair, the order of pairs by shard and first word in which they are asked for, and that of their n-grams."""
        at = (mix64(mix64(self.ids[v]) + self.ids[w].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        top = int(self.ids.max()) + 1
        order = sorted_places(at * top + self.ids[v], shards * top)
        n = lengths[order]
        grams = np.repeat((np.cumsum(lengths) - lengths)[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, order, grams


def _coarse(x: np.ndarray) -> np.ndarray:
    """Numbers from 1e-9 to 1 in one byte, to within one part in 24."""
    return np.clip(np.rint(-np.log10(x) * COARSE_STEPS), 0, 255).astype(np.uint8)


_FROM_COARSE = 10.0 ** (-np.arange(256) / COARSE_STEPS)


def _ask_ngrams(shards: int, n_total: int, n_docs: int, n_words: int):  # noqa: ANN202
    """Requests: v (as differences), w, u and training counts of n-grams in order of v and w; back1 of each distinct v and p1
    of each distinct v w."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = _Batch(left.to_pylist()[0], right)
        v, w, lengths, u, at = batch.ngrams()
        count = np.bincount(at[np.repeat(batch.train, batch.sizes)], minlength=len(u)).astype(np.uint32)
        p1, back1 = (_coarse(x) for x in batch.level1(n_total, n_docs, n_words))
        shard, order, grams = batch.shards(v, w, lengths, shards)
        shard, v, w, lengths, u, count = shard[order], v[order], w[order], lengths[order], u[grams], count[grams]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = []
        for k, s in _cut(shard, shards):
            g, n = slice(ends[s.start], ends[s.stop]), lengths[s]
            firsts, vs = changes(v[s]), np.repeat(batch.ids[v[s]], n)
            ids = (_zip_ids(np.diff(vs, prepend=0)), _zip_ids(np.repeat(batch.ids[w[s]], n)), _zip_ids(batch.ids[u[g]]))
            out.append((k, batch.row["batch"], *ids, _zip(count[g]), _zip(back1[v[s][firsts]]), _zip(p1[w[s]])))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "batch", "v", "w", "u", "n", "back1", "p1"])

    return run


def _distinct(v: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct n-grams by v, w and u: where each stands first, and the place of each row's n-gram among them."""
    top = int(max(x.max(initial=0) for x in (v, w, u))) + 1
    (_, vs), (ws, at_w), (us, at_u) = (numbered(x, top) for x in (v, w, u))
    pairs, pair = numbered(vs * len(ws) + at_w, (int(vs.max(initial=0)) + 1) * len(ws))
    found, at = numbered(pair * len(us) + at_u, len(pairs) * len(us))
    first = np.empty(len(found), np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    return first, at


def _answer_ngrams(table: pa.Table) -> pa.Table:
    """Requests of several batches have n-grams in common, which the trie is asked for once."""
    rows = table.to_pylist()
    read = lambda c: [_unzip_ids(r[c]) for r in rows]
    slices = [np.cumsum(x) for x in read("v")]
    ends = np.cumsum([len(s) for s in slices])
    v, w, u = np.concatenate(slices), np.concatenate(read("w")), np.concatenate(read("u"))
    new1, new2 = changes(v), changes(v, w)
    new1[ends[:-1]] = new2[ends[:-1]] = True
    back1, p1 = (np.concatenate([_unzip(r[c], np.uint8) for r in rows])[np.cumsum(x) - 1] for c, x in (("back1", new1), ("p1", new2)))
    first, at = _distinct(v, w, u)
    count = np.bincount(at, weights=np.concatenate([_unzip(r["n"], np.uint32) for r in rows]), minlength=len(first)).astype(np.int64)
    v, w, u = v[first], w[first], u[first]
    seen = np.flatnonzero(count)
    trie = Trie(v[seen], w[seen], u[seen], count[seen], _FROM_COARSE[p1[first[seen]]], _FROM_COARSE[back1[first[seen]]], K2, K3)
    try:
        value, back = trie.codes(v, w, u)
    finally:
        trie.close()
    n, pairs = len(rows), np.flatnonzero(new2)
    split = lambda x, cuts: pa.array([_zip_codes(y) for y in np.split(x, cuts)], pa.binary())
    return pa.table({
        "batch": table["batch"], "kind": pa.array([1] * n, pa.int32()), "shard": table["shard"],
        "a": split(value[at], ends[:-1]), "b": split(back[at[pairs]], np.searchsorted(pairs, ends[:-1])),
        "n_new": pa.array([0] * n, pa.int64()),
    })


def _score(n_total: int, n_docs: int, n_words: int, shards: int):  # noqa: ANN202
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = _Batch(left.to_pylist()[0], right)
        v, w, lengths, u, at = batch.ngrams()
        said = sorted((x["shard"], x["a"], x["b"]) for x in right.to_pylist() if x["kind"] == 1)
        _, order, grams = batch.shards(v, w, lengths, shards)
        back2, code = np.empty(len(v)), np.empty(len(u), np.uint16)
        code[grams] = np.concatenate([_unzip_codes(a) for _, a, _ in said])
        back2[order] = restored(np.concatenate([_unzip_codes(b) for _, _, b in said]), absent=1.0)
        p1, back1 = batch.level1(n_total, n_docs, n_words)
        known, base = batch.counts > 0, np.log10((batch.counts + 1) / (n_total + n_words + 1))
        back2, v, w = (np.repeat(x, lengths) for x in (back2, v, w))
        value = np.where(code == ABSENT, p1[w], restored(code)) * np.where(code < PAIR, 1.0, back1[v])
        first = np.concatenate([[0], np.cumsum(batch.sizes)[:-1]]).astype(np.int64)
        context = np.concatenate([[1.0], back2[at][:-1]])
        context[first] = K3 / (n_docs + K3)
        sums = lambda x: np.add.reduceat(x, first)
        ids = left["ids"].combine_chunks().flatten()
        n = len(first)
        return pa.table({"id": ids, "n_tokens": pa.array(batch.sizes), "n_known": pa.array(sums(known[batch.tokens + 1].astype(np.int64))), "train_tokens": pa.array([n_total] * n, pa.int64()), "base_score": pa.array(sums(base[batch.tokens + 1])), "score": pa.array(sums(np.log10(context * value[at])))})

    return run


def scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score (unigrams with one added), score."""
    kind = docs.schema[id_col].dataType.simpleString()
    batches = stored(batches_of(docs, training, id_col, text_col), "lm-batches")
    facts = batches.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_train", "n_train_docs", "n_vocab"))).first()
    word_shards, shards = max(1, -(-facts.n_vocab // VOCABULARY_SHARD)), max(1, -(-facts.n_tokens // NGRAM_SHARD))
    asked = batches.select("batch", "vocab", "counts").mapInArrow(_ask_words(word_shards), "shard int, batch long, a binary, b binary")
    words = stored(asked.groupBy("shard").applyInArrow(_answer_words(word_shards), ANSWER), "lm-words")
    n_words = words.agg(F.coalesce(F.sum("n_new"), F.lit(0))).first()[0]
    light = batches.select("batch", "ids", "sizes", "train", "tokens")
    grams = light.drop("ids").groupBy("batch").cogroup(words.groupBy("batch")).applyInArrow(_ask_ngrams(shards, int(facts.n_train), int(facts.n_train_docs), int(n_words)), "shard int, batch long, " + ", ".join(f"{c} binary" for c in ("v", "w", "u", "n", "back1", "p1")))
    said = stored(grams.groupBy("shard").applyInArrow(_answer_ngrams, ANSWER), "lm-ngrams")
    answers = words.unionByName(said)
    out = light.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(int(facts.n_train), int(facts.n_train_docs), int(n_words), shards), f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
