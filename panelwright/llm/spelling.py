"""Spelling variants by reduced-alphabet generation.

Letters are hashed to SYMBOLS symbols. Of every reduced word the full neighbourhood of one edit (itself, each deletion,
replacement and insertion, over the symbols only) is generated; what isn't in a bitmap of the reduced vocabulary goes where it
is made. The rest is joined with the reduced vocabulary, and the pairs are verified on the original words inside the join.
One edit of the words is at most one edit of their reduced forms, so no pair is lost; a bitmap that is saturated only lets more
through. A pair meets once, as a word has one reduced form and a neighbourhood is a set.

Words are counted within a batch of texts before they move, so a word that is everywhere comes once from each batch. A word's
partners share its length but for one, and are bounded by the alphabet; its forms double the count at each step, so chains
are followed by pointer jumping in a few rounds. What a word's neighbourhood takes in memory is linear in its length.

Joins are merged by hint. Spark sizes a table by its compressed file, and neighbourhoods, of many rows a word, by the file of
their words; it would broadcast what the driver has no room for.

Defined results: a null or empty text has no words; a null id is spelled as the empty text; rows that repeat an id count
as often as given; equal counts are decided by code-point order; an empty table has no words; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix64, new_path, spread, stored, text_of

#: One word in so many of a document, by its hash, loses a letter: the misspellings that the vocabulary shall have.
DAMAGE = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
SYMBOLS = 8
#: A bitmap has so many bits for each reduced word, but 2^MOST_BITS (16 MB) at most.
BITS_A_KEY, MOST_BITS = 16, 27

#: Odd, so it has an inverse modulo 2^64: what follows an edit is shifted by multiplying with either.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_RUN = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: maximal runs of letters, A-Z in lower case, some of them damaged, and how often each occurs."""

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            # bytes.lower() changes A-Z only.
            own = Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
            start = zlib.crc32(f"{id_}:".encode())
            for word, n in own.items():
                h = zlib.crc32(word.encode(), start)
                if not h % DAMAGE:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                total[word] += n
        total.pop("", None)
        yield pa.RecordBatch.from_pydict({"word": list(total), "n": pa.array(total.values(), pa.int64())})

    texts = spread(docs.select(id_col, text_col)).select(text_of(F.col(id_col)).alias("id"), text_of(F.col(text_col)).alias("text")).where("text <> ''")
    return map_batches(texts, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    return counts.where((F.char_length("word") >= least_letters) & (F.col("n") >= least_count))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def reduced_codes(letters: np.ndarray, symbols: int, edits: bool) -> np.ndarray:
    """letters: a row of code points for each word of one length. The codes of the reduced words, one column; with edits, of
    their neighbourhoods, in which a code that repeats is 0."""
    m, n = letters.shape
    s = mix64(letters.astype(np.uint64) + np.uint64(1)) % np.uint64(symbols) + np.uint64(1)
    power = _powers(BASE, n + 1)
    term = s * power[:n]
    before = np.zeros((m, n + 1), np.uint64)  # before[:, i]: what the first i symbols add
    np.cumsum(term, axis=1, out=before[:, 1:])
    whole = before[:, -1:]

    def code(sums: np.ndarray, length: int) -> np.ndarray:
        return mix64(sums + np.uint64(length * 0xD1342543DE82EF95 % 2**64)) | np.uint64(1)

    if not edits:
        return code(whole, n)
    after = whole - before  # after[:, i]: what the symbols from i on add
    some = np.arange(1, symbols + 1, dtype=np.uint64)
    deleted = before[:, :n] + after[:, 1:] * np.uint64(_INVERSE)
    replaced = (whole - term)[:, :, None] + some * power[:n, None]
    inserted = (before + after * np.uint64(BASE))[:, :, None] + some * power[:, None]
    all_ = np.hstack([code(deleted, n - 1), code(replaced.reshape(m, -1), n), code(inserted.reshape(m, -1), n + 1)])
    all_.sort(axis=1)
    all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = 0
    return all_


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and code points of the words of each length."""
    words = batch.column(0).to_pylist()
    length = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        for part in np.array_split(at, 1 + len(at) * int(n) // 50_000):  # bounds the neighbourhoods in memory
            joined = "".join(words[i] for i in part).encode("utf-32-le", "surrogatepass")
            yield part, np.frombuffer(joined, np.uint32).reshape(len(part), int(n))


def _coded(vocab: DataFrame, symbols: int) -> DataFrame:
    def add(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code = np.zeros(batch.num_rows, np.uint64)
        for at, letters in _by_length(batch):
            code[at] = reduced_codes(letters, symbols, edits=False)[:, 0]
        yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), *batch.columns], ["code", "word", "n"])

    return map_batches(vocab.select("word", "n"), add, "code long, word string, n long")


def _bitmap(coded: DataFrame) -> tuple[bytes, int]:
    """At most 16 MB: bits of the codes' highest places."""
    bits = min(MOST_BITS, max(15, (coded.count() * BITS_A_KEY).bit_length()))
    place = F.shiftrightunsigned("code", 64 - bits)
    rows = coded.select(place.alias("h")).groupBy(F.shiftright("h", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(32767)).alias("bits"))
    whole = bytearray(1 << (bits - 3))
    for r in rows.toLocalIterator():
        whole[r["bucket"] * 4096 : r["bucket"] * 4096 + 4096] = r["bits"]
    return bytes(whole), bits


def _neighbours(coded: DataFrame, symbols: int) -> DataFrame:
    """code, word and n for each code of a word's neighbourhood that may be of the reduced vocabulary."""
    whole, bits = _bitmap(coded)
    shared = coded.sparkSession.sparkContext.broadcast(whole)

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        present = np.frombuffer(shared.value, np.uint8)
        for at, letters in _by_length(batch):
            codes = reduced_codes(letters, symbols, edits=True)
            place = codes >> np.uint64(64 - bits)
            hit = (codes != 0) & ((present[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1)
            row, _ = np.nonzero(hit)
            some = batch.take(pa.array(at[row]))
            yield pa.RecordBatch.from_arrays([pa.array(codes[hit].view(np.int64)), *some.columns], ["code", "word", "n"])

    return map_batches(coded.select("word", "n"), make, "code long, word string, n long")


def near_words(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of words (each once in vocab) that differ by one edit of one code point."""
    coded = stored(_coded(vocab, symbols), "spelling-coded")
    other = coded.withColumnsRenamed({"word": "near", "n": "near_n"})
    near = F.levenshtein("word", "near", 1) == 1
    met = _neighbours(coded, symbols).alias("a").hint("merge").join(other.alias("b"), (F.col("a.code") == F.col("b.code")) & near)
    return met.select("word", "n", "near", "near_n")


def variants(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """One row per word of vocab (word, n; each word once): form is the near word of largest n if that is at least twice the
    word's n, root what the forms lead to, n_near the number of near words, form_n the form's n."""
    vocab = stored(vocab.select("word", "n"), "spelling-vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(vocab, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= 2 * F.col("n")
    found = vocab.hint("merge").join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )
    found = stored(found, "spelling-forms")
    roots = _roots(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.hint("merge").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(edges: DataFrame) -> DataFrame:
    """word and root: edges (word, root; stored) followed to their ends. A round makes the steps taken twice as long; words
    that have arrived are only looked up."""
    spark, arrived, moving = edges.sparkSession, [], edges.withColumn("ended", F.lit(False))
    while True:
        known = moving
        for part in arrived:
            known = known.unionByName(part)
        met = moving.alias("a").hint("merge").join(known.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        ended = F.col("b.root").isNull() | F.col("b.ended")
        path = new_path(spark, "spelling-roots")
        met.select("a.word", F.coalesce("b.root", "a.root").alias("root"), ended.alias("ended")).write.parquet(path)
        step = spark.read.parquet(path)
        arrived.append(step.where("ended"))
        moving = step.where("NOT ended")
        if moving.isEmpty():
            break
    out = arrived[0]
    for part in arrived[1:]:
        out = out.unionByName(part)
    return out.drop("ended")
