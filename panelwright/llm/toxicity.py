"""Toxicity by a weighted finite-state pattern grammar.

Words map to symbols: insult, threat, target, negation, report, intent, link or other. Five transducers read a clause
symbol by symbol: one for insults (alone, after a link such as "are a", in a chain), one for threats (a verb alone, after
a word of intent, at someone), one for targets (who is meant), one for negation, one for reported speech. They are composed
into one machine; its arcs emit labels, and an arc's weight is learned for each label. A clause scores by the arcs of its
path, so an insult aimed at someone weighs more than one in passing, and a denied or quoted one less. Documents are
scored from their clauses, never from isolated words.

Insult and threat lexicons hold fixed seeds and what is learned from labelled rows: whole words and stems (proper prefixes
of words) with their smoothed log-odds; a learned word counts as a threat if it mostly follows a word of intent. The
weights of arcs are fitted to the strongest clause of each labelled text, starting from and drawn towards PRIOR, which
decides where labels say nothing. A small logistic model turns the clause scores of a document into a probability.
Fitting reads at most FIT_ROWS labelled rows, chosen by a hash of the id, and keeps all that these rows teach.

Defined results: null and empty texts score like a text with no match; a very long text is scored over all its clauses;
ids, languages and sources are never read; repeated rows score alike, rows with a null id too; without usable labels the
seed lexicon, PRIOR and fixed coefficients are used; an empty table gives no row; keep_clean() passes all columns through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_part, give_back, map_batches

#: The most labelled rows that fitting may read.
FIT_ROWS = 20_000
THRESHOLD = 0.3

# Seed words of each symbol.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile cretin vermin filth pig".split()
THREATS = "kill murder destroy stab shoot strangle beat burn hurt hunt".split()
TARGETS = "you your yours he him his she her they them their we us i me my all everyone these those du ihr sie dich tu vous il elle ils te usted ellos".split()
NEGATIONS = "not no never neither nor without isn't aren't don't won't nicht kein keine nie ne pas jamais nunca sin".split()
REPORTS = "said says say wrote writes quoted quotes claimed claims reported reports called allegedly sagte schrieb dit écrit dijo escribió".split()
INTENTS = "will shall going gonna must should want wants i'll we'll gotta werde werden wird will vais va vont voy vamos van".split()
LINKS = "are is am was were be you're he's a an the such so very bist ist sind ein eine es est êtes un une eres son una".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, LINK, OTHER = range(8)
SEED_WEIGHT = 3.0
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:,\n|]+")
STEM_LENGTHS = range(3, 9)
#: Texts whose pieces are counted together before they leave a task, and the bits of such a count.
COUNTED_TEXTS, SHIFT = 500, 20
#: How many words a link, an insult, an intent, a threat or a negation reaches.
REACH = 3

#: Labels that arcs emit, and their weights before labels are seen.
PRIOR = {
    "insult": 1.0, "linked": 0.25, "chained": 0.25, "threat": 0.5, "intended": 0.5, "at_someone": 0.75,
    "aimed": 0.5, "aimed_after": 0.25, "denied": -1.0, "reported": -0.75,
}
LABELS = tuple(PRIOR)
#: How many labelled texts the prior of a weight is worth, about.
PRIOR_STRENGTH = 4.0

Machine = dict  # (state, symbol) -> (next state, labels emitted)


def _insults() -> Machine:
    """States: 0; a link within reach (link, words left); an insult within reach."""
    out: Machine = {}
    for state in [0, *product(("link", "insult"), range(1, REACH + 1))]:
        kind, left = state or ("", 0)
        later = (kind, left - 1) if left > 1 else 0
        for y in range(8):
            out[state, y] = (later, ())
        out[state, LINK] = (("link", REACH), ())
        out[state, INSULT] = (("insult", REACH), ("insult", *{"link": ["linked"], "insult": ["chained"]}.get(kind, [])))
    return out


def _threats() -> Machine:
    """States: 0; an intent within reach; a verb within reach that still lacks its object."""
    out: Machine = {}
    for state in [0, *product(("intent", "verb"), range(1, REACH + 1))]:
        kind, left = state or ("", 0)
        later = (kind, left - 1) if left > 1 else 0
        for y in range(8):
            out[state, y] = (later, ())
        out[state, INTENT] = (("intent", REACH), ())
        out[state, THREAT] = (("verb", REACH), ("threat", "intended") if kind == "intent" else ("threat",))
        if kind == "verb":
            out[state, TARGET] = (0, ("at_someone",))
    return out


def _targets() -> Machine:
    """States: whether a target was seen, and whether a hit without one is waiting for it."""
    out: Machine = {}
    for seen, waiting in product((False, True), repeat=2):
        for y in range(8):
            out[(seen, waiting), y] = ((seen, waiting), ())
        out[(seen, waiting), TARGET] = ((True, False), ("aimed_after",) if waiting else ())
        for y in (INSULT, THREAT):
            out[(seen, waiting), y] = ((seen, not seen), ("aimed",) if seen else ())
    return out


def _negations() -> Machine:
    """States: how many more words a negation governs."""
    hit = lambda y, left: ("denied",) if left and y in (INSULT, THREAT) else ()
    return {(left, y): (REACH if y == NEGATION else max(left - 1, 0), hit(y, left)) for left in range(REACH + 1) for y in range(8)}


def _reports() -> Machine:
    """States: whether a verb of report was seen; it governs the rest of the clause."""
    hit = lambda y, seen: ("reported",) if seen and y in (INSULT, THREAT) else ()
    return {(seen, y): (seen or y == REPORT, hit(y, seen)) for seen in (False, True) for y in range(8)}


def compose(*machines: Machine) -> dict:
    """The product machine: states are tuples, an arc emits the numbers of all labels of the arcs it is made of."""
    out = {}
    for state in product(*(dict.fromkeys(s for s, _ in m) for m in machines)):
        for y in range(8):
            steps = [m[s, y] for m, s in zip(machines, state, strict=True)]
            out[state, y] = (tuple(t for t, _ in steps), tuple(LABELS.index(x) for _, labels in steps for x in labels))
    return out


def _numbered(machine: dict, start: tuple) -> list:
    """The same machine over numbered states, 0 first: step[state * 8 + symbol] = next state * 8, labels."""
    number = {s: k for k, s in enumerate(dict.fromkeys([start, *(s for s, _ in machine)]))}
    return [(number[t] * 8, labels) for s in number for t, labels in (machine[s, y] for y in range(8))]


START = (0, 0, (False, False), 0, False)
GRAMMAR = _numbered(compose(_insults(), _threats(), _targets(), _negations(), _reports()), START)


@dataclass
class Lexicon:
    """words and stems: log-odds; threats: those of the words that are threats; weights: one for each of LABELS."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    threats: frozenset[str] = frozenset()
    weights: tuple = tuple(PRIOR.values())
    coefficients: tuple = (-3.0, 1.0, 0.6, 0.4, 0.0)

    def __post_init__(self) -> None:
        kinds = ((LINK, LINKS), (INTENT, INTENTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
        self.fixed = {w: (k, 0.0) for k, ws in kinds for w in ws}
        self.fixed |= {w: (k, SEED_WEIGHT) for k, ws in ((INSULT, INSULTS), (THREAT, THREATS)) for w in ws}
        self.seen: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        got = self.seen.get(word)
        if got is None:
            kind, weight = self.fixed.get(word, (OTHER, 0.0))
            if kind in (INSULT, THREAT, OTHER):
                learned = max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEM_LENGTHS if k < len(word))])
                if learned > weight:
                    kind, weight = (THREAT if kind == THREAT or word in self.threats else INSULT), learned
            if len(self.seen) > 100_000:
                self.seen.clear()
            got = self.seen[word] = (kind, weight)
        return got

    def paths(self, text: str | None) -> list[list[float]]:
        """For each clause with an insult or a threat how much weight its path carries over each label."""
        text = (text or "").lower()
        symbol = self.symbol
        if not any(symbol(w)[0] < TARGET for w in set(WORD.findall(text))):
            return []
        out = []
        for clause in CLAUSE.split(text):
            symbols = [symbol(w) for w in WORD.findall(clause)]
            if any(k < TARGET for k, _ in symbols):
                state, hit, carried = 0, 0.0, [0.0] * len(LABELS)
                for k, weight in symbols:
                    hit = weight or hit  # what a target after it completes
                    state, labels = GRAMMAR[state + k]
                    for x in labels:
                        carried[x] += hit
                out.append(carried)
        return out

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the matched clauses, largest first."""
        return sorted((sum(map(float.__mul__, self.weights, path)) for path in self.paths(text)), reverse=True)

    def features(self, text: str | None) -> list[float]:
        return _features(self.clauses(text))

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.coefficients, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _features(clauses: list[float]) -> list[float]:
    """Of clause scores above 0, largest first: 1, the strongest, all together, the second, how many."""
    found = [c for c in clauses if c > 0]
    return [1.0, found[0] if found else 0.0, math.log1p(sum(found)), found[1] if len(found) > 1 else 0.0, math.log1p(len(found))]


def _after_intent(text: str) -> set[str]:
    """Words that follow a word of intent within reach."""
    out, intents = set(), set(INTENTS)
    for clause in CLAUSE.split(text):
        words = WORD.findall(clause)
        for k, w in enumerate(words):
            if w in intents:
                out.update(words[k + 1 : k + 1 + REACH])
    return out


def _pieces_of(texts: list[str | None], toxic: list[int]) -> dict[str, int]:
    """Of each word, and each stem (with a trailing *): clean texts, SHIFT bits higher toxic texts, and as much higher toxic
    texts where it follows an intent; one number a piece, as there are many."""
    out: dict[str, int] = {}
    for text, label in zip(texts, toxic, strict=True):
        text = (text or "").lower()
        words = set(WORD.findall(text))
        one = 1 << SHIFT if label else 1
        for piece in words | {w[:k] + "*" for w in words for k in STEM_LENGTHS if k < len(w)}:
            out[piece] = out.get(piece, 0) + one
        if label:
            for w in _after_intent(text):
                out[w] += 1 << 2 * SHIFT
    return out


def _learned_words(sample: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    """All pieces whose log-odds exceed 2, counted over the sample in Spark; only these come to the driver."""

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for begin in range(0, batch.num_rows, COUNTED_TEXTS):
            part = batch.slice(begin, COUNTED_TEXTS)
            found = _pieces_of(part.column(0).to_pylist(), part.column(1).to_pylist())
            n, low = np.fromiter(found.values(), np.int64, len(found)), (1 << SHIFT) - 1
            columns = (n >> SHIFT & low, n & low, n >> 2 * SHIFT)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *map(pa.array, columns)], ["piece", "toxic", "clean", "intended"])

    least = 3 if n_toxic < 1000 else 5
    counted = map_batches(sample.select("_text", "_toxic"), count, "piece string, toxic long, clean long, intended long")
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    best = counted.groupBy("piece").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "intended"))).where(F.col("toxic") >= least)
    rows = best.withColumn("odds", odds).where("odds > 2").select("piece", "odds", "toxic", "intended").collect()  # of a bounded sample
    return Lexicon(
        {r.piece: r.odds for r in rows if r.piece[-1] != "*"},
        {r.piece[:-1]: r.odds for r in rows if r.piece[-1] == "*"},
        frozenset(r.piece for r in rows if r.piece[-1] != "*" and 2 * r.intended > r.toxic),
    )


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Coefficients drawn towards the prior, by Newton steps that are halved until they help."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(strength * (w - prior) ** 2))

    w = prior.astype(float)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(strength) + 1e-6 * np.eye(len(w)), slope)
        size, before = 1.0, loss(w)
        while loss(w - size * step) > before and size > 1e-6:
            size /= 2
        w = w - size * step
        if size * np.abs(step).max() < 1e-6:
            break
    return w


def _arc_weights(paths: list[list[list[float]]], y: np.ndarray, labels: Iterable[str]) -> tuple:
    """A weight for each label, fitted to each text's strongest clause by the weights before; labels that aren't asked for
    weigh nothing."""
    used = np.array([name in set(labels) for name in LABELS])
    prior = np.where(used, list(PRIOR.values()), 0.0)
    weights, x = prior, np.zeros((len(y), len(LABELS)))
    strength = np.append(np.where(used, PRIOR_STRENGTH, 1e9), 1e-3)
    for _ in range(4):
        for k, found in enumerate(paths):
            if found:
                x[k] = max(found, key=lambda p: float(np.dot(weights, p)))
        weights = np.where(used, _logistic(np.column_stack([x, np.ones(len(y))]), y, np.append(prior, -3.0), strength)[:-1], 0.0)
    return tuple(map(float, weights))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, arcs: Iterable[str] = LABELS) -> Lexicon:
    """Learn lexicon, arc weights and coefficients from at most fit_rows of the labelled rows of docs. arcs: the labels that
    may weigh anything; fewer of them show what the others are worth."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows))  # bounded by fit_rows
    sample = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(chosen, F.col("_key") == F.col("_id"))
    sample = sample.select("_text", "_toxic")
    sizes = {r._toxic: r["count"] for r in sample.groupBy("_toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon()
    model = _learned_words(sample, sizes[1], sizes[0])

    def describe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [[x for path in model.paths(t) for x in path] for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"x": pa.array(rows, pa.list_(pa.float64())), "y": batch.column(1)})

    rows = map_batches(sample, describe, "x array<double>, y int").groupBy("x", "y").count().collect()  # at most fit_rows
    rows = sorted(rows, key=lambda r: (r.y, r.x, r["count"]))  # the same order, so the same sums, on every run
    many = [r["count"] for r in rows]
    paths = [p for r, k in zip(rows, many, strict=True) for p in [[list(r.x[i : i + len(LABELS)]) for i in range(0, len(r.x), len(LABELS))]] * k]
    y = np.repeat([float(r.y) for r in rows], many)
    model.weights = _arc_weights(paths, y, arcs)
    x = np.array([_features(sorted((float(np.dot(model.weights, p)) for p in found), reverse=True)) for found in paths])
    model.coefficients = tuple(map(float, _logistic(x, y, np.zeros(5), np.array([1e-4, *[1e-2] * 4]))))
    model.seen.clear()
    return model


def score(docs: DataFrame, model: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score, predicted, clauses (how many score above 0), strongest (score of the strongest clause)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.array([model.features(t) for t in batch.column(1).to_pylist()])
        s = 1 / (1 + np.exp(-np.clip(x @ np.array(model.coefficients), -30, 30)))
        made = [pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(np.rint(np.expm1(x[:, 4])).astype(np.int32)), pa.array(x[:, 1])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", "score", "predicted", "clauses", "strongest"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(id_col, F.col(text_col).cast("string")), run, f"id {kind}, score double, predicted int, clauses int, strongest double")
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""

    @F.arrow_udf("boolean")
    def rejected(texts: pa.Array) -> pa.Array:
        out = pa.array([model.score(t.as_py()) >= threshold for t in texts], pa.bool_())  # one text at a time in memory
        give_back()
        return out

    return docs.where(~rejected(F.col(text_col)))


def training_labels(labels: DataFrame, parts: int = 4, held_out: int = 2, id_col: str = "doc_id") -> DataFrame:
    return labels.where(crc_part(F.col(id_col), parts) != held_out)
