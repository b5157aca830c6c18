"""The toxicity grammar against plain loops: no machines, and the composed one against its five parts run apart."""

import math
import random

import pytest

from panelwright.llm import toxicity
from panelwright.llm.toxicity import INSULT, INTENT, LINK, NEGATION, REACH, REPORT, TARGET, THREAT

WORDS = [*toxicity.INSULTS[:4], *toxicity.THREATS[:4], "you", "Them", "not", "nicht", "said", "schrieb", "will", "gonna", "are", "ist", "smurg", "smurgly", "throttle", "tree", "of", "Ärger", "don't", "x1"]
MARKS = ["", "", "", "", ".", ",", ";", "!", "\n", " | ", ": "]


def lexicon():
    return toxicity.Lexicon({"smurg": 2.5, "throttle": 4.0, "tree": 0.5}, {"smu": 3.5, "tre": 0.2}, frozenset({"throttle"}), tuple(0.3 * k - 1 for k in range(len(toxicity.LABELS))), (-1.0, 0.7, 0.4, 0.3, 0.2))


def text(rng):
    return "".join(rng.choice(WORDS) + rng.choice(MARKS) + " " for _ in range(rng.randint(0, 40)))


def labels_by_loop(kinds):
    """(place, label) of a clause, each from its definition."""
    out = []
    last = lambda i, *which: next((p for p in range(i - 1, -1, -1) if kinds[p] in which), None)
    near = lambda i, p: p is not None and i - p <= REACH
    for i, k in enumerate(kinds):
        if k == INSULT:
            out.append((i, "insult"))
            p = last(i, LINK, INSULT)
            if near(i, p):
                out.append((i, "linked" if kinds[p] == LINK else "chained"))
        if k == THREAT:
            out.append((i, "threat"))
            p = last(i, INTENT, THREAT)
            if near(i, p) and kinds[p] == INTENT:
                out.append((i, "intended"))
        if k == TARGET:
            p = last(i, INTENT, THREAT)
            if near(i, p) and kinds[p] == THREAT and TARGET not in kinds[p:i]:
                out.append((i, "at_someone"))
            before = kinds[:i]
            if TARGET not in before and (INSULT in before or THREAT in before):
                out.append((i, "aimed_after"))
        if k in (INSULT, THREAT):
            if TARGET in kinds[:i]:
                out.append((i, "aimed"))
            if near(i, last(i, NEGATION)):
                out.append((i, "denied"))
            if REPORT in kinds[:i]:
                out.append((i, "reported"))
    return sorted(out)


def test_composed_machine_is_its_five_parts():
    rng = random.Random(7)
    parts = [toxicity._insults(), toxicity._threats(), toxicity._targets(), toxicity._negations(), toxicity._reports()]
    for _ in range(3000):
        kinds = [rng.randrange(8) for _ in range(rng.randint(1, 14))]
        apart, states = [], list(toxicity.START)
        whole, state = [], 0
        for i, k in enumerate(kinds):
            for m, machine in enumerate(parts):
                states[m], labels = machine[states[m], k]
                apart += [(i, x) for x in labels]
            state, labels = toxicity.GRAMMAR[state + k]
            whole += [(i, toxicity.LABELS[x]) for x in labels]
        assert sorted(whole) == sorted(apart) == labels_by_loop(kinds)


def symbol_by_loop(model, word):
    """Fixed words first; learned weight of a word or of its longest or shorter stems where that is more."""
    kind, weight = model.fixed.get(word, (toxicity.OTHER, 0.0))
    if kind in (INSULT, THREAT, toxicity.OTHER):
        known = [model.words.get(word, 0.0)] + [w for stem, w in model.stems.items() if word.startswith(stem) and len(word) > len(stem)]
        if max(known) > weight:
            return (THREAT if kind == THREAT or word in model.threats else INSULT), max(known)
    return kind, weight


def score_by_loop(model, said):
    strengths = []
    for clause in toxicity.CLAUSE.split((said or "").lower()):
        symbols = [symbol_by_loop(model, w) for w in toxicity.WORD.findall(clause)]
        kinds = [k for k, _ in symbols]
        if INSULT in kinds or THREAT in kinds:
            hits, now = [], 0.0
            for _, w in symbols:
                now = w or now
                hits.append(now)
            strengths.append(sum(hits[i] * model.weights[toxicity.LABELS.index(x)] for i, x in labels_by_loop(kinds)))
    found = sorted((s for s in strengths if s > 0), reverse=True)
    features = [1.0, *(found[:1] or [0.0]), math.log1p(sum(found)), *(found[1:2] or [0.0]), math.log1p(len(found))]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(model.coefficients, features, strict=True))))))


def test_scores_against_loops(spark):
    rng, model = random.Random(11), lexicon()
    texts = [text(rng) for _ in range(400)] + [None, "", " \n", "You idiot. " * 3000]
    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        want = score_by_loop(model, texts[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-9)
        assert r.predicted == int(r.score >= toxicity.THRESHOLD)
    kept = toxicity.keep_clean(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score < toxicity.THRESHOLD}
