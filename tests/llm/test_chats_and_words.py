"""Conversation repair, SentencePiece pieces and spelling variants against brute force and the library."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelwright.llm import conversations, piece_bpe, spelling

ODD = "doc_id long, text string, lang string, word string, n int, code string, ids string, decoded string, near int, c int"


def as_docs(spark, pairs):
    return spark.createDataFrame([(i, t, None, "w", 1, "x", "i", "d", 2, 3) for i, t in pairs], ODD).repartition(3)


# --- conversations


def damage(rows):
    """The rows of each conversation after damage, in order, and every conversation."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = {1: "", 2: re.sub(r"[.!?]", "", text)}.get(kind, text)
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in out.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def reads(initials):
    return re.fullmatch("(s?(ua)+)?", "".join(x if x in ("s", "u", "a") else "x" for x in initials)) is not None


def cheapest(rows):
    """Dynamic programming over (state, least cost and letters), rows in order."""
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    says = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    better = lambda ways, state, way: ways if state in ways and ways[state][:2] <= way[:2] else ways | {state: way}

    def inserted(ways):
        for _ in range(3):
            for state, (cost, letters, lines) in list(ways.items()):
                to, role = says[state]
                ways = better(ways, to, (cost + 3, letters + "I", (*lines, f"{role}:")))
        return ways

    ways = inserted({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        after = {}
        for state, (cost, letters, lines) in ways.items():
            after = better(after, state, (cost + 4, letters + "D", lines))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if (to := keep.get((state, role[:1]))) is not None:
                    after = better(after, to, (cost + more, letters + "K", (*lines, f"{role}:{text}")))
                to, new = says[state]
                after = better(after, to, (cost + more + 3, letters + "R", (*lines, f"{new}:{text}")))
        ways = inserted(after)
    return min((ways[s] for s in (0, 3) if s in ways), key=lambda w: w[:2])


def expected(rows):
    out = set()
    for conv, own in damage(rows).items():
        turns = [r[0] for r in own if r[0] is not None]
        found = Counter(faults(own))
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest(own)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.add((conv, gaps, found["blank"], found["duplicate"], found["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


SAID = ["Hi.", "Hi", "", " \n", None, "Yes! ", "x" * 50 + ".", "No?", "a:b\nc.", "Ä."]
ROLES = ["system", "user", "assistant", "user", "assistant", "user", "assistant", None, "tool", "", "User"]


def odd_chats(spark, rng, long_rows=1500):
    rows = []
    for conv in [None, 0, *range(1, 120)]:
        for k in range(long_rows if conv == 0 else rng.choice([1, 2, 5, 9, 30])):
            rows.append((conv, rng.choice([None, k, k, k, k // 3]), rng.choice(ROLES), rng.choice([*SAID, f"t{k}.", f"u{k}"])))
    rows += rows[:40]
    more = [r + ("at", 1, True, "piece", 5) for r in rows]
    return rows, spark.createDataFrame(more, "conv_id long, turn long, role string, text string, at string, n int, whole boolean, c string, copies int").repartition(5)


def test_conversations_against_brute_force(spark):
    rows, df = odd_chats(spark, random.Random(3))
    repaired = conversations.repair(conversations.damaged(df), "copies")
    got = {tuple(r) for r in conversations.digested(repaired).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest").collect()}
    assert got == expected(rows)
    assert repaired.open_report.count() > 0 and repaired.whole.count() > 50  # both ways were taken
    said = defaultdict(dict)
    for r in conversations.messages(repaired).collect():
        assert r.turn not in said[r.conv_id]
        said[r.conv_id][r.turn] = r
    digests = {r[0]: r[-1] for r in got}
    for conv, lines in said.items():
        own = [lines[i] for i in range(len(lines))]
        assert reads([r.role[:1] for r in own])
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == digests[conv]


def test_one_hot_conversation_is_spread_out(spark):
    rows = [(7, k, ("user", "assistant")[k % 2], f"line {k}.") for k in range(6000)] + [(k, 0, "user", "Hi.") for k in range(100, 400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repaired = conversations.repair(conversations.damaged(df), "copies")
    assert {tuple(r) for r in conversations.digested(repaired).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest").collect()} == expected(rows)
    assert repaired.open_lines.where("conv_id = 7").count() >= 6
    assert conversations.repair(df).whole.where("audit <> 'I' AND audit <> 'KI'").count() == 0  # without damage only the end is lacking
    assert conversations.digested(conversations.repair(conversations.damaged(df.limit(0)), "copies")).count() == 0


def test_block_tables_against_all_edits():
    """Every short sequence of symbols, by trying edits in order of their letters; and long ones by dynamic programming."""
    rng = random.Random(8)
    roles = ["system", "user", "assistant", "other"]
    for n in range(5):
        for kinds in itertools.product(range(9), repeat=n) if n < 4 else (rng.choices(range(9), k=4) for _ in range(2000)):
            rows = [(i, roles[k % 4] if k < 8 else "user", "" if k == 8 else f"{i}" + ("" if k >= 4 else ".")) for i, k in enumerate(kinds)]
            symbols = conversations.np.array([8 if k == 8 else k for k in kinds], conversations.np.uint8)
            cost, audit, ends, _ = conversations.cheapest(symbols)
            want = cheapest(rows)
            assert (cost, audit) == want[:2], kinds
            assert [audit[:e][-1] for e in ends] == [x for x in audit if x != "I"]
    assert len(conversations.tables().vectors) < 100


# --- pieces


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    return piece_bpe.load(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library(spark, tokenizer):
    model, library = tokenizer
    rng = random.Random(1)
    chars = [chr(c) for c in (9, 10, 32, 32, 32, 0x2581, 0xE9, 0x301, 0x4E2D, 0x20000, 0xA0, 0x3000, 0, 0x1F600, 0xAC00)] + list("aaabbbeeettthhhiiinnnggg....====----0123456789ABCxyz")
    pieces = [p.replace("▁", " ") for p in model.ids]
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 80))) for _ in range(1500)] + ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(2000)]
    texts += ["".join(rng.choices(s, k=4000)) for s in ("ab", "=.-", "abcdefghij ", " ")] + ["", " ", "  x ", "a" * 20_000, "".join(rng.choices("etaoinshr", k=60_000))]
    docs = as_docs(spark, [*enumerate(texts), (0, texts[0]), (None, "x y"), (None, None)])
    ids = piece_bpe.encoded(docs, model)
    assert set(ids.columns) == set(docs.columns)
    got = {r.doc_id: (r.ids, r.decoded) for r in piece_bpe.decoded(ids, model).select("doc_id", "ids", "decoded").where("doc_id IS NOT NULL").collect()}
    want = library.encode(texts)
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(want))
    assert {k: v[1] for k, v in got.items()} == {i: library.decode(x) for i, x in enumerate(want)}
    assert sorted(r.ids for r in ids.where("doc_id IS NULL").collect()) == [[], library.encode("x y")]
    assert piece_bpe.decoded(piece_bpe.encoded(docs.limit(0), model), model).count() == 0


def test_decoding_of_any_ids(tokenizer):
    model, library = tokenizer
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(len(model.pieces)), rng.randrange(3, 259), 0, 1, 2, 28705, 259]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids
    with pytest.raises(IndexError):
        model.decode([-1])


def test_pieces_of_a_hostile_vocabulary():
    """Pieces that can't be reached, ties of scores, characters that are no pieces, and places that fail: as merging does."""
    rng = random.Random(6)
    for _ in range(300):
        pieces = {"".join(rng.choices("abc▁", k=rng.randint(1, 5))) for _ in range(rng.randint(3, 25))}
        pieces = sorted(pieces, key=lambda p: (len(p), p))
        rng.shuffle(pieces)
        every = [f"<0x{b:02X}>" for b in range(256)] + pieces
        scores = [0.0] * 256 + [-float(rng.randint(1, 6)) for _ in pieces]
        model = piece_bpe.Model(every, scores, [piece_bpe.BYTE] * 256 + [piece_bpe.NORMAL] * len(pieces), False, "?")
        for _ in range(20):
            text = "".join(rng.choices("abc d", k=rng.randint(1, 14)))
            want = []
            for p in model.merged(text.replace(" ", "▁")):
                want += [model.ids[p]] if p in model.ids else [model.bytes_ids[b] for b in p.encode()]
            assert piece_bpe.np.frombuffer(model.encode(text), piece_bpe.np.int32).tolist() == want, (pieces, scores[256:], text)


def test_models_that_change_texts_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="BPE"):
        piece_bpe.load(str(tmp_path / "m"))


# --- spelling


def variants_by_hand(pairs, least=3):
    counts = Counter()
    for id_, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def test_spelling_variants_against_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdéÀ×", k=rng.randint(4, 8))) for _ in range(60)]
    words = list(base)
    for w in base * 3:
        i = rng.randrange(len(w))
        words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abxyz") + w[i:], w[:i] + rng.choice("abxyz") + w[i + 1 :]]))
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "aaaaaaaa", "b" * 300, "b" * 299]
    weight = [rng.choice([1, 2, 4, 8, 16, 32, 64]) for _ in words]
    pairs = [(i, " ".join(x.upper() if rng.random() < 0.2 else x for x in rng.choices(words, weight, k=60)) + rng.choice([" ", ",", "1", "\n"])) for i in range(200)]
    pairs += [pairs[0], pairs[0], (None, pairs[1][1]), (None, None), (5, ""), (6, " 12 "), (7, "b" * 300 + " " + "b" * 299)] + [(8 + i, ("b" * 300 + " ") * 2 + "b" * 299) for i in range(3)]
    docs = as_docs(spark, pairs)
    for symbols in (1, 3, 8):
        found = spelling.variants(spelling.vocabulary(spelling.word_counts(docs)), symbols)
        assert {tuple(r) for r in found.collect()} == variants_by_hand(pairs)
    assert spelling.variants(spelling.vocabulary(spelling.word_counts(docs.limit(0)))).count() == 0


def test_chains_of_forms_lead_to_their_root(spark):
    vocab = [("a" * 5 + "b" * k, 2 ** (20 - k)) for k in range(18)] + [("zzzzz", 3), ("zzzzzz", 3)]
    rows = {r.word: r for r in spelling.variants(spark.createDataFrame(vocab, "word string, n long")).collect()}
    assert {r.root for w, r in rows.items() if w[0] == "a"} == {"aaaaa"}
    assert rows["zzzzz"].form is None and rows["zzzzz"].n_near == 1  # as frequent as its only near word


def test_spelling_broadcasts_no_join(spark):
    """Spark sizes neighbourhoods by the file of their words, so it took them for small enough."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def plans():
        bus.waitUntilEmpty(30_000)
        runs = store.executionsList()
        return {x.executionId(): x.physicalPlanDescription() for x in map(runs.apply, range(runs.length()))}

    before = plans()
    vocab = spark.createDataFrame([("a" * 5 + "b" * k, 2 ** (10 - k)) for k in range(8)], "word string, n long")
    assert spelling.variants(vocab).count() == 8
    own = [x for k, x in plans().items() if k not in before]
    assert sum("SortMergeJoin" in x for x in own) >= 3  # near words, steps to the roots, roots
    assert not any("Broadcast" in x for x in own)


def test_neighbourhoods_hold_every_edit():
    rng = random.Random(5)
    letters = "abcdefgh"
    of = lambda w, edits: spelling.reduced_codes(spelling.np.array([[ord(c) for c in w]]), 4, edits)[0]
    for _ in range(300):
        w = "".join(rng.choices(letters, k=rng.randint(2, 7)))
        around = of(w, True)
        known = around[around != 0]
        assert len(set(known.tolist())) == len(known)
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        assert {int(of(e, False)[0]) for e in edits} == set(map(int, known))


def test_queries_name_their_columns(spark, sf_dir):
    from panelwright.llm import queries

    want = {
        "op11_conversations": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
        "op12_piece_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op13_spelling": {"word", "form", "root", "n", "n_near", "form_n"},
    }
    for name, columns in want.items():
        assert set(queries.QUERIES[name](spark, sf_dir).columns) == columns
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert {tuple(r) for r in queries.QUERIES["op13_spelling"](spark, sf_dir).collect()} == variants_by_hand([(r.doc_id, r.text) for r in rows])
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = queries.QUERIES["op11_conversations"](spark, sf_dir).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {tuple(r) for r in got.collect()} == expected([tuple(r) for r in chats])
