"""The corpus pipeline on the smallest table and the queries' contracts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest

from panelwright.llm import near_dedup, queries, toxicity


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == columns
        from panelwright.llm.common import stored

        docs = stored(out, f"test-{name}")
        n = docs.count()
        if name in ("exact_dedup", "near_dedup"):
            assert n < before
        before = n
    assert docs.count() == corpus_pipeline.run(spark, sf_dir).count()


def brute_exact(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((i, text))
    return [max(g, key=lambda r: (len(r[1] or ""), r[0] is not None, -(r[0] or 0))) for g in groups.values()]


def brute_near(rows):
    sets, roots = [], near_dedup._Roots()
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and None not in (rows[a][0], rows[b][0]) and 100 * len(x & y) >= 80 * len(x | y):
                roots.join(rows[a][0], rows[b][0])
    return [r for r in rows if r[0] is None or roots.of(r[0]) == r[0]]


def brute_mixed(rows):
    """rows: id, text, source."""
    chars = Counter()
    for _, text, source in rows:
        chars[source] += len(text or "")
    target = {s: n**0.5 for s, n in chars.items()}
    out = Counter()
    for i, text, source in rows:
        if chars[source]:
            mean = target[source] / sum(target.values()) * sum(chars.values()) / chars[source]
            parts = max(1, math.ceil(mean / 16))
            for k in range(1, parts + 1):
                x = int(hashlib.md5(f"17:{'null' if i is None else i}:{k}".encode()).hexdigest()[:13], 16) / 2**52
                p = c = math.exp(-mean / parts)
                n = 0
                while c <= x:
                    n += 1
                    p *= mean / parts / n
                    c += p
                out[i, text] += n
    return +out


def odd_table(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns with the operators' own names."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(500)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    base = say(120)
    texts = [base, base + " more", base.replace(" ", "\n"), "", None, "  ", say(30_000), "You stupid idiot, you moron. I will kill you, worthless scum.", *(say(40) for _ in range(12)), base.replace("a", "b", 3)]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", i, 1.5, 7, -1, "k", "h", [1], True) for i, t in enumerate(texts)]
    rows += [rows[0], rows[9], (None, say(50), None, None, *rows[0][4:]), (None, None, None, None, *[None] * 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rate double, copies int, replica int, shuffle_key string, _hash string, spans array<int>, kept boolean").repartition(3)


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_every_stage_by_brute_force(spark, sf_dir, table):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if table == "documents" else odd_table(spark)
    from panelwright.llm.common import stored

    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    run = lambda name, df: stored(stage[name](spark, df, sf_dir), f"brute-{name}")
    model = toxicity.fit(docs, toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    clean = run("toxicity", docs)
    assert Counter(pairs(clean)) == Counter(r for r in pairs(docs) if model.score(r[1]) < toxicity.THRESHOLD) and clean.columns == columns
    exact = run("exact_dedup", clean)
    assert Counter(pairs(exact)) == Counter(brute_exact(pairs(clean))) and exact.columns == columns
    near = run("near_dedup", exact)
    assert Counter(pairs(near)) == Counter(brute_near(pairs(exact))) and near.columns == columns
    mixed = run("mixing", near)
    assert Counter(pairs(mixed)) == brute_mixed([(r.doc_id, r.text, r.source) for r in near.collect()]) and mixed.columns == columns
    before = {(r.doc_id, r.text): str(r) for r in docs.collect()}
    assert all(before[r.doc_id, r.text] == str(r) for r in mixed.collect())  # every column as it was
    tokens, got = Counter(), Counter()
    for i, text in pairs(mixed):
        tokens[i] += len((text or "").encode().split()) + 1
    for r in stage["packing"](spark, mixed, sf_dir).collect():
        got[r.doc_id] += r.tokens
    assert got == tokens and len(tokens) > 5


def test_stages_take_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda values: hashlib.md5(repr(values).encode()).hexdigest()
    want = Counter(key([r[names.index(c)] for c in sorted(names)]) for r in cur.fetchall())
    assert Counter(key([r[c] for c in sorted(names)]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_per_row(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    table = {"op7": "pages", "op11": "conversations"}.get(name.partition("_")[0], "documents")
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    n = rows.select("conv_id").distinct().count() if name.startswith("op11") else rows.count()
    assert df.count() >= 1
    if not name.startswith(("op4", "op8", "op13")):
        assert df.count() == n
