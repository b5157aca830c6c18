"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, exact_dedup, mixing, near_dedup, ngram_lm, packing, piece_bpe, quality, secret_scan, spelling, substring_dedup, toxicity, warc
from .common import crc_part


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of_kind(kind: str):  # noqa: ANN202
    return lambda x: x["kind"] == kind


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.training_labels(_table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_part(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "clauses", "strongest")


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_part(F.col("doc_id"), 7)
    scored = ngram_lm.scores(_table(spark, sf_dir, "documents"), part != 2)
    return scored.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.report(_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["rank"] < len(secret_scan.BASE_KINDS))
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.spelled(base).cast("binary"), 256).alias("base_sha256"), secret_scan.spelled(F.col("found")).alias("spans"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "text", "copies", "replica", "shuffle_key")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = exact_dedup.exact_copies(docs).withColumnsRenamed({"doc_id": "_id", "bytes": "_bytes", "prefix_hash": "_prefix"})
    digests = exact_dedup.keys(docs).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("bytes") == F.col("_bytes")) & (F.col("prefix_hash") == F.col("_prefix"))
    same &= F.coalesce(F.col("full_hash"), F.col("text_sha256")) == F.col("text_sha256")
    return found.join(digests, same).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality.calibration_labels(_table(spark, sf_dir, "labels"))
    judged = quality.judged(_table(spark, sf_dir, "documents"), labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(spark, _table(spark, sf_dir, "pages"))
    read = warc.read_records(spark, archive)
    return read.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    cut = substring_dedup.without_repeats(docs)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    removed = F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["end"] - x["start"])
    return cut.select("doc_id", F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"), F.coalesce(removed, F.lit(0)).alias("removed_chars"), F.coalesce(spans, F.lit("")).alias("spans"), "text")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(_table(spark, sf_dir, "documents"), width=2)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")), copies_col="copies")
    return conversations.digested(repaired).withColumnRenamed("digest", "repaired_sha256")


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = piece_bpe.load(public_tokenizers.path("piece_bpe_32k.model"))
    found = piece_bpe.decoded(piece_bpe.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text"), model)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spelling.word_counts(_table(spark, sf_dir, "documents"))))


SQL_OP4 = """
WITH sized AS (SELECT source, sum(length(text)) AS chars FROM documents GROUP BY source),
     rates AS (SELECT source, chars, sqrt(chars) / sum(sqrt(chars)) OVER () * sum(chars) OVER () / chars AS rate FROM sized WHERE chars > 0),
     parts AS (SELECT source, greatest(ceil(rate / 16.0), 1)::INT AS parts, rate / greatest(ceil(rate / 16.0), 1) AS mean FROM rates),
     cdf AS (SELECT source, parts, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
             FROM (SELECT source, parts, mean, unnest(range(0, (mean + 12 * sqrt(mean) + 24)::INT)) AS k FROM parts)),
     tables AS (SELECT source, parts, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source, parts),
     drawn AS (SELECT d.doc_id, d.source, d.lang, d.text,
                      list_sum(list_transform(range(1, t.parts + 1), lambda i: len(list_filter(t.cdf, lambda c: c <= ('0x' || substr(md5('17:' || d.doc_id || ':' || i), 1, 13))::BIGINT / 4503599627370496.0)))) AS copies
               FROM documents d JOIN tables t USING (source))
SELECT doc_id, source, lang, text, copies::INT AS copies, replica::INT AS replica, md5('order17:' || doc_id || ':' || replica) AS shuffle_key
FROM (SELECT *, unnest(range(0, copies::BIGINT)) AS replica FROM drawn WHERE copies > 0)
"""

SQL_OP5 = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents),
     g AS (SELECT h, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM n JOIN g USING (h)
"""

SQL_OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p),
     b AS (SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS best,
                  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                      1 + ((('0x' || substr(h, 1 + (i // 4) * 5, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), lambda x, y: x || y) AS payload_digest
           FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM b
"""

#: CRC-32 of bytes (a list of numbers), by a table of 256 entries.
_CRC = """crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) AS c FROM (SELECT unnest(range(0, 256)) AS i)))"""


def _crc_sql(octets: str) -> str:
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"


def _edits_sql() -> str:
    """What can be done with a row of each symbol in each state: up to two insertions, then an edit. Columns of the rows: state,
    symbol, reached, cost, letters, inserted lines, and the role that the row is given (null: its own, empty: it goes)."""
    says, keep = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}, {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
    out = []
    for state in range(4):
        at, new = state, []
        for k in range(3):
            lines = "[" + ", ".join(f"'{x}'" for x in new) + "]::VARCHAR[]"
            for symbol in range(9):
                add = lambda to, cost, letter, role: out.append(f"({state}, {symbol}, {to}, {3 * k + cost}, '{'I' * k + letter}', {lines}, {role})")  # noqa: B023, E731
                add(at, 4, "D", "''")
                if symbol < 8:
                    late = 3 * (symbol // 4)
                    if (at, symbol % 4) in keep:
                        add(keep[at, symbol % 4], late, "K", "NULL")
                    add(says[at][0], 3 + late, "R", f"'{says[at][1]}'")
            at, role = says[at]
            new.append(f"{role}:")
    return ", ".join(out)


SQL_OP11 = f"""
WITH RECURSIVE {_CRC},
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_sql("list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x))")} % 20 AS hit FROM conversations, crc),
dam AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE hit <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM dam),
flt AS (SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS kind FROM num),
sym AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 8 WHEN fault = 'truncated' THEN kind + 4 ELSE kind END AS symbol, (lag(kind) OVER w, kind) NOT IN ((0, 1), (1, 2), (2, 1)) AND lag(kind) OVER w IS NOT NULL AS bad FROM flt WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
edits AS (SELECT * FROM (VALUES {_edits_sql()}) v(state, symbol, reached, cost, letters, inserted, given)),
dp AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT d.conv_id, d.i + 1, reached, d.cost + e.cost, audit || letters, list_concat(lines, inserted, CASE given WHEN '' THEN []::VARCHAR[] ELSE [coalesce(given, role) || ':' || text] END)
    FROM dp d JOIN sym s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND s.i = d.i + 1 JOIN edits e ON e.state = d.state AND e.symbol = s.symbol
    QUALIFY row_number() OVER (PARTITION BY d.conv_id, reached ORDER BY d.cost + e.cost, audit || letters) = 1),
done AS (SELECT conv_id, i, cost + CASE state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS cost, audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit, list_concat(lines, CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END) AS lines FROM dp),
best AS (SELECT d.* FROM done d JOIN (SELECT c.conv_id, count(s.i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sym s ON s.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY 1) n ON n.conv_id IS NOT DISTINCT FROM d.conv_id AND n.n = d.i
    QUALIFY row_number() OVER (PARTITION BY d.conv_id ORDER BY cost, audit) = 1),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM sym GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost::BIGINT AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM b.conv_id
"""

SQL_OP13 = f"""
WITH RECURSIVE {_CRC},
own AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{c0}}-\\x{{ff}}]+')) AS w FROM documents) GROUP BY ALL),
raw AS (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM own),
hit AS (SELECT w, n, {_crc_sql("list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)")} AS h FROM raw, crc),
cnt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, sum(n)::BIGINT AS n FROM hit GROUP BY 1),
voc AS (SELECT word, n FROM cnt WHERE length(word) >= 5 AND n >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word)))::INT AS i FROM voc)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT DISTINCT c.word, c.n, v.word, v.n FROM cut c JOIN voc v ON v.word = c.rest UNION SELECT DISTINCT v.word, v.n, c.word, c.n FROM cut c JOIN voc v ON v.word = c.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM near GROUP BY word),
frm AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM voc v LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root FROM frm UNION ALL SELECT w.word, f.form FROM way w JOIN frm f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT frm.word, frm.form, w.root, frm.n, frm.n_near, frm.form_n FROM frm JOIN way w ON w.word = frm.word JOIN frm e ON e.word = w.root AND e.form IS NULL
"""

QUERIES = {"op1_toxicity": op1_toxicity, "op2_ngram_lm": op2_ngram_lm, "op3_secret_scan": op3_secret_scan, "op4_mixing": op4_mixing, "op5_exact_dedup": op5_exact_dedup, "op6_quality": op6_quality, "op7_warc": op7_warc, "op8_packing": op8_packing, "op9_substring_dedup": op9_substring_dedup, "op10_near_dedup": op10_near_dedup, "op11_conversations": op11_conversations, "op12_piece_bpe": op12_piece_bpe, "op13_spelling": op13_spelling}
ORACLE_SQL = {"op3_secret_scan": secret_scan.oracle_sql(), "op4_mixing": SQL_OP4, "op5_exact_dedup": SQL_OP5, "op7_warc": SQL_OP7, "op11_conversations": SQL_OP11, "op13_spelling": SQL_OP13}
