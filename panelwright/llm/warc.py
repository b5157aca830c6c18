"""A content-addressed web archive.

Payload bytes are stored once, under their SHA-256; the exact header block of every record is stored apart, with the
digest of its payload. A record is put together again by joining both. Reading trusts nothing: records are rebuilt to
their exact bytes and parsed from these, lengths and digests are computed anew, and what doesn't agree or is missing raises.

Only digests and ids are grouped. Payload bytes move once to the place where they are stored, and once more to the
responses that hold them; the many revisits of a common payload join only its length and digest.

Defined results: a null payload is empty; of equal payloads the record with the largest id is the response and the others
revisit it (payloads shorter than least_bytes are all responses); rows that repeat an id and payload give as many
equal records; a null id makes a record with an empty id field that refers to none but itself; a null url is empty;
line breaks in a url are dropped; a very long payload is one value like any other; an empty table gives an empty archive;
other columns are ignored, whatever their names. The date of a record is a column of times, or the time of writing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flag_maybe, join_groups, maybe_filter, new_path, stored, text_of

CRLF = "\r\n"
# The digits of base 32 in conv() and in RFC 4648.
CONV32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    headers: str
    payloads: str


def base32(hex_digits: Column, chars: int = 40) -> Column:
    """Upper-case base 32 of a hexadecimal string whose length is a multiple of 5."""
    parts = [F.lpad(F.conv(F.substring(hex_digits, k, 5), 16, 32), 4, "0") for k in range(1, chars, 5)]
    return F.translate(F.upper(F.concat(*parts)), CONV32, RFC32)


def _headers(kind: Column, ident: Column, url: Column, date: Column, digest: Column, length: Column, refers: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), ident, F.lit(">"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(refers.isNotNull(), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers, F.lit(">")))).otherwise(F.lit("")),
        F.when(refers.isNotNull(), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(length.cast("string"))),
        F.lit(CRLF),
    )


def write_archive(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date_col: str | None = None) -> Archive:
    """Store a record for each row. date_col: times of capture; without one, or where it is null, the time of writing."""
    to = Archive(new_path(spark, "archive-headers"), new_path(spark, "archive-payloads"))
    payload = text_of(F.col(payload_col)).cast("binary")
    url = F.regexp_replace(text_of(F.col(url_col)), r"[\r\n]", "")
    now = F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    date = F.coalesce(F.date_format(F.to_utc_timestamp(F.col(date_col), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), now) if date_col else now
    keyed = pages.select(F.col(id_col).alias("id"), url.alias("url"), date.alias("date"), F.sha2(payload, 256).alias("digest"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("length"))
    keyed = stored(keyed, "archive-keyed")
    best = stored(keyed.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("times")), "archive-best")
    record = join_groups(keyed, best, ["digest"], "times")
    again = (F.col("length") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(again, F.col("first").cast("string"))
    ident = F.coalesce(F.col("id").cast("string"), F.lit(""))
    block = _headers(kind, ident, F.col("url"), F.col("date"), base32(F.col("sha1")), F.col("length"), refers)
    record.select("id", "digest", block.cast("binary").alias("header")).write.parquet(to.headers)
    content = pages.select(F.col(id_col).alias("id"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # Payloads that the bitmap of repeated digests doesn't know are stored where they are read; only others move.
    common = stored(best.where("times > 1").select("digest"), "archive-common")
    flagged = flag_maybe(content, maybe_filter(common, F.col("digest")), F.col("digest"))
    again = flagged.where("__pw_maybe").alias("p").join(best.alias("b"), (F.col("p.digest") == F.col("b.digest")) & F.col("p.id").eqNullSafe(F.col("b.first")))
    again = again.select("p.digest", "p.payload").dropDuplicates(["digest"])
    flagged.where("NOT __pw_maybe").select("digest", "payload").unionByName(again).write.parquet(to.payloads)
    return to


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """digest, payload, and length and SHA-1 as computed from the stored bytes; a payload whose SHA-256 is not
    its address raises."""
    held = spark.read.parquet(archive.payloads)
    true = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))))
    return held.select(true.alias("digest"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))


def _missing(digest: Column) -> Column:
    return F.raise_error(F.concat(F.lit("missing payload "), digest))


def _is_revisit() -> Column:
    return F.decode("header", "UTF-8").contains(f"WARC-Type: revisit{CRLF}")


def _with_payloads(heads: DataFrame, held: DataFrame) -> DataFrame:
    """heads of responses with body and times: equal records are one row with their number, so that only payloads shorter than the
    archive's least_bytes, which all are responses, can be common to many; of these, the heavy ones are broadcast (at most
    HEAVY, each shorter than that)."""
    alike = stored(heads.groupBy("id", "digest", "header").agg(F.count("*").alias("times")), "archive-heads")
    bodies = held.select("digest", F.col("payload").alias("body"))
    common = stored(alike.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1"), "archive-common")
    if common.isEmpty():
        return alike.join(bodies, "digest", "left")
    short = stored(common.join(bodies, "digest"), "archive-short")
    marked = join_groups(alike, short, ["digest"], "k", prune=False, how="left")
    rest = marked.where("k IS NULL").drop("body").join(bodies, "digest", "left")
    return marked.where("k IS NOT NULL").drop("k").unionByName(rest.drop("k"))


def _record(body: Column) -> Column:
    return F.concat("header", body, F.lit(f"{CRLF}{CRLF}".encode()))


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """id, digest, record (exact bytes: header block, payload, or nothing for a revisit, and the closing line breaks). A
    record whose payload isn't there raises."""
    head = spark.read.parquet(archive.headers)
    whole = _with_payloads(head.where(~_is_revisit()), read_payloads(spark, archive))
    whole = whole.withColumn("body", F.coalesce("body", _missing(F.col("digest")).cast("binary")))
    whole = whole.select("id", "digest", _record(F.col("body")).alias("record"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_k"))
    bare = head.where(_is_revisit()).select("id", "digest", _record(F.lit(b"")).alias("record"))
    return whole.drop("_k").unionByName(bare)


def _field(header: Column, pattern: str) -> Column:
    found = F.regexp_extract(header, f"(?md)^{pattern}\r$", 1)
    return F.when(found != "", found)


def _parsed(rows: DataFrame) -> DataFrame:
    """Rows with record: its fields, and length and digests of its body, from its bytes."""
    # In ISO-8859-1 a character is a byte, so that positions of characters are positions of bytes.
    split = rows.withColumn("_end", F.locate(f"{CRLF}{CRLF}", F.decode("record", "ISO-8859-1")) + 3)
    text = F.decode(F.substring("record", F.lit(1), F.col("_end")), "UTF-8")
    body = F.substring("record", F.col("_end") + 1, F.octet_length("record") - F.col("_end") - 4)
    return split.select(
        "digest", *(["times"] if "times" in rows.columns else []),
        _field(text, "WARC-Record-ID: <urn:page:([^>\r]*)>").alias("id"),
        _field(text, "WARC-Type: ([a-z]+)").alias("record_type"),
        _field(text, "WARC-Refers-To: <urn:page:([^>\r]*)>").alias("refers_to"),
        _field(text, "WARC-Target-URI: ([^\r]*)").alias("url"),
        _field(text, "WARC-Date: ([^\r]*)").alias("date"),
        _field(text, "WARC-Payload-Digest: sha1:([A-Z2-7]+)").alias("stated"),
        _field(text, "Content-Length: ([0-9]+)").cast("long").alias("stated_bytes"),
        F.octet_length(body).cast("long").alias("own_bytes"),
        base32(F.sha1(body)).alias("own_digest"),
        F.sha2(body, 256).alias("address"),
    )


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row per record, parsed from its rebuilt bytes: id, record_type, refers_to, url, date, payload_bytes,
    payload_digest. Length and digest are those of the record's own payload, for a revisit those of the stored payload that
    it refers to, and must be what the header states. Payloads are read and verified once, by the responses; what revisits need
    of them is kept from there."""
    head = spark.read.parquet(archive.headers)
    whole = _with_payloads(head.where(~_is_revisit()), spark.read.parquet(archive.payloads))
    lost = F.when(F.col("body").isNull(), _missing(F.col("digest")).cast("binary")).otherwise(F.col("body"))
    own = _parsed(whole.select("digest", "times", _record(lost).alias("record")))
    broken = F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("string")
    own = own.withColumn("payload_digest", F.when(F.col("address") == F.col("digest"), F.col("own_digest")).otherwise(broken)).withColumn("payload_bytes", F.col("own_bytes"))
    own = stored(own.drop("address"), "archive-responses")
    facts = own.groupBy("digest").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    again = stored(_parsed(head.where(_is_revisit()).select("digest", _record(F.lit(b"")).alias("record"))).drop("address"), "archive-revisits")
    referred = stored(again.groupBy("digest").agg(F.count("*").alias("k")).join(facts, "digest", "left"), "archive-referred")
    again = join_groups(again, referred, ["digest"], "k", prune=False).drop("k")
    again = again.withColumn("payload_digest", F.coalesce("payload_digest", _missing(F.col("digest")).cast("string")))
    agreed = (F.col("stated") == F.col("payload_digest")) & (F.col("stated_bytes") == F.col("own_bytes"))
    checked = F.when(agreed, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("record and header differ: "), F.coalesce("id", F.lit("")))).cast("string"))
    own = own.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("_k", "times")
    return own.unionByName(again).select("id", "record_type", "refers_to", "url", "date", "payload_bytes", checked.alias("payload_digest"))
