"""WARC archives: written with Spark's text sink, read back by boundary chains.

Writing: one ``response`` record a page, with HTTP head and the html as its
payload; of pages with equal payloads (SHA-256 and length) of at least
``min_bytes`` bytes only the one with the largest page_id carries it, the others
are ``revisit`` records with the digest, the length and a reference.  Records
end with CRLF CRLF, so files are plain concatenated records.

Reading: archives are read in parallel as chunks between CRLF CRLF.

1. A chunk's offset is the running sum of chunk sizes in its file.  What is
   kept of a chunk is its offset, size and SHA-1 and its text only if it opens
   a WARC or HTTP head.
2. Each chunk that opens with the WARC magic is a candidate with a successor offset
   (its end by Content-Length).  Payloads may hold the magic as well.
3. Neighbouring candidates of which each is the successor of the one before
   form a segment, which a chain leaves only at its end.  Pointer jumping
   over segments, from offset 0 of each file, doubles the known chain a
   round; candidates that no chain reaches are rejected.
4. A payload that is one chunk has that chunk's digest; the chunks of the others
   are read again and put together.

Null html counts as empty, a null url as the empty URL, a null page_id as an
empty record id.  Of repeated page_ids the last row in the scan counts as the largest.
A record without a Content-Length ends its file's chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentable.llm.common import cut, numbered, scanned, small_side, table, text_or_empty
from sentable.sources.io import scratch_path

CRLF = "\r\n"
MAGIC = "WARC/1."
RECORDS_PER_ARCHIVE = 20_000
MIN_BYTES = 0
# Base32 digits and the digits conv() gives for them.
CONV_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(c: Column) -> Column:
    """Bare upper-case base32: every five hex digits of the SHA-1 make four characters."""
    digest = F.sha1(c)
    return F.translate(F.upper(F.concat(*[
        F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)])), CONV_DIGITS, BASE32)


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, record): the text of each page's record, but for its last CRLF."""
    pages = scanned(pages)
    base = (numbered(pages, "page_id", "url", "html")
            .select("rid", "page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20]", "%20").alias("url"),
                    text_or_empty("html").alias("html"))
            .withColumn("n", F.octet_length("html")).withColumn("key", F.unhex(F.sha2("html", 256))))
    keepers = (base.where(F.col("n") >= min_bytes).groupBy("key", "n")
               .agg(F.max(F.struct("page_id", "rid")).alias("keep"), F.count("*").alias("copies"))
               .where("copies > 1").select("key", "n", "keep"))
    keepers = small_side(cut(keepers, "warc-keepers"))
    r = base.join(keepers, ["key", "n"], "left")
    revisit = F.col("keep").isNotNull() & (F.col("keep.rid") != F.col("rid"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n").cast("string"), F.lit(CRLF + CRLF))
    body = F.when(revisit, http).otherwise(F.concat(http, "html"))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn(F.col("page_id")),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Refers-To: "), urn(F.col("keep.page_id")), F.lit(
            f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))
        .otherwise(F.lit("")),
        F.lit(f"{CRLF}WARC-Target-URI: "), F.col("url"), F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), base32_sha1(F.col("html")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    return r.select("page_id", F.concat(head, body, F.lit(CRLF)).alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES,
                   per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    (records(pages, min_bytes).select("record").write.mode("errorifexists")
     .option("lineSep", CRLF).option("maxRecordsPerFile", per_archive).text(path))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", CRLF + CRLF).text(path)
            .select(F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    (F.octet_length("value") + 4).cast("long").alias("size"),
                    base32_sha1(F.col("value").cast("binary")).alias("digest"), "value"))


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    head = F.col("value").startswith(MAGIC) | F.col("value").startswith(CRLF + MAGIC) | F.col("value").startswith("HTTP/")
    c = _chunks(spark, path).select(
        "id", "file", "block", "size", "digest", F.when(head, F.col("value")).alias("head"))
    before = Window.partitionBy("file").orderBy("block", "id").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))).drop("block", "id")


def field(head: str, name: str) -> Column:
    return F.regexp_extract(head, f"(?i)\\r\\n{name}:[ \\t]*([^\\r\\n]*)", 1)


def candidates(index: DataFrame) -> DataFrame:
    """Record-to-successor offsets of every chunk that opens like a record."""
    skip = F.when(F.col("head").startswith(CRLF), 2).otherwise(0)      # the payload before ended with CRLF
    length = F.expr("try_cast(nullif(h_length, '') AS bigint)")
    c = (index.where(F.col("head").startswith(MAGIC) | F.col("head").startswith(CRLF + MAGIC))
         .withColumn("h_length", field("head", "Content-Length"))
         .select("file", (F.col("at") + skip).alias("start"), (F.col("at") + F.col("size")).alias("body"),
                 length.alias("length"), "head"))
    return c.withColumn("next", F.col("body") + F.col("length") + 4)


def chains(cands: DataFrame) -> DataFrame:
    """The candidates that the chain from offset 0 of their file reaches."""
    w = Window.partitionBy("file").orderBy("start")
    new = F.when(F.lag("next").over(w) == F.col("start"), 0).otherwise(1)
    c = cut(cands.withColumn("new", new).withColumn("seg", F.sum("new").over(w)).drop("new"), "warc-candidates")
    exits = c.groupBy("file", "seg").agg(F.max_by("next", "start").alias("next"))
    jump = cut(exits.join(c.select("file", F.col("start").alias("next"), F.col("seg").alias("to")), ["file", "next"])
               .select("file", "seg", "to", F.col("next").alias("entry")), "warc-jumps")
    reach = cut(c.where("start = 0").select("file", "seg", F.col("start").alias("entry")), "warc-reach")
    known = reach.count()
    while True:
        step = reach.join(jump.withColumnRenamed("entry", "e"), ["file", "seg"]).select(
            "file", F.col("to").alias("seg"), F.col("e").alias("entry"))
        more = cut(reach.union(step).distinct(), "warc-reach")
        n = more.count()
        if n == known:
            break
        reach, known = more, n
        second = jump.select("file", F.col("seg").alias("to"), F.col("to").alias("to2"), F.col("entry").alias("entry2"))
        jump = cut(jump.join(second, ["file", "to"]).select(
            "file", "seg", F.col("to2").alias("to"), F.col("entry2").alias("entry")), "warc-jumps")
    return c.join(reach, ["file", "seg"]).where("start >= entry").drop("seg", "entry")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row each record: record_id, record_type, refers_to, payload_bytes,
    payload_digest (recomputed from the payload; for revisits as recorded)."""
    index = cut(chunk_index(spark, path), "warc-index")
    recs = cut(chains(candidates(index)), "warc-records")
    http = index.where(F.col("head").startswith("HTTP/")).select(
        "file", F.col("at").alias("body"), F.col("size").alias("h_size"), F.col("head").alias("h_head"))
    r = recs.join(http, ["file", "body"], "left").withColumn(
        "from", F.col("body") + F.coalesce("h_size", F.lit(0))).withColumn(
        "bytes", F.col("length") - F.coalesce("h_size", F.lit(0)))
    whole = index.select("file", F.col("at").alias("from"), (F.col("size") - 4).alias("bytes"), "digest")
    r = cut(r.join(whole, ["file", "from", "bytes"], "left"), "warc-payloads")
    is_revisit = F.lower(field("head", "WARC-Type")) == "revisit"
    rest = r.where(F.col("digest").isNull() & ~is_revisit).select("file", "start", "from", "bytes")
    if not rest.isEmpty():
        r = r.join(_assembled(spark, path, index, rest), ["file", "start"], "left").withColumn(
            "digest", F.coalesce("digest", "joined"))
    urn = lambda name: F.regexp_extract(field("head", name), "<urn:page:(-?[0-9]*)>", 1)
    recorded = F.regexp_extract(field("head", "WARC-Payload-Digest"), "^sha1:([A-Z2-7]+)", 1)
    number = lambda c: c.try_cast("long")
    return r.select(
        number(urn("WARC-Record-ID")).alias("page_id"),
        F.when(is_revisit, number(field("h_head", "Content-Length"))).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(is_revisit, recorded).otherwise(F.col("digest")).alias("payload_digest"),
        F.lower(field("head", "WARC-Type")).alias("record_type"),
        F.when(is_revisit, number(urn("WARC-Refers-To"))).alias("refers_to"))


def _assembled(spark: SparkSession, path: str, index: DataFrame, rest: DataFrame) -> DataFrame:
    """Digests of payloads that hold CRLF CRLF or end with CRLF: their chunks, joined again."""
    # each chunk belongs to the last record whose payload starts at or before it
    marks = rest.select("file", F.col("from").alias("at"), F.lit(0).alias("chunk"), "start", "bytes")
    rows = marks.unionByName(index.select("file", "at", F.lit(1).alias("chunk"), "size", "digest"), allowMissingColumns=True)
    w = Window.partitionBy("file").orderBy("at", "chunk")
    own = F.last(F.when(F.col("start").isNotNull(), F.struct("start", "at", "bytes")), ignorenulls=True).over(w)
    parts = cut(rows.withColumn("own", own).where("chunk = 1 AND at < own.at + own.bytes").select(
        "file", "at", "size", "digest", F.col("own.start").alias("start"), F.col("own.bytes").alias("bytes")), "warc-parts")
    # chunks are named by what they hold, not by their place in a scan, which may be cut otherwise this time
    wanted = small_side(cut(parts.select("size", "digest").distinct(), "warc-chunks"))
    values = (_chunks(spark, path).join(wanted, ["size", "digest"], "left_semi")
              .groupBy("size", "digest").agg(F.max("value").alias("value")))
    text = parts.join(values, ["size", "digest"])
    joined = F.array_join(F.transform(F.array_sort("parts"), lambda p: p["value"]), CRLF + CRLF)
    payload = F.substring(F.concat(joined, F.lit(CRLF + CRLF)).cast("binary"), F.lit(1), F.col("bytes").cast("int"))
    return (text.groupBy("file", "start", "bytes").agg(F.collect_list(F.struct("at", "value")).alias("parts"))
            .select("file", "start", base32_sha1(payload).alias("joined")))


def query(spark, sf_dir):
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, d,
             max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
         (('0x' || substr(d, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '')
         AS payload_digest,
       CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep = page_id THEN NULL ELSE keep END AS refers_to
FROM k
"""
