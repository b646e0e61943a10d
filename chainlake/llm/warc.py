"""WARC archives: writing, and reading by boundary-chain verification.

Writing: the text sink writes one record per row, with CRLF CRLF as its line
separator, which is exactly the trailer of a WARC record.

Reading: the text source is splittable and cuts the files at every magic
``WARC/1.0 CRLF``.  The magic has no border, so any split finds the same cuts.
Byte offsets follow from the lengths of the pieces by prefix sums: over the
pieces of a split, and over the splits of a file.  Each piece whose header is
whole is a candidate record; its Content-Length gives the offset of its
successor.  Candidates of a split that lead to the next one form runs; pointer
jumping over the runs of all splits, from the start of the file, keeps only
what is reachable (in log2 of the splits rounds, without a task per file), so a
magic inside a payload starts no record.  A record that holds a magic in its
payload consists of several pieces, which are put together again; all other
payloads are digested in the scan.

Defined cases (writing): a null payload is an empty one.  Of records with equal
payloads of at least ``min_bytes`` bytes the largest id is the response; rows
that repeat that id as well are responses too, and rows without an id revisit
the largest id, or are responses where no row has one.  Control characters,
blanks and non-ASCII characters in URLs are percent-encoded, a null URL has no
WARC-Target-URI.  Defined cases (reading): bytes that no chain from the start
of a file reaches are no records; an empty folder gives no rows.  Only the
named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainlake.llm.common import fresh_path, staged, table

MAGIC = "WARC/1.0\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(h: Column) -> Column:
    """Base32 (upper case, 32 characters, no padding) of a hex SHA-1."""
    def char(i: Column) -> Column:
        five = F.floor(i / 4).cast("int")  # 5 hex digits are 4 characters
        bits = F.conv(h.substr(five * 5 + 1, F.lit(5)), 16, 10).cast("bigint")
        low = F.pmod(F.floor(bits / F.pow(F.lit(32.0), 3 - F.pmod(i, F.lit(4)))), F.lit(32))
        return F.lit(_BASE32).substr(low.cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), char), "")


def plan_records(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(r_id, r_digest, refers_to) of the rows that revisit another."""
    body = F.coalesce(F.col(payload_col), F.lit(""))
    meta = pages.select(F.col(id_col).alias("r_id"), F.sha1(body).alias("r_digest"), F.octet_length(body).alias("n"))
    dup = (meta.where(F.col("n") >= min_bytes).groupBy("r_digest")
           .agg(F.max("r_id").alias("refers_to"), F.count(F.lit(1)).alias("c"))
           .where("c > 1 AND refers_to IS NOT NULL").select(F.col("r_digest").alias("d"), "refers_to"))
    return (meta.where(F.col("n") >= min_bytes).join(dup, F.col("r_digest") == F.col("d"))
            .where(~F.col("r_id").eqNullSafe(F.col("refers_to"))).select("r_id", "r_digest", "refers_to").distinct())


def _header_value(c: Column) -> Column:
    """Percent-encoded for a header line; also cannot end in the magic."""
    safe = F.transform(F.split(c, ""), lambda x: F.when(x.rlike("^[!-~]$"), x).otherwise(
        F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")))
    return F.regexp_replace(F.array_join(safe, ""), "WARC/1.0$", "WARC/1%2E0")


def write(pages: DataFrame, path: str, id_col="page_id", url_col="url", payload_col="html", min_bytes: int = 0) -> None:
    """Write one record per row; the archives are the files below ``path``."""
    rev = staged(plan_records(pages, id_col, payload_col, min_bytes), "warc-revisits")  # written, so that its size is known
    body = F.coalesce(F.col(payload_col), F.lit(""))
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body"), F.sha1(body).alias("digest"))
    p = p.join(rev, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    block = F.when(F.col("r_digest").isNull(), F.col("body")).otherwise(F.lit(""))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(F.col("r_digest").isNull(), "response").otherwise("revisit"), F.lit("\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", _header_value(F.col("url"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        line("X-Payload-Length", F.octet_length("body").cast("string")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    p.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "none").text(path)


def raw_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between magics: file, split, idx (in the split), piece.  The
    text source gives the bytes as they are, without decoding."""
    raw = (spark.read.option("lineSep", MAGIC).text(path)
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                   F.monotonically_increasing_id().alias("mid"), F.col("value").cast("binary").alias("piece")))
    return raw


def _field(head: Column, name: str) -> Column:
    got = F.regexp_extract(head, rf"(?i)\r\n{name}: *([^\r\n]*)\r\n", 1)
    return F.when(got != "", got)


def candidates(pieces: DataFrame) -> DataFrame:
    """One row per piece: file, mid, at (offset of its magic), next (successor
    offset, null if the piece has no whole header), whole (the record is just
    this piece), and for whole records the header fields and the digest."""
    cut = F.locate("\r\n\r\n", F.col("piece").cast("string"))  # characters; the header is ASCII
    n = F.octet_length("piece").cast("long")
    head = F.concat(F.lit("\r\n"), F.col("piece").cast("string").substr(F.lit(1), cut + 1))
    d = pieces.withColumn("n", n).withColumn("head", F.when(cut > 0, head)).withColumn(
        "head_n", F.octet_length("head").cast("long"))  # header bytes after the magic, with the blank line
    length = F.when(_field(F.col("head"), "Content-Length").rlike("^[0-9]{1,18}$"),
                    _field(F.col("head"), "Content-Length").cast("long"))
    d = d.withColumn("length", length).withColumn("room", F.col("n") - F.col("head_n") - 4)
    whole = F.col("room") == F.col("length")
    body = F.col("piece").substr(F.col("head_n").cast("int") + 1, F.col("length").cast("int"))
    return d.select("file", "split", "mid", "n", "head_n", "length", F.coalesce(whole, F.lit(False)).alias("whole"),
                    *[_field(F.col("head"), h).alias(a) for a, h in FIELDS],
                    F.when(whole, base32(F.sha1(body))).alias("digest"))


FIELDS = (("type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("uri", "WARC-Target-URI"),
          ("refers", "WARC-Refers-To"), ("said_digest", "WARC-Payload-Digest"), ("said_length", "X-Payload-Length"))


def located(cand: DataFrame) -> DataFrame:
    """Adds idx, at and next.  The piece before the first magic of a file is
    not a record and only shifts the offsets."""
    per_split = W.partitionBy("file", "split")
    before = per_split.orderBy("mid").rowsBetween(W.unboundedPreceding, -1)
    size = F.lit(len(MAGIC)) + F.col("n")
    d = (cand.withColumn("idx", F.row_number().over(per_split.orderBy("mid")) - 1)
         .withColumn("inner", F.coalesce(F.sum(size).over(before), F.lit(0))))
    sums = cand.groupBy("file", "split").agg(F.sum(size).alias("b"))
    sums = sums.select(F.col("file").alias("f"), F.col("split").alias("s"), F.coalesce(F.sum("b").over(
        W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    d = d.join(sums, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s"))).drop("f", "s")
    d = d.withColumn("at", F.col("off") + F.col("inner") - len(MAGIC)).where("at >= 0")
    return d.withColumn("next", F.col("at") + len(MAGIC) + F.col("head_n") + F.col("length") + 4).drop("off", "inner")


def reachable(d: DataFrame) -> DataFrame:
    """Adds ``record``: offset of the reachable record that a piece belongs to
    (null: none).  Rows that start a record have record = at.

    Runs live inside a split, named by the offset of their first piece; the
    jumps connect them across splits, so no task holds a file."""
    order = W.partitionBy("file", "split").orderBy("at")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    linked = F.col("next") == F.lead("at").over(order)
    marked = (d.withColumn("linked", F.coalesce(linked, F.lit(False)))
              .withColumn("brk", ~F.coalesce(F.lag("linked").over(order), F.lit(False)))
              .withColumn("run", F.last(F.when(F.col("brk"), F.col("at")), ignorenulls=True).over(so_far)))
    marked = staged(marked, "warc-pieces")
    # a run leaves through its last piece; where it goes is inside another run
    exits = marked.where("NOT linked AND next IS NOT NULL").select("file", F.col("run").alias("from_run"), F.col("next").alias("goal"))
    spots = marked.select(F.col("file").alias("f"), "at", F.col("run").alias("to_run"))
    jump = staged(exits.join(spots, (F.col("file") == F.col("f")) & (F.col("goal") == F.col("at")))
                  .select("file", "from_run", "to_run", F.col("at").alias("entry")), "warc-jump")
    reach = staged(marked.where("at = 0").select("file", "run", F.lit(0).cast("long").alias("entry")), "warc-reach")
    n = reach.count()
    while n:  # doubles the reach: all runs within 2^k jumps of the start
        hop = jump.select(F.col("file").alias("f"), "from_run", "to_run", F.col("entry").alias("e"))
        more = reach.join(hop, (F.col("file") == F.col("f")) & (F.col("run") == F.col("from_run"))).select(
            "file", F.col("to_run").alias("run"), F.col("e").alias("entry"))
        reach = staged(reach.unionByName(more).distinct(), "warc-reach")
        now = reach.count()
        if now == n:
            break
        n = now
        on = hop.withColumnsRenamed({"from_run": "r2", "to_run": "t2"})
        jump = staged(jump.join(on, (F.col("file") == F.col("f")) & (F.col("to_run") == F.col("r2")))
                      .select("file", "from_run", F.col("t2").alias("to_run"), F.col("e").alias("entry")), "warc-jump")
    r = reach.select(F.col("file").alias("f"), F.col("run").alias("r"), "entry")
    on = marked.join(r, (F.col("file") == F.col("f")) & (F.col("run") == F.col("r")), "left").drop("f", "r")
    start = F.when(F.col("next").isNotNull() & (F.col("at") >= F.col("entry")), F.col("at"))
    on = on.withColumn("start", start).withColumn("stop", F.when(F.col("start").isNotNull(), F.col("next")))
    on = (on.withColumn("record", F.last("start", ignorenulls=True).over(so_far))
          .withColumn("until", F.last("stop", ignorenulls=True).over(so_far)))
    # a record may begin in an earlier split: one row per split says which
    ends = on.groupBy("file", "split").agg(F.max(F.when(F.col("start").isNotNull(), F.struct("start", "stop"))).alias("end"))
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(F.col("file").alias("f"), F.col("split").alias("s"), F.last("end", ignorenulls=True).over(earlier).alias("open"))
    on = on.join(carry, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    on = on.withColumn("record", F.coalesce("record", "open.start")).withColumn("until", F.coalesce("until", "open.stop"))
    return (on.withColumn("record", F.when(F.col("at") < F.col("until"), F.col("record")))
            .drop("linked", "brk", "run", "entry", "start", "stop", "until", "f", "s", "open"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per reachable record: file, at, type, record_id, uri, refers,
    said_digest, said_length, length (of its block), digest (of its block)."""
    on = staged(reachable(located(candidates(raw_pieces(spark, path)))), "warc-records")
    heads = on.where("record = at")
    named = ["file", "at", "length", *[a for a, _ in FIELDS]]
    one = heads.where("whole").select(*named, "digest")
    split = heads.where("NOT whole").select(F.col("file").alias("f"), F.col("at").alias("r"))
    if split.isEmpty():  # nothing to put together, so no second scan
        return one
    parts = (on.where("record IS NOT NULL").join(split, (F.col("file") == F.col("f")) & (F.col("record") == F.col("r")))
             .select(F.col("file").alias("pf"), F.col("split").alias("ps"), F.col("idx").alias("pi"), "at", "record",
                     "head_n", "length"))
    raw = raw_pieces(spark, path)
    firsts = raw.groupBy("file", "split").agg(F.min("mid").alias("m0")).select(
        F.col("file").alias("mf"), F.col("split").alias("ms"), "m0")
    want = parts.join(firsts, (F.col("pf") == F.col("mf")) & (F.col("ps") == F.col("ms"))).withColumn("want", F.col("m0") + F.col("pi"))
    bits = (raw.join(want, (F.col("file") == F.col("pf")) & (F.col("split") == F.col("ps")) & (F.col("mid") == F.col("want")))
            .select("file", "record", "at", "piece", "head_n", "length"))
    whole = (bits.groupBy("file", "record")
             .agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("bs"),
                  F.min(F.when(F.col("at") == F.col("record"), F.col("head_n"))).alias("skip"),
                  F.min(F.when(F.col("at") == F.col("record"), F.col("length"))).alias("len")))
    joined = F.aggregate(F.col("bs"), F.unhex(F.lit("")), lambda acc, b: F.when(F.octet_length(acc) == 0, b["piece"])
                         .otherwise(F.concat(acc, F.encode(F.lit(MAGIC), "UTF-8"), b["piece"])))
    body = joined.substr(F.col("skip").cast("int") + 1, F.col("len").cast("int"))
    whole = whole.select(F.col("file").alias("wf"), F.col("record").alias("wr"), base32(F.sha1(body)).alias("digest"))
    several = (heads.where("NOT whole").select(*named)
               .join(whole, (F.col("file") == F.col("wf")) & (F.col("at") == F.col("wr"))).select(*named, "digest"))
    return one.unionByName(several)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    r = read(spark, path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:([0-9-]*)>$", 1)
    revisit = F.col("type") == "revisit"
    return r.select(
        number("record_id").try_cast("long").alias("page_id"),
        F.when(revisit, F.col("said_length").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("said_digest", "^sha1:", "")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, number("refers").cast("long")).alias("refers_to"))


_SQL_DIGIT = "substr('" + _BASE32 + "', (CAST(CAST('0x' || substr(p.x, {at}, 5) AS BIGINT) // {div} AS BIGINT) % 32) + 1, 1)"
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
w AS (SELECT x, max(page_id) AS m FROM p GROUP BY x)
SELECT p.page_id, octet_length(encode(p.h)) AS payload_bytes,
       {" || ".join(_SQL_DIGIT.format(at=i // 4 * 5 + 1, div=32 ** (3 - i % 4)) for i in range(32))} AS payload_digest,
       CASE WHEN p.page_id IS DISTINCT FROM w.m AND w.m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM w.m THEN w.m END AS refers_to
FROM p JOIN w USING (x)
"""
