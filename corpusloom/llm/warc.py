"""WARC archives: writing with revisit records, and reading back by boundary-chain verification.

Archives are plain WARC/1.1 written by Spark's text writer, whose line separator is the CRLF CRLF that ends a record. They
are read by Spark's text reader with the record magic as separator, so any task can read any part of an archive: each
piece is a candidate record, and the running sum of the pieces' bytes gives its offset. A candidate names its successor
(offset + header + Content-Length + trailer). Pointer jumping from offset 0 keeps the candidates on the chain; magic that
occurs inside a payload is not on it, and its pieces go back to the record that holds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import Scratch

MAGIC = "WARC/1.1\r\n"
TRAILER = "\r\n\r\n"
RECORDS_PER_FILE = 2_000
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(content: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of 20 bits, four letters each."""
    digest = F.sha1(content)
    letters = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(B32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write(pages: DataFrame, to: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = None, least_bytes: int = LEAST_BYTES) -> None:
    """Writes a record per row below ``to``, dated with the time of writing; its target is that of ``uri_col``, where null or not given a urn of its id.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest id becomes a response and the others
    become revisit records, which name it and carry the payload's digest and length but not the payload. A null payload
    is empty. A null id counts as the smallest, and its record has a random one; rows that tie for the largest are all responses. Blanks and
    control characters in a target are written as %20.
    """
    content = F.coalesce(F.col(payload_col), F.lit(""))
    urn = F.coalesce(F.concat(F.lit("urn:page:"), F.col(id_col).cast("long").cast("string")), F.concat(F.lit("urn:uuid:"), F.expr("uuid()")))
    uri = F.regexp_replace(F.col(uri_col).cast("string"), "[\\x00-\\x20\\x7F]", "%20") if uri_col else F.lit(None)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), content.alias("payload"), urn.alias("urn"), uri.alias("uri"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload").cast("binary")).alias("digest"))
    same = rows.filter(F.col("bytes") >= least_bytes).select("id", "digest").groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # only repeated payloads; a table of its own, so that the join below can split a hot payload over tasks
    same = Scratch(pages.sparkSession, "repeats").keep(same.filter("n > 1 and first is not null").select(F.col("digest").alias("d"), "first"), "first")
    rows = rows.join(same, F.col("digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    eol = F.lit("\r\n")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, eol)
    head = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", F.concat(F.lit("<"), F.col("urn"), F.lit(">"))),
        field("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        field("WARC-Target-URI", F.coalesce("uri", "urn")),
        F.when(revisit, field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("Content-Type", F.lit("text/html")),
        field("WARC-Payload-Length", F.col("bytes").cast("string")),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        eol,
    )
    record = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    rows.select(record.alias("value")).write.option("lineSep", TRAILER).option("maxRecordsPerFile", RECORDS_PER_FILE).text(to)


def _field(head: Column, name: str, value: str) -> Column:
    got = F.regexp_extract(head, f"(?m)^{name}: {value}\\r?$", 1)
    return F.when(got != "", got)


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole files, sorted by file and offset, get ``owner``: the offset of the record on the chain that holds them.

    Only offsets are held, of one file at a time.
    """
    held: list[pa.RecordBatch] = []

    def close(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        start, after = (whole.column(whole.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("start", "after"))
        n = len(start)
        to = np.searchsorted(start, after)
        lands = (to < n) & (start[np.minimum(to, n - 1)] == after) & (after > start)
        jump = np.append(np.where(lands, to, n), n)  # n: the chain's end
        on = np.zeros(n + 1, dtype=bool)
        on[0] = start[0] == 0
        while True:  # after k rounds all of the first 2**k records of the chain are marked
            more = on.copy()
            more[jump[on]] = True
            if (more == on).all():
                break
            on, jump = more, jump[jump]
        last = np.maximum.accumulate(np.where(on[:n], np.arange(n), -1))
        owner = np.where(last >= 0, start[np.maximum(last, 0)], -1)
        return whole.append_column("owner", pa.array(owner, pa.int64()))

    for batch in batches:
        files = batch.column(batch.schema.get_field_index("file"))
        while batch.num_rows:
            names = files.to_numpy(zero_copy_only=False)
            if held and held[0].column(held[0].schema.get_field_index("file"))[0].as_py() != names[0]:
                yield close(held)
                held = []
            n = int(np.argmax(names != names[0])) or len(names)
            held.append(batch.slice(0, n))
            batch = batch.slice(n)
            files = batch.column(batch.schema.get_field_index("file"))
    if held:
        yield close(held)


def read(spark: SparkSession, at: str) -> DataFrame:
    """Records of the archives below ``at``: ``page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset``.

    Bytes and digest are of the payload as read back; those of a revisit record are its response's, and null if no response of the id that
    it names has the digest and length that its header states. Magic inside a payload starts no record. An archive without records gives no rows.
    """
    pieces = spark.read.option("lineSep", MAGIC).text(at).select("value", "_metadata.file_path", "_metadata.file_block_start")
    # the pieces of a task come in the order of the file; their running bytes in it give each one's place
    pieces = pieces.withColumn("ord", F.monotonically_increasing_id())
    head = F.substring_index("value", TRAILER, 1)
    body_at = F.octet_length(head) + len(TRAILER)
    length = F.col("length")
    rows = pieces.select("*", head.alias("head"), F.octet_length("value").cast("long").alias("n")).withColumn("length", F.try_to_number(_field(F.col("head"), "Content-Length", "(\\d{1,18})"), F.lit("9" * 18)).cast("long"))
    body = F.substring(F.col("value").cast("binary"), body_at + 1, length.cast("int"))
    whole = F.col("n") >= body_at + length
    rows = rows.select(
        F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), "ord", "n", length, body_at.cast("long").alias("body_at"),
        F.when(whole, base32_sha1(body)).alias("digest"), whole.alias("whole"),
        _field(F.col("head"), "WARC-Type", "(\\w+)").alias("type"),
        _field(F.col("head"), "WARC-Record-ID", "<urn:page:(-?\\d+)>").cast("long").alias("id"),
        _field(F.col("head"), "WARC-Refers-To", "<urn:page:(-?\\d+)>").cast("long").alias("refers_to"),
        _field(F.col("head"), "WARC-Payload-Digest", "sha1:(\\w+)").alias("named_digest"),
        _field(F.col("head"), "WARC-Payload-Length", "(\\d+)").cast("long").alias("named_bytes"),
    )
    # a piece with no separator before it is the first of its file; all others begin after one
    order = Window.partitionBy("file").orderBy("block", "ord")
    # the window leaves whole files in a task, sorted as chain() needs them
    rows = rows.withColumn("offset", F.sum(F.col("n") + len(MAGIC)).over(order) - F.col("n") - 2 * len(MAGIC)).filter("offset >= 0")
    rows = rows.withColumnRenamed("offset", "start").withColumn("after", F.coalesce(F.col("start") + len(MAGIC) + F.col("body_at") + F.col("length") + len(TRAILER), F.lit(-1)))
    schema = rows.drop("block", "ord").schema.simpleString()[7:-1].replace(":", " ")
    rows = rows.drop("block", "ord").mapInArrow(chain, f"{schema}, owner long")
    rows = Scratch(spark, "chain").keep(rows, "chain")

    records = rows.filter("start = owner")
    split = records.filter("not whole")
    digest, found = F.col("digest"), F.col("length")
    if not split.isEmpty():  # payloads with magic inside: read those archives' pieces again and put them together
        spans = rows.join(split.select("file", "owner"), ["file", "owner"], "left_semi").select("file", "start", "owner")
        n = Window.partitionBy("file_path").orderBy("file_block_start", "ord")
        again = pieces.join(spans.select(F.col("file").alias("file_path")).distinct(), "file_path", "left_semi")
        again = again.withColumn("start", F.sum(F.octet_length("value") + len(MAGIC)).over(n) - F.octet_length("value") - 2 * len(MAGIC))
        parts = again.select(F.col("file_path").alias("file"), "start", "value").join(spans, ["file", "start"])
        joined = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
        joined = joined.select("file", "owner", F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value"))
        joined = joined.join(split.select("file", "owner", "body_at", "length"), ["file", "owner"])
        body = F.substring(F.col("value").cast("binary"), F.col("body_at").cast("int") + 1, F.col("length").cast("int"))
        joined = joined.select("file", "owner", base32_sha1(body).alias("joined_digest"), F.length(body).cast("long").alias("joined_bytes"))
        records = records.join(joined, ["file", "owner"], "left")
        digest, found = F.coalesce("digest", "joined_digest"), F.coalesce("joined_bytes", "length")
    revisit = F.col("type") == "revisit"
    found = records.select("id", "type", "refers_to", "file", F.col("start").alias("offset"), found.alias("bytes"), digest.alias("digest"), "named_bytes", "named_digest")
    found = Scratch(spark, "records").keep(found, "records")
    responses = found.filter(~revisit).select(F.col("id").alias("to"), F.col("bytes").alias("to_bytes"), F.col("digest").alias("to_digest")).distinct()
    same = revisit & (F.col("refers_to") == F.col("to")) & (F.col("named_bytes") == F.col("to_bytes")) & (F.col("named_digest") == F.col("to_digest"))
    return found.join(responses, same, "left").select(
        F.col("id").alias("page_id"),
        F.when(revisit, F.col("to_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("to_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
        "file",
        "offset",
    )
