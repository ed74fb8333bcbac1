"""WARC archives: writing, reading, and resolving revisits of equal payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salts, scratch

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "content_key string, refers_to long, date string, payload binary"
)


def sha1_base32(data: Column) -> Column:
    """Base-32 SHA-1: each 5 hexadecimal digits are 4 digits of base 32, spelt with RFC 4648's letters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def now() -> Column:
    """The time of the query, as WARC dates are written."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fresh_id(*of: Column) -> Column:
    """A record id made from a hash, so that a task that runs again makes the same one."""
    h = F.md5(F.concat_ws("\n", *of))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def archive_number(length: Column, archive_bytes: int) -> Column:
    """Number of a record's archive within its task: which stretch of ``archive_bytes`` bytes it starts in.

    Only lengths go to Python, where a sum runs on from batch to batch of a task.
    """

    @F.pandas_udf("int")
    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        before = 0
        for b in batches:
            ends = before + b.cumsum()
            yield ((ends - b) // archive_bytes).astype("int32")
            before = int(ends.iloc[-1]) if len(ends) else before

    return number.asNondeterministic()(length)


def write(records: DataFrame, path: str, archive_bytes: int = 32 << 20, level: str = "FIVE") -> None:
    """Write records as gzipped WARC 1.1.

    ``records`` has record_id, date, page_id, url, record_type, payload_bytes, payload_digest, payload, and for
    revisits refers_to, refers_id, refers_uri, refers_date, null elsewhere. Null urls are left out, line ends in them
    are escaped; null payloads are empty. An empty table gives an empty folder.

    A record is a row of Spark's text writer, whose line end is the empty line that closes a WARC record; so tasks
    commit their archives as they do for any table, to any file system that Spark reaches. ``payload`` is a string
    or null (a revisit has none). A task cuts its archives by running bytes: each holds ``archive_bytes`` before
    compression and the rest of its last record, so at most twice that unless a record is longer. ``level`` is
    zlib's: FIVE takes 60 % of the default's time for 2 % more bytes of web pages. Columns beyond these are not looked at.
    """
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]+", "%0A")
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    payload = F.coalesce(F.col("payload"), F.lit(""))
    length = F.octet_length(payload).cast("long") + F.lit(len(HTTP))
    value = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.col("date")),
        optional("WARC-Target-URI", one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        optional("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(PROFILE))),
        optional("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_id"), F.lit(">"))),
        optional("WARC-Refers-To-Target-URI", one_line(F.col("refers_uri"))),
        optional("WARC-Refers-To-Date", F.col("refers_date")),
        optional("X-Refers-To-Page", F.col("refers_to").cast("string")),
        optional("X-Page", F.col("page_id").cast("string")),
        line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), length.cast("string"), F.lit(END), F.lit(HTTP), payload,
    )
    texts = records.select(value.alias("value"))
    cut = texts.withColumn("archive", archive_number(F.octet_length("value").cast("long") + F.lit(len(END)), archive_bytes))
    # A task's archives come one after another: a few open files spare it a sort of its records, which would spill them.
    spark, setting = records.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "64")
    try:
        cut.write.partitionBy("archive").option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", level).text(path)
    finally:
        spark.conf.set(setting, before)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record; lengths come from Content-Length, so a block may hold anything.

    An archive is unpacked as it is read, whether it is one gzip member or one a record, so a record at a time is in memory.
    """
    file = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        file = io.BufferedReader(gzip.GzipFile(fileobj=file), 1 << 16)
    while top := file.readline():
        if not top.startswith(b"WARC/1."):
            continue
        headers = {}
        while (line := file.readline()).strip():
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                headers[name.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        block = file.read(n)
        if len(block) < n or not line:
            raise ValueError("a WARC record is cut short")
        yield headers, block


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of a folder of archives, gzipped or not, as columns of ``RECORD``.

    Payload length and SHA-1 are those of the payload that was read, for a revisit those that its header states; ``content_key`` is the
    payload's SHA-256. Without ``payloads`` the payload is null. An archive is one row of a task, unpacked record by
    record, so archives should be of some ten MB, as ``write`` makes them; a payload of any length is read whole. An
    empty folder gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("content_key", pa.string()), ("refers_to", pa.int64()), ("date", pa.string()), ("payload", pa.binary())])
        number = lambda h, name: int(h[name]) if name in h else None
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for h, block in _records(content.as_py()):
                    kind = h.get("warc-type")
                    cut = re.match(rb"HTTP/[^\r\n]*\r\n(?:[^\r\n]+\r\n)*\r\n", block) if "http" in h.get("content-type", "") else None
                    payload = block[cut.end() :] if cut else block
                    digest, n, key = h.get("warc-payload-digest", "").removeprefix("sha1:"), number(h, "x-payload-bytes"), None
                    if kind != "revisit":
                        digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        key = hashlib.sha256(payload).hexdigest()
                    rows.append((h.get("warc-record-id", "").strip("<>"), number(h, "x-page"), h.get("warc-target-uri"), kind, n, digest, key, number(h, "x-refers-to-page"), h.get("warc-date"), payload if payloads and kind != "revisit" else None))
                    size += len(payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def archived(pages: DataFrame, archive_bytes: int = 32 << 20) -> str:
    """Write every row of ``pages`` (page_id, url, html) as a response record; the folder.

    Null html is an empty payload, html of any length is one record. Rows that repeat get records of their own, an
    empty table gives an empty folder, and other columns are not looked at, whatever they are called.
    """
    path = scratch(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html"), F.lit(""))
    # The place in the table tells rows apart that repeat.
    nth = F.monotonically_increasing_id().cast("string")
    write(
        pages.select(
            fresh_id(F.lit(path), F.col("page_id").cast("string"), nth).alias("record_id"), now().alias("date"),
            F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.lit("response").alias("record_type"),
            F.octet_length(payload).cast("long").alias("payload_bytes"), sha1_base32(payload).alias("payload_digest"),
            F.lit(None).cast("long").alias("refers_to"), payload.alias("payload"),
            *[F.lit(None).cast("string").alias(c) for c in ("refers_id", "refers_uri", "refers_date")],
        ),
        path, archive_bytes,
    )
    return path


def resolved(spark: SparkSession, path: str, least_bytes: int = 0, archive_bytes: int = 32 << 20) -> str:
    """Write the archives of ``path`` anew without repeated payloads; the new folder.

    Of records with one payload of at least ``least_bytes`` bytes, the one with the largest page id stays a
    response, the others become revisits that refer to it; records of one page id are told apart by record id. All
    records get fresh headers: a new record id, a new date, and revisits their original's id, address and date as
    the new archives have them. Only headers are shuffled by payload digest, with counts combined before the shuffle;
    the records of one payload are looked up by salts, so a payload that a third of all pages have is spread.
    Payloads travel once, by record id, to the tasks that write them.

    Empty payloads are payloads like others, null page ids are the smallest, and an empty folder gives an empty one.
    """
    found = read(spark, path)
    to = scratch(spark, "warc")
    new_id = fresh_id(F.lit(to), F.col("record_id"))
    heads = read(spark, path, payloads=False).where(F.col("payload_bytes") >= least_bytes)
    salt = F.pmod(F.xxhash64("record_id"), F.lit(salts(spark))).cast("int").alias("salt")
    heads = heads.select("record_id", "page_id", "url", F.unhex("content_key").alias("key"), salt)
    by_salt = heads.groupBy("key", "salt").agg(F.max(F.struct("page_id", "record_id", "url")).alias("o"), F.count("*").alias("n"))
    first = by_salt.groupBy("key").agg(F.max("o").alias("o"), F.sum("n").alias("n")).where("n > 1")
    of = by_salt.select("key", "salt").join(first, "key").select("key", "salt", F.col("o.page_id").alias("refers_to"), F.col("o.record_id").alias("origin"), F.col("o.url").alias("refers_uri"))
    revisits = heads.select("record_id", "key", "salt").join(of, ["key", "salt"]).where("record_id <> origin").select("record_id", "refers_to", "origin", "refers_uri")
    x = found.drop("refers_to").join(revisits, "record_id", "left").withColumn("date", now())
    again = F.col("origin").isNotNull()
    x = x.withColumns(
        {
            "record_type": F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
            "payload": F.when(~again, F.col("payload").cast("string")),
            "refers_id": F.when(again, fresh_id(F.lit(to), F.col("origin"))),
            "refers_date": F.when(again, F.col("date")),
            "record_id": new_id,
        }
    )
    write(x, to, archive_bytes)
    return to
