"""A content-addressed web archive: payloads once by digest, record headers apart, joins to restore."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism.llm.common import read, shared_folder, written

# Fixed values of the archive format and of the base-32 digits.
CRLF = "\r\n"
END = "\r\n\r\n"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"
MIN_BYTES = 0
FILE_RECORDS = 5000


def base32_sha1(payload: Column) -> Column:
    """The 160 bits as eight groups of five hex digits, each written as four base-32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), _DIGITS, _BASE32)


def payload_bytes(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def record_headers(pages: DataFrame, min_bytes: int = MIN_BYTES, date: str = DATE) -> DataFrame:
    """(page_id, record_type, refers_to, sha256, header) of every page; payloads are not shuffled.

    Pages meet by the SHA-256 of their payload; the smallest page_id of a payload is its
    response, and rows of that id with that payload are all responses. A null page_id is the
    response only where no other id has the payload.
    """
    payload = payload_bytes(F.col("html"))
    thin = pages.select(
        "page_id", "url", F.sha2(payload, 256).alias("sha256"), base32_sha1(payload).alias("sha1"),
        F.octet_length(payload).alias("length"),
    )
    # Written, so that both sides of the join are plain rows and a hot payload can be split.
    shared = written(
        thin.groupBy(F.col("sha256").alias("key")).agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
        .filter("rows > 1").select("key", "first"),
        "shared",
    )
    joined = thin.join(shared, thin.sha256 == shared.key, "left")
    response = F.col("key").isNull() | F.col("page_id").eqNullSafe(F.col("first")) | (F.col("length") < min_bytes)
    kind = F.when(response, "response").otherwise("revisit")
    refers = F.when(~response, F.col("first"))

    def record_id(page):
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))

    def line(name, value):
        return F.concat(F.lit(f"{CRLF}{name}: "), value)

    header = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, F.lit("")).otherwise(line("WARC-Refers-To", record_id(refers))),
        F.when(response, F.lit("")).otherwise(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        ),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("X-Payload-SHA256", F.col("sha256")),
        line("Content-Length", F.when(response, F.col("length")).otherwise(0).cast("string")),
    )
    return joined.select(
        "page_id", kind.alias("record_type"), refers.alias("refers_to"), "sha256", header.alias("header")
    )


def write_archive(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Archives under ``folder``: ``records`` holds each payload once, ``headers`` every record's header.

    ``records`` are compressed archive files of response records, one for each distinct payload
    (the response of the smallest page_id). ``headers`` has a row for each page. Both are
    written by Spark's committers, so a lost executor leaves no half file behind.
    """
    spark = pages.sparkSession
    record_headers(pages, min_bytes, date).write.parquet(f"{folder}/headers")
    headers = spark.read.parquet(f"{folder}/headers").filter("record_type = 'response'").select(
        F.col("page_id").alias("id"), F.col("sha256").alias("key"), "header"
    )
    owner = F.struct(F.col("id").isNull().alias("none"), "id", "header")  # ids before null
    owners = headers.groupBy("key").agg(F.min(owner).alias("o")).select("key", "o.id", "o.header")
    held = pages.select("page_id", "html", F.sha2(payload_bytes(F.col("html")), 256).alias("sha256"))
    stored = held.join(owners, held.page_id.eqNullSafe(owners.id) & (held.sha256 == owners.key))
    repeated = pages.groupBy("page_id").count().filter("count > 1")
    if not repeated.isEmpty():
        stored = stored.dropDuplicates(["sha256"])
    record = F.concat("header", F.lit(END), F.coalesce("html", F.lit("")))
    stored.select(record).write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(f"{folder}/records")


def _records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, payload) of each record; a payload is as long as its header says."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        header = data[at:cut]
        length = int(header.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
        end = cut + 4 + length
        yield header, data[cut + 4 : end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at = end + 4


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, payload) read back from the archive files and verified against the digest in the header."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = zlib.decompress(content.as_py(), wbits=31)
                keys, payloads = [], []
                for header, payload in _records(data):
                    keys.append(header.rsplit(b"\r\nX-Payload-SHA256: ", 1)[1].split(b"\r\n")[0].decode())
                    payloads.append(payload)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(payloads, pa.binary())], ["sha256", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{folder}/records")
    found = files.select("content").mapInArrow(run, "sha256 string, payload binary")
    real = F.sha2("payload", 256)
    checked = F.when(real == F.col("sha256"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest "), "sha256"))
    )
    return found.select("sha256", checked.alias("payload"))


def restore(spark: SparkSession, folder: str, of_payload: dict[str, Column] | None = None) -> DataFrame:
    """The original records: every header joined to its payload by digest.

    ``of_payload`` gives columns computed once from each stored payload, in place of the payload.
    Headers of one digest may be many; their side of the join is split when skewed.
    """
    payloads = read_payloads(spark, folder).withColumnRenamed("sha256", "key")
    if of_payload is not None:
        payloads = payloads.select("key", *[c.alias(n) for n, c in of_payload.items()])
    headers = spark.read.parquet(f"{folder}/headers")
    return headers.join(payloads, headers.sha256 == payloads.key, "left").drop("key")


def op6_warc(spark, sf_dir):
    folder = shared_folder(spark, "warc")
    write_archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    payload = F.col("payload")
    facts = {"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": base32_sha1(payload)}
    kind = F.regexp_extract("header", r"WARC-Type: (\w+)", 1)
    refers = F.regexp_extract("header", r"WARC-Refers-To: <urn:page:(-?\d+)>", 1)
    return restore(spark, folder, facts).select(
        "page_id", "payload_bytes", "payload_digest", kind.alias("record_type"),
        F.when(kind == "revisit", refers.cast("long")).alias("refers_to"),
    )
