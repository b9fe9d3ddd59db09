"""WARC archives in which a payload is stored once.

`records` decides types: headers (id, digest, length), never payloads, are shuffled by payload digest; of equal payloads of at
least `MIN_BYTES` the record with the smallest id is the response, the others are revisits of it. `write` writes archives with
fresh headers, `read` parses archives, `resolved` joins revisit records to the responses they refer to.

Archives are plain WARC/1.1 files written by Spark's own writer with its commit protocol: a record is one row, the separator is
the two line ends that close a record. Files hold a bounded number of records.

Defined cases: a null payload is empty. Payloads under `MIN_BYTES` are always stored. A group of equal payloads without any id
has no revisits; rows without an id in other groups are revisits. Rows that repeat the smallest id of a group are all
responses. Null addresses give no target header; control characters in addresses are percent-encoded, so none can end a
header. An empty table gives no archives, and `read` an empty table. Further input columns are not archived.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunloom.llm.common import output_schema, staged

MIN_BYTES = 100
RECORDS_PER_FILE = 2_000
#: Bytes of the table of original records up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
END = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_RECORD = ("record_id string, type string, page_id bigint, target_uri string, date string, payload_digest string, refers_to string, "
           "payload binary")


def record_id(page: Column) -> Column:
    """A stable name for the record of a page."""
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page.cast("string"), F.lit("without id"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Per page: page_id, url, payload (text), payload_digest, and original: the id it revisits, null for a response."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("payload_digest"))
    heads = rows.where(F.octet_length("payload") >= MIN_BYTES).select("page_id", "payload_digest")
    first = heads.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = staged(first.where("n > 1 AND first IS NOT NULL").select("payload_digest", "first"), folder, "originals")
    few = first.count() * 80 <= BROADCAST_BYTES
    found = rows.join(F.broadcast(first) if few else first, "payload_digest", "left")
    return found.select("page_id", "url", "payload", "payload_digest",
                        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("original"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _address(url: Column) -> Column:
    for code in (*range(32), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def write(found: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of `records` under `folder`."""
    revisit = F.col("original").isNotNull()
    body = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.col("payload")))
    plain = F.col("url").rlike(r"[\x00-\x1f\x7f]")
    head = F.concat(
        F.lit("WARC/1.1" + END), _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", record_id(F.col("page_id"))), _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.when(plain, _address(F.col("url"))).otherwise(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _field("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _field("WARC-Refers-To", F.when(revisit, record_id(F.col("original")))), _field("X-Page-ID", F.col("page_id").cast("string")),
        _field("Content-Type", F.lit("application/http; msgtype=response")), _field("Content-Length", F.octet_length(body).cast("string")), F.lit(END))
    found.select(F.concat(head, body).alias("value")).write.option("lineSep", END + END).option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def parse(content: bytes) -> Iterator[dict]:
    """Records of an archive, by their stated lengths."""
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:stop].decode().split(END)
        if not version.startswith("WARC/"):
            raise ValueError("this is no WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = stop + 4
        at = start + int(fields["content-length"]) + 4
        body = content[start:at - 4]
        page = fields.get("x-page-id")
        yield {"record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "page_id": int(page) if page else None,
               "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
               "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"), "refers_to": fields.get("warc-refers-to"),
               "payload": body[body.index(b"\r\n\r\n") + 4:] if b"\r\n\r\n" in body else body}


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives under `folder`; revisits have an empty payload."""
    schema = T._parse_datatype_string(_RECORD)
    arrow = output_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                found = list(parse(content))
                for at in range(0, len(found), 200):
                    yield pa.RecordBatch.from_pylist(found[at:at + 200], schema=arrow)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type and refers_to (the page id of the response).

    Lengths and digests of responses are taken from their payloads; revisits get those of the response they refer to, found by
    its record id. Only headers are joined.
    """
    heads = found.select("record_id", "page_id", F.col("type").alias("record_type"), "refers_to",
                         F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))
    kept = heads.where("record_type = 'response'").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
                                                          F.lit(None).cast("bigint").alias("refers_to"))
    wanted = heads.where("record_type = 'revisit'").select("page_id", "record_type", F.col("refers_to").alias("record_id"))
    # rows that repeat an id and a payload are one original
    originals = heads.where("record_type = 'response'").groupBy("record_id").agg(
        F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes"), F.min("digest").alias("payload_digest"))
    return kept.unionByName(wanted.join(originals, "record_id", "left").drop("record_id"))
