"""Web archives as a chunked record table.

Writing: a payload is cut into pieces, and every piece becomes a record of its own: the first a ``response``, the
others its ``continuation`` segments, as the WARC format has it. The rows (record identifier, chunk number, piece)
are written by Spark as compressed text whose line separator ends the records, so no task ever holds more than a
piece. Of records with equal payloads one is stored, the others are ``revisit`` records that refer to it.
Reading: a compressed archive is one split, so its lines come in order. They are parsed one by one; each segment
gives a row with the record's identifier, the chunk's number, and the length and digest of the payload so far.
The digest is fed line by line, so a record is never put together in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch, stored

#: Characters of a payload in one record.
CHUNK = 1 << 18
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"
CHUNKS = "file string, page_id long, chunk_no int, record_type string, refers_to long, stated_digest string, chunk_bytes long, payload_bytes long, payload_digest string, last boolean"


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK, least: int = REVISIT_BYTES) -> DataFrame:
    """``id``, ``url``, ``digest``, ``refers_to``, ``bytes``, ``chunks``, ``chunk_no``, ``piece`` for each piece of each page."""
    body = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    # only digests meet by payload (and the tables are written before they do, so Spark can split a hot digest); payloads meet by identifier
    large = stored(rows.where(F.col("bytes") >= least).select("id", "digest"), "digests")
    first = stored(large.groupBy("digest").agg(F.max("id").alias("stored_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "stored_id"), "first")
    again = stored(large.join(first, "digest").where("id <> stored_id").select("id", "digest", F.col("stored_id").alias("refers_to")).distinct(), "revisits")
    told = rows.join(again, ["id", "digest"], "left")
    kept = F.when(F.col("refers_to").isNull(), F.col("body")).otherwise(F.lit(""))
    cut = told.withColumn("body", kept).withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.length("body") / chunk)).cast("int"))
    pieces = F.expr(f"transform(sequence(0, chunks - 1), i -> substring(body, i * {chunk} + 1, {chunk}))")
    return cut.select("id", "url", "digest", "refers_to", "bytes", "chunks", F.posexplode(pieces).alias("chunk_no", "piece"))


def write_archives(chunks: DataFrame, path: str) -> None:
    """Write the rows of ``chunk_table`` as archives; the pieces of a page stay in one file, in order."""
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))
    first, revisit = F.col("chunk_no") == 0, F.col("refers_to").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(f"{END}{END}"))
    block = F.when(first, F.concat(head, F.col("piece"))).otherwise(F.col("piece"))

    def line(field: str, value, when=None):
        text = F.concat(F.lit(f"{field}: "), value, F.lit(END))
        return text if when is None else F.when(when, text).otherwise(F.lit(""))

    record = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(first, name).otherwise(F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("#"), F.col("chunk_no").cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"\s", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")), first & revisit),
        line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"), F.col("chunks") > 1),
        line("WARC-Segment-Origin-ID", name, ~first),
        line("WARC-Segment-Total-Length", (F.col("bytes") + F.octet_length(head)).cast("string"), (F.col("chunks") > 1) & (F.col("chunk_no") == F.col("chunks") - 1)),
        line("Content-Type", F.when(first, F.lit("application/http; msgtype=response")).otherwise(F.lit("application/octet-stream"))),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END), block, F.lit(END),
    )
    chunks.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class _Reader:
    """Takes the lines of an archive in order; tells of each segment."""

    def __init__(self):
        self.state, self.fields, self.out = "gap", {}, []
        self.origin, self.digest, self.total = None, None, 0

    def line(self, text: bytes) -> None:
        if self.state == "gap":
            if text:
                self.state, self.fields = "fields", {}
        elif self.state == "fields":
            if text:
                name, _, value = text.partition(b":")
                self.fields[name.decode().lower()] = value.strip().decode()
            else:
                self._begin()
        elif self.state == "block":
            self._take(text)

    def _begin(self) -> None:
        f = self.fields
        self.left, self.taken, self.joined, self.state = int(f["content-length"]), 0, False, "block"
        if f["warc-type"] == "continuation":
            self.part, self.chunk = "payload", int(f["warc-segment-number"]) - 1
        else:
            self.part, self.chunk, self.origin, self.digest, self.total = "header", 0, f, hashlib.sha1(), 0

    def _take(self, text: bytes) -> None:
        if self.joined:
            self.left -= len(END)
            if self.part == "payload":
                self._payload(END.encode())
        self.joined = True
        self.left -= len(text)
        if self.part == "header":  # the protocol's own header ends with an empty line
            self.part = "header" if text else "start"
        else:
            self._payload(text)
            self.part = "payload"
        if self.left == 0:
            self._end()

    def _payload(self, data: bytes) -> None:
        self.digest.update(data)
        self.taken += len(data)
        self.total += len(data)

    def _end(self) -> None:
        self.state = "gap"
        f, last = self.origin, "warc-segment-number" not in self.fields or "warc-segment-total-length" in self.fields
        self.out.append((_number(f["warc-record-id"]), self.chunk, f["warc-type"], _number(f.get("warc-refers-to", "")), f.get("warc-payload-digest", "").removeprefix("sha1:"), self.taken, self.total, self.digest.hexdigest(), last))


def _number(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    file, reader = None, _Reader()
    for batch in batches:
        out = []
        for name, value in zip(batch.column("file").to_pylist(), batch.column("value").cast(pa.binary()), strict=True):
            if name != file:
                file, reader = name, _Reader()
            reader.line(value.as_py())
            if reader.out:
                out += [(file, *x) for x in reader.out]
                reader.out.clear()
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each segment in the archives below ``path`` (columns ``CHUNKS``); digests run over the payload so far."""
    lines = spark.read.option("lineSep", END).text(path).select(F.input_file_name().alias("file"), "value")
    return lines.mapInArrow(_parse, CHUNKS)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK, least: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives, read them back, and tell of each record.

    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``chunks``. A null payload is empty, a
    null identifier or address is left out of its record, repeated rows are repeated records (the largest
    identifier's rows are all responses), an empty table gives an empty result, other columns play no part.
    """
    spark = pages.sparkSession
    path = scratch(spark, "archives")
    write_archives(chunk_table(pages, id_col, url_col, payload_col, chunk, least), path)
    records = stored(read_chunks(spark, path).where("last"), "records")
    whole = records.where("record_type = 'response'")
    seen = whole.dropDuplicates(["page_id"]).select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    again = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(seen, "refers_to", "left")
    columns = [F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("chunk_no") + 1).alias("chunks")]
    return whole.select(*columns).unionByName(again.withColumn("payload_bytes", F.col("b")).withColumn("payload_digest", F.col("d")).select(*columns))
