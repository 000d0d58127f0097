"""WARC archives written and read by Spark, with payloads as a chunked record table.

Writing: every row becomes one WARC/1.1 record of a gzip file that Spark's text writer
commits, so a lost executor only repeats its own files. Equal payloads of at least
`dedup_bytes` are stored once, in the record with the smallest id; the others are revisit
records that name it. Copies are found by digests and ids; only rows that a filter of fixed
size takes for copies are then moved, all others are written where they were read. Record
ids hold the row's id and the beginning of the payload's digest, so that rows of one id, or
of none, have records of their own unless they are equal. Reading: a file's lines come back in order (gzip files are never
split); a small state machine turns them into rows (record, chunk number, bytes), each with
the digest of the payload so far. No payload is ever put together: memory holds one chunk,
or one line where a line is longer.

Defined cases: a null payload is empty; rows with a null id keep a record of their own and
are never referred to; repeated rows of the smallest id are all responses; an empty table
gives archives without records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm.common import fresh_path, pick, stored
from storepulse.llm.ngram_join import id_filter

CRLF = "\r\n"
CHUNKS = (
    "file string, record_no long, record_id string, record_type string, target_uri string, refers_to string, "
    "stated_digest string, stated_bytes long, chunk_no long, chunk_start long, chunk binary, digest_so_far string, is_last boolean"
)
CHUNK_FIELDS = pa.schema([
    ("file", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
    ("target_uri", pa.string()), ("refers_to", pa.string()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()),
    ("chunk_no", pa.int64()), ("chunk_start", pa.int64()), ("chunk", pa.binary()), ("digest_so_far", pa.string()),
    ("is_last", pa.bool_()),
])


@dataclass(frozen=True)
class WarcOptions:
    dedup_bytes: int = 100
    chunk_bytes: int = 1 << 20
    prefix: str = "urn:page:"


def plan_records(rows: DataFrame, key: str, uri: str, payload: str, options: WarcOptions = WarcOptions()) -> DataFrame:
    """(key, uri, body, digest, bytes, first): `first` is the id a revisit refers to, else NULL.

    Only digests and ids are shuffled to find the first of equal payloads, combined on the
    map side. Rows whose digest is not among those of copies, which a bounded filter tells
    with few mistakes, stay where they were read; the exact join decides for the others.
    """
    base = pick(rows, key, uri, payload)
    body = F.coalesce(payload, F.lit(""))
    sized = base.select(
        F.col(key).alias("key"), F.col(uri).alias("uri"), body.alias("body"),
        F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"),
    )
    firsts = (
        sized.filter(F.col("bytes") >= options.dedup_bytes).groupBy("digest", "bytes")
        .agg(F.min("key").alias("smallest"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
        .select("digest", "bytes", "smallest")
    )
    firsts = stored(firsts, "warc-copies")
    maybe = id_filter(firsts.select(F.xxhash64("digest").alias("id")))(F.xxhash64("digest"))
    marked = sized.withColumn("maybe", maybe)
    refers = F.when(~F.col("key").eqNullSafe(F.col("smallest")), F.col("smallest"))
    columns = ("key", "uri", "body", "digest", "bytes")
    alone = marked.filter("not maybe").select(*columns, F.lit(None).cast(sized.schema["key"].dataType).alias("first"))
    return alone.union(marked.filter("maybe").join(firsts, ["digest", "bytes"], "left").select(*columns, refers.alias("first")))


def record_text(options: WarcOptions) -> Column:
    """One record without its very last line feed, which the text writer adds."""
    revisit = F.col("first").isNotNull()
    short = F.substring("digest", 1, 16)
    ident = lambda c: F.concat(
        F.lit(f"<{options.prefix}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(":"), short, F.lit(">"))
    # A line break inside a URL would end its header early.
    clean_uri = F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]", "")
    size = F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(CRLF),
        F.lit("WARC-Record-ID: "), ident(F.col("key")), F.lit(CRLF),
        F.lit("WARC-Date: "), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(CRLF),
        F.lit("WARC-Target-URI: "), clean_uri, F.lit(CRLF),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(CRLF),
        F.when(revisit, F.concat(
            F.lit("WARC-Refers-To: "), ident(F.col("first")), F.lit(CRLF),
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF),
        )).otherwise(F.lit("")),
        F.lit("Content-Type: text/html" + CRLF + "Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF),
    )
    return F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("body")), F.lit(CRLF + "\r"))


def write_warc(rows: DataFrame, path: str, key: str, uri: str, payload: str, options: WarcOptions = WarcOptions()) -> str:
    """Write gzip WARC files below `path`; a file is one valid WARC stream when unpacked."""
    records = plan_records(rows, key, uri, payload, options).select(record_text(options).alias("value"))
    records.write.option("lineSep", "\n").option("compression", "gzip").text(path)
    return path


@dataclass
class _Record:
    number: int
    head: dict = field(default_factory=dict)
    state: str = "version"
    left: int = 0
    chunk: bytearray = field(default_factory=bytearray)
    chunk_no: int = 0
    done: int = 0
    digest: object = field(default_factory=hashlib.sha256)


class ChunkReader:
    """Lines of WARC files in order -> chunk rows. Feed whole lines without their line feed."""

    def __init__(self, chunk_bytes: int):
        self.chunk_bytes = chunk_bytes
        self.file, self.record, self.rows = None, None, []

    def line(self, file: str, line: bytes) -> None:
        if file != self.file:
            self._ended()
            self.file, self.record = file, _Record(0)
        r = self.record
        if r.state == "version":
            if line.strip():
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record where one should begin, in {file}")
                r.state = "head"
        elif r.state == "head":
            text = line.removesuffix(b"\r")
            if text:
                name, _, value = text.partition(b":")
                r.head[name.strip().lower().decode()] = value.strip().decode()
            else:
                r.left, r.state = int(r.head["content-length"]), "body"
                if r.left == 0:
                    self._close()
        else:
            # The line feed that ended this line belongs to the payload unless the payload is full.
            self._body(memoryview(line)[: r.left])
            if r.left:
                self._body(memoryview(b"\n"))
            if r.left == 0:
                self._close()

    def _body(self, data: memoryview) -> None:
        r = self.record
        r.left -= len(data)
        while len(data):
            part = data[: self.chunk_bytes - len(r.chunk)]
            r.chunk += part
            data = data[len(part):]
            if len(r.chunk) == self.chunk_bytes and (len(data) or r.left):
                self._emit(False)

    def _emit(self, last: bool) -> None:
        r = self.record
        r.digest.update(r.chunk)
        h = r.head
        strip = lambda x: None if x is None else x.strip("<>")
        self.rows.append((
            self.file, r.number, strip(h.get("warc-record-id")), h.get("warc-type"), h.get("warc-target-uri"),
            strip(h.get("warc-refers-to")), (h.get("warc-payload-digest") or "").rpartition(":")[2] or None,
            int(h["content-length"]), r.chunk_no, r.done, bytes(r.chunk), r.digest.hexdigest(), last,
        ))
        r.done += len(r.chunk)
        r.chunk_no += 1
        r.chunk = bytearray()

    def _close(self) -> None:
        self._emit(True)
        self.record = _Record(self.record.number + 1)

    def _ended(self) -> None:
        if self.record is not None and self.record.state != "version":
            raise ValueError(f"the last record of {self.file} is cut off")

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays(
            [pa.array(col, f.type) for col, f in zip(zip(*rows) if rows else [()] * len(CHUNK_FIELDS), CHUNK_FIELDS)],
            schema=CHUNK_FIELDS,
        )


def read_warc(spark: SparkSession, path: str, options: WarcOptions = WarcOptions()) -> DataFrame:
    """The chunk table of all archives below `path`. The last chunk of a record has the digest
    of its whole payload in `digest_so_far`."""
    lines = (
        spark.read.option("lineSep", "\n").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    )
    chunk_bytes = options.chunk_bytes

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = ChunkReader(chunk_bytes), 0
        for batch in batches:
            files = batch.column(0).dictionary_encode()
            names, codes = files.dictionary.to_pylist(), files.indices.to_pylist()
            for code, line in zip(codes, batch.column(1)):
                reader.line(names[code], line.as_buffer().to_pybytes())
                if len(reader.rows) > held:
                    held = len(reader.rows)
                    if sum(len(r[10]) for r in reader.rows[-8:]) > 4 * chunk_bytes or held >= 500:
                        yield reader.take()
                        held = 0
        reader._ended()
        yield reader.take()

    return lines.mapInArrow(parse, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: (record_id, record_type, refers_to, payload_bytes, payload_digest).

    Responses are measured from their payload as it was read. A revisit's payload is that of
    the response it refers to; the join also holds the stated digest against the read one,
    and a revisit whose response is missing or differs gets NULL bytes and digest.
    """
    ends = chunks.filter("is_last").select(
        "record_id", "record_type", "refers_to", "stated_digest",
        (F.col("chunk_start") + F.octet_length("chunk")).cast("long").alias("bytes"), F.col("digest_so_far").alias("read_digest"),
    )
    whole = ends.filter("record_type = 'response'").groupBy("record_id", "read_digest").agg(F.first("bytes").alias("whole_bytes"))
    source = whole.select(
        F.col("record_id").alias("refers_to"), F.col("read_digest").alias("stated_digest"), "whole_bytes",
    )
    own = F.col("record_type") == "response"
    return ends.join(source, ["refers_to", "stated_digest"], "left").select(
        "record_id", "record_type", "refers_to",
        F.when(own, F.col("bytes")).otherwise(F.col("whole_bytes")).alias("payload_bytes"),
        F.when(own, F.col("read_digest")).otherwise(F.when(F.col("whole_bytes").isNotNull(), F.col("stated_digest"))).alias("payload_digest"),
    )


def archived_pages(spark: SparkSession, pages: DataFrame, options: WarcOptions = WarcOptions()) -> DataFrame:
    """Write all pages, read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    path = write_warc(pages, fresh_path(spark, "warc"), "page_id", "url", "html", options)
    number = lambda c: F.nullif(F.regexp_extract(c, f"^{options.prefix}(.*):[0-9a-f]+$", 1), F.lit("")).cast("long")
    read = records(read_warc(spark, path, options))
    return read.select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )
