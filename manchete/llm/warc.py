"""WARC archives: pages written as request, response or revisit, and metadata records, and
transactions assembled again from such records.

Archives are text files to Spark: a record is its header block and its content, and the
separator of Spark's text writer is the pair of line ends that closes a WARC record. They
are read the same way, split at the version line that begins the next record. A payload
that contains such a line would be split too; such a cut leaves a record shorter than its
Content-Length says, so it never goes unnoticed, and the files concerned are read whole
and cut by length instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manchete.llm.common import left_lookup
from manchete.workspace import materialise

#: Fixed values of the format.
VERSION = "WARC/1.1"
LINE = "\r\n"
END = LINE + LINE
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "concurrent_to": "WARC-Concurrent-To",
    "refers_to": "WARC-Refers-To",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}

#: Payloads from this size on are archived once.
REVISIT_BYTES = 1000
#: Every capture of a table that has no dates carries this one.
UNDATED = "1970-01-01T00:00:00Z"


def _identifier(*parts: Column | str) -> Column:
    """A name-based identifier: the same parts give the same record id."""
    text = [p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]
    known = [F.coalesce(t, F.lit("-")) for t in text]
    digest = F.md5(F.concat_ws(":", *known).cast("binary"))
    return F.concat(
        F.lit("<urn:uuid:"),
        F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        F.lit(">"),
    )


def _record(fields: list[tuple[str, Column]], content: Column) -> Column:
    """A record without the line ends that close it; a field without value is left out."""
    lines = [F.concat(F.lit(f"{LINE}{name}: "), value) for name, value in fields]
    return F.concat(
        F.lit(VERSION),
        *[F.coalesce(line, F.lit("")) for line in lines],
        F.lit(f"{LINE}Content-Length: "),
        F.octet_length(content).cast("string"),
        F.lit(END),
        content,
    )


def captures(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as captures: page_id, url, payload, payload_bytes, payload_digest, response_id.

    `response_id` is the page that holds a payload of at least REVISIT_BYTES, the one with
    the largest id among equal payloads, or the page itself. Only a hash of each payload
    is compared and only payloads that occur more than once are looked up.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(id).alias("page_id"),
        F.col(url).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
    )
    large = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest")
    shared = materialise(
        large.agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    )
    found = left_lookup(rows, shared, "payload_digest", "n", spread_by="page_id")
    return found.withColumn("response_id", F.coalesce("holder", "page_id")).drop("holder")


def write_archives(pages: DataFrame, path: str, records_per_file: int = 20_000, compression: str = "gzip") -> None:
    """Write request, response or revisit, and metadata records of every page below `path`.

    Columns read: page_id, url, html. A null html is an empty payload, a null url leaves the
    target out, a null page_id is written as such and refers to itself; repeated rows are
    written repeatedly, with the same identifiers. Other columns are not read.
    """
    rows = captures(pages)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    capture = _identifier("response", F.col("page_id"), F.col("payload_digest"))
    holder = _identifier("response", F.col("response_id"), F.col("payload_digest"))
    is_response = F.col("page_id").eqNullSafe(F.col("response_id"))
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    target = ("WARC-Target-URI", F.regexp_replace("url", r"\s+", "%20"))
    date = ("WARC-Date", F.lit(UNDATED))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END),
    )
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", _identifier("request", F.col("page_id"), F.col("payload_digest"))),
            ("WARC-Concurrent-To", capture),
            target,
            date,
            ("Content-Type", F.lit("application/http;msgtype=request")),
        ],
        F.concat(F.lit("GET "), F.coalesce(target[1], F.lit("/")), F.lit(f" HTTP/1.1{END}")),
    )
    response = _record(
        [
            ("WARC-Type", F.when(is_response, F.lit("response")).otherwise(F.lit("revisit"))),
            ("WARC-Record-ID", capture),
            ("WARC-Refers-To", F.when(~is_response, holder)),
            ("WARC-Profile", F.when(~is_response, F.lit(REVISIT_PROFILE))),
            target,
            date,
            ("WARC-Payload-Digest", digest),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(http, F.when(is_response, F.col("payload")).otherwise(F.lit(""))),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", _identifier("metadata", F.col("page_id"), F.col("payload_digest"))),
            ("WARC-Concurrent-To", capture),
            target,
            date,
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(
            F.lit("page-id: "),
            name,
            F.coalesce(F.concat(F.lit(f"{LINE}refers-to-page-id: "), F.when(~is_response, F.col("response_id"))), F.lit("")),
            F.lit(LINE),
        ),
    )
    (
        rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
        .write.option("lineSep", END)
        .option("compression", compression)
        .option("maxRecordsPerFile", 3 * records_per_file)
        .text(path)
    )


class Cutter:
    """Records of a file by their lengths, from its bytes piece by piece.

    It holds what has come of one record, and raises an error where a file ends within one.
    """

    def __init__(self) -> None:
        self.held, self.passed = bytearray(), 0

    def add(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while True:
            gone = min(self.passed, len(self.held))
            del self.held[:gone]  # closing line ends of the record before
            self.passed -= gone
            head = -1 if self.passed else self.held.find(END.encode())
            if head < 0:
                return
            lines = bytes(self.held[:head]).split(LINE.encode())
            lengths = [line.split(b":", 1)[1] for line in lines if line.lower().startswith(b"content-length:")]
            if not lengths:
                raise ValueError("a record without its length")
            end = head + len(END) + int(lengths[0])
            if len(self.held) < end:
                return
            yield bytes(self.held[:end])
            del self.held[:end]
            self.passed = len(END)

    def close(self) -> None:
        if self.held.strip():
            raise ValueError("a file that ends within a record")
        self.held.clear()
        self.passed = 0


def _by_length(pieces: DataFrame, separator: str) -> DataFrame:
    """(value, path): the records of files whose pieces do not fit their declared lengths.

    The pieces of a file come to one task in their order, which glues them again, a record
    at a time.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, at = Cutter(), None
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value"), strict=True):
                if path != at and at is not None:
                    cutter.close()
                data = value.as_py() if path != at else separator.encode() + value.as_py()
                at = path
                for record in cutter.add(data):
                    yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary()), pa.array([path])], names=["value", "path"])
        cutter.close()

    raw = pieces.select("path", "start", "at", F.col("value").cast("binary").alias("value"))
    ordered = raw.repartition("path").sortWithinPartitions("path", "start", "at").select("path", "value")
    return ordered.mapInArrow(cut, "value binary, path string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below `path`: the columns of FIELDS, http_length,
    payload_bytes, payload_sha1, `content` (binary) and `path`.

    The payload is the body of an HTTP message, else the content.

    Files are split and read in parallel (compressed ones by one task each). Where a payload
    holds what looks like the beginning of a record, the pieces of its file are put in
    order again and cut by the declared lengths, a record at a time. Header names
    are matched in any case, records of any type and order are returned, and an empty
    folder of archives gives no record. A file that is cut short raises an error.
    """
    # The separator has no repeated beginning: those are missed at the border of a buffer.
    separator = f"\n{VERSION}{LINE}"
    pieces = spark.read.option("lineSep", separator).text(path)
    pieces = pieces.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Records still have their closing line ends, and the first of a file its version line.
    whole = _fields(pieces, F.when(F.startswith("value", F.lit(VERSION + LINE)), len(VERSION + LINE)).otherwise(0))
    broken = whole.where(~_complete()).select("path").distinct()
    names = [r.path for r in broken.limit(1).collect()]
    if not names:
        return _finished(whole)
    good = _finished(whole.join(broken, "path", "left_anti"))
    records = _by_length(pieces.join(broken, "path", "left_semi"), separator)
    again = _fields(records.select(F.col("value").cast("string").alias("value"), "path"), F.lit(len(VERSION + LINE)))
    return good.unionByName(_finished(again))


def _fields(pieces: DataFrame, skip: Column) -> DataFrame:
    """Header fields of raw records, and where their content lies."""
    head = F.instr("value", END)
    lines = F.concat(F.lit("\n"), F.substring(F.col("value"), skip + 1, F.col("__head") - 1 - skip), F.lit("\r\n"))
    rows = pieces.withColumn("__head", head).withColumn("__lines", lines)
    named = {
        column: F.nullif(F.regexp_extract("__lines", rf"(?i)\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
        for column, name in FIELDS.items()
    }
    length = F.regexp_extract("__lines", r"(?i)\nContent-Length:[ \t]*(\d+)", 1).try_cast("long")
    return rows.withColumns(named | {"__length": length}).drop("__lines")


def _finished(rows: DataFrame) -> DataFrame:
    content = F.substring(F.col("value").cast("binary"), F.col("__head") + len(END), F.col("__length").cast("int"))
    is_http = F.coalesce(F.startswith("content_type", F.lit("application/http")), F.lit(False))
    body = F.when(is_http, http_body(F.col("content"))).otherwise(F.col("content"))
    # Only the head of a message is searched; a null separates "no HTTP" from a length of 0.
    head = F.substring(F.col("content"), 1, 4096).cast("string")
    length = F.regexp_extract(head, r"(?i)\nContent-Length:[ \t]*(\d+)", 1).try_cast("long")
    return rows.select(*FIELDS, content.alias("content"), "path").select(
        *FIELDS,
        F.when(is_http, length).alias("http_length"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(body).alias("payload_sha1"),
        "content",
        "path",
    )


def _complete() -> Column:
    """Whether the bytes after the header are the declared ones, and at most the closing line ends."""
    held = F.octet_length("value") - (F.col("__head") - 1) - len(END)
    return F.coalesce(
        (F.col("__head") > 0) & held.between(F.col("__length"), F.col("__length") + len(END)), F.lit(False)
    )


def http_body(content: Column) -> Column:
    """The body of an HTTP message held in `content`."""
    head = F.instr(content.cast("string"), END)
    return F.substring(content, head + len(END), F.octet_length(content))


def assemble(records: DataFrame, captured_content: bool = True) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata.

    A response or revisit record is a capture; request and metadata records join it by
    their concurrent-to identifier. Of several such records of a capture the one with the
    smallest identifier counts, and `requests` and `metadatas` say how many there were. Records
    that name no known capture give a row without response. Repeated captures give a row
    each. Columns: the fields and content of each record as structs, null where missing.
    Without `captured_content` the captures' own content, which was measured when it was
    read, stays out of the joins and the result.
    """
    parts = [*FIELDS, "http_length", "payload_bytes", "payload_sha1", "content"]
    own = F.struct(*[c for c in parts if captured_content or c != "content"])
    is_capture = F.col("record_type").isin("response", "revisit", "resource")
    heads = records.where(is_capture).select(F.col("record_id").alias("capture_id"), own.alias("response"))

    def beside(kind: str, count: str) -> DataFrame:
        joined = records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        # The identifier leads the struct, so it decides which record is the smallest.
        first = F.min(F.struct("record_id", *[c for c in parts if c != "record_id"])).alias(kind)
        return joined.groupBy(F.col("concurrent_to").alias("capture_id")).agg(first, F.count("*").alias(count))

    return (
        heads.join(beside("request", "requests"), "capture_id", "full")
        .join(beside("metadata", "metadatas"), "capture_id", "full")
        .select("capture_id", "response", "request", "metadata", "requests", "metadatas")
    )


def capture_digests(captured: DataFrame) -> DataFrame:
    """Per assembled capture: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The page is named by the metadata record. A response's payload was measured when it was
    read; a revisit has the digest and HTTP length of the payload it stands for.
    """
    fields = F.col("metadata.content").cast("string")
    page = F.nullif(F.regexp_extract(fields, r"(?:^|\n)page-id: *(-?\d+)", 1), F.lit(""))
    other = F.nullif(F.regexp_extract(fields, r"(?:^|\n)refers-to-page-id: *(-?\d+)", 1), F.lit(""))
    is_revisit = F.col("response.record_type") == "revisit"
    stated = F.regexp_extract("response.payload_digest", r"(?i)^sha1:([0-9a-f]{40})$", 1)
    return captured.select(
        page.try_cast("long").alias("page_id"),
        F.when(is_revisit, F.col("response.http_length")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(is_revisit, stated).otherwise(F.col("response.payload_sha1")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        other.try_cast("long").alias("refers_to"),
    )
