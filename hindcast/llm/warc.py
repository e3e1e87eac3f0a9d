"""WARC archives: writing captures as request, response (or revisit) and metadata records, and assembling them again.

Records are written and read as one stream per file; a reader holds one record at a time. Spark's text files separate their
lines by any string: with the blank line pair that ends every record, a file's lines joined again are its bytes, however
often the same bytes stand inside a payload. Files are compressed whole, so each is read by one task from its start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm.common import kept

END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = {"warc-type": "type", "warc-record-id": "record_id", "warc-concurrent-to": "concurrent_to", "warc-target-uri": "uri", "warc-date": "date", "warc-payload-digest": "digest"}
RECORD = "type string, record_id string, concurrent_to string, uri string, date string, digest string, headers map<string,string>, http string, payload binary, payload_bytes long, payload_sha1 string"


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record's text without its final blank lines; fields with a null value are left out."""
    lines = [F.concat(F.lit(f"\r\n{name}: "), value) for name, value in fields]
    length = F.concat(F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.lit("WARC/1.1"), *(F.coalesce(line, F.lit("")) for line in lines), length, F.lit(END), block)


def write_captures(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the archive of ``pages`` (page_id, url, html; extra columns are ignored) to the new folder ``path``.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of at least ``least_bytes`` bytes the one
    with the largest page_id is a response and the others revisit it; rows that repeat its page_id are responses too.
    Smaller payloads are all responses. Null page_ids are smaller than any other and have no page_id field. A url loses
    line breaks, a null url its field.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least_bytes
    tops = kept(rows.where(large).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("uses")).where("uses > 1").select("digest", "top"))
    # Only payloads that come again travel by their digest; the left join keeps the others.
    judged = rows.where(large).join(tops, "digest", "left")
    original = F.col("top").isNull() | F.col("page_id").eqNullSafe(F.col("top"))
    big = judged.select("page_id", "url", "html", "digest", "top", original.alias("original"))
    small = rows.where(~large).select("page_id", "url", "html", "digest", F.lit(None).cast(rows.schema["page_id"].dataType).alias("top"), F.lit(True).alias("original"))
    captures = big.union(small).withColumn("capture", F.expr("uuid()"))

    uri, when = F.regexp_replace("url", "[\r\n]+", " "), F.lit(date)
    own, asked, about = (F.concat(F.lit("<urn:uuid:"), F.expr(f"concat_ws('-', substr(x, 1, 8), substr(x, 9, 4), substr(x, 13, 4), substr(x, 17, 4), substr(x, 21, 12))".replace("x", f"md5(concat(capture, '{kind}'))")), F.lit(">")) for kind in ("response", "request", "metadata"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    of_response = [("WARC-Type", F.lit("response")), ("WARC-Record-ID", own), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))]
    of_revisit = [("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", own), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))]
    of_request = [("WARC-Type", F.lit("request")), ("WARC-Record-ID", asked), ("WARC-Concurrent-To", own), ("WARC-Date", when), ("WARC-Target-URI", uri), ("Content-Type", F.lit("application/http; msgtype=request"))]
    of_metadata = [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", about), ("WARC-Concurrent-To", own), ("WARC-Date", when), ("WARC-Target-URI", uri), ("Content-Type", F.lit("application/warc-fields"))]
    page = F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    records = F.array(
        _record(of_request, F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1"), F.lit(END))),
        F.when(F.col("original"), _record(of_response, F.concat(http, F.col("html")))).otherwise(_record(of_revisit, http)),
        _record(of_metadata, page),
    )
    captures.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class _Bytes:
    """A stream of pieces, each of which was followed by END, read like a file."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.end = pieces, bytearray(), END.encode()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.held += piece + self.end
        return piece is not None

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        got = bytes(self.held[:n])
        del self.held[:n]
        return got

    def head(self) -> bytes | None:
        """All up to the next END, without the blank lines before it; None at the end of the stream."""
        while True:
            blank = len(self.held) - len(self.held.lstrip(b"\r\n"))
            del self.held[:blank]
            at = self.held.find(self.end)
            if at >= 0:
                return self.take(at + len(self.end))[:at]
            if not self._more():
                return None


def _parse(pieces: Iterator[bytes], payloads: bool) -> Iterator[dict]:
    stream = _Bytes(pieces)
    while (head := stream.head()) is not None:
        lines = head.split(b"\r\n")
        headers: dict[str, str] = {}
        for line in lines[1:]:
            name, colon, value = line.partition(b":")
            if colon:
                headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        if not lines[0].startswith(b"WARC/") or not headers.get("content-length", "").isdigit():
            continue  # not a record: read on at the next blank line
        block = stream.take(int(headers["content-length"]))
        http, payload = None, block
        if headers.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(stream.end)
            http = http.decode("utf-8", "replace")
        row = {to: headers.get(name) for name, to in _FIELDS.items()}
        shown = payload if payloads or row["type"] == "metadata" else None
        yield row | {"headers": list(headers.items()), "http": http, "payload": shown, "payload_bytes": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest()}


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record below ``path``, in the columns of RECORD. Bytes that are no record are passed over.

    Without ``payloads`` only metadata keep theirs; length and digest are those of the payload in the archive either way.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (piece for batch in batches for piece in batch.column(0).to_pylist())
        rows, size = [], 0
        for row in _parse(pieces, payloads):
            rows.append(row)
            size += len(row["payload"] or b"") + 1000
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    text, number = pa.string(), pa.int64()
    schema = pa.schema([*((c, text) for c in _FIELDS.values()), ("headers", pa.map_(text, text)), ("http", text), ("payload", pa.binary()), ("payload_bytes", number), ("payload_sha1", text)])
    return spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value")).mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, uri, date, response, request, metadata (array).

    Records belong together by the identifier they are concurrent to; a record that names none stands for its own. The
    response is the response or revisit record; captures without one are left out, missing requests are null. A metadata
    record that names the request of a response follows it to the response's capture.
    """
    parts = records.where(F.col("type").isin("request", "response", "revisit", "metadata") & F.col("record_id").isNotNull())
    body = F.struct("type", "record_id", "uri", "date", "digest", "headers", "http", "payload", "payload_bytes", "payload_sha1")
    rows = parts.select(F.coalesce("concurrent_to", "record_id").alias("names"), "record_id", "concurrent_to", "type", body.alias("body"))
    # Metadata about a request: one step further along the identifiers.
    hops = parts.where("type = 'request' and concurrent_to is not null").select(F.col("record_id").alias("via"), F.col("concurrent_to").alias("further"))
    rows = rows.join(hops, rows["names"] == hops["via"], "left").withColumn("capture", F.coalesce("further", "names"))
    is_main = F.col("type").isin("response", "revisit")
    grouped = rows.groupBy("capture").agg(
        F.first(F.when(is_main, F.col("body")), ignorenulls=True).alias("response"),
        F.first(F.when(F.col("type") == "request", F.col("body")), ignorenulls=True).alias("request"),
        F.collect_list(F.when(F.col("type") == "metadata", F.col("body"))).alias("metadata"),
    )
    return grouped.where("response is not null").select("response.record_id", "response.uri", "response.date", "response", "request", "metadata")


def captured_pages(captures: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id (text), payload_bytes, payload_digest, record_type, refers_to of assembled captures.

    A revisit has the length and the page of the response with its digest: the one of at least ``least_bytes`` bytes.
    """
    page = F.nullif(F.regexp_extract(F.element_at("metadata", 1)["payload"].cast("string"), r"page_id: ([^\r\n]*)", 1), F.lit(""))
    rows = kept(captures.select(F.when(F.size("metadata") > 0, page).alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.payload_bytes").alias("bytes"), F.col("response.payload_sha1").alias("sha1"), F.regexp_extract("response.digest", "^sha1:(.*)$", 1).alias("stated")))
    whole = rows.where("record_type = 'response'")
    revisits = rows.where("record_type = 'revisit'").select("page_id", "record_type", "stated")
    originals = kept(whole.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.max("bytes").alias("bytes")))
    back = revisits.join(originals, revisits["stated"] == originals["sha1"], "left")
    return whole.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to")).union(
        back.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("stated").alias("payload_digest"), "record_type", "refers_to")
    )
