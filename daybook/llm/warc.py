"""WARC archives written and read as rows of chunks.

A payload beyond the chunk size is stored as a record and continuation records
(segments), one row each, so that no row holds more than a chunk besides its
page. Reading streams the lines of an archive: a record comes out as rows of
record identifier and chunk number, each with the digest so far, and memory
holds a chunk, never a record.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.shipping import ship

RECORD = "urn:page:"
END = "\r\n"

CHUNKS = ("record_id string, record_type string, refers_to string, chunk_no int, chunk binary, "
          "n_bytes bigint, sha1 string, is_last boolean, declared_sha1 string, declared_bytes bigint")


def _text(column: Column) -> Column:
    """A header value: no control characters, which would end it."""
    return F.regexp_replace(column.cast("string"), r"\p{Cntrl}", "")


def _header(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(END)))


def plan_records(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, refers_to: what the archives are to say."""
    base = pages.select(
        "page_id", _text(F.col("url")).alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload"))
    large = base.where(F.col("n_bytes") >= least_bytes).select("page_id", "digest")
    kept = (large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
            .where("n > 1").drop("n"))
    revisits = large.join(kept, "digest").where("page_id <> refers_to").distinct()
    return base.join(revisits, ["page_id", "digest"], "left")


def write_archives(
    pages: DataFrame, path: str, *, least_bytes: int = 1000, chunk_bytes: int = 1 << 20,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) as gzip archives below ``path``.

    Of records with equal payloads of at least ``least_bytes`` the one with the
    largest page_id is a response and the others revisit it; smaller ones are
    all responses, and so are a page without id and rows that repeat page_id and
    payload. A null html is an empty payload; a record of a null url has no
    target; control characters in a url are left out. No rows give no records.
    """
    records = plan_records(pages, least_bytes)
    revisit = F.col("refers_to").isNotNull()
    last = F.when(revisit, 0).otherwise(
        F.greatest(F.ceil(F.col("n_bytes") / chunk_bytes) - 1, F.lit(0))).cast("int")
    # Cut before the rows are multiplied, so that no chunk's row carries the whole payload.
    payload = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(
        payload, k * chunk_bytes + 1, F.lit(chunk_bytes)))
    rows = records.select(
        "page_id", "url", "digest", "n_bytes", "refers_to", last.alias("last"), F.posexplode(chunks).alias("k", "body"))
    name = F.concat(F.lit(f"<{RECORD}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    first, body = F.col("k") == 0, F.col("body")
    http = F.when(first & ~revisit, F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("n_bytes").cast("string"), F.lit(END + END))).otherwise("")
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _header("WARC-Type", F.when(~first, "continuation").when(revisit, "revisit")
                .otherwise("response")),
        _header("WARC-Record-ID", F.concat(
            name, F.when(first, "").otherwise(F.concat(F.lit("#"), F.col("k"))), F.lit(">"))),
        _header("WARC-Date", date),
        _header("WARC-Target-URI", F.when(F.length("url") > 0, F.col("url"))),
        _header("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _header("X-Payload-Length", F.when(first, F.col("n_bytes"))),
        _header("WARC-Refers-To", F.concat(F.lit(f"<{RECORD}"), F.col("refers_to"), F.lit(">"))),
        _header("WARC-Profile", F.when(
            revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("WARC-Segment-Number", F.when(F.col("last") > 0, F.col("k") + 1)),
        _header("WARC-Segment-Origin-ID", F.when(~first, F.concat(name, F.lit(">")))),
        _header("WARC-Segment-Total-Length", F.when(
            ~first & (F.col("k") == F.col("last")), F.col("n_bytes"))),
        _header("Content-Type", "application/http; msgtype=response"),
        _header("Content-Length", F.octet_length(http) + F.octet_length(body)),
        F.lit(END), http)
    record = F.concat(head.cast("binary"), body).cast("string").alias("value")
    # The writer ends each row, and so each record, with two line ends.
    rows.select(record).write.option("lineSep", END + END).option("compression", "gzip").text(path)


class _Reader:
    """Lines in, chunk rows out. It holds one chunk and the digest of the record at hand."""

    def __init__(self, chunk_bytes: int, payload: bool):
        self.chunk_bytes, self.payload = chunk_bytes, payload
        self.rows: list[tuple] = []
        self.state, self.left, self.in_http = "between", 0, False
        self.headers: dict[str, str] = {}
        self.record: dict | None = None

    def line(self, data: bytes) -> None:
        if self.state == "between":
            if data.startswith(b"WARC/"):
                self.state, self.headers = "headers", {}
            elif data.strip():
                raise ValueError(f"not a WARC record: {data[:60]!r}")
        elif self.state == "headers":
            if data := data.rstrip(b"\r"):
                key, _, value = data.decode().partition(": ")
                self.headers[key] = value
            else:
                self._begin()
        else:
            data += b"\n"
            own = data[:self.left] if self.left < len(data) else data
            self.left -= len(own)
            if self.in_http:
                self.in_http = own != b"\r\n"
            else:
                self._take(own)
            if not self.left:
                self.state = "between"

    def _begin(self) -> None:
        kind = self.headers.get("WARC-Type")
        self.left = int(self.headers["Content-Length"])
        self.state = "block" if self.left else "between"
        if kind == "continuation":
            if self.record is None or self.headers["WARC-Segment-Origin-ID"] != self.record["id"]:
                raise ValueError("a continuation without its record")
            return
        self.close()
        self.in_http = kind == "response"
        self.record = {
            "id": self.headers["WARC-Record-ID"], "kind": kind, "no": 0, "n": 0,
            "refers": self.headers.get("WARC-Refers-To"), "sha1": hashlib.sha1(),
            "said": self.headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
            "bytes": int(self.headers.get("X-Payload-Length", -1)), "held": [], "size": 0}

    def _take(self, data: bytes) -> None:
        r = self.record
        r["held"].append(data)
        r["size"] += len(data)
        if r["size"] >= self.chunk_bytes:
            self._emit(False)

    def _emit(self, last: bool) -> None:
        r = self.record
        data = b"".join(r["held"])
        r["sha1"].update(data)
        r["n"] += len(data)
        self.rows.append((r["id"], r["kind"], r["refers"], r["no"], data if self.payload else None,
                          r["n"], r["sha1"].hexdigest(), last, r["said"], r["bytes"]))
        r["no"], r["held"], r["size"] = r["no"] + 1, [], 0

    def close(self) -> None:
        if self.record is not None:
            self._emit(True)
            self.record = None


def read_archives(
    spark: SparkSession, path: str, *, chunk_bytes: int = 1 << 20, payload: bool = True
) -> DataFrame:
    """The archives' records as rows of chunks (columns: ``CHUNKS``).

    ``n_bytes`` and ``sha1`` are of the payload up to and with the chunk; the
    row with ``is_last`` has them for the whole record, also if it has no
    payload. ``payload=False`` leaves the chunks out. An archive is one task,
    as gzip cannot be split; its records are whole and in order.
    """
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(),
             pa.string(), pa.bool_(), pa.string(), pa.int64()]
    names = [f.split(" ")[0] for f in CHUNKS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(chunk_bytes, payload)
        for part in parts:
            for line in part.column(0):
                reader.line(line.as_py())
                if len(reader.rows) >= (4 if payload else 4096):
                    yield batch(reader.rows)
                    reader.rows = []
        reader.close()
        if reader.rows:
            yield batch(reader.rows)

    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(parse, CHUNKS)


def page_records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a row per record read back.

    For a response length and digest are those of the payload as read; a record
    whose payload is not what its header says raises. A revisit has no payload,
    so its header speaks for the payload it refers to.
    """
    whole = chunks.where("is_last")
    revisit = F.col("record_type") == "revisit"
    sound = (F.col("sha1") == F.col("declared_sha1")) & (F.col("n_bytes") == F.col("declared_bytes"))
    page = lambda c: F.regexp_extract(c, f"<{RECORD}(-?[0-9]+)", 1)
    return whole.select(
        F.when(page("record_id") != "", page("record_id").cast("bigint")).alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).when(sound, F.col("n_bytes"))
        .otherwise(F.raise_error(F.lit("a payload differs from its digest"))).alias("payload_bytes"),
        F.when(revisit, F.col("declared_sha1")).otherwise(F.col("sha1")).alias("payload_digest"),
        "record_type",
        F.when(revisit, page("refers_to").cast("bigint")).alias("refers_to"))
