"""WARC archives as a chunked record table (operator 1).

``write_warc`` writes one record per row; ``read_chunks`` streams archives as rows of (record, chunk number) with
the digest of all bytes so far, so no payload is ever held whole by the reader.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.llm.common import bounded_batches, join_hot, materialize, new_path, partitions
from tokensieve.llm.files import committed, open_fs

CHUNK = 64 << 10
ROLL = 256 << 20
PREFIX = "urn:tokensieve:page:"
#: Payloads of fewer bytes are never written as revisits.
LEAST = 1000


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to for each page.

    The payload is the html in UTF-8, empty for null. Of equal payloads of at least ``least`` bytes the largest
    page_id is the response and the others revisit it; rows that repeat that page_id are responses too. A null
    page_id is a response only if all its equals have none. Extra columns are ignored. Digests are
    aggregated before anything is joined; a digest that many pages share is broadcast with the few like it,
    and its pages are spread.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    same = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    same = materialize(same, "digests")
    total = pages.count()
    out = join_hot(rows, same, ["payload_digest"], "n", total, ["page_id"])
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return out.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def _header(x: dict) -> bytes:
    clean = lambda s: s.replace("\r", "%0D").replace("\n", "%0A")
    name = lambda i: f"<{PREFIX}{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {x['record_type']}", f"WARC-Record-ID: {name(x['page_id'])}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {clean(x['url'])}"] if x["url"] else []
    lines += [f"WARC-Payload-Digest: sha1:{x['payload_digest']}", f"X-Payload-Length: {x['payload_bytes']}"]
    if x["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: {name(x['refers_to'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Length: 0"]
    else:
        lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {x['payload_bytes']}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str | None = None, level: int = 1) -> DataFrame:
    """Write planned records into gzip-per-record archives; returns the manifest (file, n_records), already written out.

    A task streams its records into files of about ROLL bytes each; no rows make no file.
    """
    spark = records.sparkSession
    folder = folder or new_path(spark, "warc")
    bounded_batches(spark, 256)
    schema = pa.schema([("file", pa.string()), ("n_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in b.to_pylist())
        first = next(rows, None)
        while first is not None:
            with committed(folder, ".warc.gz") as (out, name):
                n = size = 0
                while first is not None and size < ROLL:
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(z.compress(_header(first)))
                    if first["record_type"] != "revisit":
                        body = memoryview(first["payload"])
                        for at in range(0, len(body), CHUNK):
                            out.write(z.compress(body[at : at + CHUNK]))
                        size += len(body)
                    out.write(z.compress(b"\r\n\r\n") + z.flush())
                    n += 1
                    first = next(rows, None)
            yield pa.RecordBatch.from_pylist([{"file": name, "n_records": n}], schema)

    return materialize(records.mapInArrow(run, "file string, n_records long"), "warc-manifest")


class _Stream:
    """Inflated bytes of a gzip-per-record file, a bounded buffer at a time."""

    def __init__(self, f):
        self.f, self.z, self.raw, self.buf = f, None, b"", b""

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.f.read(CHUNK)
                if not self.raw:
                    return False
            if self.z is None:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.raw, CHUNK)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if self.z.eof:
                self.z = None
            if got:
                self.buf += got
                return True

    def line(self) -> bytes | None:
        while (at := self.buf.find(b"\n")) < 0:
            if not self._more():
                return None
        out, self.buf = self.buf[:at].rstrip(b"\r"), self.buf[at + 1 :]
        return out

    def take(self, n: int) -> bytes:
        """At most n bytes, at least one."""
        if not self.buf and not self._more():
            raise EOFError("the archive ends within a record")
        out, self.buf = self.buf[:n], self.buf[n:]
        return out


def chunks(f, chunk: int = CHUNK) -> Iterator[dict]:
    """Rows of one open archive: the record's header fields, chunk_no, data, bytes and digest so far, is_last."""
    s = _Stream(f)
    while (line := s.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while line := s.line():
            k, _, v = line.decode("utf-8").partition(":")
            head[k.strip().lower()] = v.strip()
        left, no, seen, sha = int(head["content-length"]), 0, 0, hashlib.sha1()
        while True:
            data = bytearray()
            while left and len(data) < chunk:
                got = s.take(min(left, chunk - len(data)))
                data += got
                left -= len(got)
            sha.update(data)
            seen += len(data)
            yield {"head": head, "chunk_no": no, "data": bytes(data), "bytes_so_far": seen, "digest_so_far": sha.copy().hexdigest(), "is_last": not left}
            no += 1
            if not left:
                break


def read_chunks(spark: SparkSession, manifest: DataFrame, data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of archives: record_id, record_type, refers_to, url, declared_digest, declared_bytes, chunk_no, bytes_so_far, digest_so_far, is_last and, if asked, data.

    A record without payload has one empty chunk. One task reads one file as a stream.
    """
    bounded_batches(spark)
    fields = [("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("chunk_no", pa.int64()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_())]
    schema = pa.schema(fields + [("data", pa.binary())] * data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                fs, p = open_fs(name)
                rows: list[dict] = []
                with fs.open_input_stream(p, compression=None) as f:
                    for x in chunks(f, chunk):
                        h = x["head"]
                        rows.append({
                            "record_id": h["warc-record-id"], "record_type": h["warc-type"], "refers_to": h.get("warc-refers-to"), "url": h.get("warc-target-uri"),
                            "declared_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "declared_bytes": int(h.get("x-payload-length", h["content-length"])),
                            **{k: x[k] for k in ("chunk_no", "bytes_so_far", "digest_so_far", "is_last")}, **({"data": x["data"]} if data else {}),
                        })
                        if len(rows) >= 64:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "record_id string, record_type string, refers_to string, url string, declared_digest string, declared_bytes long, chunk_no long, bytes_so_far long, digest_so_far string, is_last boolean" + ", data binary" * data
    return manifest.select("file").repartition(partitions(spark)).mapInArrow(run, ddl)


def page_of(record_id):
    """The page_id inside a record identifier, null if it has none."""
    return F.nullif(F.regexp_extract(record_id, PREFIX + r"(-?\d*)>", 1), F.lit("")).cast("long")
