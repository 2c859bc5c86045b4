"""Web archives: WARC files with a table of where each record lies, and reads of selected records by byte range.

Writing: equal payloads are found by SHA-256 with a pre-aggregated group-by, one record of each group carries the payload and the
others revisit it. Every task writes its own files, under names that no other attempt uses, and returns one index row per record;
Spark commits the rows of the attempt that succeeded, so files of lost attempts are never referred to.

Reading: the index rows are ranged by (file, offset), in as many tasks as their bytes ask for; neighbours are read together, one range request for records whose gap is
small, up to a bounded size. Only the ranges that hold selected records are fetched.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scalar, session_of, shared_dir, staged

#: Payloads below this are never deduplicated.
LEAST_SHARED = 100
#: Bytes of a file, of one range read, and of a gap that a range read bridges.
FILE_BYTES, RANGE_BYTES, GAP_BYTES = 1 << 30, 8 << 20, 64 << 10
#: Bytes of records that one task reads, about.
TASK_BYTES = 16 << 20

INDEX = "file string, offset long, length long, url string, payload_digest string, record_id long, page_id long, record_type string"


def _record_id(n: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=n)}>"


def _member(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member; fields without value are left out, line breaks in values become %0D and %0A."""
    lines = [f"{k}: {v.replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in fields if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode()
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def _packed(payloads: pa.Array) -> pa.Array:
    z = zstandard.ZstdCompressor(level=3)
    return pa.array([z.compress(x) for x in payloads.to_pylist()], pa.binary())


def _writer(folder: str, date: str):
    def write(batches):
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows: dict[str, list] = {k: [] for k in ("file", "offset", "length")}
                for r in b.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(info)
                        at = len(info)
                    again, payload = r["record_type"] == "revisit", zstandard.decompress(r["packed"])
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    fields = [
                        ("WARC-Type", r["record_type"]),
                        ("WARC-Record-ID", _record_id(r["record_id"])),
                        ("WARC-Date", date),
                        ("WARC-Target-URI", r["url"]),
                        ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"),
                        ("WARC-Refers-To", _record_id(r["target"]) if again else None),
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if again else None),
                        ("Content-Type", "application/http; msgtype=response"),
                    ]
                    data = _member(fields, http if again else http + payload)
                    out.write(data)
                    for k, v in zip(rows, (f"{folder}/{name}", at, len(data)), strict=True):
                        rows[k].append(v)
                    at += len(data)
                yield pa.RecordBatch.from_pydict(rows | {k: b.column(k) for k in ("url", "payload_digest", "record_id", "page_id", "record_type")})
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each page below folder (a URI that every executor can write) and returns the index.

    pages: page_id long, url string, html string; other columns are ignored. Of records with equal payloads of at least
    LEAST_SHARED bytes the one with the smallest page_id is the response (null ids last; among repeated rows, one of them).
    Null html is an empty payload, a null url leaves the target out; a table without rows writes no file.
    """
    session_of(pages)
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # numbered once and written, so that every later step sees the same numbers; payloads are small on disk and on the way
    packed = F.arrow_udf(_packed, "binary")("payload").alias("packed")
    rows = staged(rows.select("page_id", "url", packed, F.length("payload").alias("size"), F.sha2("payload", 256).alias("payload_digest"), F.monotonically_increasing_id().alias("record_id")), "none")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id"))
    shared = rows.where(F.col("size") >= LEAST_SHARED).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("many"), first.alias("first"))
    rows = rows.join(shared.where("many > 1").select("payload_digest", F.col("first.record_id").alias("target")), "payload_digest", "left")
    kind = F.when(F.col("target") != F.col("record_id"), F.lit("revisit")).otherwise(F.lit("response"))
    rows = rows.select("record_id", "page_id", "url", "packed", "payload_digest", kind.alias("record_type"), "target")
    return staged(rows.mapInArrow(_writer(folder, date), INDEX))


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields of a record and its payload (what follows the HTTP header)."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("a record does not end where its index says")
    return fields, block.partition(b"\r\n\r\n")[2]


def _reader(payloads: bool):
    def read(batches):
        from pyarrow.fs import FileSystem

        name, source = "", None
        for b in batches:
            rows, out = b.to_pylist(), []
            k = 0
            while k < len(rows):
                first, z = rows[k], k
                end = first["offset"] + first["length"]
                while z + 1 < len(rows) and rows[z + 1]["file"] == first["file"] and rows[z + 1]["offset"] - end <= GAP_BYTES and rows[z + 1]["offset"] + rows[z + 1]["length"] - first["offset"] <= RANGE_BYTES:
                    z += 1
                    end = max(end, rows[z]["offset"] + rows[z]["length"])
                if name != first["file"]:
                    if source is not None:
                        source.close()
                    fs, path = FileSystem.from_uri(name := first["file"])
                    source = fs.open_input_file(path)
                data = source.read_at(end - first["offset"], first["offset"])
                for r in rows[k : z + 1]:
                    a = r["offset"] - first["offset"]
                    fields, payload = parsed(data[a : a + r["length"]])
                    again = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not again and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                    number = lambda k: uuid.UUID(fields[k][10:-1]).int if k in fields else None  # noqa: B023, E731
                    out.append((number("WARC-Record-ID"), r["page_id"], fields.get("WARC-Target-URI"), fields["WARC-Type"], None if again else len(payload), digest, number("WARC-Refers-To"), payload if payloads and not again else None))
                k = z + 1
            names = ("record_id", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "target", "payload")
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=list(names))
        if source is not None:
            source.close()

    return read


def read_archives(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the given index rows: record_id, page_id, url, record_type, payload_bytes, payload_digest, target, payload.

    A revisit has no payload of its own: its payload and payload_bytes are null and target is the record_id of its response
    (see resolved()). No index rows give no records; a record whose bytes do not match its digest stops the job.
    """
    session_of(selected)
    tasks = 1 + scalar(selected.agg(F.coalesce(F.sum("length"), F.lit(0)))) // TASK_BYTES
    ranged = selected.select("file", "offset", "length", "page_id").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    return ranged.mapInArrow(_reader(payloads), "record_id long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, target long, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Adds to revisits what their responses hold: page_id as refers_to, and payload_bytes. The responses must be among the records."""
    records = staged(records.drop("payload"))
    targets = records.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    found = records.join(targets, "target", "left")
    again = F.col("record_type") == "revisit"
    return found.select(
        "page_id",
        F.when(again, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(again, F.col("_page")).alias("refers_to"),
        "url",
    )


def archive_folder(spark: SparkSession) -> str:
    return shared_dir(spark)
