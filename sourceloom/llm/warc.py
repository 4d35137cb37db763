"""WARC archives: records written by tasks, an index written first, and selected records read by coalesced byte ranges.

Writing: every page becomes one record, a gzip member of its own as the format asks. Of records with equal payloads the one
with the smallest page id is a response, the others are revisits that refer to it and carry headers only; payloads shorter
than ``least`` bytes are all responses. A task appends its records to a file of its own in the shared folder, under a name that no
other attempt uses, and returns the index rows (file, offset, length, page id, URL, digest); the saved index names only
files of attempts that succeeded, so lost executors leave at most files that nothing refers to.

Reading: index rows are selected (by any condition on the index), brought together by file and ordered by offset; ranges at most
``gap`` bytes apart become one read of at most ``span`` bytes, from which the records are cut. Large files are split into runs of
``span`` bytes, so a file is never one task's work. Every record's length and digest are checked against its header.

Defined results: a null payload is empty; a null URL is an empty one; rows that repeat a page id are records of their own, and
revisits refer to the page id of the response; a null page id comes after all others among equal payloads. An empty
table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import saved, ship, tasks, text_or_empty
from sourceloom.session import shared_dir

INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, digest string, type string"
RECORD = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
#: Spans of the archives that a task reads at most.
TASK_SPANS = 8
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, as a gzip member. A revisit has no block; its payload's length is a header."""
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        payload = b""
    fields.append(("Content-Type", "text/html"))
    fields.append(("Content-Length", str(len(payload))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + payload + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> dict:
    """The fields of RECORD from a gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    payload = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(payload) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")

    def number(name: str) -> int | None:
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "payload": payload if kind == "response" else None,
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number("WARC-Refers-To"),
    }


# ----- writing ----------------------------------------------------------------------------------------------------


def write_archive(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the pages to files under ``folder`` and returns the saved index.

    Which record is the response is decided on hashes alone, by minima taken before the shuffle; the payloads are shuffled
    once, to meet that decision by page, which spreads copies evenly.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), text_or_empty(payload_col).alias("html"))
    rows = rows.withColumn("hash", F.unhex(F.sha1("html")))
    keys = saved(rows.select("page_id", "hash").where(F.octet_length("html") >= least))
    firsts = saved(keys.groupBy("hash").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "first"))
    revisits = keys.join(firsts, "hash").where("page_id <> first or page_id is null").select("page_id", "hash", "first").distinct()
    revisits = revisits.withColumnsRenamed({"page_id": "of", "hash": "of_hash", "first": "refers_to"})
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left")
    rows = rows.select("page_id", "url", "html", "refers_to")
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, offset = None, "", 0
        for batch in batches:
            index = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                digest = payload_digest(payload)
                member = record(page_id, url or "", payload, digest, refers_to)
                if out is None:  # a name of its own for each attempt
                    files, root = pafs.FileSystem.from_uri(folder)
                    files.create_dir(f"{root}/{run}", recursive=True)
                    name = f"{run}/{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                index.append((name, offset, len(member), page_id, url, digest, "response" if refers_to is None else "revisit"))
                offset += len(member)
            columns = list(zip(*index, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    return saved(rows.mapInArrow(write, INDEX))


# ----- reading ----------------------------------------------------------------------------------------------------


def coalesced(ranges: list[tuple[int, int]], gap: int, span: int) -> list[tuple[int, int, int]]:
    """(offset, length, number of ranges) of reads for ranges (offset, length) in the order of their offsets."""
    reads: list[list[int]] = []
    for offset, length in ranges:
        if reads and offset <= reads[-1][0] + reads[-1][1] + gap and offset + length - reads[-1][0] <= span:
            reads[-1][1] = max(reads[-1][1], offset + length - reads[-1][0])
            reads[-1][2] += 1
        else:
            reads.append([offset, length, 1])
    return [tuple(r) for r in reads]


def read_records(index: DataFrame, folder: str, gap: int = 64 << 10, span: int = 4 << 20) -> DataFrame:
    """The records that the index rows name.

    The number of tasks follows from the bytes of the records, not from those of the index, which are few.
    """
    spark = index.sparkSession
    ship(spark)
    spans = math.ceil((index.agg(F.sum("length")).first()[0] or 0) / span)
    number = max(1, math.ceil(spans / TASK_SPANS), min(spans, tasks(spark)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            at = 0
            while at < len(rows):
                end = next((k for k in range(at, len(rows)) if rows[k][0] != rows[at][0]), len(rows))
                if name != rows[at][0]:
                    if source is not None:
                        source.close()
                    name = rows[at][0]
                    source = files.open_input_file(f"{root}/{name}")
                for offset, length, n in coalesced([r[1:] for r in rows[at:end]], gap, span):
                    block = source.read_at(length, offset)
                    found = [parsed(block[o - offset : o - offset + size]) for _, o, size in rows[at : at + n]]
                    yield pa.RecordBatch.from_pylist(found, schema)
                    at += n
        if source is not None:
            source.close()

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    part = F.floor(F.col("offset") / span)
    placed = index.select("file", "offset", "length", part.alias("part")).repartition(number, "file", "part").sortWithinPartitions("file", "offset")
    return placed.select("file", "offset", "length").mapInArrow(read, RECORD)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder of the cluster, as a URI."""
    shared = shared_dir(spark)
    return f"{shared if '://' in shared else 'file://' + shared}/warc-{uuid.uuid4().hex}"
