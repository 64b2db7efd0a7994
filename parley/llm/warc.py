"""WARC archives with an index written first, and reads of byte ranges found through it.

Every record is a gzip member of its own. The index has a row for each record (file, offset, length, url, digest);
reading selects rows of the index, joins neighbouring ranges into one read and takes the records out of it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, release, stage

INDEX = "page_id bigint, file string, offset bigint, length bigint, url string, payload_digest string, record_type string, refers_to bigint"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload and refers_to: of equal payloads of at least ``least_bytes``, all but the
    largest page_id refer to it. Null ids refer to the largest id that isn't null; with none, and for rows that share
    the largest id, each is a response. Null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    groups = rows.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    # stored, so that the join is planned on its size: a few groups are sent to all, many are joined by key
    repeated = stage(groups.where("n > 1").select("sha", "last"), "warc-groups")
    return rows.join(repeated, "sha", "left").select("page_id", "url", "payload", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to"))


def _line(value) -> str:
    """A header value without control characters or spaces."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in str(value))


def record(page_id, url, payload: bytes, refers_to=None) -> tuple[bytes, str]:
    """One WARC record, and the bare base32 SHA-1 of its payload. A revisit keeps the HTTP header but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_line(url)}"] if url else []), f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n", digest


def parse(raw: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of a record; a response's digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    of = lambda name: int(v) if (v := fields.get(name, "<urn:page:>")[10:-1]) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return of("WARC-Record-ID"), fields.get("WARC-Target-URI"), length, digest, fields["WARC-Type"], of("WARC-Refers-To"), payload


def write_warc(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write ``roles()`` rows as one archive for each partition under ``folder``; return the stored index.

    An archive takes its final name only when whole, and each attempt of a task writes a file of its own, so only the archives of
    attempts that ended well are in the index. An empty partition writes none.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for frame in frames:
            rows = []
            for page in frame.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}.open")
                raw, digest = record(page["page_id"], page["url"], page["payload"], page["refers_to"])
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                rows.append((page["page_id"], name, offset, len(member), page["url"], digest, "response" if page["refers_to"] is None else "revisit", page["refers_to"]))
                offset += len(member)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            names = [c.split()[0] for c in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        if out is not None:
            out.close()
            store.move(f"{root}/{name}.open", f"{root}/{name}")

    return stage(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, INDEX), "warc-index")


def read_warc(index: DataFrame, folder: str, payloads: bool = True, gap: int = 64 << 10, span: int = 2 << 20, task: int = 8 << 20) -> DataFrame:
    """The records of the given index rows. Ranges of one archive that lie within ``gap`` bytes are read at once, up to about ``span``.

    The index is small beside the archives, so the reads are dealt out by the bytes to be read: a task for each ``task`` of them, or, beyond 4096 tasks, as many larger ones.
    """
    tasks = max(1, min((index.agg(F.sum("length")).first()[0] or 0) // task, 4096))
    order = Window.partitionBy("file").orderBy("offset")
    apart = F.col("offset") - F.lag(F.col("offset") + F.col("length"), 1, -(gap + 1)).over(order) > gap
    runs = index.select("file", "offset", "length", apart.cast("int").alias("apart"), F.floor(F.col("offset") / span).alias("part"))
    runs = runs.withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    reads = runs.groupBy("file", "run", "part").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("ranges")).repartition(tasks, "file", "run", "part")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in READ.split(", ")]
        for frame in frames:
            for read in frame.to_pylist():
                start, end = read["ranges"][0]["offset"], max(r["offset"] + r["length"] for r in read["ranges"])
                with store.open_input_file(f"{root}/{read['file']}") as archive:
                    archive.seek(start)
                    held = archive.read(end - start)
                rows = [parse(zlib.decompress(held[r["offset"] - start : r["offset"] + r["length"] - start], 31)) for r in read["ranges"]]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns if payloads else columns[:-1] + [pa.nulls(len(rows), pa.binary())], names)
        release()

    return reads.select("file", "ranges").mapInArrow(run, READ)


def op10_warc_index_first(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_folder(spark, "warc")
    index = write_warc(roles(pages), folder)
    return read_warc(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
