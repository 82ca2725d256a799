"""WARC archives in seekable Zstandard bundles.

Each task writes a bundle: records are grouped into independent Zstandard frames of about FRAME_BYTES, and
the file ends with a seek table (a skippable frame, so any Zstandard reader can unpack the file). The index
maps a record to bundle, frame and offset inside the unpacked frame; reading one record costs the seek
table and one frame. Payloads of MIN_REVISIT bytes and more that equal an earlier page's (smaller id) are
written as revisit records without the payload.

A null payload is empty. Pages with equal id and payload are written each, all response or all revisit. Null
ids never are the smallest. An empty table writes no bundle. Other columns than id, url and html are not
read. Files carry a random name, and only those in the written index count: what a lost executor left behind
is never read. A row of the html must fit a task, a bundle need not: it is written frame by frame.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.llm.scratch import fresh_path, written

FRAME_BYTES = 1 << 16
MIN_REVISIT = 100
#: Frames that one reading task takes of a bundle.
FRAMES_PER_TASK = 64
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Of a local path or a URI that pyarrow knows; s3a and s3n are Hadoop's names for s3."""
    uri = re.sub("^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record_id(page_id: str | None) -> str:
    """By the id as text; a null id, which no text equals, has the record id of its name space."""
    return f"<urn:uuid:{uuid.NAMESPACE_OID if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, page_id)}>"


def make_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One WARC/1.1 record; payload_length and digest always speak of the full payload. Ids are percent-encoded in
    headers, and a null id has no header."""
    uri = "".join(c for c in (url or "urn:unknown") if c.isprintable())
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", *([] if page_id is None else [f"X-Page-ID: {quote(page_id, safe='')}"]),
    ]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers)}", f"X-Refers-To-Page: {quote(refers, safe='')}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    return head, block[block.index(b"\r\n\r\n") + 4 :]


class Bundle:
    """Writes frames to an open stream, and the seek table at the end."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.sizes: list[tuple[int, int]] = []
        self.open = bytearray()
        self.packer = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset in the frame."""
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self._close_frame()
        place = (len(self.sizes), len(self.open))
        self.open += record
        return place

    def _close_frame(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        self.stream.write(packed)
        self.sizes.append((len(packed), len(self.open)))
        self.open = bytearray()

    def finish(self) -> None:
        if self.open:
            self._close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, packed size, size) of each frame, from the end of an open file."""
    size = file.size()
    file.seek(size - 9)
    frames, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * frames)
    cells = struct.iter_unpack("<II", file.read(8 * frames))
    out, at = [], 0
    for packed, full in cells:
        out.append((at, packed, full))
        at += packed
    return out


def read_frame(file, table: list[tuple[int, int, int]], frame: int) -> bytes:
    start, packed, full = table[frame]
    file.seek(start)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=full)


def _write(folder: str):
    def run(it):
        bundle, path = None, ""
        for batch in it:
            rows = []
            for page, url, html, digest, refers, name in zip(*(batch.column(k) for k in range(6))):
                if bundle is None:
                    system, root = _file_system(folder)
                    system.create_dir(root, recursive=True)
                    path = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(system.open_output_stream(f"{root}/{path}", compression=None))
                payload = (html.as_py() or "").encode()
                name = name.as_py()
                frame, offset = bundle.add(make_record(name, url.as_py(), payload, digest.as_py(), refers.as_py()))
                rows.append((page.as_py(), record_id(name), path, frame, offset))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "record_id", "bundle", "frame", "offset"])
        if bundle is not None:
            bundle.finish()

    return run


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers): pages whose payload an earlier page has."""
    digests = written(pages.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest"), "digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "first-pages")
    return written(digests.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers"))).distinct(), "revisits")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the archives; returns their folder and the index (page_id, record_id, bundle, frame, offset)."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    known = revisits(rows).select(F.col("page_id").alias("__i"), F.col("digest").alias("__d"), F.col("refers").cast("string").alias("refers"))
    rows = rows.join(known, F.col("page_id").eqNullSafe(F.col("__i")) & (F.col("digest") == F.col("__d")), "left").select("page_id", "url", "payload", "digest", "refers", F.col("page_id").cast("string").alias("name"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return folder, written(rows.mapInArrow(_write(folder), f"page_id {kind}, record_id string, bundle string, frame int, offset int"), "warc-index")


def read_archives(folder: str, index: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, all from the
    archives; a response's digest is computed from what was read and must equal its header."""
    kind = index.schema["page_id"].dataType.simpleString()

    def run(it):
        system, root = _file_system(folder)
        path, frame, file, table, data = "", -1, None, [], b""
        for batch in it:
            out = []
            for bundle, number, offset in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if bundle != path:
                    if file is not None:
                        file.close()
                    path, frame, file = bundle, -1, system.open_input_file(f"{root}/{bundle}")
                    table = seek_table(file)
                if number != frame:
                    frame, data = number, read_frame(file, table, number)
                head, payload = parse_record(data, offset)
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(head["X-Payload-Length"])
                if head["WARC-Type"] == "response":
                    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                        raise ValueError(f"{bundle}: record {head['WARC-Record-ID']} is damaged")
                ids = (unquote(head[k]) if k in head else None for k in ("X-Page-ID", "X-Refers-To-Page"))
                out.append((next(ids), size, digest, head["WARC-Type"], next(ids)))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file is not None:
            file.close()

    # a row of the small index is a read of an archive, so the number of tasks follows the frames
    frames = index.groupBy("bundle").agg((F.max("frame") + 1).alias("n")).agg(F.sum("n")).first()[0] or 0
    dealt = index.select("bundle", "frame", "offset").repartition(max(1, -(-frames // FRAMES_PER_TASK)), "bundle", F.floor(F.col("frame") / FRAMES_PER_TASK)).sortWithinPartitions("bundle", "frame", "offset")
    got = dealt.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return got.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(*write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""
