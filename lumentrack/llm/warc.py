"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

Writing: pages are grouped by payload digest; in each group the page of the largest id becomes a
response record and the others become revisits of it. Every task writes archives of bounded
size to a shared folder. Reading: the dictionary is loaded from the leading skippable frame, one
frame is decoded per record, and record headers, content lengths and payload digests are
validated; a faulty archive raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir, spread_join, unit_hash
from .files import open_file, write_file

#: Magic of the skippable frame that holds a dictionary, and of a Zstandard frame.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: The dictionary is trained on about so many pages, on so many characters from the start of each, to this size. This changes how small records get, and nothing else.
SAMPLE_PAGES, SAMPLE_CHARS, DICT_BYTES = 400, 16384, 32768
#: An archive is closed when its compressed records exceed this.
ARCHIVE_BYTES = 64 << 20
_READ = 1 << 16


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url: str | None, payload: bytes, sha: str, refers_to, revisit: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{sha}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages (SAMPLE_PAGES, SAMPLE_CHARS), or b"" if they are too few to train on."""
    total = pages.count()
    if not total:
        return b""
    part = pages.where(unit_hash(F.struct("page_id", "url")) < SAMPLE_PAGES / total).select(F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_CHARS).alias("html")).limit(2 * SAMPLE_PAGES)
    sample = [r.html.encode() for r in part.collect() if r.html]
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def assign(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses): which page of each payload is archived whole."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    groups = pages.select("page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n")).where(F.col("n") >= min_bytes)
    first = materialise(groups.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("sha", "first"), "first-pages")
    later = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return spread_join(rows, first, "sha", "left").select("page_id", "url", "payload", later.alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write a record for every page and return the archives: (path, records). The files are written once, before this returns.

    Equal payloads of ``min_bytes`` bytes or more make revisits. Null html is an empty payload; payloads of any
    length are written whole, one at a time in memory; a null page_id is less than any other; rows that repeat the largest page_id of
    a payload are all responses. An empty table makes no archive. Other columns are not read, whatever their names.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    trained = train(pages)

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        lead = struct.pack("<II", DICT_MAGIC, len(trained)) + trained if trained else b""
        frames, held = [], 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array([write_file(folder, "pages.warc.zst", [lead, *frames])]), pa.array([len(frames)], pa.int64())], ["path", "records"])

        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                page_id, url, payload, refers_to = (x.as_py() for x in row)
                frames.append(compressor.compress(_record(page_id, url, payload, digest(payload), refers_to, refers_to is not None)))
                held += len(frames[-1])
                if held >= ARCHIVE_BYTES:
                    yield close()
                    frames, held = [], 0
        if frames:
            yield close()

    return materialise(assign(pages, min_bytes).mapInArrow(run, "path string, records long"), "archives")


def frames(source):
    """Yield the decoded bytes of each Zstandard frame; a leading dictionary frame is loaded first."""
    data, trained, start = b"", None, True

    def need(n):
        nonlocal data
        while len(data) < n and (more := source.read(max(_READ, n - len(data)))):
            data += more
        return len(data) >= n

    while need(4):
        magic = struct.unpack_from("<I", data)[0]
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if not need(8) or not need(8 + (size := struct.unpack_from("<I", data, 4)[0])):
                raise ValueError("skippable frame is cut short")
            if start and magic == DICT_MAGIC:
                content = data[8 : 8 + size]
                if content[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
                    content = zstandard.ZstdDecompressor().decompress(content)
                trained = zstandard.ZstdCompressionDict(content)
            data, start = data[8 + size :], False
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame: {magic:08x}")
        start = False
        frame, out = zstandard.ZstdDecompressor(dict_data=trained).decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = source.read(_READ)
            if not data:
                raise ValueError("frame is cut short")
        yield b"".join(out)
    if data:
        raise ValueError("bytes after the last frame")


def parse(record: bytes) -> dict:
    """Validated record: type, page_id, refers_to, url, payload_bytes, digest, payload (None for revisits)."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if not gap or first != "WARC/1.1" or fields.get("WARC-Type") not in ("response", "revisit"):
        raise ValueError(f"not a WARC record: {record[:40]!r}")
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length and block differ")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    length = next((int(x[16:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")), None)
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not gap or length is None or (payload if revisit else len(payload) != length or digest(payload) != sha):
        raise ValueError("payload doesn't match its length or digest")
    name = lambda k: int(x) if (x := fields[k].removeprefix("<urn:page:").removesuffix(">")) else None
    return {"type": fields["WARC-Type"], "page_id": name("WARC-Record-ID"), "refers_to": name("WARC-Refers-To") if revisit else None, "url": fields["WARC-Target-URI"], "payload_bytes": length, "digest": sha, "payload": None if revisit else payload}


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the archives listed in column ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for.

    One record is decoded at a time; a faulty archive is an error; no archive, no rows; other
    columns of ``archives`` are not read. ``unresolved`` tells revisits without their response.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    keys = ["page_id", "payload_bytes", "digest", "type", "refers_to", "payload"][: 5 + payloads]
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as source:
                    rows, held = [], 0
                    for data in frames(source):
                        rows.append(parse(data))
                        held += len(data) if payloads else 200
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(keys, types, strict=False)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(keys, types, strict=False)], names)

    spread = archives.select("path").repartition(max(1, min(archives.count(), 4096)))
    return spread.mapInArrow(run, schema)


def unresolved(records: DataFrame) -> DataFrame:
    """The revisits of ``read`` records that no response with the same id and payload digest answers; none if all archives are there."""
    answers = records.where("record_type = 'response'").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).distinct()
    revisits = records.where("record_type = 'revisit'")
    return revisits.join(answers, revisits.refers_to.eqNullSafe(F.col("_id")) & (revisits.payload_digest == F.col("_digest")), "left_anti")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
x AS (SELECT page_id, octet_length(b) AS n, p.h, last, upper(p.h) AS u FROM p JOIN g ON p.h = g.h),
d AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(u, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1), '' ORDER BY i) AS payload_digest
  FROM x, range(32) t(i) GROUP BY page_id)
SELECT x.page_id, x.n AS payload_bytes, payload_digest, CASE WHEN x.page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN x.page_id <> last THEN last END AS refers_to
FROM x JOIN d ON x.page_id = d.page_id
"""
