"""WARC records in ZIP packages, read back by range.

``write_archives`` puts gzipped WARC records into packages of bounded size: ZIP files whose members are stored, not
compressed again, the records in ``archive/data.warc.gz`` and an index with a line for each record in
``indexes/index.jsonl``. ``read_archives`` opens each package by its end: end record, ZIP64 locator and record where
fields are full, central directory, then the members' local headers; it takes the records' places from the index and
reads them by range. Nothing is extracted.

Nulls and odd cases: a null html is an empty payload; a null url leaves its header out; control characters in a url are
percent-encoded, as is all but letters and digits in a page_id; a null page_id is kept, told from an empty one, and is
never referred to; of rows that repeat the smallest page_id of a payload
all are responses; other columns are ignored; an empty table writes no archive and gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage, map_batches, shared_folder

#: Payloads below this size are never revisits.
LEAST_REVISITED = 100
#: A package is closed beyond this size or number of records.
PACKAGE_BYTES, PACKAGE_RECORDS = 16 << 20, 5_000
#: Bytes read at once.
RANGE_BYTES = 2 << 20
#: Bytes of archives that one task reads, about.
TASK_BYTES = 128 << 20
#: Above so many payloads that occur more than once, the lookup is a shuffle join.
BROADCAST_ROWS = 50_000
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records ------------------------------------------------------------------------------------------------------
def _urn(page_id: object) -> bytes:
    """An id as text that no character of it can break; no id is told from an empty one."""
    return b"<urn:none>" if page_id is None else b"<urn:page:" + quote(str(page_id), safe="").encode() + b">"


def _page(urn: str | None) -> str | None:
    return unquote(urn.removeprefix("<urn:page:").removesuffix(">")) if urn and urn != "<urn:none>" else None


def warc_record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """One gzipped record: a response with the payload, or a revisit without it."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _urn(page_id), b"WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "replace")))
    if revisit:
        head += [b"WARC-Profile: " + _PROFILE, b"WARC-Refers-To: " + _urn(refers_to)]
    head += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a gzipped record."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


# --- packages -----------------------------------------------------------------------------------------------------
def package(records: list[bytes]) -> bytes:
    """A ZIP file of stored members: the records and their index."""
    out, at, lines = io.BytesIO(), 0, []
    for r in records:
        lines.append(json.dumps({"offset": at, "length": len(r)}))
        at += len(r)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True) as f:
            for r in records:
                f.write(r)
        z.writestr(zipfile.ZipInfo(INDEX), "\n".join(lines))
    return out.getvalue()


def members(read_at, size: int) -> dict[str, tuple[int, int]]:  # noqa: ANN001
    """Name to (offset, size) of the stored members. ``read_at(count, offset)`` reads a range of the package."""
    tail = min(size, 22 + 0xFFFF)
    end = read_at(tail, size - tail)
    at = end.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, cd_size, cd_at = struct.unpack_from("<HII", end, at + 10)
    if count == 0xFFFF or 0xFFFFFFFF in (cd_size, cd_at):
        sign, _, where = struct.unpack_from("<4sIQ", read_at(20, size - tail + at - 20))
        if sign != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        sign, count, cd_size, cd_at = struct.unpack_from("<4s28xQQQ", read_at(56, where))
        if sign != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
    directory, found, p = read_at(cd_size, cd_at), {}, 0
    for _ in range(count):
        sign, flags, method, packed, plain, n, m, k, local = struct.unpack_from("<4s4xHH8xIIHHH8xI", directory, p)
        if sign != b"PK\x01\x02":
            raise ValueError("bad central directory")
        name, extra = directory[p + 46 : p + 46 + n], directory[p + 46 + n : p + 46 + n + m]
        p += 46 + n + m + k
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:  # the fields that are full, in this order
                wide = iter(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                plain, packed, local = (next(wide) if x == 0xFFFFFFFF else x for x in (plain, packed, local))
            extra = extra[4 + length :]
        if method or flags & 1:
            continue  # only stored members can be read by range
        n, m = struct.unpack_from("<26x2H", read_at(30, local))
        found[name.decode("utf-8")] = (local + 30 + n + m, plain)
    return found


def read_package(read_at, size: int) -> Iterator[tuple[dict[str, str], bytes]]:  # noqa: ANN001
    """The records that the index lists, read by range in blocks of neighbours."""
    found = members(read_at, size)
    if RECORDS not in found or INDEX not in found:
        raise ValueError(f"{RECORDS} or {INDEX} is missing or compressed")
    base, (at, length) = found[RECORDS][0], found[INDEX]
    places = [(x["offset"], x["length"]) for x in map(json.loads, filter(None, read_at(length, at).split(b"\n")))]
    i = 0
    while i < len(places):
        j, first = i + 1, places[i][0]
        while j < len(places) and places[j][0] == sum(places[j - 1]) and sum(places[j]) - first <= RANGE_BYTES:
            j += 1
        block = read_at(sum(places[j - 1]) - first, base + first)
        for offset, length in places[i:j]:
            yield parse_record(block[offset - first : offset - first + length])
        i = j


# --- the operator -------------------------------------------------------------------------------------------------
def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row of ``pages`` into packages below ``folder``; to (path, bytes, records).

    Files of a failed attempt are left over, but never listed. ``folder`` is any address that pyarrow's file systems
    open, the same for all executors."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.sha2(payload, 256).alias("digest"), F.col(html_col).alias("html"), F.octet_length(payload).alias("n"))
    often = rows.where(F.col("n") >= LEAST_REVISITED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1 and first is not null").select("digest", "first")
    often = cut_lineage(often)
    often = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).cast("string").alias("refers_to")
    rows = rows.join(often, "digest", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "digest", "html", refers_to)
    base = f"{folder.rstrip('/')}/warc-{uuid.uuid4().hex}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path, data = f"{root}/{uuid.uuid4().hex}.wacz", package(held)
            with store.open_output_stream(path) as f:
                f.write(data)
            out = pa.RecordBatch.from_pydict({"path": [path], "bytes": [len(data)], "records": [len(held)]})
            held.clear()
            return out

        for b in batches:
            for page_id, url, digest, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(warc_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to))
                size += len(held[-1])
                if len(held) >= PACKAGE_RECORDS or size >= PACKAGE_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return cut_lineage(map_batches(rows, work, "path string, bytes long, records long")).withColumn("base", F.lit(base))


def read_archives(archives: DataFrame) -> DataFrame:
    """``archives(path, bytes, base)`` to (page_id string, payload_bytes, payload_digest, record_type, refers_to string); a
    revisit gets the size of the payload that it refers to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, _ = fs.FileSystem.from_uri(base)
                rows: list[tuple] = []
                with store.open_input_file(path) as f:
                    for headers, payload in read_package(lambda n, at: f.read_at(n, at), size):  # noqa: B023
                        page, other = (_page(headers.get(k)) for k in ("warc-record-id", "warc-refers-to"))
                        said = headers["warc-payload-digest"].removeprefix("sha256:")
                        kind = headers["warc-type"]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != said:
                            raise ValueError(f"{path}: the payload of page {page} doesn't have its digest")
                        rows.append((page, len(payload) if kind == "response" else None, said, kind, other))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "n", "payload_digest", "record_type", "refers_to"])

    files, size = archives.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = min(files, max(archives.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    files = archives.select("path", "bytes", "base").repartition(max(1, tasks))
    rows = cut_lineage(map_batches(files, work, "page_id string, n long, payload_digest string, record_type string, refers_to string"))
    first = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("n").alias("there"))
    revisits = rows.where("record_type = 'revisit'").join(first, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.where("record_type = 'response'").withColumnRenamed("n", "payload_bytes").select(columns).unionByName(revisits.withColumnRenamed("there", "payload_bytes").select(columns))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row for each row of ``pages``, from archives
    that are written to the shared folder and read back."""
    written = write_archives(pages, shared_folder(pages.sparkSession), id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    return read_archives(written).withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
