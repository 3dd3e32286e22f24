import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import warc


def zip64(files):
    """A ZIP file that keeps every size and place in ZIP64 fields."""
    out, central = b"", b""
    for name, data in files.items():
        at, name = len(out), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out += struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra)) + name + extra + data
        extra = struct.pack("<HHI", 99, 4, 7) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        central += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 2, 0, 0, 0, 0xFFFFFFFF) + name + extra + b"hi"
    where = len(out)
    end = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, len(files), len(files), len(central), where)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, where + len(central), 1)
    return out + central + end + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 5) + b"PK..."


def reader(data):
    return lambda n, at: data[at : at + n]


def test_zip64_directory():
    data = zip64({"a": b"one", "indexes/b": b"\0" * 70_000})
    assert {k: data[at : at + n] for k, (at, n) in warc.members(reader(data), len(data)).items()} == {"a": b"one", "indexes/b": b"\0" * 70_000}


def test_package_round_trip():
    payloads = [b"", b"x" * 99, b"a\r\n\r\nb", bytes(range(256)) * 9000]
    data = warc.package([warc.warc_record(i, f"http://e.org/{i}", p, hashlib.sha256(p).hexdigest()) for i, p in enumerate(payloads)])
    assert [p for _, p in warc.read_package(reader(data), len(data))] == payloads
    with pytest.raises(ValueError, match="central directory"):
        warc.members(reader(b"junk" * 30), 120)


def slow(rows):
    out = []
    for page_id, _, html in rows:
        p = (html or "").encode()
        equal = [i for i, _, h in rows if (h or "").encode() == p and i is not None]
        first = min(equal, default=None)
        revisit = len(p) >= 100 and first is not None and first != page_id
        out.append((page_id, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


@pytest.mark.parametrize("bound", [50_000, 0])
def test_query_on_odd_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
    same, edge = "<p>é same</p>" * 12, "y" * 100
    rows = [(i, f"http://e.org/{i}", same) for i in range(40, 10, -1)] + [(1, None, None), (2, "u r\nl", ""), (3, "x", edge), (4, "x", edge), (5, "x", "z" * 99), (6, "x", "z" * 99), (None, "n", same), (7, "big", "<b>" * 400_000), (3, "x", edge), (None, "n", "q" * 200), (None, "n", "q" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("n", F.lit(0)).repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=key) == sorted(slow(rows), key=key)


def test_string_ids_of_any_characters(spark):
    same = "<p>equal payload</p>" * 12
    ids = ["", "x\r\ny", "a b>%<", "é:한", None, "none", "x", "urn:none"]
    rows = [(i, "u", same if k % 2 else f"{same}{k}") for k, i in enumerate(ids)]
    got = [tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()]
    key = lambda r: (r[0] is None, r[0] or "", r[2])
    assert sorted(got, key=key) == sorted(slow(rows), key=key)


def test_archives_are_read_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_RECORDS", 5)
    pages = spark.range(200).selectExpr("id as page_id", "'u' as url", "concat('page ', id) as html").repartition(2)
    archives = warc.write_archives(pages, warc.shared_folder(spark))
    read = warc.read_archives(archives)
    assert archives.count() >= 40 and read.count() == 200 and spark.sparkContext.defaultParallelism == 8


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
