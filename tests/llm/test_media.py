import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import media


def test_images_keep_every_byte():
    rnd = random.Random(5)
    for data in (b"", b"x", b"\0" * 64, b"\xff" * 65, rnd.randbytes(6400)):
        p = media.padded(data)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.rstrip(b"\0") == data.rstrip(b"\0")
        assert media.from_png(media.to_png(p)) == p
    broken = bytearray(media.to_png(media.padded(b"abc")))
    broken[-20] ^= 1
    with pytest.raises(ValueError, match="chunk"):
        media.from_png(bytes(broken))


def test_sequence_keeps_order_and_captions():
    html = "<title>no</title><p>one &amp; <b>two</b></p><figure><img src='sha256:ab' alt='x'><figcaption>cap <i>1</i></figcaption></figure>tail<img src='http://e/i.png' alt='alt'><script>var t='<p>';</script><p>end"
    got = [(x["position"], x["kind"], x.get("text"), x.get("digest"), x.get("caption")) for x in media.sequence(html)]
    assert got == [(0, "text", "one & two", None, None), (1, "img", None, "ab", "cap 1"), (2, "text", "tail", None, None), (3, "img", None, None, "alt"), (4, "text", "end", None, None)]
    assert media.sequence(None) == media.sequence("") == []


def test_captions_reach_their_media_wherever_they_stand():
    flat = lambda html: [(x["kind"], x.get("text"), x.get("caption")) for x in media.sequence(html)]
    cap = "<figcaption>the <p>cap</p></figcaption>"
    two = [("img", None, "the cap"), ("img", None, "the cap")]
    for inner in (f"{cap}<img alt='x'><img>", f"<img>{cap}<img>", f"<img><img>{cap}"):
        assert flat(f"<figure>{inner}</figure>") == two
    assert flat(f"a{cap}b") == [("text", "a", None), ("text", "the", None), ("text", "cap", None), ("text", "b", None)]
    assert flat(f"a<figure>{cap}<p>q</figure>b") == [("text", t, None) for t in ("a", "the cap", "q", "b")]
    assert flat(f"<figure>{cap}<figure><img></figure><figure><img><figcaption>own</figcaption></figure></figure>") == [two[0], ("img", None, "own")]
    assert flat("<figure><figcaption>open<img>") == [("img", None, "open")]
    assert flat("<figure><img alt='kept'></figure></figure><img alt='y'>z") == [("img", None, "kept"), ("img", None, "y"), ("text", "z", None)]


def test_interleaved_over_real_pages_loses_no_medium_and_no_word(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    got = {r.page_id: r["items"] for r in media.interleaved(pages, "page_id").collect()}
    rows = pages.collect()
    assert len(got) == len(rows) and any(got.values())
    for r in rows[:50]:
        lone = "<figure><figcaption>before it</figcaption><img src='i'></figure>"
        items = media.sequence((r.html or "") + lone)
        assert [(x["kind"], x.get("caption")) for x in items][-1] == ("img", "before it")
        assert [x.get("text") for x in items[:-1]] == [x["text"] for x in got[r.page_id]]


def test_query_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "é" * 33), (5, "copy"), (6, "copy"), (6, "copy"), (None, "<b>&\"'"), (8, "long " * 60_000), (9, "copy\0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("html", F.lit("clash"))
    out = media.text_media(docs).collect()
    expect = []
    for i, t in rows:
        data = (t or "").encode()
        p = media.padded(data)
        expect.append((i, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(expect, key=key)
    equal = {}
    for r in out:
        assert equal.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
        assert r.caption == f"document {r.doc_id}"


def slow_feature(samples):
    """Straight from the samples, one at a time."""
    n = len(samples)
    mean = sum(samples) / n
    spread = (sum((x - mean) ** 2 for x in samples) / n) ** 0.5
    shares = [samples.count(bytes([v])) / n for v in range(256)]
    entropy = -sum(p * math.log2(p) for p in shares if p)
    bins = [sum(shares[k : k + 16]) for k in range(0, 256, 16)]
    return [mean, spread, entropy, *bins]


def test_features_equal_brute_force():
    rnd = random.Random(12)
    for data in (b"", b"plain text " * 90, bytes(range(256)), rnd.randbytes(5000), "é한🙂".encode() * 40):
        samples = media.padded(data)
        got = [float(x) for x in re.findall(r"-?\d+\.\d+", media.feature(samples))]
        assert len(got) == 19 and all(abs(a - b) < 1e-4 for a, b in zip(got, slow_feature(samples), strict=True))


def test_hot_digest_is_split(spark):
    rows = [(i, "copied text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("salt", F.lit("clash")).withColumn("places", F.lit(1))
    refs = docs.select("*", F.sha1("text").alias("digest")).repartition(4)
    payloads = refs.select("digest", F.col("text").alias("stored")).dropDuplicates(["digest"])
    got = media.resolve(refs, payloads)
    assert set(got.columns) == {*refs.columns, "stored"} and got.where("stored = text and salt = 'clash'").count() == 3000
    assert "digest" in got.columns and media.text_media(docs).count() == 3000


def test_unresolved_reference_and_empty(spark):
    pages = spark.createDataFrame([(1, "<img src='sha256:ff'><p>t</p>"), (2, None)], "page_id long, html string")
    refs = media.references(media.interleaved(pages, "page_id"))
    stored = spark.createDataFrame([("aa", bytearray(media.to_png(bytes(64))))], "digest string, medium binary")
    assert [(r.page_id, r.digest, r.payload_bytes) for r in media.resolve(refs, media.features(stored)).collect()] == [(1, "ff", None)]
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0
