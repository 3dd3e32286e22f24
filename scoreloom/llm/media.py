"""Media columns: interleaved document sequences.

``interleaved`` parses HTML into the ordered sequence of a document: texts and media references as structs with their
position, each medium with the digest it refers to and its own caption. ``resolve`` joins the references with a table of
stored media on the digest, so positions and captions stay with their payload. ``store_payloads`` makes such a table: a
payload of bytes becomes the 8-bit samples of a gray PNG image, 64 samples a row, without loss; ``features`` reads the
stored bytes back.

Nulls and odd cases: a null text is an empty payload, which is padded to 64 zero bytes; a null id is kept; rows that
repeat a payload store it each and share one resolved row; references without a payload resolve to nulls; null html has
an empty sequence; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage, free_names, map_batches, written

ROW = 64
#: A digest with more than one of so many of all references is split in the join.
HOT = 256
#: Digests whose image a task remembers to have read.
_SEEN = 100_000
_PNG = b"\x89PNG\r\n\x1a\n"
_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("source", pa.string()), ("n_bytes", pa.int64()), ("caption", pa.string())])
_ITEM_SQL = "array<struct<position:int,kind:string,text:string,digest:string,source:string,n_bytes:bigint,caption:string>>"


# --- images -------------------------------------------------------------------------------------------------------
def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of a row."""
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b"\0")


def to_png(payload: bytes) -> bytes:
    """A gray image of 8-bit samples, one byte a sample; rows are stored unfiltered."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that ``to_png`` wrote; checks every chunk."""
    if not data.startswith(_PNG):
        raise ValueError("not a PNG image")
    at, body, width, height = len(_PNG), [], 0, 0
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError(f"bad {kind!r} chunk")
        if kind == b"IHDR":
            width, height, depth, color, _, _, lace = struct.unpack(">IIBBBBB", part)
            if (depth, color, lace) != (8, 0, 0):
                raise ValueError("not a gray image of 8-bit samples")
        elif kind == b"IDAT":
            body.append(part)
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and their shares in 16 bins, in fixed digits."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    p = counts / counts.sum()
    values = np.arange(256)
    mean = float((p * values).sum())
    spread = float(np.sqrt((p * (values - mean) ** 2).sum()))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};bins=" + ",".join(f"{x:.4f}" for x in p.reshape(16, 16).sum(axis=1))


# --- sequences ----------------------------------------------------------------------------------------------------
@dataclass
class _Figure:
    media: list[dict]
    captions: list[tuple[int, str]]  # each with the place where it would stand as text


class _Reader(HTMLParser):
    """Texts between tags and media tags, in order; a figure's caption goes to the media in the figure."""

    SILENT = ("script", "style", "template", "title")
    MEDIA = ("img", "video", "audio", "source", "embed")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figures: list[_Figure] = []  # the open ones, the outermost first
        self.caption = False

    def end_text(self) -> str:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        return text

    def put_text(self) -> None:
        if self.caption:  # a block of the caption
            self.words.append(" ")
        elif text := self.end_text():
            self.items.append({"kind": "text", "text": text})

    def end_caption(self) -> None:
        if self.caption:
            self.caption = False
            self.figures[-1].captions.append((len(self.items), self.end_text()))

    def end_figure(self) -> None:
        """The caption, wherever it stands, goes to the figure's media that have none of their own figure; without media it is text."""
        self.end_caption()
        self.put_text()
        figure = self.figures.pop()
        if figure.media and figure.captions:
            text = " ".join(t for _, t in figure.captions if t)
            for item in figure.media:
                item["caption"] = text
        elif figure.media and self.figures:
            self.figures[-1].media += figure.media
        else:
            for at, text in reversed(figure.captions):
                self.items[at:at] = [{"kind": "text", "text": text}] if text else []

    def finish(self) -> None:
        while self.figures:
            self.end_figure()
        self.put_text()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SILENT:
            self.silent += 1
        elif tag == "figure":
            self.end_caption()
            self.put_text()
            self.figures.append(_Figure([], []))
        elif tag == "figcaption":
            self.end_caption()
            self.put_text()
            self.caption = bool(self.figures)  # outside a figure it is text
        elif tag in self.MEDIA:
            self.put_text()
            a = dict(attrs)
            source = a.get("src") or ""
            size = a.get("data-bytes") or ""
            item = {"kind": tag, "source": source, "digest": source.removeprefix("sha256:") if source.startswith("sha256:") else None, "caption": a.get("alt"), "n_bytes": int(size) if size.isdecimal() else None}
            self.items.append(item)
            if self.figures:
                self.figures[-1].media.append(item)
        elif tag in ("p", "div", "br", "li", "h1", "h2", "h3", "article", "section", "table", "tr", "ul", "ol", "nav"):
            self.put_text()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            if self.caption:
                self.end_caption()
            else:
                self.put_text()
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "article", "section", "figure", "tr", "td"):
            self.put_text()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.words.append(data)


def sequence(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.finish()
    return [{"position": i, **x} for i, x in enumerate(reader.items)]


def interleaved(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id_col, items): the ordered sequence of each document."""
    rows = pages.select(id_col, F.col(html_col).alias("_html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence(h) for h in b.column(1).to_pylist()], pa.list_(_ITEM))], [id_col, "items"])

    return map_batches(rows, work, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, items {_ITEM_SQL}")


def references(sequences: DataFrame) -> DataFrame:
    """One row for each medium of a sequence, with its position, digest and caption."""
    rest = [c for c in sequences.columns if c != "items"]
    media = sequences.select(*rest, F.explode("items").alias("item")).where("item.kind <> 'text'")
    return media.select(*rest, "item.position", "item.kind", "item.digest", "item.source", "item.n_bytes", "item.caption")


def resolve(refs: DataFrame, payloads: DataFrame) -> DataFrame:
    """References with what ``payloads`` (a row for each digest) has of them. Digests with more than one of ``HOT`` of all
    references, fewer than ``HOT`` in number, are split: their references go to as many places as they fill, and the
    payload's row to each."""
    salt, places = free_names(refs, "salt", "places")
    refs = cut_lineage(refs)  # counted, then joined
    total = refs.count()
    hot = refs.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") * HOT > total)
    hot = F.broadcast(hot.select("digest", F.ceil(F.col("n") * F.lit(HOT / max(total, 1))).cast("int").alias(places)))
    place = F.pmod(F.monotonically_increasing_id(), F.coalesce(F.col(places), F.lit(1))).cast("int")  # any place will do
    refs = refs.join(hot, "digest", "left").withColumn(salt, place).drop(places)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(places), F.lit(1)) - 1))
    payloads = payloads.join(hot, "digest", "left").withColumn(salt, every).drop(places)
    return refs.join(payloads, ["digest", salt], "left").drop(salt)


# --- the stored table ---------------------------------------------------------------------------------------------
def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes (doc_id, digest, html, medium) to the shared folder and reads it back: each text's padded bytes as an image,
    and the HTML that refers to it by digest."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for at in range(0, len(texts), 256):  # the images of a few texts at a time
                digests, pages, images = [], [], []
                for doc, text in zip(ids[at : at + 256].to_pylist(), texts[at : at + 256], strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    payload = padded(data)
                    digest = hashlib.sha256(payload).hexdigest()
                    name = entities.escape(f"document {doc}")
                    digests.append(digest)
                    pages.append(f'<article><h1>{name}</h1><figure><img src="sha256:{digest}" data-bytes="{len(data)}" width="{ROW}" height="{len(payload) // ROW}"><figcaption>{name}</figcaption></figure></article>')
                    images.append(to_png(payload))
                yield pa.RecordBatch.from_arrays([ids[at : at + 256], pa.array(digests), pa.array(pages), pa.array(images, pa.binary())], ["doc_id", "digest", "html", "medium"])

    stored = map_batches(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest string, html string, medium binary")
    return written(stored, "media")


def features(stored: DataFrame) -> DataFrame:
    """``stored(digest, medium)`` to a row for each digest: what its stored bytes hold. A task reads copies of an image once,
    as long as it remembers them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            rows, new = [], []
            for i, digest in enumerate(b.column(0).to_pylist()):
                if digest not in seen:
                    new.append(i)
                    if len(seen) < _SEEN:
                        seen.add(digest)
            for i in new:
                data = b.column(1)[i].as_py()
                payload = from_png(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(new)), *columns], names)

    got = map_batches(stored.select("digest", "medium"), work, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return got.dropDuplicates(["digest"])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption),
    one row for each row of ``docs``."""
    stored = store_payloads(docs, id_col, text_col)
    refs = references(interleaved(stored.select("doc_id", "html"), "doc_id"))
    found = resolve(refs, features(stored))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
