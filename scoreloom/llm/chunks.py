"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes (h = 2 h + GEAR[byte], modulo 2^32; the low half that is used depends on the last 16
bytes). A chunk ends after a word where that half falls below a bound, about every ``WORDS_A_CHUNK`` words; where none does
within the longest chunk, it ends after the word with the smallest hash there, or inside a word where there is no space.
So an insertion moves boundaries only near itself.

What is compared over the whole corpus, by 128-bit digest, are runs of chunks: from each chunk on, as many as have
``MIN_WORDS`` words. A run is a repeat if a document before has it, in one piece; the first such document is its source.
So short phrases that many documents have never add up to a passage that none has. Repeated runs that go on in the same
place of the same source make a span. A passage of over 50 words yields one wherever it stands; a stray common line
doesn't. The first document keeps its text.

Documents are ordered by id, those without one last, and where several texts share an id or lack one, by the texts' hash;
each such text is a document of its own. Nulls and odd cases: a null or empty text has no chunks; rows that repeat id and
text are one document, reported once and cut alike; 64 KiB without a new run's words end a passage; other columns are
carried along untouched, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WHITE_SPACE, cut_lineage, map_batches, sliced, written

WORDS_A_CHUNK = 5
#: Bytes of a chunk: no boundary before the first bound, and one after the second whatever the hash says.
CHUNK_BYTES = (12, 128)
MIN_WORDS = 16
#: Bytes of a run, fewer than that.
_LONGEST = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE_SPACE)] = True


def gear_table(seed: int = 7) -> np.ndarray:
    """256 random 32-bit numbers, the same everywhere."""
    return np.frombuffer(b"".join(xxhash.xxh32(bytes([i]), seed).digest() for i in range(256)), ">u4").astype(np.uint32)


_GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte. Doubling: a hash over 2 k bytes is made of two over k bytes."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def _forced(raw: np.ndarray, last: int) -> int:
    """The end of a chunk from ``last`` in whose reach no word ends: the place between characters with the smallest hash."""
    least, most = CHUNK_BYTES
    lo = max(0, last - 31)
    h = (gear_hashes(raw[lo : last + most]) & np.uint32(0xFFFF))[last - lo :]
    usable = raw[last + 1 : last + most + 1] & 0xC0 != 0x80
    usable[: least - 1] = False
    at = np.flatnonzero(usable)
    return last + int(at[np.argmin(h[at])]) + 1


def boundaries(data: bytes) -> list[int]:
    """Where chunks begin and end: 0, ..., len(data)."""
    n = len(data)
    if not n:
        return [0]
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    ends = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))  # a space after a word
    hashes = np.zeros(len(ends), np.uint16)
    bound, (least, most) = 65536 // WORDS_A_CHUNK, CHUNK_BYTES
    step = 1 << 22
    for at in range(0, n, step):  # long texts in pieces, each with the 32 bytes before it
        lo = max(0, at - 32)
        h = gear_hashes(raw[lo : at + step])[at - lo :]
        i, j = np.searchsorted(ends, (at, at + step))
        hashes[i:j] = h[ends[i:j] - at] & np.uint32(0xFFFF)
    out, last = [0], 0
    for c in [*ends[hashes < bound].tolist(), n]:
        end = min(c + 1, n)
        while end - last > most:  # after the word with the smallest hash in reach
            i, j = np.searchsorted(ends, (last + least - 1, last + most))
            last = int(ends[i + np.argmin(hashes[i:j])]) + 1 if i < j else _forced(raw, last)
            out.append(last)
        if end - last >= least or end == n:
            if end > last:
                out.append(end)
            last = end
    return out


def runs_of_chunks(data: bytes, min_words: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The digest of each run of chunks of at least ``min_words`` words; its place (start, bytes, words); the words before it."""
    at = np.array(boundaries(data), np.int64)
    if len(at) < 2:
        return [], at[:0], at[:0]
    letter = ~_SPACE[np.frombuffer(data, np.uint8)]
    begins = np.cumsum(letter & ~np.concatenate([[False], letter[:-1]]), dtype=np.int32)
    words = begins[at[1:] - 1] - begins[at[:-1]] + letter[at[:-1]]  # a word that a chunk cuts counts on both sides
    before = np.concatenate([[0], np.cumsum(words)])
    first = np.flatnonzero(words)
    last = np.searchsorted(before, before[first] + min_words)
    first, last = first[last < len(at)], last[last < len(at)]
    size = at[last] - at[first]
    first, last, size = (x[size < _LONGEST] for x in (first, last, size))
    start = at[first]
    digests = [xxhash.xxh3_128_digest(data[i : i + n]) for i, n in zip(start.tolist(), size.tolist(), strict=True)]
    return digests, start << 26 | size << 10 | before[last] - before[first], before[first]


def run_rows(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc, th, hi, lo, place, word) for each run of chunks: the document's id and its text's hash, the run's digest in two
    halves; place holds start, bytes and words; word is the number of words before it."""
    if not 0 < min_words < 900:
        raise ValueError("min_words must be from 1 to 899")
    docs = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    names = ["hi", "lo", "place", "word"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            found = [runs_of_chunks((t or "").encode("utf-8", "surrogatepass"), min_words) for t in b.column(2).to_pylist()]
            sizes = [len(d) for d, _, _ in found]
            halves = np.frombuffer(b"".join(x for d, _, _ in found for x in d), ">i8").reshape(-1, 2).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            places, words = (np.concatenate([f[i] for f in found]) for i in (1, 2))
            columns = (halves[:, 0], halves[:, 1], places, words)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), *map(pa.array, columns)], ["doc", "th", *names])

    kind = docs.schema["doc"].dataType.simpleString()
    return map_batches(docs, work, f"doc {kind}, th long, hi long, lo long, place long, word long")


def _repeated(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc, th, span_start, span_end, n_words, source_doc_id, source_start) for each repeated span."""
    rows, digest = run_rows(docs, id_col, text_col, min_words), ["hi", "lo"]
    start, size, words = F.shiftright("place", 26), F.shiftright("place", 10).bitwiseAND(65535), F.col("place").bitwiseAND(1023)
    # the extremes of a hash of the document tell whether two have the run; they combine before the shuffle
    key = F.xxhash64("doc", "th")
    shared = rows.groupBy(*digest).agg(F.min(key).alias("one"), F.max(key).alias("other"))
    shared = cut_lineage(shared.where("one <> other").select(*digest))
    again = written(rows.join(shared, digest), "chunks")
    order = F.struct(F.col("doc").isNull(), F.col("doc").alias("doc"), F.col("th").alias("th"), start.alias("start"))
    first = again.groupBy(*digest).agg(F.min(order).alias("s"))
    first = cut_lineage(first).select(*digest, F.col("s.doc").alias("s_doc"), F.col("s.th").alias("s_th"), F.col("s.start").alias("s_start"))
    found = again.join(first, digest).where(~(F.col("doc").eqNullSafe(F.col("s_doc")) & (F.col("th") == F.col("s_th"))))
    last = F.col("word") + words
    found = found.select("doc", "th", start.alias("start"), (start + size).alias("end"), "word", last.alias("last"), "s_doc", "s_th", "s_start").distinct()
    # a span goes on where its runs overlap and stand as far apart in the same source
    same = Window.partitionBy("doc", "th", "s_doc", "s_th", F.col("start") - F.col("s_start")).orderBy("start")
    new = F.coalesce(F.lag("end").over(same) < F.col("start"), F.lit(True)).cast("int")
    spans = found.withColumn("new", new).withColumn("span", F.sum("new").over(same))
    spans = spans.groupBy("doc", "th", "s_doc", "s_th", (F.col("start") - F.col("s_start")).alias("shift"), "span").agg(
        F.min("start").alias("span_start"), F.max("end").alias("span_end"), (F.max("last") - F.min("word")).alias("n_words"), F.min("s_start").alias("source_start")
    )
    return spans.select("doc", "th", "span_start", "span_end", "n_words", F.col("s_doc").alias("source_doc_id"), "source_start")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, span_start, span_end, n_words, source_doc_id, source_start): bytes of the text that one document before it
    has, word for word from source_start on. Spans with other sources may overlap."""
    return _repeated(docs, id_col, text_col, min_words).withColumnRenamed("doc", "doc_id").drop("th")


def _cuts(spans: DataFrame) -> DataFrame:
    """(doc, th, cuts): the spans of each document, joined where they overlap, in order."""
    order = Window.partitionBy("doc", "th").orderBy("span_start", "span_end")
    reach = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(reach < F.col("span_start"), F.lit(True)).cast("int")
    parts = spans.withColumn("new", new).withColumn("cut", F.sum("new").over(order)).groupBy("doc", "th", "cut")
    parts = parts.agg(F.struct(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).alias("span"))
    return cut_lineage(parts.groupBy("doc", "th").agg(F.sort_array(F.collect_list("span")).alias("cuts")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated spans cut out of the texts (and ``length_col`` counted anew); documents that keep no word
    go."""
    cuts = _cuts(_repeated(docs, id_col, text_col, min_words)).withColumnsRenamed({"doc": "c_doc", "th": "c_th"})
    # the input's columns travel in one struct, so that no name of theirs can clash
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"))
    rows = packed.join(cuts, F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("th") == F.col("c_th")), "left")
    text = F.col("row")[text_col]
    data = text.cast("binary")
    # what stands before each span, then what follows the last one
    begin = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts.span_end"))
    end = F.concat(F.col("cuts.span_start"), F.array(F.octet_length(text).cast("long")))
    piece = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda i: F.substring(data, (begin[i] + 1).cast("int"), (end[i] - begin[i]).cast("int")))
    left = F.aggregate(piece, F.lit(b""), lambda s, x: F.concat(s, x)).cast("string")
    whole = F.col("cuts").isNull()
    rows = rows.select("row", whole.alias("whole"), F.when(whole, text).otherwise(left).alias("left"))
    rows = rows.where(F.col("whole") | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    kept = {c: F.col("row")[c] for c in docs.columns}
    kept[text_col] = F.col("left")
    if length_col in docs.columns:
        kept[length_col] = F.when(F.col("whole"), kept[length_col]).otherwise(F.length("left")).cast(docs.schema[length_col].dataType)
    return rows.select(*(value.alias(c) for c, value in kept.items()))
