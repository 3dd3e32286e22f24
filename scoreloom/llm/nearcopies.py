"""Near copies by words: texts whose sets of five-word shingles have a Jaccard similarity of at least ``ALIKE``.

MinHash bands find candidates: ``BANDS`` bands of ``ROWS`` minima, of which a pair of similarity s shares at least one
with probability 1 - (1 - s^ROWS)^BANDS, 0.9999 at 0.8. Every candidate is then compared on its whole sets (of 64-bit
shingle hashes), so nothing below the similarity is linked. The texts that share a band are a bucket; each is first
compared with the bucket's most typical text (the one with most company over all its bands), which joins most of a
large group with one comparison a text. Buckets that are still in several components are cut into leaves, and all
their leaves are compared with each other; of the links found there only a spanning forest is kept.

Nulls and odd cases: words are split at ASCII white space and lower-cased (ASCII), as for SimHash; fewer than five words
are one shingle; texts without words, null ones too, are copies of each other and of nothing else. Other columns are
carried along untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import cut_lineage, map_batches, sliced, written
from .simhash import forest, keep_first
from .simhash import keep_one_each as keep_by_simhash

SHINGLE = 5
#: Similarity of near copies, as a fraction, so that the comparison is exact.
ALIKE = (4, 5)
BANDS, ROWS = 24, 5
SEED = 42
#: Texts of one leaf, and shingles of one leaf of several texts, at most.
LEAF, LEAF_SHINGLES = 128, 1 << 15
_RANDOM = np.random.default_rng(SEED)
_PLACES, _TURNS, _MIX = (_RANDOM.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1) for n in (SHINGLE, BANDS * ROWS, ROWS))
_OF_BAND = _RANDOM.integers(0, 2**63, BANDS).astype(np.uint64)


# --- sketches -----------------------------------------------------------------------------------------------------
def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _scatter(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(w, SEED) for w in words]), ">u8").astype(np.uint64)
    size = min(SHINGLE, len(h))
    total = np.zeros(len(h) - size + 1 if size else 0, np.uint64)
    for i in range(size):
        total += h[i : i + len(total)] * _PLACES[i]
    return np.unique(_scatter(total))


def bands(found: np.ndarray) -> np.ndarray:
    """A hash for each band; none for a text without words."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[at : at + 1024] * _TURNS[:, None]).min(axis=1), out=least)
    rows = _scatter(least).reshape(BANDS, ROWS) * _MIX
    return _scatter(rows.sum(axis=1, dtype=np.uint64) + _OF_BAND).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, key, size, bands): th is the text's hash, key that of its words, size its number of shingles."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            keys, sizes, hashes = [], [], []
            for text in b.column(2).to_pylist():
                words = _words(text)
                found = shingles(words)
                keys.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                sizes.append(len(found))
                hashes.append(bands(found))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(hashes)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists], ["doc_id", "th", "key", "size", "bands"])

    return map_batches(docs, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, key long, size long, bands array<long>")


def _sets(docs: DataFrame, chosen: DataFrame, text_col: str) -> DataFrame:
    """``chosen(key, th)`` to (key, shingles), the hashes as bytes."""
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).join(chosen, "th")
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(_words(t)).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["key", "shingles"])

    return map_batches(texts, work, "key long, shingles binary")


# --- comparisons --------------------------------------------------------------------------------------------------
def _alike(shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``shared`` of ``sizes`` shingles together is similar enough."""
    return ALIKE[1] * shared >= ALIKE[0] * (sizes - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` whose sets are alike."""
    a, b = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"of_{k}")) for k in ("u", "v"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", "of_u", "of_v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (p, q))
                keep.append(bool(_alike(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep))

    return map_batches(both, work, "u long, v long")


_LEAVES = "h long, node long, members array<long>, labels array<long>, sets array<binary>"


def _leaves(rows: DataFrame) -> DataFrame:
    """``rows(h, key, label, shingles)``, sorted by h and key, to leaves of each bucket."""
    schema = pa.schema([("h", pa.int64()), ("node", pa.int64()), ("members", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("sets", pa.list_(pa.binary()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0

        def leaf() -> pa.RecordBatch:
            row = {"h": held[0][0], "node": held[0][1], "members": [r[1] for r in held], "labels": [r[2] for r in held], "sets": [r[3] for r in held]}
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            for row in zip(*(b.column(i) for i in range(4)), strict=True):
                row = tuple(x.as_py() for x in row)  # noqa: PLW2901
                size = len(row[3]) // 8
                if held and (row[0] != held[0][0] or len(held) >= LEAF or weight + size > LEAF_SHINGLES):
                    yield leaf()
                    held, weight = [], 0
                held.append(row)
                weight += size
        if held:
            yield leaf()

    return map_batches(rows, work, _LEAVES)


def _near(sets: list[np.ndarray]) -> np.ndarray:
    """The symmetric matrix of links between sets."""
    sizes = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(at, minlength=len(values)) > 1  # the rest is in one set only
    keep = often[at]
    place = (np.cumsum(often) - 1)[at[keep]]
    owner, n = owner[keep], int(often.sum())
    shared = np.zeros((len(sets), len(sets)))
    for lo in range(0, n, 8192):
        here = (place >= lo) & (place < lo + 8192)
        there = np.zeros((len(sets), min(8192, n - lo)), np.float32)
        there[owner[here], place[here] - lo] = 1
        shared += there @ there.T
    return _alike(np.rint(shared).astype(np.int64), sizes[:, None] + sizes[None, :])


def _across(leaves: DataFrame) -> DataFrame:
    """Links (u, v) between texts of different components, over all pairs of leaves of a bucket."""
    x = leaves.select("h", *(F.col(c).alias(f"x_{c}") for c in leaves.columns[1:]))
    y = leaves.select("h", *(F.col(c).alias(f"y_{c}") for c in leaves.columns[1:]))
    one = "array_max(array_union(x_labels, y_labels)) = array_min(array_union(x_labels, y_labels))"
    pairs = x.join(y, "h").where(f"x_node <= y_node and not {one}")
    pairs = pairs.select("x_members", "x_labels", "x_sets", "y_members", "y_labels", "y_sets")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, labels, sets = (np.concatenate([np.asarray(batch.column(c + s)[row].values).astype(np.int64) for s in (0, 3)]) if c < 2 else [np.frombuffer(z.as_buffer(), np.uint64) for s in (0, 3) for z in batch.column(c + s)[row].values] for c in range(3))
                near = _near(sets) & (labels[:, None] != labels[None, :])
                if found := forest(near):
                    i, j = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(keys[j])], ["u", "v"])

    return map_batches(pairs, work, "u long, v long")


# --- the operator -------------------------------------------------------------------------------------------------
def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, label), one row for each row of ``docs``; label names the group."""
    rows = cut_lineage(sketches(docs, id_col, text_col))
    texts = cut_lineage(rows.groupBy("key").agg(F.min("th").alias("th"), F.min("size").alias("size"), F.min("bands").alias("bands")))
    members = texts.select("key", "size", F.explode("bands").alias("h"))
    shared = members.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(members.join(shared, "h"))
    company = members.groupBy("key").agg(F.sum("n").alias("company"))
    ranked = members.join(company, "key")
    typical = ranked.groupBy("h").agg(F.max(F.struct("company", "key", "size")).alias("t"))
    fits = f"key <> t.key and least(size, t.size) * {ALIKE[1]} >= greatest(size, t.size) * {ALIKE[0]}"
    pairs = cut_lineage(members.join(typical, "h").where(fits).select(F.col("key").alias("u"), F.col("t.key").alias("v")).distinct())
    chosen = texts.join(members.select("key").distinct(), "key", "left_semi").select("key", "th")
    sets = cut_lineage(_sets(docs, chosen, text_col))
    links = cut_lineage(_confirmed(pairs, sets))
    labels = components(links).select(F.col("node").alias("key"), "label")

    placed = members.select("h", "key").join(labels, "key", "left").select("h", "key", F.coalesce("label", "key").alias("label"))
    mixed = placed.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("h")
    open_rows = placed.join(mixed, "h", "left_semi").join(sets, "key").select("h", "key", "label", "shingles")
    leaves = cut_lineage(_leaves(open_rows.repartitionByRange("h", "key").sortWithinPartitions("h", "key")))
    labels = components(links.unionByName(_across(leaves))).select(F.col("node").alias("key"), "label")
    return rows.join(labels, "key", "left").select("doc_id", "th", F.coalesce("label", "key").alias("label"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each group of near copies: the one with the smallest doc_id, as in SimHash."""
    return keep_first(docs, grouped(docs, id_col, text_col), id_col, text_col)


def keep_one_of_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near duplicates: one row stays of each group by SimHash, and of those one of each group of near copies
    that SimHash's few bits don't tell."""
    first = written(keep_by_simhash(docs, id_col, text_col), "near-dedup")
    return keep_one_each(first, id_col, text_col)
