"""Draws with replacement by hash: how often each row of a class is drawn in each replicate.

Draw k of class y in replicate r takes the row of rank ``hash(seed:r:y:k)`` modulo the class's size. Tasks make the draws of
some thousand k in some replicates at once and send each block of ranks what fell into it, two bytes a draw; a block's rows
then get their counts, a byte for each replicate. No row is made for a draw, and no task sees all rows of a class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Draws of a class and replicates that are made at once, ranks of a block (their places in it fit two bytes).
DRAWS, TOGETHER, BLOCK = 1 << 15, 32, 1 << 14

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0)
_DRAWN = "y int, block long, first int, sizes binary, places binary"


def sha1_head(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first 32 bits of the SHA-1 of n messages of one block each, given as their sixteen words, padding included."""
    w = [np.array(np.broadcast_to(np.asarray(x, np.uint32), n)) for x in words]
    a, b, c, d, e = (np.full(n, x, np.uint32) for x in _START)
    f, room = np.empty(n, np.uint32), np.empty(n, np.uint32)

    def turned(x: np.ndarray, by: int, out: np.ndarray, spare: np.ndarray) -> None:
        np.right_shift(x, np.uint32(32 - by), out=spare)
        np.left_shift(x, np.uint32(by), out=out)
        np.bitwise_or(out, spare, out=out)

    for t in range(80):
        x = w[t % 16]
        if t >= 16:
            for back in (3, 8, 14):
                np.bitwise_xor(x, w[(t - back) % 16], out=x)
            turned(x, 1, x, room)
        if t < 20:
            step = 0x5A827999
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif 40 <= t < 60:
            step = 0x8F1BBCDC
            np.bitwise_or(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_and(b, c, out=room)
            np.bitwise_or(f, room, out=f)
        else:
            step = 0x6ED9EBA1 if t < 40 else 0xCA62C1D6
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        for term in (f, x, np.uint32(step)):
            np.add(e, term, out=e)
        turned(a, 5, f, room)
        np.add(e, f, out=e)
        turned(b, 30, b, room)
        a, b, c, d, e = e, a, b, c, d
    return a + np.uint32(_START[0])


def heads(prefix: bytes, numbers: np.ndarray) -> np.ndarray:
    """The first 32 bits of the SHA-1 of ``prefix`` and a number's digits, for ascending numbers of equally many digits."""
    digits = len(str(numbers[-1]))
    size = len(prefix) + digits
    if size > 55:
        raise ValueError("seed, replicate, class and draw must fit 55 characters")
    block = bytearray(64)
    block[: size + 1] = prefix + bytes(digits) + b"\x80"
    block[56:] = (8 * size).to_bytes(8, "big")
    words: list[np.ndarray | int] = [int.from_bytes(block[i : i + 4], "big") for i in range(0, 64, 4)]
    for i in range(digits):
        at = len(prefix) + i
        digit = (numbers // 10 ** (digits - 1 - i) % 10 + 48).astype(np.uint32)
        words[at // 4] = words[at // 4] | digit << np.uint32(24 - at % 4 * 8)
    return sha1_head(words, len(numbers))


def _of_job(y: int, size: int, begin: int, first: int, last: int, seed: int) -> pa.RecordBatch:
    """Draws ``begin`` and on of class y in replicates first to last, a row for each block of ranks: how many each replicate
    has there, and their places in it, replicate after replicate."""
    end = min(size, begin + DRAWS)
    edges = [begin, *(10**d for d in range(1, len(str(end))) if begin < 10**d < end), end]
    spans = [np.arange(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False)]
    hashes = [heads(f"{seed}:{r}:{y}:".encode(), span) for r in range(first, last) for span in spans]
    ranks = np.concatenate(hashes).astype(np.int64) % size
    blocks, n = ranks // BLOCK, last - first
    counts = np.bincount(blocks * n + np.repeat(np.arange(n), end - begin), minlength=n * -(-size // BLOCK)).reshape(-1, n)
    kind = np.uint16 if counts.shape[0] <= 1 << 16 else np.int64  # numbers of two bytes sort by their digits
    places = (ranks % BLOCK).astype(np.uint16)[np.argsort(blocks.astype(kind), kind="stable")]
    ends = np.cumsum(counts.sum(axis=1))
    hit = np.flatnonzero(counts.any(axis=1))
    columns = [pa.array(np.full(len(hit), y, np.int32)), pa.array(hit.astype(np.int64)), pa.array(np.full(len(hit), first, np.int32))]
    columns.append(pa.array([counts[i].astype(np.uint32).tobytes() for i in hit], pa.binary()))
    columns.append(pa.array([places[ends[i] - counts[i].sum() : ends[i]].tobytes() for i in hit], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["y", "block", "first", "sizes", "places"])


def drawn(spark: SparkSession, sizes: dict[int, int], replicates: int, seed: int) -> DataFrame:
    """(y, block, first, sizes, places): all draws of the classes y of so many rows, packed by blocks of ranks."""
    groups = -(-replicates // TOGETHER)
    jobs = {y: -(-size // DRAWS) * groups for y, size in sorted(sizes.items())}
    total = sum(jobs.values())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for job in b.column(0).to_pylist():
                for y, n in jobs.items():
                    if job < n:
                        at, group = divmod(job, groups)
                        yield _of_job(y, sizes[y], at * DRAWS, group * TOGETHER, min(replicates, (group + 1) * TOGETHER), seed)
                        break
                    job -= n

    parts = max(1, min(total, max(spark.sparkContext.defaultParallelism, total // 4)))
    return spark.range(0, total, 1, parts).mapInArrow(work, _DRAWN)


def _counts(replicates: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(items: pa.Table, packed: pa.Table) -> pa.Table:
        found = np.zeros((replicates, BLOCK), np.uint8)
        packed = packed.sort_by("first")
        firsts = packed["first"].to_numpy()
        sizes, places = (packed[c].to_pylist() for c in ("sizes", "places"))
        edges = [*np.flatnonzero(np.diff(firsts, prepend=-1)).tolist(), len(firsts)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            n = len(sizes[lo]) // 4
            own = np.concatenate([np.repeat(np.arange(n), np.frombuffer(x, np.uint32)) for x in sizes[lo:hi]])
            at = own * BLOCK + np.frombuffer(b"".join(places[lo:hi]), np.uint16)
            counts = np.bincount(at, minlength=n * BLOCK).reshape(n, BLOCK)
            if counts.max() > 255:
                raise OverflowError("a row was drawn more than 255 times in a replicate")
            found[firsts[lo] : firsts[lo] + n] = counts
        of_items = np.ascontiguousarray(found.T[items["rank"].to_numpy() % BLOCK])
        weights = pa.FixedSizeBinaryArray.from_buffers(pa.binary(replicates), len(of_items), [None, pa.py_buffer(of_items)]).cast(pa.binary())
        return items.select(["grp", "s", "y"]).append_column("x0", weights).append_column("part", items["part"])

    return work


def with_counts(rows: DataFrame, sizes: dict[int, int], replicates: int, seed: int) -> DataFrame:
    """``rows(grp, s, y, rank, part)``, ``rank`` from 0 within its class y, to (grp, s, y, x0, part): x0 is how often a row is
    drawn in each replicate, a byte each."""
    by = ["y", "block"]
    items = rows.withColumn("block", F.floor(F.col("rank") / BLOCK)).groupBy(*by)
    packed = drawn(rows.sparkSession, sizes, replicates, seed).groupBy(*by)
    return items.cogroup(packed).applyInArrow(_counts(replicates), "grp string, s double, y int, x0 binary, part int")
