"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints that differ in at most ``BITS_APART`` = 3 of 64 bits agree in at least one of four blocks of 16 bits, so four
orderings of the index, each with another block in front, meet every pair. In an ordering the codes are sorted by their
rank in the Gray sequence, in which neighbours differ in one bit, so codes that stand together share many bits. The index
is a tree over that order: the block in front is the pattern of an upper node, which its codes share without a difference;
below, ``FANOUT`` neighbouring nodes, and at the bottom ``LEAF`` codes, make a node with the mask and pattern of the bits that
all its codes share. The search walks down with pairs of nodes. Each pair carries the difference accumulated so far and
the bits it was counted over; going down counts only bits newly shared, and a pair beyond ``BITS_APART`` is pruned with all
that is below it. Only leaves compare codes. Of the links that are found in a node only a spanning forest is kept, which
loses no connection.

The codes of one upper node are searched in one task, as long as they are at most ``HELD``; larger ones are cut into blocks
of neighbours, whose tree is walked level by level as Spark joins in the same way, and each pair of blocks that is left is
a task's work.

Nulls and odd cases: a null or empty text has fingerprint zero and is linked like any other; fewer than three words are
one shingle; a null doc_id keeps its row, and never becomes a component id unless no document that can be reached has
one (then the id is null). Repeated rows each get a row. Other columns of the input are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import cut_lineage, map_batches, sliced

BITS_APART = 3
SHINGLE = 3
SEED = 42
#: Bits of each of the four blocks.
BLOCK_BITS = 16
#: Codes of a leaf, children of a node; groups of up to SMALL codes are one leaf.
LEAF, FANOUT, SMALL = 16, 8, 48
#: Codes of an upper node that a task holds; larger ones are cut into blocks of neighbours.
HELD, BLOCK = 1 << 18, 1 << 15
#: Pairs of nodes that a task expands at once.
_WIDE = 1 << 14


# --- fingerprints -------------------------------------------------------------------------------------------------
def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the lower-cased text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(shingles), 1 << 15):
        block = b"".join([digest(s, SEED) for s in shingles[at : at + (1 << 15)]])
        ones += np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp): the text's hash, and the fingerprint as the signed long with the same bits."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            fps = np.fromiter(map(fingerprint, b.column(2).to_pylist()), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "th", "fp"])

    return map_batches(docs, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, fp long")


# --- orderings ----------------------------------------------------------------------------------------------------
def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def turned(fps: np.ndarray, t: int) -> np.ndarray:
    """The codes of ordering ``t``: block t in front, the others after it in a circle."""
    left = np.uint64(BLOCK_BITS * t)
    return (fps << left) | (fps >> np.uint64(64 - BLOCK_BITS * t)) if t else fps


def _orderings(distinct: DataFrame) -> DataFrame:
    """A row (part, side, rank, fp) for each fingerprint and ordering: part names the ordering and its upper node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t in range(64 // BLOCK_BITS):
                codes = turned(fps, t)
                part = (codes >> np.uint64(64 - BLOCK_BITS)).astype(np.int64) | (t << BLOCK_BITS)
                rank = (gray_rank(codes) >> np.uint64(1)).view(np.int64)  # the lowest bit would only order two codes
                columns = [pa.array(part), pa.array(np.zeros(len(fps), np.int32)), pa.array(rank), pa.array(fps.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "side", "rank", "fp"])

    return map_batches(distinct.select("fp"), work, "part long, side int, rank long, fp long")


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    left, found = set(range(len(near))), []
    while left:
        front = [left.pop()]
        while front:
            at = front.pop()
            new = [j for j in np.flatnonzero(near[at]).tolist() if j in left]
            left.difference_update(new)
            found += [(at, j) for j in new]
            front += new
    return found


# --- the tree within a task ---------------------------------------------------------------------------------------
def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) of the nodes of each level, from the leaves up."""
    low, high = (f.reduceat(fps, np.arange(0, len(fps), LEAF)) for f in (np.bitwise_and, np.bitwise_or))
    out = []
    while True:
        mask = ~(low ^ high)
        out.append((mask, low & mask))
        if len(low) <= FANOUT:
            return out
        at = np.arange(0, len(low), FANOUT)
        low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)


class _Forest:
    """Links that connect codes which none before connects."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        a, b = self.label[u], self.label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        _, one = np.unique(np.minimum(a, b) * len(self.label) + np.maximum(a, b), return_index=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for k in one.tolist():
            x, y = find(int(a[k])), find(int(b[k]))
            if x != y:
                root[max(x, y)] = min(x, y)
                self.links.append((int(u[k]), int(v[k])))
        if root:
            change = np.arange(len(self.label))
            change[list(root)] = [find(x) for x in root]
            self.label = change[self.label]


def tree_links(x: np.ndarray, y: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Places (in x followed by y) of codes at most ``BITS_APART`` apart: between x and y, or within x. Each is in Gray order.
    Only links that connect something new."""
    own = y is None
    levels_x = _levels(x)
    levels_y = levels_x if own else _levels(y)
    height = max(len(levels_x), len(levels_y))
    for levels in (levels_x, levels_y):
        while len(levels) < height:  # nodes of one child: the same nodes again
            levels.append(levels[-1])
    other = x if own else y
    forest = _Forest(len(x) if own else len(x) + len(y))
    leaf_x, leaf_y = (np.concatenate([c, np.repeat(c[-1:], -len(c) % LEAF)]).reshape(-1, LEAF) for c in (x, other))
    step_x, step_y = ([(len(a[0]) > len(b[0])) for a, b in zip(levels, levels[1:])] for levels in (levels_x, levels_y))

    def children(nodes: np.ndarray, level: int, levels: list, steps: list) -> tuple[np.ndarray, np.ndarray]:
        """The children of each node, and whether each is there."""
        if not steps[level]:
            return nodes[:, None], np.ones((len(nodes), 1), bool)
        below = nodes[:, None] * FANOUT + np.arange(FANOUT)
        return below, below < len(levels[level][0])

    def pruned(i: np.ndarray, j: np.ndarray, level: int, known: np.ndarray, apart: np.ndarray) -> tuple:
        (mask_x, is_x), (mask_y, is_y) = levels_x[level], levels_y[level]
        both = mask_x[i] & mask_y[j]
        apart = apart + np.bitwise_count((is_x[i] ^ is_y[j]) & both & ~known)
        keep = apart <= BITS_APART
        return i[keep], j[keep], (both | known)[keep], apart[keep]

    top = height - 1
    i, j = (z.ravel() for z in np.meshgrid(*(np.arange(len(levels[top][0])) for levels in (levels_x, levels_y)), indexing="ij"))
    if own:
        i, j = i[i <= j], j[i <= j]
    work = [(top, *pruned(i, j, top, np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint8)))]
    while work:
        level, i, j, known, apart = work.pop()
        if not len(i):
            continue
        wide = _WIDE // (LEAF if level == 0 else 1)
        if len(i) > wide:
            work += [(level, i[k : k + wide], j[k : k + wide], known[k : k + wide], apart[k : k + wide]) for k in range(0, len(i), wide)]
        elif level:
            down_x, there_x = children(i, level - 1, levels_x, step_x)
            down_y, there_y = children(j, level - 1, levels_y, step_y)
            there = there_x[:, :, None] & there_y[:, None, :]
            if own:
                there &= down_x[:, :, None] <= down_y[:, None, :]
            pair, a, b = np.nonzero(there)
            work.append((level - 1, *pruned(down_x[pair, a], down_y[pair, b], level - 1, known[pair], apart[pair])))
        else:
            pair, a, b = np.nonzero(np.bitwise_count(leaf_x[i][:, :, None] ^ leaf_y[j][:, None, :]) <= BITS_APART)
            u, v = i[pair] * LEAF + a, j[pair] * LEAF + b
            good = (u < len(x)) & (v < len(other)) & ((u < v) if own else True)
            forest.add(u[good], v[good] + (0 if own else len(x)))
    return forest.links


def small_links(fps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small groups at once: ``starts`` has where each begins, and the end."""
    lens = np.diff(starts)
    after = np.repeat(starts[1:], lens) - np.arange(len(fps))  # codes of the group from here on
    label, out = np.arange(len(fps)), []
    for k in range(1, int(lens.max(initial=0))):
        i = np.flatnonzero(after > k)
        i = i[np.bitwise_count(fps[i] ^ fps[i + k]) <= BITS_APART]
        i = i[label[i] != label[i + k]]
        label[i] = label[i + k] = np.minimum(label[i], label[i + k])  # equal labels: connected by links before
        out.append((i, i + k))
    u, v = (np.concatenate([p[s] for p in out]) if out else np.zeros(0, np.int64) for s in (0, 1))
    return fps[u], fps[v]


def _searched(rows: DataFrame) -> DataFrame:
    """``rows(part, side, rank, fp)``, each part whole and sorted in one partition, to links (u, v): within a part of one side,
    between the sides of one with two."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((0, 3), np.int64)]

        def search(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Links of whole parts."""
            starts = np.concatenate([[0], np.flatnonzero(np.diff(rows[:, 0])) + 1, [len(rows)]])
            fps, sides, lens = np.ascontiguousarray(rows[:, 2]).view(np.uint64), rows[:, 1], np.diff(starts)
            two = np.zeros(len(lens), bool) if not sides.any() else np.logical_or.reduceat(sides > 0, starts[:-1])
            small = (lens <= SMALL) & ~two
            keep = np.repeat(small, lens)
            u, v = small_links(fps[keep], np.concatenate([[0], np.cumsum(lens[small])]))
            yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)) for z in (u, v)], ["u", "v"])
            for k in np.flatnonzero(~small).tolist():
                codes, first = fps[starts[k] : starts[k + 1]], int((sides[starts[k] : starts[k + 1]] == 0).sum())
                found = tree_links(codes[:first], codes[first:] if two[k] else None)
                if found:
                    i, j = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(codes[z].view(np.int64)) for z in (i, j)], ["u", "v"])

        for b in batches:
            rows = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 3)], axis=1)
            ends = np.flatnonzero(rows[:, 0] != rows[-1, 0])
            cut = int(ends[-1]) + 1 if len(ends) else 0
            done = [*held, rows[:cut]]
            if sum(map(len, done)) and (cut or held[-1][-1, 0] != rows[-1, 0]):
                yield from search(np.concatenate(done))
                held = [rows[cut:]]
            else:
                held.append(rows)
        last = np.concatenate(held)
        if len(last):
            yield from search(last)

    return map_batches(rows, work, "u long, v long")


# --- upper nodes that no task holds -------------------------------------------------------------------------------
def _blocks(rows: DataFrame) -> DataFrame:
    """``rows``, sorted, to blocks (part, block, low, high, fps) of at most ``BLOCK`` neighbours of one part."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("fps", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)

        def block(rows: np.ndarray) -> pa.RecordBatch:
            fps = np.ascontiguousarray(rows[:, 2])
            row = {"part": int(rows[0, 0]), "block": int(rows[0, 1]), "low": int(np.bitwise_and.reduce(fps)), "high": int(np.bitwise_or.reduce(fps)), "fps": fps}
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            held = np.concatenate([held, np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3)], axis=1)])
            while len(held) and (held[0, 0] != held[-1, 0] or len(held) >= BLOCK):
                same = int(np.searchsorted(held[:, 0], held[0, 0], side="right"))
                n = min(same, BLOCK)
                yield block(held[:n])
                held = held[n:]
        if len(held):
            yield block(held)

    return map_batches(rows, work, "part long, block long, low long, high long, fps array<long>")


def _across(rows: DataFrame) -> DataFrame:
    """Links of the parts that no task holds. ``rows`` has their codes."""
    blocks = cut_lineage(_blocks(rows.repartitionByRange("part", "rank").sortWithinPartitions("part", "rank")))
    order = Window.partitionBy("part").orderBy("block")
    level = blocks.select("part", "low", "high", (F.row_number().over(order) - 1).alias("node"), "block")
    levels = [cut_lineage(level)]
    while levels[-1].where(F.col("node") > 0).limit(1).count():
        up = F.floor(F.col("node") / FANOUT).cast("int")
        above = levels[-1].groupBy("part", up.alias("node")).agg(F.expr("bit_and(low)").alias("low"), F.expr("bit_or(high)").alias("high"))
        levels.append(cut_lineage(above))
    pairs = levels[-1].select("part", F.col("node").alias("x"), F.col("node").alias("y"), F.lit(0).cast("long").alias("known"), F.lit(0).alias("apart"))
    for nodes in reversed(levels):
        mask = F.expr("~(low ^ high)")
        side = nodes.select("part", "node", mask.alias("mask"), F.col("low").alias("pattern"), *(["block"] if "block" in nodes.columns else []))
        if nodes is not levels[-1]:  # to the children
            children = side.select("part", F.floor(F.col("node") / FANOUT).cast("int").alias("up"), F.col("node").alias("child"))
            pairs = pairs.join(children.withColumnsRenamed({"up": "x", "child": "cx"}), ["part", "x"])
            pairs = pairs.join(children.withColumnsRenamed({"up": "y", "child": "cy"}), ["part", "y"]).where("cx <= cy")
            pairs = pairs.select("part", F.col("cx").alias("x"), F.col("cy").alias("y"), "known", "apart")
        for z in "xy":
            pairs = pairs.join(side.select("part", *(F.col(c).alias(z if c == "node" else f"{z}_{c}") for c in side.columns[1:])), ["part", z])
        new = "(x_pattern ^ y_pattern) & x_mask & y_mask & ~known"
        pairs = pairs.withColumn("apart", F.expr(f"apart + bit_count({new})")).where(F.col("apart") <= BITS_APART)
        pairs = pairs.withColumn("known", F.expr("known | (x_mask & y_mask)"))
        kept = ["part", "x", "y", "known", "apart"]
        pairs = cut_lineage(pairs.select(*kept, *(["x_block", "y_block"] if "block" in nodes.columns else [])))
    pairs = cut_lineage(pairs.withColumn("pair", F.monotonically_increasing_id()))
    codes = blocks.select(F.col("part").alias("of"), "block", F.posexplode("fps").alias("place", "fp"))
    sides = pairs.select("pair", F.col("part").alias("of"), F.explode(F.expr("array_distinct(array(struct(0 as side, x_block as block), struct(if(x = y, 0, 1) as side, y_block as block)))")).alias("s"))
    sides = sides.select("pair", "of", "s.side", "s.block")
    both = codes.join(sides, ["of", "block"]).select(F.col("pair").alias("part"), "side", F.col("place").cast("long").alias("rank"), "fp")
    return _searched(both.repartition("part").sortWithinPartitions("part", "side", "rank"))


def links(distinct: DataFrame) -> DataFrame:
    """``distinct(fp)`` to links (u, v) that connect exactly the fingerprints which chains of close pairs connect."""
    rows = _orderings(distinct)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # at most 4 * 2^16 upper nodes, whatever the corpus
    large = cut_lineage(sizes.where(F.col("n") > HELD).select("part"))
    if large.isEmpty():
        return _searched(rows.repartition("part").sortWithinPartitions("part", "rank"))
    held = rows.join(F.broadcast(large), "part", "left_anti")
    found = _searched(held.repartition("part").sortWithinPartitions("part", "rank"))
    return found.unionByName(_across(rows.join(F.broadcast(large), "part", "left_semi")))


# --- the operator -------------------------------------------------------------------------------------------------
def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp, label, component_id): th is the text's hash, label names the group also where no id does."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col))
    reps = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = components(links(reps)).select(F.col("node").alias("fp"), "label")
    labelled = reps.join(labels, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_fp = labelled.join(smallest, "label").select("fp", "label", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "th", "fp", "label", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``."""
    return grouped(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each near-duplicate group: the one with the smallest doc_id (a null id comes
    last, then the text's hash decides; of rows that repeat both, one stays)."""
    return keep_first(docs, grouped(docs, id_col, text_col), id_col, text_col)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of ``docs`` with the smallest id of each label of ``groups(doc_id, th, label)``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")).alias("k")
    kept = groups.groupBy("label").agg(first).select(_id_key("k.doc_id").alias("id"), F.col("k.th").alias("th"))
    # the input's columns travel in one struct, so that no name of theirs can clash
    keyed = docs.select(F.struct(*docs.columns).alias("row"), _id_key(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    one = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.lit(0)))
    return keyed.join(kept, ["id", "th"], "left_semi").withColumn("n", one).where("n = 1").select("row.*")


def _id_key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
