"""Prefix trie of conversations: which beginnings conversations share, and the tokens that sharing them saves.

A turn is its role and text; a node is a distinct sequence of turns that a conversation begins with. Turns are reduced to
128-bit digests and lengths first, so no text leaves the first step. Conversations that are equal become one sequence with
the number of its conversations, its smallest id and the hash of all ids, before tries are built.

Sequences are hash-partitioned by the digest of their first turn. ``applyInPandas`` builds the tries of each partition:
a dictionary of pointers for each node, filled in one walk a sequence, then summed up in postorder with a stack of its own.
A first turn with more than ``GROUP_TURNS`` turns below it isn't built: its top node is aggregated in Spark, and its sequences are
partitioned anew by their next turn, round after round, until all groups are small. The tops that were split off are summed
up from the deepest round upwards. So a first turn that a third of all conversations have is spread over tasks by what
follows it, and copies of one conversation are one row before any group is built.

Ids that end at a node are hashed in ascending order: blocks of at most 4,096 neighbouring ids are joined to strings in Spark
and a task streams the blocks of a node through one hash, so that no list of ids is ever held.

Nulls and odd cases: a null role or text is empty; turns are ordered by number, null first, ties by digest; rows that
repeat a turn count each; rows without a conversation id belong to none and are left out; remainders have the sign of the
id, as in SQL; other columns are ignored; an empty table gives an empty result, all turnless conversations the root alone.
A conversation's digests (24 bytes a turn) are one row, which bounds a conversation to what a task holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, written

#: Turns of a group that is built as one trie.
GROUP_TURNS = 1 << 16
#: Ids that agree in all but so many bits make one string.
ID_BITS = 12
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, path): each conversation's turns in order, as digest and code points."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # the role's length first, so that no two turns are written alike
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.octet_length(role), F.concat(role, text)), 256), 1, 32))
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"), digest.alias("digest"), F.length(text).alias("size"))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t"))
    paths = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return paths.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("path"))


def rebuilt(paths: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % ``every`` (none if that is absent), h being
    crc32 of c in decimal, modulo ``heads``."""
    c = F.col("conv_id")
    base, h = c - c % every, (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    first = paths.where(c % every == 0).select(c.alias("base"), F.slice("path", 1, heads - 1).alias("head"))
    own = paths.select("conv_id", "path", base.alias("base"), h.alias("h"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("path", 1, 0))
    rest = F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0)))
    return own.join(first, "base", "left").select("conv_id", F.concat(head, rest).alias("path"))


def _id_hashes(rows: DataFrame) -> DataFrame:
    """``rows(key, conv_id)`` to (key, conv_id, n, ends): the smallest id, the ids, and the hash of all in ascending order."""
    block = F.shiftright("conv_id", ID_BITS).alias("block")
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    blocks = rows.groupBy("key", block).agg(F.array_join(ids, ",").alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    alike = blocks.repartition("key").sortWithinPartitions("key", "block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for b in batches:
            out = []
            for k, ids, n, low in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, first, total, state.hexdigest()))
                    key, first, total, state = k, low, n, hashlib.sha256(ids.encode())
                else:
                    total += n
                    state.update(f",{ids}".encode())
            if out:
                yield _batch(out)
        if key is not None:
            yield _batch([(key, first, total, state.hexdigest())])

    return map_batches(alike.select("key", "ids", "n", "conv_id"), work, "key binary, conv_id long, n long, ends string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True))
    return pa.RecordBatch.from_arrays(list(columns), ["key", "conv_id", "n", "ends"])


def distinct_sequences(paths: DataFrame) -> DataFrame:
    """(conv_id, n, ends, path): each distinct sequence once, under its smallest id."""
    whole = F.unhex(F.sha2(F.array_join(F.transform("path.digest", F.hex), ""), 256))
    paths = written(paths, "trie")
    return paths.join(_id_hashes(paths.select(whole.alias("key"), "conv_id")).drop("key"), "conv_id").select("conv_id", "n", "ends", "path")


def build(group: pd.DataFrame, level: int) -> pd.DataFrame:
    """The nodes of the tries of a group; the sequences of one key share their first ``level`` turns. Only a trie's top has a
    parent_key."""
    kids: list[dict[bytes, int]] = []
    low, members, ends, size, up, depth, parents, parent_keys = [], [], [], [], [], [], [], []

    def node(turn_size: int, above: int, place: int, parent: int | None = None, parent_key: bytes | None = None) -> int:
        kids.append({})
        values = (None, 0, EMPTY_HASH, turn_size, above, place, parent, parent_key)
        for column, value in zip((low, members, ends, size, up, depth, parents, parent_keys), values, strict=True):
            column.append(value)
        return len(kids) - 1

    tops: dict[bytes, int] = {}
    names = ("key", "conv_id", "n", "ends", "digests", "sizes", "parent_conv_id", "parent_key")
    for key, conv_id, n, hashed, digests, sizes, parent, parent_key in zip(*(group[c] for c in names), strict=True):
        at = tops.get(key)
        if at is None:
            at = tops[key] = node(int(sizes[level - 1]), -1, level, parent, parent_key)
        for place in range(level, len(digests) + 1):
            if low[at] is None or conv_id < low[at]:
                low[at] = conv_id
            members[at] += n
            if place == len(digests):
                ends[at] = hashed
                break
            child = kids[at].get(digests[place])
            if child is None:
                child = kids[at][digests[place]] = node(int(sizes[place]), at, place + 1)
            at = child
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for top in tops.values():
        stack = [(top, iter(kids[top].values()))]
        while stack:
            at, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                stack.append((child, iter(kids[child].values())))
                continue
            stack.pop()
            leaves[at] += not kids[at]
            saved[at] += (members[at] - 1) * size[at]
            if up[at] >= 0:
                leaves[up[at]] += leaves[at]
                saved[up[at]] += saved[at]
    above = [low[p] if p >= 0 else parent for p, parent in zip(up, parents, strict=True)]
    columns = (low, depth, above, members, [len(k) for k in kids], leaves, saved, ends)
    return pd.DataFrame(dict(zip((c.split()[0] for c in _NODE.split(", ")), columns, strict=True))).assign(parent_key=parent_keys)


def _builder(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda group: build(group, level)


def _tops(rows: DataFrame, level: int) -> DataFrame:
    """The groups that are too large: (key, parent_key, parent_conv_id, conv_id, n_convs, ends, own), own being the tokens that
    the node itself saves."""
    here = F.size("path") == level
    last = F.col("path")[level - 1]["size"] if level else F.lit(0)
    groups = rows.groupBy("key").agg(
        F.sum(F.size("path") - level + 1).alias("turns"), F.min("parent_key").alias("parent_key"), F.min("parent_conv_id").alias("parent_conv_id"), F.min("conv_id").alias("conv_id"),
        F.sum("n").alias("n_convs"), F.max(F.when(here, F.col("ends"))).alias("ends"), F.max(last).cast("long").alias("size"),
    )
    own = (F.col("n_convs") - 1) * F.col("size")
    return groups.select("key", "turns", "parent_key", "parent_conv_id", "conv_id", "n_convs", F.coalesce("ends", F.lit(EMPTY_HASH)).alias("ends"), own.alias("own"))


def nodes(paths: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """``paths(conv_id, path)`` to a row for each node of their trie: conv_id and parent_conv_id (smallest ids that begin like
    the node, like its parent), depth, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = written(distinct_sequences(paths).withColumns({"key": F.lit(b""), "parent_key": F.lit(None).cast("binary"), "parent_conv_id": F.lit(None).cast("long")}), "trie")
    names, built, tops = [c.split()[0] for c in _NODE.split(", ")], [], []
    level = 0
    while True:
        large = _tops(rows, level)
        large = written(large if level == 0 else large.where(F.col("turns") > group_turns), "trie")
        if level:
            # many small groups share a task's frame, of some GROUP_TURNS turns in all
            turns = rows.agg(F.sum(F.size("path") - level + 1)).first()[0] or 0
            bucket = F.pmod(F.xxhash64("key"), F.lit(1 + 4 * turns // group_turns)).alias("bucket")
            digests, sizes = F.col("path.digest").alias("digests"), F.col("path.size").alias("sizes")
            small = rows.join(large, "key", "left_anti").select(bucket, "key", "parent_key", "parent_conv_id", "conv_id", "n", "ends", digests, sizes)
            built.append(written(small.groupBy("bucket").applyInPandas(_builder(level), f"{_NODE}, parent_key binary"), "trie"))
        if large.isEmpty():
            break
        tops.append(large.drop("turns"))
        above = large.select("key", F.col("conv_id").alias("parent_conv_id"))
        deeper = rows.drop("parent_conv_id", "parent_key").where(F.size("path") > level).join(above, "key")
        following = F.unhex(F.sha2(F.concat("key", F.col("path")[level]["digest"]), 256))
        rows = written(deeper.select("conv_id", "n", "ends", "path", "parent_conv_id", F.col("key").alias("parent_key"), following.alias("key")), "trie")
        level += 1
    if not tops:
        return rows.sparkSession.createDataFrame([], _NODE)
    every = [part.select(*names) for part in built]
    below = None  # what the tops of the round below sum up to, by parent
    for depth in range(len(tops) - 1, -1, -1):
        sums = [F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
        parts = [built[depth].where("parent_key is not null").select("parent_key", "n_leaves", "saved_tokens")] if depth < len(built) else []
        children = reduce(DataFrame.unionByName, [*parts, *([below] if below is not None else [])])
        sums = children.groupBy(F.col("parent_key").alias("key")).agg(*sums)
        made = tops[depth].join(sums, "key", "left").select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.coalesce("saved_tokens", F.lit(0)) + F.col("own")).cast("long").alias("saved_tokens"),
            F.col("ends").alias("ends_sha256"), "parent_key",
        )
        made = written(made, "trie")
        every.append(made.select(*names))
        below = made.select("parent_key", "n_leaves", "saved_tokens")
    return reduce(DataFrame.unionByName, every)


def trie(turns: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """The nodes of all conversations, rebuilt with shared beginnings."""
    return nodes(rebuilt(sequences(turns)), group_turns)
