"""Repair of conversations' structure: the cheapest edits after which roles read user, assistant, user, assistant and so on,
after a system turn or none.

A conversation is a row of states: nothing yet, after the system turn, after a user's, after an assistant's. Keeping a turn
moves to the state of its role and is free; giving it the role that is due costs 3, deleting it 4, inserting an empty turn
of the role that is due 3; a cut-off turn that stays costs 3 more; blank and repeated turns must go. Conversations are
bucketed by length and laid out as tensors with time first: one vectorised step a turn, from the last to the first, finds
all conversations' least costs to the end from each state and stores them; then all are traced forward together, each
taking the first letter of Delete, Insert, Keep, Rerole that still costs the least. A state and a letter determine what
happens, so the edits are the least in ASCII order.

Rows shuffle twice. The tensors need no text: roles' initials, faults and a hash to find repeats by. The edits then meet the
texts in rows sorted within partitions, and a task streams each conversation through one hash, holding a batch of texts.

Nulls and odd cases: a null role, text, turn or id counts as one space where it is written out, null turns come first, rows
without an id are one conversation; ties of a number are in order of a hash of role and text, equal rows side by side;
other columns are ignored; an empty table gives an empty result. A conversation's numbers (some 50 bytes a turn), not its
texts, are held in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, sliced

#: States, and the state after the turn that is due in each.
START, SYSTEM, USER, ASSISTANT = range(4)
_DUE = np.array([USER, USER, ASSISTANT, USER])
_NEVER = 1 << 29
#: The state after a turn of initial s, u, a or another is kept; 4 where it can't be.
_KEEP = np.array([[SYSTEM, USER, 4, 4], [4, USER, 4, 4], [4, 4, ASSISTANT, 4], [4, USER, 4, 4]])
#: Costs from the end: nothing or whole pairs are an end already.
_END = np.array([0, 6, 3, 0], np.int32)
#: Turns of a tensor, padding included, unless one conversation has more.
_CELLS = 1 << 18
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text, copy) after damage by the crc32 of id and turn, modulo 20: 0 drops a row (its role and text
    become null), 1 empties the text, 2 removes its sentence ends, 3 repeats the row, 4 makes its role user."""
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, "turn", "role", "text")]
    kind = F.crc32(F.concat_ws(":", *written[:2]).cast("binary")) % 20
    role = F.when(kind == 4, "user").otherwise(written[2])
    text = F.when(kind == 1, "").when(kind == 2, F.translate(written[3], ".!?", "")).otherwise(written[3])
    rows = turns.select(F.col(id_col).alias("conv_id"), "turn", F.when(kind != 0, role).alias("role"), F.when(kind != 0, text).alias("text"), kind.alias("kind"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(0), (F.col("kind") == 3).cast("int"))).alias("copy"))


def _hashed(rows: DataFrame) -> DataFrame:
    """With the order of rows that share a turn."""
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})


def least_costs(codes: np.ndarray, must_go: np.ndarray, cut_off: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[turn, conversation, state]: least cost from before this turn to the end; all inputs [turn, conversation], by initial."""
    turns, n = codes.shape
    stored = np.empty((turns + 1, n, 4), np.int32)
    stored[turns] = _END
    for t in range(turns - 1, -1, -1):
        after = stored[t + 1]
        reach = np.concatenate([after, np.full((n, 1), _NEVER, np.int32)], axis=1)  # state 4: never
        stay = np.where(cut_off[t], 3, 0).astype(np.int32)[:, None] + np.where(must_go[t], _NEVER, 0).astype(np.int32)[:, None]
        keep = np.take_along_axis(reach, _KEEP[:, codes[t]].T, axis=1)
        here = np.minimum(after + 4, np.minimum(keep, after[:, _DUE] + 3) + stay)
        here = np.minimum(here, here[:, _DUE] + 3)
        here = np.minimum(here, here[:, _DUE] + 3)  # two inserts in a row are as many as can help
        stored[t] = np.where((t < lengths)[:, None], here, after)
    return stored


def cheapest_edits(stored: np.ndarray, codes: np.ndarray, must_go: np.ndarray, cut_off: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Each conversation's edits, traced forward together through the stored costs."""
    n = codes.shape[1]
    place, state, rows, letters = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), []
    while True:
        inside = place < lengths
        cost = stored[place, rows, state]
        busy = inside | (cost > 0)
        if not busy.any():
            break
        at, due = np.minimum(place, codes.shape[0] - 1), _DUE[state]
        later = stored[np.minimum(place + 1, codes.shape[0]), rows]
        stay, goes = np.where(cut_off[at, rows], 3, 0), must_go[at, rows]
        kept = _KEEP[state, codes[at, rows]]
        delete = inside & (later[rows, state] + 4 == cost)
        insert = ~delete & (stored[place, rows, due] + 3 == cost)
        keep = inside & ~delete & ~insert & ~goes & (kept < 4) & (later[rows, np.minimum(kept, 3)] + stay == cost)
        letters.append(np.where(busy, np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R")))), 0).astype(np.uint8))
        state = np.where(busy & ~delete, np.where(keep, kept, due), state)
        place += busy & ~insert
    if not letters:
        return [b""] * n
    return [row.tobytes().rstrip(b"\0") for row in np.ascontiguousarray(np.stack(letters, axis=1))]


def repair_batch(sizes: np.ndarray, codes: np.ndarray, must_go: np.ndarray, cut_off: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Costs and edits of conversations whose turns lie one after another, ``sizes`` of each."""
    costs, edits = np.zeros(len(sizes), np.int64), [b""] * len(sizes)
    starts = np.cumsum(sizes) - sizes
    bucket = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for b in np.unique(bucket[sizes > 0]).tolist():
        every = np.flatnonzero((bucket == b) & (sizes > 0))
        step = max(1, _CELLS >> b)
        for some in (every[i : i + step] for i in range(0, len(every), step)):
            lengths = sizes[some]
            # turn t of each conversation; beyond the end, any turn, which isn't looked at
            take = np.minimum(starts[some] + np.arange(lengths.max())[:, None], len(codes) - 1)
            tensors = codes[take], must_go[take], cut_off[take], lengths
            stored = least_costs(*tensors)
            costs[some] = stored[0, :, START]
            for i, letters in zip(some.tolist(), cheapest_edits(stored, *tensors), strict=True):
                edits[i] = letters
    return costs, edits


def plans(rows: DataFrame) -> DataFrame:
    """``damaged`` rows to (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one for each conversation."""
    initial, space = F.substring("role", 1, 1), r"[\x20\x09-\x0D]"
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut_off = ~F.col("text").rlike(rf"[.!?]{space}*+\z")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), "h1", "h2", "copy", code.alias("code"), blank.alias("blank"), cut_off.alias("cut"))
    listed = _hashed(rows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("role").isNotNull(), turn))).alias("ts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            lists = b.column(1)
            flat = lists.flatten()
            turn, h1, h2, _, code, blank, cut = (flat.field(i) for i in range(7))
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            codes, blank, cut = (x.to_numpy(zero_copy_only=False) for x in (code, blank, cut))
            frame = pd.DataFrame({"owner": owner, "h1": h1.to_numpy(zero_copy_only=False), "h2": h2.to_numpy(zero_copy_only=False)})
            twice = ~blank & frame.duplicated().to_numpy()
            short = ~blank & ~twice & cut
            count = lambda flags: np.bincount(owner[flags], minlength=len(sizes))  # noqa: B023, E731
            pair, same = 4 * codes[:-1] + codes[1:], owner[:-1] == owner[1:]
            illegal = np.bincount(owner[1:][same & ~np.isin(pair, (1, 6, 9))], minlength=len(sizes))
            known = pd.DataFrame({"owner": owner, "turn": turn.to_pandas(integer_object_nulls=True)}).dropna()
            spans = known.astype("int64").groupby("owner")["turn"].agg(["min", "max", "nunique"])
            gaps = np.zeros(len(sizes), np.int64)
            gaps[spans.index] = spans["max"] - spans["min"] + 1 - spans["nunique"]
            costs, edits = repair_batch(sizes, codes, blank | twice, short)
            numbers = (gaps, count(blank), count(twice), count(short), illegal, costs)
            arrays = [b.column(0), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array([e.decode() for e in edits])]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", *_COUNTS, "audit"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return map_batches(listed, work, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string")


class _Repaired:
    """The lines of one repaired conversation, as its turns come along."""

    names = {USER: "user", ASSISTANT: "assistant"}

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.digest, self.lines = audit, 0, START, hashlib.sha256(), 0

    def line(self, role: str, text: str, state: int) -> None:
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines, self.state = self.lines + 1, state

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            due = int(_DUE[self.state])
            self.line(self.names[due], "", due)
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserted()
        edit, due = self.audit[self.at], int(_DUE[self.state])
        self.at += 1
        if edit == "K":
            self.line(role, text, SYSTEM if role[0] == "s" else due)
        elif edit == "R":
            self.line(self.names[due], text, due)

    def hexdigest(self) -> str:
        self.inserted()
        return self.digest.hexdigest()


def repair(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of the damaged
    ``turns``; the last is the hash of the repaired conversation's lines, ``role:text``."""
    rows = damaged(turns, id_col)
    texts = _hashed(rows.where("role is not null")).withColumn("first", F.lit(0))
    fields = [*_COUNTS, "audit"]
    every = texts.unionByName(plans(rows).withColumn("first", F.lit(1)), allowMissingColumns=True).repartition("conv_id")
    ordered = every.sortWithinPartitions("conv_id", F.desc("first"), "turn", "h1", "h2", "copy").select("conv_id", "first", "role", "text", *fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = made = None
        for b in sliced(batches, 1024):
            done = []
            for conv_id, first, role, text, *numbers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first:
                    if plan:
                        done.append((*plan, made.hexdigest()))
                    plan, made = (conv_id, *numbers), _Repaired(numbers[-1])
                else:
                    made.turn(role, text)
            if done:
                yield _result(done, b.schema[0].type)
            kind = b.schema[0].type
        if plan:
            yield _result([(*plan, made.hexdigest())], kind)

    kind = turns.schema[id_col].dataType.simpleString()
    return map_batches(ordered, work, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")


def _result(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])
