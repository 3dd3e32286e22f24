"""Best-fit packing of token sequences by bulk-synchronous rounds.

Documents are tokenised, end with one separator and are cut only beyond the capacity. Full pieces are a sequence each; for
the rest as many sequences are opened as its tokens fill, each a gap of the whole capacity. A round range-sorts the pieces
that are left and the gaps together, from the largest size down, a gap before pieces of its size. Each range is swept in a
task: a piece goes to its successor, the smallest gap that holds it, and what is left of the gap takes part again where it
is no smaller than the range. Pieces that find no gap in their range, and gaps that all pieces of later ranges fit in, are
matched between ranges, by rank: the largest piece first, to the smallest of the gaps before it, and as many pieces to a
gap as surely fit. Of this only the ranges' counts and extremes are carried over the ranges; the rows meet in a join. Then
the gaps are updated and the next round begins. Pieces larger than every gap open new sequences at once, and gaps smaller
than every piece that is left take no further part. Half a range's rows or fewer are one range, however many partitions
Spark deals to. Rounds write what they leave to the shared folder.

Nulls and odd cases: a null or empty text is the separator alone; a null id is kept; rows that repeat an id are packed
each (their pieces count from 0); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import cut_lineage, map_batches, written

CAPACITY = 4096
SEPARATOR = 1
TOKENIZER = "word_bpe_49k.json"
#: Chunks of text between ASCII white space whose ids a task remembers.
_CACHE = 500_000
_END = b"\0"
#: Latin letters, then any run of ASCII signs but the apostrophe, which the tokenizer treats apart.
_KINDS = re.compile("^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)|(.+))$", re.MULTILINE)
#: Rows of a range, about, and ranges of a round, at most.
RANGE_ROWS, RANGES = 1 << 16, 1 << 13


# --- tokens -------------------------------------------------------------------------------------------------------
class Ids:
    """Token ids of a text as little-endian unsigned 32-bit numbers. This tokenizer never joins text across ASCII white
    space, so what stands between is encoded once and remembered, as long as there is room.

    Plain words of Latin letters with signs after them, nearly all of most texts, go through tiktoken, which merges the same vocabulary several
    times faster: a word's end mark is one more byte that first joins the last letter, then merges go by rank. All else
    goes through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token.removesuffix("</w>")) + _END * token.endswith("</w>")
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [bytes([b]) + _END for b in range(256)] + [raw(a) + raw(b) for a, b in merges] + [bytes([b]) for b in range(256)]
        ranks = {token: i for i, token in enumerate(order)}
        self.plain = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ids, self.ends = np.zeros(len(order), "<u4"), np.zeros(len(order), bool)
        for token, i in model["vocab"].items():
            if all(c in letters for c in token.removesuffix("</w>")) and (at := ranks.get(raw(token))) is not None:
                self.ids[at], self.ends[at] = i, token.endswith("</w>")

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk, without remembering them."""
        found = _KINDS.findall(b"\n".join(chunks).decode()) if chunks else []  # no chunk has a line break
        plain = "".join([f"{word}\0{signs}\0" if signs else f"{word}\0" for word, signs, _ in found if word])
        flat = np.array(self.plain.encode_ordinary(plain.lower()) if plain else [], np.int64)
        stops = (4 * (np.flatnonzero(self.ends[flat]) + 1)).tolist()
        data, last, k = self.ids[flat].tobytes(), 0, -1
        other = [rest for word, _, rest in found if not word]
        got = iter(self.tokenizer.encode_batch(other, add_special_tokens=False) if other else [])
        out = []
        for word, signs, _ in found:
            if word:
                k += 2 if signs else 1
                out.append(data[last : stops[k]])
                last = stops[k]
            else:
                out.append(np.array(next(got).ids, "<u4").tobytes())
        return out

    def texts(self, texts: list[str | None]) -> list[bytes]:
        known, chunks, ends = self.known, [], [0]
        for t in texts:
            chunks += (t or "").encode("utf-8", "replace").split()
            ends.append(len(chunks))
        parts = list(map(known.get, chunks))
        missing, at = [], -1
        try:
            while True:
                at = parts.index(None, at + 1)
                missing.append(at)
        except ValueError:
            pass
        if missing:
            new = list({chunks[i] for i in missing})
            found = dict(zip(new, self.encode(new), strict=True))
            for i in missing:
                parts[i] = found[chunks[i]]
            if len(known) + len(found) <= _CACHE:
                known.update(found)
        return [b"".join(parts[i:j]) for i, j in pairwise(ends)]


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Ids:
    """One in each process: a worker that takes several tasks reads the vocabulary once and keeps what it remembers."""
    return Ids(path)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's pieces."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    end = np.array([SEPARATOR], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = loaded(path)
        for b in batches:
            rows: list[tuple] = []
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            packs = (pack for at in range(0, len(docs), 64) for pack in zip(docs[at : at + 64], ids.texts(texts[at : at + 64]), strict=True))
            for doc_id, data in packs:
                data += end
                rows += [(doc_id, k, k * capacity, len(part) // 4, zlib.crc32(part)) for k in range(-(-len(data) // (4 * capacity))) for part in (data[4 * capacity * k : 4 * capacity * (k + 1)],)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (b.schema[0].type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# --- a range ------------------------------------------------------------------------------------------------------
Run = tuple[int, int, int, int, int, list[int]]


def best_fit(sizes: np.ndarray, gaps: np.ndarray, sequences: np.ndarray) -> tuple[list[Run], np.ndarray, dict[int, list[int]]]:
    """Sweeps pieces of descending ``sizes`` over the gaps of ``sequences``. To runs (first piece, pieces, size, gap, pieces a
    gap, sequences), the places of pieces that no gap holds, and the gaps that are left by size."""
    pools: dict[int, list[int]] = {}
    for gap in np.unique(gaps).tolist():
        pools[gap] = sequences[gaps == gap].tolist()
    have = sorted(pools)
    runs: list[Run] = []
    left: list[np.ndarray] = [np.zeros(0, np.int64)]

    def put(gap: int, back: list[int]) -> None:
        if gap and back:
            if gap not in pools:
                pools[gap] = []
                insort(have, gap)
            pools[gap] += back

    ends = [*(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)] if len(sizes) else []
    at = 0
    for end in ends:
        size = int(sizes[at])
        while at < end:
            k = bisect_left(have, size)
            if k == len(have):
                left.append(np.arange(at, end))
                break
            gap = have[k]
            each = gap // size  # equal pieces follow each other into what the first one leaves
            take = pools[gap][-(-(-(end - at) // each)) :]
            del pools[gap][-len(take) :]
            if not pools[gap]:
                del pools[gap], have[k]
            n = min(end - at, each * len(take))
            runs.append((at, n, size, gap, each, take))
            full, rest = divmod(n, each)
            put(gap - each * size, take[:full])
            put(gap - rest * size, take[full:])
            at += n
        at = end
    return runs, np.concatenate(left), pools


#: kind: 0 a gap, 1 a piece that is left, 2 a placed piece. rank: of those that other ranges are asked or offered, in order.
_SWEPT = "kind int, id long, size int, part int, rank long, sequence long, at int"


def _swept(state: DataFrame, n_rows: int, capacity: int) -> DataFrame:
    """``state(kind, id, size)``, of at most ``n_rows``: one round's sweeps inside the ranges."""
    order = [F.col("size").desc(), F.col("kind"), F.col("id")]
    # many short ranges leave pieces to many rounds; so few rows are swept at once
    dealt = state.repartition(1) if n_rows <= RANGE_ROWS // 2 else state.repartitionByRange(min(RANGES, -(-n_rows // RANGE_ROWS)), *order)
    rows = dealt.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("size", pa.int32()), ("part", pa.int32()), ("rank", pa.int64()), ("sequence", pa.int64()), ("at", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None:
            return
        kind, ident, size = (table.column(k).to_numpy() for k in range(3))
        part, least, unit = table.column(3)[0].as_py(), int(size[-1]), kind == 1
        units, sizes = ident[unit], size[unit]
        runs, left, pools = best_fit(sizes, size[~unit], ident[~unit])

        def out(kind: int, ident: np.ndarray, size: np.ndarray, rank: np.ndarray | None = None, sequence: np.ndarray | None = None, at: np.ndarray | None = None) -> pa.RecordBatch:
            n = len(ident)
            columns = [np.full(n, kind), ident, size, np.full(n, part), rank, sequence, at]
            return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        if runs:
            place = np.concatenate([np.arange(n) for _, n, *_ in runs])
            of = np.repeat(np.arange(len(runs)), [n for _, n, *_ in runs])
            first, size_, gap, each = (np.array([r[k] for r in runs])[of] for k in (0, 2, 3, 4))
            taken = np.concatenate([r[5] for r in runs])
            begin = np.cumsum([0] + [len(r[5]) for r in runs])[:-1][of]
            yield out(2, units[first + place], size_, None, taken[begin + place // each], capacity - gap + place % each * size_)
        if len(left):
            yield out(1, units[left], sizes[left], np.arange(len(left)))
        gaps = [(g, pools[g]) for g in sorted(pools, reverse=True)]
        for offered in (True, False):
            some = [(g, np.array(p)) for g, p in gaps if (g >= least) == offered]
            if some:
                ids = np.concatenate([p for _, p in some])
                yield out(0, ids, np.repeat([g for g, _ in some], [len(p) for _, p in some]), np.arange(len(ids)) if offered else None)

    return map_batches(rows, work, _SWEPT)


# --- between ranges -----------------------------------------------------------------------------------------------
Match = tuple[int, int, int, int, int, int, int]


def carried(parts: list[tuple[int, int, int, int, int]]) -> list[Match]:
    """``parts(part, pieces left, largest of them, gaps offered, smallest of them)`` in order, to matches (part, first rank,
    pieces, pieces a gap, part of the gaps, rank of the first gap, gaps); the gaps' ranks go down from there. A piece is
    offered the gaps of all ranges before, the nearest first, as a stack holds them."""
    stack: list[list[int]] = []
    found = []
    for part, pieces, largest, gaps, smallest in parts:
        rank = 0
        while rank < pieces and stack:
            of, there, least = stack[-1]
            each = max(1, least // largest)
            m = min(there, -(-(pieces - rank) // each))
            n = min(pieces - rank, m * each)
            found.append((part, rank, n, each, of, there - 1, m))
            rank += n
            stack[-1][1] -= m
            if m == there:
                stack.pop()
        if gaps:
            stack.append([part, gaps, smallest])
    return found


def _matched(swept: DataFrame, matches: list[Match]) -> DataFrame:
    """``swept`` with what the matches, two a range at most, give each row: of a piece the range and the rank of its gap and
    its slot there, of a gap whether it is taken."""
    by_unit, by_gap = ({p: np.array(list(ms)) for p, ms in groupby(sorted(matches, key=lambda m: (m[k], m[1])), key=lambda m: m[k])} for k in (0, 4))  # noqa: B023

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, part = (b.column(k).to_numpy() for k in (0, 3))
            ranked = b.column(4).is_valid().to_numpy(zero_copy_only=False)
            rank = b.column(4).fill_null(-1).to_numpy()
            to, g_rank, slot, taken = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, bool)
            for p in np.unique(part).tolist():
                if p in by_unit:
                    rows = np.flatnonzero((part == p) & (kind == 1))
                    own = by_unit[p]
                    at = np.searchsorted(own[:, 1], rank[rows], side="right") - 1
                    inside = (at >= 0) & (rank[rows] < own[at, 1] + own[at, 2])
                    rows, own = rows[inside], own[at[inside]]
                    place = rank[rows] - own[:, 1]
                    to[rows], g_rank[rows], slot[rows] = own[:, 4], own[:, 5] - place // own[:, 3], place % own[:, 3]
                if p in by_gap:
                    rows = np.flatnonzero((part == p) & (kind == 0) & ranked)
                    for _, _, _, _, _, top, m in by_gap[p].tolist():
                        taken[rows] |= (rank[rows] > top - m) & (rank[rows] <= top)
            extra = [pa.array(to, pa.int32(), mask=to < 0), pa.array(g_rank), pa.array(slot), pa.array(taken)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "g_part", "g_rank", "slot", "taken"])

    return map_batches(swept, work, f"{_SWEPT}, g_part int, g_rank long, slot long, taken boolean")


def place_all(units: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``units(id, size)``, pieces smaller than the capacity, to (id, sequence, at)."""
    spark = units.sparkSession
    n_rows, total = units.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    fresh = lambda first, n: spark.range(first, first + n).select(F.lit(0).alias("kind"), "id", F.lit(capacity).alias("size"))
    opened = -(-total // capacity)
    state = units.select(F.lit(1).alias("kind"), "id", F.col("size").cast("int").alias("size")).unionByName(fresh(0, opened))
    n_rows += opened
    placed = [units.select("id", F.col("id").alias("sequence"), F.lit(0).alias("at")).limit(0)]
    left = total
    while left:
        swept = cut_lineage(_swept(state, n_rows, capacity))
        stats = swept.groupBy("part", "kind", F.col("rank").isNotNull().alias("ranked")).agg(*(f("size").alias(f.__name__) for f in (F.count, F.min, F.max, F.sum)))
        stats = {(r["part"], r["kind"], r["ranked"]): r for r in stats.collect()}  # at most four rows for each range
        none = {"count": 0, "min": 0, "max": 0, "sum": 0}
        parts = sorted({p for p, *_ in stats})
        of = {p: (stats.get((p, 1, True), none), stats.get((p, 0, True), none)) for p in parts}
        matches = carried([(p, u["count"], u["max"], g["count"], g["min"]) for p, (u, g) in of.items()])
        few = max(spark.sparkContext.defaultParallelism, -(-n_rows // RANGE_ROWS))  # files of a round's results, so that its checkpoints can go
        placed.append(written(swept.where("kind = 2").select("id", "sequence", "at").coalesce(few), "packed"))
        if matches:
            asked = cut_lineage(_matched(swept.where("kind <> 2"), matches))
            given = asked.where("g_part is not null").select(F.col("id").alias("unit"), F.col("size").alias("length"), "g_part", "g_rank", "slot")
            offers = asked.where("taken").select(F.col("part").alias("g_part"), F.col("rank").alias("g_rank"), F.col("id").alias("sequence"), F.col("size").alias("gap"))
            along = Window.partitionBy("g_part", "g_rank").orderBy("slot")  # as many pieces as fit in one gap
            joined = given.join(offers, ["g_part", "g_rank"]).withColumn("upto", F.sum("length").over(along)).withColumn("last", F.lead("unit").over(along).isNull())
            joined = written(joined.select("unit", "sequence", "length", "gap", "upto", "last").coalesce(few), "packed")
            placed.append(joined.select(F.col("unit").alias("id"), "sequence", (capacity - F.col("gap") + F.col("upto") - F.col("length")).cast("int").alias("at")))
            again = joined.where("last and upto < gap").select(F.lit(0).alias("kind"), F.col("sequence").alias("id"), (F.col("gap") - F.col("upto")).cast("int").alias("size"))
            state = asked.where("g_part is null and not taken").select("kind", "id", "size").unionByName(again)
        else:
            state = swept.where("kind <> 2").select("kind", "id", "size")
        got = sum(m[2] for m in matches)
        largest_gap = max((r["max"] for (_, kind, _), r in stats.items() if kind == 0), default=0)
        room = sum(r["sum"] for (_, kind, _), r in stats.items() if kind == 0)
        units_stats = [u for u, _ in of.values() if u["count"]]
        left = sum(u["count"] for u in units_stats) - got
        tokens = sum(u["sum"] for u in units_stats)
        # pieces that no gap can hold open sequences, as do more tokens than there is room for; gaps only shrink, so at once
        beyond = sum(u["sum"] for u in units_stats if u["min"] > largest_gap)
        stuck = not got and not any(kind == 2 for _, kind, _ in stats)
        more = -(-max(beyond, tokens - room, tokens if stuck else 0) // capacity) if left else 0
        least = min((u["min"] for u in units_stats), default=0)
        state = state.where((F.col("kind") == 1) | (F.col("size") >= least))
        if more > 0:
            state, opened = state.unionByName(fresh(opened, more)), opened + more
        n_rows = left + sum(r["count"] for (_, kind, _), r in stats.items() if kind == 0 and r["max"] >= least) + max(more, 0)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece."""
    rows = pieces(docs, path or public_tokenizers.path(TOKENIZER), capacity, id_col, text_col)
    rows = cut_lineage(rows.withColumn("unit", F.monotonically_increasing_id()))  # fixes the pieces' numbers
    units = rows.where(F.col("length") < capacity).select(F.col("unit").alias("id"), F.col("length").alias("size"))
    placed = place_all(units, capacity).withColumnRenamed("id", "unit")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = rows.where(F.col("length") == capacity).select(*names, (-1 - F.col("unit")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.where(F.col("length") < capacity).join(placed, "unit")
    return full.unionByName(rest.select(*names, F.col("sequence").alias("sequence_id"), F.col("at").cast("long").alias("offset")))
