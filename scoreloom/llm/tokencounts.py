"""Exact token counts of every prefix of a text, by prefix dynamic programming over byte-pair encoding.

A byte-pair encoding has one encoding of each prefix, and the encoding of a prefix is that of a shorter prefix and one more
token: its last one. So the table of last tokens fills from left to right: a token that ends here is the last one if its
neighbour, the last token where it begins, stays apart from it when the two are encoded together. The count at a prefix is
the count where its last token begins, and one. Pairs are tested once and remembered, and so are whole pieces (words, in
the main), since the pre-tokenizer never merges across pieces.

Cutting a text can also change its pieces at the cut, and the counts take that into account: white space at the end is one
piece, an unfinished contraction is a sign and letters, an unfinished special string is ordinary text. So the count at a
prefix is what the tokenizer gives for the prefix as a text of its own. Counts may fall from one prefix to the next, where
a character joins what stood apart.

With the counts at hand, truncation and budgets need no encoding: ``prefix_counts`` stores them, ``tokens_at`` reads the
count of a prefix, ``chars_within`` the longest prefix within a budget, and ``truncated`` cuts texts to it.

Nulls and odd cases: a null text is empty (no bytes, no tokens, an empty table); rows with a null id or a repeated one are
counted each; other columns are ignored by counts and kept by ``truncated``; an empty table gives an empty result. Bytes
that aren't UTF-8 count as U+FFFD. Long texts are worked off in blocks between words, so only their counts grow with them.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .packing import _byte_letters
from .shared import free_names, map_batches, sliced

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Pieces, and characters in them, that a process remembers; beyond either it starts anew.
_PIECES, _CHARS = 1_000_000, 16_000_000
#: Pairs of tokens whose encoding a process remembers.
_PAIRS = 4_000_000
#: Characters of a text that are worked off at once.
_BLOCK = 1 << 20
_CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))


class Prefixes:
    """Counts for one byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in whole["model"]["merges"]]
        tokens = [*(bytes([b]) for b in range(256)), *(raw(a) + raw(b) for a, b in merges)]
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.merged = tiktoken.Encoding("prefixes", pat_str=".+", mergeable_ranks=self.ids, special_tokens={})
        self.longest: dict[bytes, int] = {}  # of the tokens that end in these two bytes
        for t in tokens:
            self.longest[t[-2:]] = max(self.longest.get(t[-2:], 1), len(t))
        special = sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.runs, self.word_end = regex.compile(r"\s{2,}"), regex.compile(r"\S(?=\s)")
        self.apart: dict[int, bool] = {}
        self.agrees: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.lasts, self.flat = array("q"), array("q"), array("q"), array("i")
        self.data, self.last, self.count = b"", [-1], [0]  # of the bytes that were counted last

    # --- one piece
    def stays_apart(self, left: int, right: int) -> bool:
        """Whether two tokens, or one (no left one: -1), are the encoding of their bytes."""
        ids = [left, right] if left >= 0 else [right]
        if len(self.apart) > _PAIRS:
            self.apart.clear()
        found = self.apart[left << 20 | right] = self.merged._encode_single_piece(self.merged.decode_bytes(ids)) == ids  # noqa: SLF001
        return found

    def bytewise(self, data: bytes) -> list[int]:
        """Token counts of data[:0], data[:1], ... data: the dynamic programme. What the bytes before share with these stays."""
        ids, longest, apart = self.ids.get, self.longest.get, self.apart.get
        same = 0
        for a, b in zip(self.data, data, strict=False):
            if a != b:
                break
            same += 1
        last, count = self.last, self.count
        self.data = data
        del last[same + 1 :], count[same + 1 :]
        for end in range(same + 1, len(data) + 1):
            start = max(0, end - longest(data[max(0, end - 2) : end], 1))
            while True:  # a byte is a token, so one is found
                token = ids(data[start:end])
                if token is not None:
                    fits = apart(last[start] << 20 | token)
                    if fits or (fits is None and self.stays_apart(last[start], token)):
                        break
                start += 1
            last.append(token)
            count.append(count[start] + 1)
        return count.copy()

    def piece(self, text: str) -> list[int]:
        """Counts at text[:1], text[:2], ... text, a piece of the pre-tokenizer."""
        data = text.encode()
        counts = self.bytewise(data)
        if text in _CONTRACTIONS:  # unfinished, it is two pieces: the sign and letters
            return [1, *(1 + n for n in self.bytewise(data[1:-1])[1:]), counts[-1]]
        return counts[1:] if len(data) == len(text) else [counts[i] for i in accumulate(len(c.encode()) for c in text)]

    def remember(self, piece: str) -> int:
        counts = self.piece(piece)
        at = self.known[piece] = len(self.known)
        self.starts.append(len(self.flat))
        self.sizes.append(len(counts))
        self.lasts.append(counts[-1])
        self.flat.extend(counts)
        return at

    # --- a text
    def split(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces. The pattern finds them, unless the text has a character that the tokenizer's own tables
        of characters class otherwise, which each new character is tried for once."""
        for c in set(text) - self.agrees.keys():
            probe = f"a{c}a 1{c}1 !{c}!  {c}"
            spans = [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
            self.agrees[c] = spans == [m.span() for m in self.pieces.finditer(probe)]
        if all(map(self.agrees.get, set(text))):
            return self.pieces.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, pieces: Iterable[list[str]]) -> None:
        """Remembers new pieces, in order, so that each begins like the one before it."""
        if len(self.known) > _PIECES or len(self.flat) > _CHARS:
            self.forget()
        for piece in sorted(set(chain.from_iterable(pieces)).difference(self.known)):
            self.remember(piece)

    def block(self, text: str, pieces: list[str]) -> np.ndarray:
        """Counts at text[:1], ... text, a text without special strings, in known pieces."""
        index = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        starts, sizes, lasts = (np.frombuffer(a, np.int64)[index] for a in (self.starts, self.sizes, self.lasts))
        ends = np.cumsum(sizes)
        # place in the text less place in the store, and what comes before, both as steps at the pieces' starts
        shift = np.repeat(starts - (ends - sizes), sizes)
        counts = np.frombuffer(self.flat, np.int32)[shift + np.arange(len(text))] + np.repeat(np.cumsum(lasts) - lasts, sizes)
        for m in self.runs.finditer(text):  # at the end of a prefix, white space is one piece
            a, b = m.span()
            counts[a:b] = (counts[a - 1] if a else 0) + np.array(self.piece(m.group()))
        return counts

    def plain(self, text: str) -> np.ndarray:
        """Counts at text[:1], ... text of a text without special strings, in blocks that end at the ends of words."""
        out, at, base = [], 0, 0
        while at < len(text):
            m = self.word_end.search(text, at + _BLOCK) if at + _BLOCK < len(text) else None
            end = m.end() if m else len(text)
            pieces = self.split(text[at:end])
            self.learn([pieces])
            counts = self.block(text[at:end], pieces)
            out.append(counts + base)
            base += int(counts[-1])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """``text`` of each, the pieces of all being learnt together."""
        short = [len(t) <= _BLOCK and not (self.special and self.special.search(t)) for t in texts]
        pieces = [self.split(t) if s else [] for t, s in zip(texts, short, strict=True)]
        self.learn(pieces)
        # long texts come last, as they may make it forget the others' pieces
        done = {i: self.block(t, p) for i, (t, p, s) in enumerate(zip(texts, pieces, short, strict=True)) if s}
        return (done.pop(i) if s else self.text(t) for i, (t, s) in enumerate(zip(texts, short, strict=True)))

    def text(self, text: str) -> np.ndarray:
        """Counts at text[:1], text[:2], ... text."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out, at, base = [], 0, 0
        for m in self.special.finditer(text):
            # an unfinished special string is ordinary text that follows on
            counts = self.plain(text[at : m.end()])
            out.append(counts[:-1] + base)
            base += (int(counts[m.start() - at - 1]) if m.start() > at else 0) + 1
            out.append(np.array([base], np.int64))
            at = m.end()
        if at < len(text):
            out.append(self.plain(text[at:]) + base)
        return np.concatenate(out)


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Prefixes:
    """One in each process, for all its tasks."""
    return Prefixes(path)


def _within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens; counts may fall, so the last such place."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def _texts(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.make_valid_utf8(F.col(text_col)), F.lit(""))


def prefix_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, counts): counts[i] is the number of tokens of the first i + 1 characters."""
    path = path or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), _texts(docs, text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(path)
        for b in sliced(batches, 256):
            counts = [c.astype(np.int32) for c in table.texts(b.column(2).to_pylist())]
            ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(counts)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), column], ["doc_id", "n_bytes", "counts"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, work, f"doc_id {kind}, n_bytes long, counts array<int>")


def tokens_at(counts: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` characters, of the whole text if it has fewer."""
    at = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(counts))
    return F.when(at > 0, F.element_at(counts, at.cast("int"))).otherwise(0)


def chars_within(counts: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    places = F.transform(counts, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(places), F.lit(0))


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars): the table's last entry, whether it is beyond the limit, and the
    characters of the longest prefix within the limit. The table itself stays in the task."""
    path = path or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), _texts(docs, text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(path)
        for b in sliced(batches, 256):
            found = []
            for counts in table.texts(b.column(2).to_pylist()):
                total = int(counts[-1]) if len(counts) else 0
                found.append((total, total > limit, len(counts) if total <= limit else _within(counts, limit)))
            total, over, fit = zip(*found, strict=True)
            arrays = [b.column(0), b.column(1), pa.array(total, pa.int64()), pa.array(over), pa.array(fit, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def truncated(docs: DataFrame, limit: int = LIMIT, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``limit`` tokens; null texts stay null, other columns as
    they are, in their order."""
    path = path or public_tokenizers.path(TOKENIZER)
    (scratch,) = free_names(docs, "text_to_cut")
    names, place = docs.columns, docs.columns.index(text_col)
    rows = docs.withColumn(scratch, F.make_valid_utf8(F.col(text_col))).select(*names, scratch)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(path)
        for b in sliced(batches, 256):
            texts = b.column(len(names)).to_pylist()
            counted = table.texts([t or "" for t in texts])
            cut = [t if not len(c) or c[-1] <= limit else t[: _within(c, limit)] for t, c in zip(texts, counted, strict=True)]
            arrays = [pa.array(cut, b.schema[i].type) if i == place else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(lambda batches: work(b for b in batches if b.num_rows), docs.schema)
