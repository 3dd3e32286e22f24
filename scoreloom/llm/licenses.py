"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

The templates' grams of ``GRAM`` words are winnowed (the smallest hash of each ``WINDOW`` neighbouring grams) into an
inverted index from fingerprint to template and place. A document is winnowed the same way, so a run of ``GRAM + WINDOW -
1`` words that it shares with a template always meets the index; of templates shorter than ``SHORT`` words all grams are
indexed and all grams of the document looked up. Hits of a template that follow each other in both texts, each at most
``BAND`` diagonals from the one before, are one chain. Along it the template is aligned with the document's words, at most
``BAND`` words off the chain's diagonal, and the share of the template's words that match is its coverage. Matches of at
least ``COVERAGE`` are reported with their span, if the words that tell licenses apart are the same there as in the
template, in the same order: versions and modifiers, and in short templates the licenses' names.

The index is made of the templates alone, a parameter, so its size is bounded whatever the corpus. The built-in ones are
whole short licenses, headers and notices (``license_texts``); ``templates_in`` reads a folder of license files, such as
the whole texts of long licenses.

Nulls and odd cases: null and empty texts match nothing; a null id is kept; repeated rows are reported each; of
overlapping matches the one with more matched words stays, then the one of higher coverage, then the earlier one, then the
first in name order; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_texts
from .shared import map_batches

GRAM = 3
WINDOW = 3
BAND = 6
COVERAGE = 0.8
#: Templates of fewer words have all their grams indexed, and must match in the names of licenses too.
SHORT = 16
#: Words that tell licenses of one family apart, names of licenses, and words that a version follows.
MODIFIERS = frozenset("noncommercial nc sharealike sa noderivatives noderivs nd lesser library affero".split())
NAMES = frozenset("apache mit bsd isc mozilla eclipse gnu gpl lgpl agpl cc cc0 creative unlicense clause gplv2 gplv3 lgplv2 lgplv3 agplv3".split())
BEFORE_VERSIONS = frozenset("version v license attribution by".split()) | MODIFIERS | NAMES
TEMPLATES = license_texts.templates()
_WORDS = re.compile(r"\w+")
_CACHE = 200_000


def words(text: str) -> list[str]:
    """The lower-cased words; as many as ``_WORDS`` finds in the text itself."""
    found = _WORDS.findall(text)
    return "\0".join(found).lower().split("\0") if found else []


def templates_in(folder: str) -> dict[str, tuple[str, ...]]:
    """Templates from the files of a folder on the driver, named by file."""
    files = sorted(p for p in Path(folder).iterdir() if p.is_file())
    return {p.name.lower(): (p.read_text("utf-8", "replace"),) for p in files}


def keys(tokens: list[str], short: bool) -> list[str]:
    """The words that tell licenses apart, in order; a number counts if it stands after a word that a version follows."""
    out, version = [], False
    for w in tokens:
        number = w.isdecimal()
        if w in MODIFIERS or (number and version) or (short and w in NAMES):
            out.append(w)
        version = w in BEFORE_VERSIONS or (number and version)
    return out


def gram_hashes(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = (h + ids[j : n + j]) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the chosen grams: of each window the smallest hash, the rightmost of equal ones."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.array([np.argmin(hashes)] if len(hashes) else [], np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, WINDOW):
        lower = hashes[j : n + j] <= best
        best[lower] = hashes[j : n + j][lower]
        at[lower] = np.flatnonzero(lower) + j
    return np.unique(at)


def align(template: list[str], doc: list[str], chain: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """(matched, first, end) of the best alignment along a chain of (template word, diagonal): template word i stands about
    doc word i + diagonal of the last link that isn't beyond it. Words match or they don't; a skipped word on either side
    costs half a match."""
    width = 2 * BAND + 1
    row = [(0.0, 0, -1, -1)] * width  # score, matched, first, last: free to start anywhere in the band
    centre, at, low = chain[0][1], 0, (-1e9, 0, -1, -1)
    for i, word in enumerate(template):
        shift = -centre
        while at < len(chain) and chain[at][0] <= i:
            centre, at = chain[at][1], at + 1
        shift += centre
        if shift:  # the band moves on with the chain
            row = [row[k + shift] if 0 <= k + shift < width else low for k in range(width)]
        base = i + centre - BAND
        new: list[tuple] = []
        for k in range(width):
            take, j = row[k], base + k
            if 0 <= j < len(doc) and doc[j] == word:
                take = (take[0] + 1, take[1] + 1, j if take[2] < 0 else take[2], j)
            else:
                take = (take[0] - 1, *take[1:])
            if k + 1 < width and row[k + 1][0] - 0.5 > take[0]:  # the template's word is missing
                take = (row[k + 1][0] - 0.5, *row[k + 1][1:])
            if k and new[k - 1][2] >= 0 and new[k - 1][0] - 0.5 > take[0]:  # an extra word in the document
                take = (new[k - 1][0] - 0.5, *new[k - 1][1:])
            new.append(take)
        row = new
    score, matched, first, last = max(row, key=lambda x: (x[1], x[0]))
    return (matched, first, last + 1) if matched else None


def chains(hits: list[tuple[int, int]], size: int) -> list[list[tuple[int, int]]]:
    """Hits (doc word, template word), in order, to chains of (template word, diagonal): each link is beyond the one before
    in both texts and at most ``BAND`` diagonals from it. A template of ``size`` words has no longer chain in the document
    than its words and a band for each link."""
    done: list[list[tuple[int, int]]] = []
    open_: list[tuple[int, list[tuple[int, int]]]] = []  # the doc word of the last link, and the chain
    for p, q in hits:
        near = None
        still = []
        for k in open_:
            last, links = k
            if p - last > size + BAND:
                done.append(links)
                continue
            still.append(k)
            drift = abs(p - q - links[-1][1])
            if last < p and links[-1][0] < q and drift <= BAND and (near is None or drift < near[0]):
                near = (drift, len(still) - 1)
        if near is None:
            still.append((p, [(q, p - q)]))
        else:
            links = still[near[1]][1]
            links.append((q, p - q))
            still[near[1]] = (p, links)
        open_ = still
    return done + [links for _, links in open_]


class Index:
    """Inverted index over the templates: fingerprints of long ones, all grams of short ones."""

    def __init__(self, templates: Mapping[str, str | tuple[str, ...]]) -> None:
        self.templates: list[tuple[str, list[str], Counter, list[str]]] = []
        self.known: dict[str, int] = {}
        sparse, dense = defaultdict(list), defaultdict(list)
        for name, texts in sorted(templates.items()):
            for text in (texts,) if isinstance(texts, str) else texts:
                tokens = words(text)
                hashes = gram_hashes(self.ids(tokens))
                short = len(tokens) < SHORT
                for p in range(len(hashes)) if short else winnow(hashes).tolist():
                    (dense if short else sparse)[int(hashes[p])].append((len(self.templates), p))
                self.templates.append((name, tokens, Counter(tokens), keys(tokens, short)))
        self.sparse, self.dense = dict(sparse), dict(dense)
        self.prints, self.grams = (np.array(sorted(x), np.uint64) for x in (sparse, dense))

    def ids(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        out = list(map(known.get, tokens))
        if None in out:
            for i, (w, x) in enumerate(zip(tokens, out, strict=True)):
                if x is None:
                    out[i] = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        return np.array(out, np.uint64)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, span start, span end), the spans in code points of the text."""
        tokens = words(text or "")
        hashes = gram_hashes(self.ids(tokens))
        if not len(hashes):
            return []
        at = winnow(hashes)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for places, table, prints in ((at, self.sparse, self.prints), (np.arange(len(hashes)), self.dense, self.grams)):
            if len(prints):
                found = np.minimum(np.searchsorted(prints, hashes[places]), len(prints) - 1)
                for p in places[prints[found] == hashes[places]].tolist():
                    for t, q in table[int(hashes[p])]:
                        hits[t].append((p, q))
        if not hits:
            return []
        found = []
        for t, pairs in hits.items():
            name, template, counts, wanted = self.templates[t]
            size = len(template)
            for chain in chains(pairs, size):
                # words of the template that stand anywhere near bound what can match
                (q0, d0), (q1, d1) = chain[0], chain[-1]
                near = set(tokens[max(0, d0 - 2 * BAND - size) : d1 + 2 * size + 2 * BAND])
                if sum(n for w, n in counts.items() if w in near) < COVERAGE * size:
                    continue
                got = align(template, tokens, chain)
                if got and got[0] >= COVERAGE * size and keys(tokens[got[1] : got[2]], size < SHORT) == wanted:
                    found.append((-got[0], -got[0] / size, got[1], name, got[2], size))
        kept: list[tuple] = []
        for f in sorted(found):
            if all(f[4] <= k[2] or f[2] >= k[4] for k in kept):
                kept.append(f)
        if not kept:
            return []
        spots = list(_WORDS.finditer(text))
        return [(name, -m / size, -m, spots[first].start(), spots[end - 1].end()) for m, _, first, name, end, size in sorted(kept, key=lambda k: k[2])]


def scan(docs: DataFrame, templates: Mapping[str, str | tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, matched_words, span_start, span_end), one row for each match in a whole text. Spans are
    code points of the text."""
    index = Index(TEMPLATES if templates is None else templates)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = (pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, m) for i, t in enumerate(b.column(1).to_pylist()) for m in shared.value.scan(t)]
            if got:
                ids = b.column(0).take(pa.array([i for i, _ in got]))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*(m for _, m in got), strict=True), kinds, strict=True))], ["doc_id", "license", "coverage", "matched_words", "span_start", "span_end"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, work, f"doc_id {kind}, license string, coverage double, matched_words int, span_start long, span_end long")
