"""Quality rules: base counts, then a linear-chain conditional random field over a document's lines.

Each line is content or boilerplate; the Viterbi path gives the labels, and a document is kept if at least
``CONTENT_SHARE`` of its words stand in content lines. The field's weights are fitted by the exact gradient of the
likelihood (forward and backward sums) on documents with a quality label. The labels are the documents', those of lines
are latent: in a good document lines begin as content but for those seen before in it; in a bad one as weak marks say
(symbols, tables of bars, capitals, lines seen before), all boilerplate where nothing is marked. Then all are decoded again
with the field fitted so far, a good document held to ``CONTENT_SHARE`` of content at least and a bad one to less, and the
field is fitted anew. So sequences that change labels are learnt from.

Learnt from are only documents outside the held-out fold (crc32 of the id as text, modulo 5, is not 0) that pass the base
rules, at most ``FIT_ROWS`` of them, and of these, in the order of a hash of the id, as many as have ``FIT_LINES`` lines
together. A document of more than ``FIT_DOC_LINES`` lines gives that many successive ones, from a place that its text's hash
picks, so that no single document fills the sample. They are cut into pieces of ``PIECE`` lines. Without labels of both classes ``PRIOR`` is used.

Nulls and odd cases: a null text has no words and fails the base rules, as does one of fewer than 20 words; a null id is
kept; repeated rows each get a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WHITE_SPACE, cut_lineage, map_batches, sliced

#: The bounds on documents and lines that the field is fitted on, and on lines of one document; lines of a piece.
FIT_ROWS = 4_000
FIT_LINES = 200_000
FIT_DOC_LINES = 2_000
PIECE = 64
CONTENT_SHARE = 0.5
#: Pieces of a gradient step, passes over all pieces of one fit, and how often lines are decoded and fitted anew.
BATCH, PASSES, ROUNDS = 64, 6, 3
#: A line with more of one of these features is boilerplate to begin with (by place in FEATURES).
MARKS = {1: 0.15, 2: 0.5, 3: 0.6, 6: 0.5}
#: Features of a line: constant, symbols, bars, capitals, exclamation marks, few words, seen before, digits, word length.
FEATURES = 9
#: Fixed values used when nothing can be learnt: content's weight for each feature, and for staying in a label.
PRIOR = (np.array([1.5, -6.0, -6.0, -4.0, -4.0, -0.3, -1.0, -2.0, 0.0]), np.array([[0.5, -0.5], [-0.5, 0.5]]))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row for each line that has a word."""
    out, seen = [], set()
    for line in lines:
        n = len(line)
        words = line.count(b" ") + 1
        cut = lambda chars: n - len(line.translate(None, chars))  # noqa: B023, E731
        out.append((1.0, min(1.0, 4 * cut(_SYMBOLS) / n), min(1.0, 2 * line.count(b"|") / words), cut(_UPPER) / n, min(1.0, line.count(b"!") / words), float(words < 5), float(line in seen), cut(_DIGITS) / n, min(n / words, 40) / 40))
        seen.add(line)
    return np.array(out, float).reshape(-1, FEATURES)


def viterbi(unary: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Labels (1: content) of the best path. unary: content's score at each line, boilerplate's being 0."""
    (m00, m01), (m10, m11) = moves.tolist()
    a, b, back = 0.0, 0.0, []
    for i, u in enumerate(unary.tolist()):
        if i:
            from_a, from_b = (a + m00, b + m10), (a + m01, b + m11)
            back.append((int(from_a[1] > from_a[0]), int(from_b[1] > from_b[0])))
            a, b = max(from_a), max(from_b) + u
        else:
            b = u
    at = int(b > a)
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return np.array(path[::-1] if len(unary) else [], int)


def _step(x: np.ndarray, y: np.ndarray, on: np.ndarray, weight: np.ndarray, w: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log likelihood of the line labels ``y`` of a batch of pieces; ``on`` marks lines that are there."""
    n, length = y.shape
    score = np.stack([np.zeros((n, length)), x @ w], axis=2)
    ahead = np.zeros((n, length, 2))
    ahead[:, 0] = score[:, 0]
    for t in range(1, length):
        z = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + score[:, t]
        ahead[:, t] = np.where(on[:, t, None], z, ahead[:, t - 1])
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    behind, pairs = np.zeros((n, length, 2)), np.zeros((2, 2))
    for t in range(length - 1, 0, -1):
        after = score[:, t] + behind[:, t]
        both = ahead[:, t - 1, :, None] + moves + after[:, None, :] - total[:, None, None]
        pairs += (np.exp(both) * (weight * on[:, t])[:, None, None]).sum(axis=0)
        behind[:, t - 1] = np.where(on[:, t, None], np.logaddexp.reduce(moves + after[:, None, :], axis=2), 0.0)
    content = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * on
    seen, step = np.zeros((2, 2)), weight[:, None] * on[:, 1:]
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), step.ravel())
    return (((y * on - content) * weight[:, None])[:, :, None] * x).sum(axis=(0, 1)), seen - pairs


def fit_lines(docs: list[np.ndarray], lines: list[np.ndarray], weights: np.ndarray, w: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves that raise the likelihood of the lines' labels, from (w, moves) on."""
    pieces = [(d[at : at + PIECE], y[at : at + PIECE], k) for d, y, k in zip(docs, lines, weights, strict=True) for at in range(0, len(d), PIECE)]
    pieces.sort(key=lambda p: len(p[0]))  # pieces of a batch are about as long
    batches = []
    for at in range(0, len(pieces), BATCH):
        part = pieces[at : at + BATCH]
        length = len(part[-1][0])
        x, y, on = np.zeros((len(part), length, FEATURES)), np.zeros((len(part), length), int), np.zeros((len(part), length), bool)
        for i, (d, labels, _) in enumerate(part):
            x[i, : len(d)], y[i, : len(d)], on[i, : len(d)] = d, labels, True
        batches.append((x, y, on, np.array([k for *_, k in part])))
    w, moves, rng, step = w.copy(), moves.copy(), np.random.default_rng(5), 0
    m, u = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]
    for _ in range(PASSES):
        for k in rng.permutation(len(batches)).tolist():
            step += 1
            grads = _step(*batches[k], w, moves)
            for i, (p, decay) in enumerate(((w, 1e-3), (moves, 1e-2))):
                g = grads[i] * (len(batches) / 4) - decay * p
                m[i] = 0.9 * m[i] + 0.1 * g
                u[i] = 0.999 * u[i] + 0.001 * g**2
                p += 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(u[i] / (1 - 0.999**step)) + 1e-8)
    return w, moves


def first_labels(lines: np.ndarray, good: int) -> np.ndarray:
    """What lines are to begin with: 1 for content."""
    if good:
        return (lines[:, 6] == 0).astype(int)
    marked = np.zeros(len(lines), bool)
    for k, least in MARKS.items():
        marked |= lines[:, k] > least
    return (~marked).astype(int) if marked.any() else np.zeros(len(lines), int)


def held_path(unary: np.ndarray, moves: np.ndarray, words: np.ndarray, good: int) -> np.ndarray:
    """The best path of a document, its content pushed up, or down in a bad one, until the share of its words is on the side of
    ``CONTENT_SHARE`` that its label says."""
    for push in (0.0, 1.0, 2.0, 4.0, 8.0, 16.0):
        y = viterbi(unary + (push if good else -push), moves)
        if ((words * y).sum() >= CONTENT_SHARE * words.sum()) == bool(good):
            return y
    return np.full(len(unary), good)


def fit(docs: list[np.ndarray], labels: np.ndarray, words: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves from documents' line features and quality labels; ``words`` counts each line's words."""
    used = [i for i, d in enumerate(docs) if len(d)]
    words = [np.ones(len(docs[i])) for i in used] if words is None else [words[i] for i in used]
    docs, labels = [docs[i] for i in used], np.array([labels[i] for i in used], int)
    if not docs or labels.min() == labels.max():
        return PRIOR
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())  # classes count alike
    weights = share / np.array([len(d) for d in docs])
    lines = [first_labels(d, y) for d, y in zip(docs, labels.tolist(), strict=True)]
    w, moves = PRIOR
    for turn in range(ROUNDS):
        if turn:
            lines = [held_path(d @ w, moves, n, good) for d, good, n in zip(docs, labels.tolist(), words, strict=True)]
        w, moves = fit_lines(docs, lines, weights, w, moves)
    return w, moves


def _content_lines(data: bytes) -> list[bytes]:
    return [line for line in data.split(b"\n") if line.strip()]


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("good"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # bounded, so it can be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "good", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()]
            lines = [[] if base_failed(t.split()) else _content_lines(t) for t in texts]  # the base rules decide on those
            # features look at the whole document; then the lines that are learnt from are picked
            starts = [zlib.crc32(t) % max(1, len(x) - FIT_DOC_LINES + 1) for t, x in zip(texts, lines, strict=True)]
            some = [slice(at, at + FIT_DOC_LINES) for at in starts]
            feats = [line_features(x)[part].astype("<f8").tobytes() for x, part in zip(lines, some, strict=True)]
            words = [np.array([len(line.split()) for line in x[part]], "<f8").tobytes() for x, part in zip(lines, some, strict=True)]
            sizes = pa.array([len(w) // 8 for w in words], pa.int64())
            columns = [b.column(0), b.column(1), *(pa.array(c, pa.binary()) for c in (feats, words)), sizes]
            yield pa.RecordBatch.from_arrays(columns, ["id", "good", "lines", "words", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_batches(texts, work, f"id {kind}, good int, lines binary, words binary, n long")
    found = cut_lineage(found.where("n > 0").dropDuplicates(["id"]))
    order = Window.orderBy(F.xxhash64("id"), "id")  # over at most ``rows`` rows
    short = found.select("id", "n").withColumn("upto", F.sum("n").over(order)).where(F.col("upto") <= FIT_LINES).select("id")
    got = found.join(short, "id").orderBy(F.xxhash64("id"), "id").select("good", "lines", "words").collect()
    lines = [np.frombuffer(bytes(r["lines"]), "<f8").reshape(-1, FEATURES) for r in got]
    return fit(lines, np.array([r["good"] for r in got], int), [np.frombuffer(bytes(r["words"]), "<f8") for r in got])


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of ``width`` words that are found twice or more, the first included."""
    n = len(words)
    if n <= width:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    windows = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + h[j : n - width + 1 + j]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[np.flatnonzero(twice)] += 1
    edge[np.flatnonzero(twice) + width] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_failed(words: list[bytes]) -> bool:
    return len(words) < 20 or 100 * repeat_words(words) > 30 * len(words)


def measure(text: str | None, weights: np.ndarray, moves: np.ndarray) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text or "") - (len(data) - len(data.translate(None, WHITE_SPACE)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    lines = _content_lines(data)
    for line in lines:
        dup += line in seen
        seen.add(line)
    repeats = repeat_words(words)
    failed = n < 20 or 100 * repeats > 30 * n
    share = 0.0
    if lines:
        good = viterbi(line_features(lines) @ weights, moves)
        share = sum(len(line.split()) for line, y in zip(lines, good.tolist(), strict=True) if y) / n
    return n, chars, symbols, dup, repeats, failed, share, not failed and share >= CONTENT_SHARE


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share), one row for
    each row of ``docs``."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            got = list(zip(*(measure(t, *model) for t in b.column(1).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(got, kinds, strict=True))], ["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, work, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
