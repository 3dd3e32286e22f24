import itertools
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from scoreloom.llm import quality


def slow_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_base_counts_equal_brute_force():
    rnd = random.Random(7)
    texts = [None, "", " \n\n ", "one", "a b c d e f g h a b c d e f g h", "é x ## $|<>& line\n\nline\nline\n x"]
    texts += ["".join(rnd.choice(["ab", "c", " ", " ", "\n", "#", "é"]) for _ in range(rnd.randint(1, 300))) for _ in range(60)]
    texts += [" ".join(rnd.choices("pqr", k=60)) for _ in range(10)]
    for t in texts:
        assert quality.measure(t, *quality.PRIOR)[:6] == slow_base(t), t


def test_viterbi_equals_all_paths():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        unary, moves = rnd.normal(0, 2, n), rnd.normal(0, 1, (2, 2))
        score = lambda p: sum(unary[i] * y for i, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(quality.viterbi(unary, moves).tolist()) == best
    assert len(quality.viterbi(np.zeros(0), np.zeros((2, 2)))) == 0


def slow_gradient(x, y, w, moves):
    """Of the log likelihood of one path, over all paths."""
    paths = [np.array(p) for p in itertools.product((0, 1), repeat=len(y))]
    score = lambda p: float(((x @ w) * p).sum()) + sum(moves[a, b] for a, b in itertools.pairwise(p))
    chance = np.exp([score(p) for p in paths])
    chance /= chance.sum()
    feature = lambda p: (x * p[:, None]).sum(axis=0)
    pair = lambda p: sum((np.outer(np.eye(2)[a], np.eye(2)[b]) for a, b in itertools.pairwise(p)), np.zeros((2, 2)))
    mean = [sum(c * f(p) for c, p in zip(chance, paths, strict=True)) for f in (feature, pair)]
    return feature(np.array(y)) - mean[0], pair(np.array(y)) - mean[1]


def test_gradient_equals_all_paths():
    rnd = np.random.default_rng(5)
    lens, length = [1, 3, 6], 6
    x, y, on = rnd.normal(0, 1, (3, length, quality.FEATURES)), rnd.integers(0, 2, (3, length)), np.zeros((3, length), bool)
    for i, n in enumerate(lens):
        on[i, :n], x[i, n:], y[i, n:] = True, 0, 0
    w, moves, weight = rnd.normal(0, 1, quality.FEATURES), rnd.normal(0, 1, (2, 2)), np.array([1.0, 0.5, 2.0])
    got = quality._step(x, y, on, weight, w, moves)
    slow = [slow_gradient(x[i, :n], y[i, :n], w, moves) for i, n in enumerate(lens)]
    for k in (0, 1):
        assert np.allclose(got[k], sum(c * g[k] for c, g in zip(weight, slow, strict=True)))


def test_documents_are_held_to_their_labels_side_of_the_share():
    words, unary = np.array([10.0, 10.0, 10.0]), np.array([3.0, 9.0, 2.0])
    bad, good = (quality.held_path(u, np.zeros((2, 2)), words, y) for u, y in ((unary, 0), (-unary, 1)))
    assert bad.tolist() == [0, 1, 0] and good.tolist() == [1, 0, 1]
    assert quality.held_path(unary + 99, np.zeros((2, 2)), words, 0).tolist() == [0, 0, 0]


def corpus():
    rnd, rows = random.Random(9), []
    for i in range(400):
        good = i % 3 > 0
        line = lambda: " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(rnd.randint(6, 14))) + "."
        junk = lambda: " | ".join("".join(rnd.choices("ABCDEF#$", k=6)) for _ in range(8))
        rows.append((i, "\n".join((line if (rnd.random() < 0.9) == good else junk)() for _ in range(rnd.randint(5, 15))), int(good)))
    return rows


def test_field_learns_lines_and_decides(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.rate(docs, labels).collect()}
    right = [out[i].kept == bool(y) for i, _, y in rows if not out[i].base_failed]
    assert np.mean(right) > 0.97
    held = [i for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0 and not out[i].base_failed]
    assert np.mean([out[i].kept == bool(rows[i][2]) for i in held]) > 0.95
    for i, t, _ in rows:
        assert tuple(out[i])[1:7] == slow_base(t)


def test_lines_of_mixed_documents_are_told_apart(spark):
    """Junk lines in good documents and plain lines in bad ones get their own labels, though labels are documents'."""
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    w, moves = quality.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))
    right = []
    for i, t, _ in rows:
        if zlib.crc32(str(i).encode()) % 5 == 0:
            lines = quality._content_lines(t.encode())
            path = quality.viterbi(quality.line_features(lines) @ w, moves)
            right += [bool(y) == (b"|" not in line) for y, line in zip(path.tolist(), lines, strict=True)]
    assert np.mean(right) > 0.95


def test_long_documents_are_learnt_from(spark):
    rnd = random.Random(4)
    plain = lambda k: "\n".join(f"plain words of line {rnd.random()} number {k} {i} here" for i in range(150))
    junk = lambda k: "\n".join(f"## {rnd.random()} $$$ || {k} {i} ### %%% && ** | |" for i in range(150))
    rows = [(i, (plain if i % 2 else junk)(i), i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    w, moves = quality.train(docs, labels)
    assert w is not quality.PRIOR[0]
    assert all(r.kept == bool(r.doc_id % 2) for r in quality.rate(docs, labels).collect())


def test_a_giant_document_does_not_end_the_sample(spark, monkeypatch):
    """Each labelled document in turn has more lines than the whole sample may have; the field is learnt all the same."""
    monkeypatch.setattr(quality, "FIT_LINES", 900)
    monkeypatch.setattr(quality, "FIT_DOC_LINES", 30)
    rows = corpus()[:60]
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    giant = "\n".join(f"plain words of line {i} in a very long book" for i in range(1_500))
    for big in (0, 17, 41):
        docs = spark.createDataFrame([(i, giant if rows[big][0] == i else t) for i, t, _ in rows], "doc_id long, text string")
        w, moves = quality.train(docs, labels)
        assert w is not quality.PRIOR[0] and moves is not quality.PRIOR[1]


def test_odd_rows(spark):
    rows = [(1, None), (None, "w " * 50), (2, "x" * 200_000), (3, "\n".join(f"a line with several plain words {i} here" for i in range(30_000))), (4, "dup"), (4, "dup")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("quality", F.lit(0))
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    for y in (labels, labels.limit(0)):
        out = quality.rate(docs, y).collect()
        assert len(out) == len(rows) and {r.doc_id: r.n_words for r in out}[3] == 240_000
        assert next(r for r in out if r.doc_id == 3).kept and not any(r.kept for r in out if r.base_failed)
    assert quality.rate(docs.limit(0), labels).count() == 0
