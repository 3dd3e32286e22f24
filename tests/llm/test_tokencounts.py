"""Counts at every prefix against the tokenizer itself on each prefix; budgets, odd rows and long texts."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scoreloom.llm import catalog, tokencounts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    *("a", "the ", "tion", "don't", "'re", "'l", "'", "Z'", "1", "23", "!", "...", "---", "A", "é", "ß", "日本", "語", "é"),
    *(" ", "  ", "        ", "\n", "\n\n", "\t", "\r\n", " ", "　", "\x1c", "\u0085"),
    *("<|endoftext|>", "<|end", "՘", "\U00010940", "⁠", "😀", "👩‍👩‍👧"),
]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_every_prefix(whole):
    draw = random.Random(5)
    table = tokencounts.loaded(PATH)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 14))) for _ in range(1500)]
    texts += ["".join(draw.choices("ab'x 1\n.", k=40)) for _ in range(100)]
    for text, counts in zip(texts, table.texts(texts), strict=True):
        assert counts.tolist() == [whole(text[:i]) for i in range(1, len(text) + 1)], repr(text)


def test_blocks_and_forgetting_change_nothing(monkeypatch, whole):
    draw = random.Random(6)
    text = " ".join("".join(draw.choices("abcdeé \n'", k=draw.randint(1, 12))) for _ in range(400)) + "x" * 300
    expected = [whole(text[:i]) for i in range(1, len(text) + 1)]
    for name, value in (("_BLOCK", 64), ("_PIECES", 10), ("_CHARS", 50), ("_PAIRS", 20)):
        monkeypatch.setattr(tokencounts, name, value)
    table = tokencounts.Prefixes(PATH)
    assert table.text(text).tolist() == expected
    assert [c.tolist() for c in table.texts([text, "short one", text])][2] == expected


def test_long_runs_without_words(whole):
    for text in ("ab" * 30_000, " " * 20_000, "日" * 5_000, "x " * 20_000):
        assert tokencounts.loaded(PATH).text(text)[-1] == whole(text)


ROWS = [(1, "one two three"), (1, "one two three"), (None, "hello <|endoftext|> world"), (2, None), (3, ""), (4, " \n "), (5, "word " * 3000)]
SCHEMA = "doc_id long, text string"


def test_counts_of_odd_rows(spark, whole):
    got = tokencounts.count_tokens(spark.createDataFrame(ROWS, SCHEMA), limit=10)
    expected = []
    for i, t in ROWS:
        t = t or ""
        fits = [n for n in range(len(t) + 1) if whole(t[:n]) <= 10] if len(t) < 100 else [49]
        expected.append((i, len(t.encode()), whole(t), whole(t) > 10, max(fits)))
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert key(got.collect()) == key(expected)
    assert tokencounts.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stored_counts_answer_budgets(spark, whole):
    docs = spark.createDataFrame(ROWS[:6], SCHEMA)
    rows = tokencounts.prefix_counts(docs).select(
        "doc_id", "counts", tokencounts.tokens_at(F.col("counts"), 5).alias("at5"), tokencounts.tokens_at(F.col("counts"), 10_000).alias("all"), tokencounts.chars_within(F.col("counts"), 3).alias("in3")
    )
    texts = {i: t or "" for i, t in ROWS[:6]}
    for r in rows.collect():
        t = texts[r.doc_id]
        assert r.counts == [whole(t[:n]) for n in range(1, len(t) + 1)]
        assert (r.at5, r["all"]) == (whole(t[:5]), whole(t)) and r.in3 == max(n for n in range(len(t) + 1) if whole(t[:n]) <= 3)


def test_truncated_keeps_columns(spark, whole):
    docs = spark.createDataFrame([("k", t, i) for i, t in ROWS], "text_to_cut string, text string, counts long")
    out = tokencounts.truncated(docs, limit=4)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    for r in out.collect():
        assert r.text_to_cut == "k" and (r.text is None) == (r.counts == 2) and whole(r.text or "") <= 4
    assert {r.text for r in out.where("counts = 5").collect()} == {"word word word word"}


def test_query_counts_as_the_tokenizer(spark, whole):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = catalog.queries()["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        n = whole(docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)
