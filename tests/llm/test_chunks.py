import itertools
import random

from pyspark.sql import functions as F

from scoreloom.llm import chunks

RND = random.Random(11)


def prose(n, rnd=RND):
    return " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8))) for _ in range(n))


def slow_gear(data, i):
    h = 0
    for b in data[max(0, i - 31) : i + 1]:
        h = (h * 2 + int(chunks._GEAR[b])) % 2**32
    return h


SPACE = b"\t\n\x0b\x0c\r "


def ends_word(data, i):
    return data[i] in SPACE and i > 0 and data[i - 1] not in SPACE


def slow_forced(data, last):
    """The end in reach with the smallest hash: after a word if one ends there, else anywhere between characters."""
    least, most = chunks.CHUNK_BYTES
    reach = [i for i in range(last + least - 1, last + most)]
    at = [i for i in reach if ends_word(data, i)] or [i for i in reach if data[i + 1] & 0xC0 != 0x80]
    return min(at, key=lambda i: (slow_gear(data, i) % 65536, i)) + 1


def slow_boundaries(data):
    out, last = [0], 0
    least, most = chunks.CHUNK_BYTES
    strong = [i + 1 for i in range(len(data)) if ends_word(data, i) and slow_gear(data, i) % 65536 < 65536 // chunks.WORDS_A_CHUNK]
    for end in [*strong, len(data)]:
        while end - last > most:
            last = slow_forced(data, last)
            out.append(last)
        if end > last and (end - last >= least or end == len(data)):
            out.append(end)
            last = end
    return out


def test_boundaries_equal_one_byte_at_a_time():
    for data in (b"", b"a", b" ", prose(300).encode(), b"x" * 1000, b" \n" * 300, prose(40).encode() + b"y" * 700 + b" z", "é ü\n\n".encode() * 90, ("a" + "é한🙂" * 300).encode()):
        got = chunks.boundaries(data)
        assert got == slow_boundaries(data), data[:40]
        assert all(0 < j - i <= chunks.CHUNK_BYTES[1] for i, j in zip(got, got[1:], strict=False))


def test_insertions_move_boundaries_only_nearby():
    text = prose(2000).encode()
    other = text[:500] + b"some inserted words " + text[500:]
    parts = lambda d: {d[i:j] for i, j in itertools.pairwise(chunks.boundaries(d))}
    assert len(parts(text) - parts(other)) < 8


def test_passages_keep_aligned_chunks_in_any_context():
    """Of passages of 51 words, also of few distinct words, nearly all leave enough words in chunks that contexts share."""
    rnd = random.Random(2)
    for distinct, bound in ((51, 0.98), (12, 0.98), (5, 0.98)):
        caught = 0
        for _ in range(300):
            vocabulary = prose(distinct, rnd).split()
            passage = " ".join((vocabulary * 51)[:51])
            sides = []
            for _ in range(2):
                data = f"{prose(rnd.randint(5, 60), rnd)} {passage} {prose(30, rnd)}".encode()
                at = chunks.boundaries(data)
                sides.append([data[i:j] for i, j in itertools.pairwise(at)])
            other, best, run = set(sides[1]), 0, 0
            for part in sides[0]:
                run = run + len(part.split()) if part in other else 0
                best = max(best, run)
            caught += best >= chunks.MIN_WORDS
        assert caught >= bound * 300, (distinct, caught)


def test_passages_without_spaces_align(spark):
    rnd = random.Random(3)
    passage = "".join(rnd.choices("가나다라마바사아자차카타파하", k=900))
    a, b = (f"{prose(rnd.randint(5, 40), rnd)} {passage}".encode() for _ in range(2))
    parts = [{d[i:j] for i, j in itertools.pairwise(chunks.boundaries(d))} for d in (a, b)]
    assert sum(map(len, parts[0] & parts[1])) > 0.5 * len(passage.encode())


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    p, q, r = prose(90), prose(300), prose(80)
    rows = [(1, p), (2, f"{prose(30)} {p} {prose(30)}"), (2, q), (2, q), (None, f"{r} {prose(9)}"), (None, r), (3, f"{q} tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [(x.doc_id, x.text) for x in chunks.without_repeats(docs).collect()]
    assert sum(t == q for i, t in left if i == 2) == 2  # unique text survives, in each of its rows
    assert all(p not in t for i, t in left if i == 2) and next(t for i, t in left if i == 3) != rows[-1][1]
    assert sum(t.startswith(r) for i, t in left if i is None) == 1  # texts without an id repeat each other too
    same = spark.createDataFrame([(7, f"{p} x"), (7, f"{p} y"), (7, f"{p} z")], "doc_id long, text string")
    got = sorted(x.text for x in chunks.without_repeats(same).collect())
    assert sum(p in t for t in got) == 1


def fixture():
    """Documents, ids that must be caught (with the passage), ids that must be left alone."""
    docs, planted = [], {}
    line = "A very common opening line, eight words."
    for i in range(120):
        docs.append([i, f"{line}\n{prose(RND.randint(30, 200))}\n{prose(40)}"])
    for k in range(25):
        passage = prose(RND.randint(51, 120))
        for i in RND.sample(range(120), 3):
            at = docs[i][1].index("\n") + 1
            docs[i][1] = docs[i][1][:at] + passage + " " + docs[i][1][at:]
            planted.setdefault(k, []).append((i, passage))
    return docs, planted


def test_query_catches_planted_passages(spark):
    docs, planted = fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("place", F.lit(1)).repartition(4)
    spans = chunks.repeated_spans(frame).collect()
    texts = dict(docs)
    later = {i for found in planted.values() for i, _ in found if i != min(j for j, _ in found)}
    assert {r.doc_id for r in spans} == later
    for r in spans:
        part = texts[r.doc_id].encode()[r.span_start : r.span_end]
        assert r.source_doc_id < r.doc_id and len(part.split()) == r.n_words >= chunks.MIN_WORDS
        assert any(part[:40] in t.encode() for i, t in docs if i < r.doc_id)
    frame = frame.withColumn("n_chars", F.length("text"))
    left = {r.doc_id: r for r in chunks.without_repeats(frame).collect()}
    assert set(left) == set(texts) and left[0].digest == "clash"
    for i, t in texts.items():
        assert left[i].n_chars == len(left[i].text) and (i in later or left[i].text == t)
    for found in planted.values():
        assert [i for i, p in found if p in left[i].text] == [min(i for i, _ in found)]


def test_odd_rows(spark):
    p, q = prose(80), prose(70)
    rows = [(1, p), (2, p), (2, p), (None, p), (None, q), (None, q), (5, None), (6, ""), (7, " \n "), (8, "é " * 40_000), (9, q + " é\n" + p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = chunks.repeated_spans(docs)
    assert sorted({(r.doc_id is None, r.doc_id or 0) for r in spans.collect()}) == [(False, 2), (False, 9), (True, 0)]
    left = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in chunks.without_repeats(docs).collect()), key=str)
    kept = {k[1] for k in left if not k[0]}
    assert kept == {1, 5, 6, 7, 8, 9} and all(len(k[2].split()) < 16 for k in left if k[0])
    nine = next(k[2] for k in left if k[1] == 9)
    assert nine.startswith(q) and p not in nine
    empty = spark.createDataFrame([], "doc_id long, text string")
    wide = [(1, "é" * 900 + " " + p), (2, "aé" + "é" * 898 + "한" * 400 + " " + p)]
    found = {r.doc_id: r.text for r in chunks.without_repeats(spark.createDataFrame(wide, "doc_id long, text string")).collect()}
    assert found[1] == wide[0][1] and p not in found[2] and set(found[2]) <= set(wide[1][1])
    assert chunks.repeated_spans(empty).count() == 0 and chunks.without_repeats(empty).count() == 0


def brute_spans(docs, min_words=chunks.MIN_WORDS):
    """Bytes of each document that lie in a run of chunks, of min_words words and not a chunk more than these need, that a
    document before it has as it stands."""
    out = {}
    for n, (i, t) in enumerate(docs):
        data, covered = t.encode(), set()
        at = chunks.boundaries(data)
        before = [(d, set(chunks.boundaries(d))) for d in (x.encode() for _, x in docs[:n])]
        for a in range(len(at) - 1):
            if not data[at[a] : at[a + 1]].split():
                continue
            words, e = 0, a
            while e < len(at) - 1 and words < min_words:
                words += len(data[at[e] : at[e + 1]].split())
                e += 1
            run = data[at[a] : at[e]]
            # anywhere in the text before, at a chunk's beginning there
            if words >= min_words and any(d[p : p + len(run)] == run and p + len(run) in ends for d, ends in before for p in ends):
                covered |= set(range(at[a], at[e]))
        if covered:
            out[i, t] = covered
    return out


def test_shared_runs_of_words_against_brute_force(spark):
    """Documents that share word runs of 3 to 60 words with others: exactly the bytes in repeated runs are reported, each span
    stands in its source word for word, and spans that add up over sources don't come about."""
    rnd = random.Random(9)
    pool = prose(2500, rnd).split()
    docs = []
    for i in range(60):
        words = []
        while len(words) < 150:
            k, n = rnd.randrange(2400), rnd.choice([3, 5, 8, 12, 14, 20, 40, 60])
            words += pool[k : k + n] + prose(rnd.choice([0, 0, 2, 9]), rnd).split()
        docs.append((i, " ".join(words)))
    got, texts = {}, dict(docs)
    for r in chunks.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect():
        part = texts[r.doc_id].encode()[r.span_start : r.span_end]
        assert texts[r.source_doc_id].encode()[r.source_start : r.source_start + len(part)] == part and len(part.split()) == r.n_words >= 16
        got.setdefault((r.doc_id, texts[r.doc_id]), set()).update(range(r.span_start, r.span_end))
    assert got == brute_spans(docs) and len(got) > 10


def test_phrases_of_many_documents_are_no_passage(spark):
    """A text whose words all stand elsewhere, at most 14 in a row in any one document."""
    rnd = random.Random(12)
    words = prose(120, rnd).split()
    docs = [(k, " ".join([*prose(20, rnd).split(), *words[a : a + 14], *prose(20, rnd).split()])) for k, a in enumerate(range(0, 110, 2))]
    docs.append((1000, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r for r in chunks.repeated_spans(frame).collect() if r.doc_id == 1000] == []
    assert chunks.without_repeats(frame).where("doc_id = 1000").first().text == " ".join(words)


def test_overlapping_sources_are_cut_once(spark):
    rnd = random.Random(13)
    words = prose(160, rnd).split()
    docs = [(1, " ".join(words[:100])), (2, " ".join(words[60:])), (3, " ".join([*prose(30, rnd).split(), *words, *prose(30, rnd).split()]))]
    left = {r.doc_id: r.text for r in chunks.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert left[1] == docs[0][1] and len(left[3].split()) < 100
    kept = iter(docs[2][1].split())
    assert all(w in kept for w in left[3].split()[:-1])
