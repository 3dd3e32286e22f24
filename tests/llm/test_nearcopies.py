import itertools
import random

import corpus_pipeline
from scoreloom.llm import nearcopies, simhash


def similarity(a, b):
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def slow_kept(rows):
    label = {i: i for i, _ in rows}
    pairs = [(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if similarity(s, t) >= 0.8]
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return sorted(set(label.values()))


def corpus():
    """Bases with copies at all distances; most copies are near their base and not near each other."""
    rnd, texts = random.Random(4), []
    for b in range(6):
        base = [f"w{rnd.randint(0, 900)}" for _ in range(150)]
        texts.append(base)
        for _ in range(30):
            copy = list(base)
            for at in rnd.sample(range(150), rnd.randint(0, 7)):
                copy[at] = f"x{rnd.randint(0, 10**6)}"
            texts.append(copy)
    rnd.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_groups_equal_brute_force_also_over_many_leaves(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for leaf in (4, 128):
        monkeypatch.setattr(nearcopies, "LEAF", leaf)
        assert sorted(r.doc_id for r in nearcopies.keep_one_each(docs).collect()) == slow_kept(rows)


def test_near_dedup_keeps_one_of_near_copies_that_simhash_tells_apart(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_simhash = [r.doc_id for r in simhash.keep_one_each(docs).collect()]
    left = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    texts = dict(rows)
    alike = [(a, b) for a, b in itertools.combinations(sorted(by_simhash), 2) if similarity(texts[a], texts[b]) >= 0.8]
    assert any((simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > 3 for a, b in alike)
    assert left < set(by_simhash) and not [1 for a, b in alike if {a, b} <= left]
    # each that is gone has one that stayed, reached over close fingerprints or similar shingles
    fps = {i: simhash.fingerprint(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    pairs = [(a, b) for a, b in itertools.combinations(texts, 2) if (fps[a] ^ fps[b]).bit_count() <= 3 or similarity(texts[a], texts[b]) >= 0.8]
    for _ in range(6):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert {group[i] for i in left} == set(group.values())


def test_odd_rows(spark):
    rows = [(5, "a b c d"), (3, "A b  c\td"), (9, None), (8, ""), (7, "x " * 30_000), (7, "x " * 30_000), (None, "lone words here"), (4, "a b c e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in nearcopies.keep_one_each(docs).collect()]
    assert sorted(kept, key=lambda i: (i is None, i or 0)) == [3, 4, 7, 8, None]
    assert nearcopies.keep_one_each(docs.limit(0)).count() == 0
