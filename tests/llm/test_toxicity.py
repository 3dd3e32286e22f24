import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from scoreloom.llm import toxicity


def slow_score(model, text):
    """The machine's sum over all pairs of terms."""
    rows = sorted({int(model.place[t]) for w in toxicity._WORDS.findall((text or "").lower()) for t in toxicity.word_terms(w) if model.place[t] >= 0})
    z = model.bias + sum(model.weights[i] for i in rows)
    z += sum(float(model.factors[i] @ model.factors[j]) for a, i in enumerate(rows) for j in rows[a + 1 :])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def corpus(n=1500):
    """Toxic means an insult together with a group mention; either alone is harmless."""
    rnd, rows = random.Random(6), []
    for i in range(n):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(5, 60))]
        insult, group = rnd.random() < 0.4, rnd.random() < 0.4
        words += [rnd.choice(("vile", "filthy"))] * insult + [rnd.choice(("northerners", "southerners"))] * group
        rnd.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_learns_a_pair_that_no_sum_of_weights_can(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in out if out[i].held_out} == set(held)
    assert np.mean([out[i].predicted == rows[i][2] for i in held]) > 0.95
    model = toxicity.train(docs, labels)
    assert all(abs(out[i].score - slow_score(model, rows[i][1])) < 1e-9 for i in held[:50])


def exclusive(n=3000, vocabulary=1000):
    """Toxic means exactly one of two words, each in half of the texts, so neither alone tells anything."""
    rnd, rows = random.Random(9), []
    for i in range(n):
        words = [f"w{rnd.randint(0, vocabulary)}" for _ in range(rnd.randint(20, 60))]
        one, two = rnd.random() < 0.5, rnd.random() < 0.5
        rows.append((i, " ".join(rnd.sample(words + ["alpha"] * one + ["omega"] * two, len(words) + one + two)), int(one != two)))
    return rows


def beside(n=3000):
    """Toxic means a slur, or a group's name, rare and as common in clean texts, together with a word that tells a little."""
    rnd, rows = random.Random(10), []
    for i in range(n):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(20, 60))]
        hint, group, slur = rnd.random() < 0.3, rnd.random() < 0.1, rnd.random() < 0.02
        rows.append((i, " ".join(words + ["hateful"] * hint + ["northerners"] * group + ["slur"] * slur), int(slur or (hint and group))))
    return rows


def test_learns_pairs_of_words_that_tell_nothing_alone(spark):
    for rows, least in ((exclusive(), 0.97), (beside(), 0.99)):
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
        labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
        out = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
        held = [i for i in out if out[i].held_out]
        assert np.mean([out[i].predicted == rows[i][2] for i in held]) > least


def test_fit_beats_every_additive_rule():
    """On the exclusive-or any sum of weights and bias is right for three of the four cases at most."""
    a, b = np.random.default_rng(4).integers(0, 2, (2, 3000))
    docs = [np.array([k for k, x in enumerate((u, v)) if x], np.int32) for u, v in zip(a, b, strict=True)]
    y = (a != b).astype(float)
    machine = toxicity.fit(docs, y, np.arange(3000) % 4 == 0, np.arange(2))
    assert np.mean([(machine.score(d + 1) >= 0.5) == t for d, t in zip(docs, y, strict=True)]) > 0.99
    sums = [np.mean((bias + u * a + v * b >= 0) == y) for bias in (-1.5, -0.5, 0.5, 1.5) for u in (-1, 0, 1) for v in (-1, 0, 1)]
    assert max(sums) < 0.8


def test_held_out_labels_never_matter(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    one, two = (sorted(toxicity.score_documents(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in ([(r[0], r[2]) for r in rows], flip))
    assert one == two


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "vile northerners"), (3, "x " * 100_000), (4, "dup"), (4, "dup"), (5, "É vile")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(0))
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 1), (None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    for y in (labels, labels.limit(0)):
        out = toxicity.score_documents(docs, y).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
        assert next(r for r in out if r.doc_id is None).held_out
    kept = toxicity.keep_civil(docs, labels)
    assert kept.columns == docs.columns
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_company_in_steps_finds_the_same_terms(spark, monkeypatch):
    """Terms beside telling ones are counted some at a time; how many at a time changes nothing."""
    rnd = random.Random(21)
    rows = []
    for i in range(600):
        toxic = i % 2
        words = [f"t{k}" for k in range(30) if rnd.random() < (0.35 if toxic else 0.15)] + [f"n{rnd.randrange(60)}" for _ in range(12)]
        rows.append((toxic, sorted({zlib.crc32(w.encode()) & 0xFFFFF for w in words})))
    found = spark.createDataFrame(rows, "toxic int, terms array<int>").cache()
    whole = toxicity.telling_terms(found)
    monkeypatch.setattr(toxicity, "_COMPANY_STEP", 3)
    parts = toxicity.telling_terms(found)
    assert len(whole[0]) > 20 and whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
