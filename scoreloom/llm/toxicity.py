"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their leading 4 and 5 characters (word stems), each hashed to
``HASH_BITS`` bits. The machine is fitted on at most ``FIT_ROWS`` labelled rows, those with the smallest hash of their
id (all of them, if there are fewer), never one of the held-out fold. Their hashed terms are counted in Spark. Kept are
terms that tell the classes apart alone; terms that do so among the documents with another telling term; and frequent
terms that do so only as pairs, in which case either one alone may tell nothing. The model has a weight and ``FACTORS``
factors for each, so a pair of terms counts beyond the sum of its parts. The penalty and the number of epochs are chosen on
an inner fold of the rows it learns from. Every row of the table is then scored over its whole text.

Nulls and odd cases: a null or empty text has no terms and gets the score of the bias; a null id is held out; rows that
repeat an id are scored each, and learnt from once; an id with several labels counts as toxic if one says so; labels
without a document are ignored; with no labels, or only one class, every score is the share of toxic labels (0 without
any). Other columns are never inputs. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage, free_names, map_batches, sliced

#: The bound on rows that the classifier is fitted on.
FIT_ROWS = 12_000
HASH_BITS = 20
#: A term enters the machine by its likelihood ratio (or chi-square) with the label: alone; beside one of the COMPANY terms that tell most; or as
#: a pair with another one of the FREQUENT terms with most documents. Chance hardly explains such values (PAIR_CHI is
#: higher, for there are more pairs than terms).
FREQUENT = 1_024
COMPANY = 64
#: So many of these are counted at once, which bounds what a task holds.
_COMPANY_STEP = 16
#: Texts that a task turns into Python strings at once.
_SLICE = 512
LEAST_CHI, PAIR_CHI = 16.0, 40.0
FACTORS = 4
#: Adam's rate, documents a step, most epochs; the penalties that inner folds choose from.
RATE, BATCH, EPOCHS = 0.03, 64, 16
PENALTIES = (0.003, 0.03, 0.3)
_WORDS = re.compile(r"\w+")
_MASK = (1 << HASH_BITS) - 1
_CACHE = 200_000


def word_terms(word: str) -> tuple[int, ...]:
    """Hashes of a lower-cased word and of its stems."""
    b = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) & _MASK, zlib.crc32(b"4" + word[:4].encode("utf-8", "surrogatepass")) & _MASK, zlib.crc32(b"5" + word[:5].encode("utf-8", "surrogatepass")) & _MASK


def terms(text: str | None) -> np.ndarray:
    found: set[int] = set()
    for w in set(_WORDS.findall((text or "").lower())):
        found.update(word_terms(w))
    return np.fromiter(found, np.int32, len(found))


@dataclass
class Machine:
    """place: hashed term to row of weights, -1 for none."""

    bias: float
    place: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray) -> float:
        """Probability of a document that has these distinct rows of weights."""
        v = self.factors[rows]
        s = v.sum(axis=0)
        z = self.bias + self.weights[rows].sum() + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _segments(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All docs' rows one after another, and where each begins; a doc without rows takes the spare row 0."""
    filled = [d if len(d) else np.zeros(1, np.int32) for d in docs]
    return np.concatenate(filled), np.concatenate([[0], np.cumsum([len(d) for d in filled])])


def _forward(w: dict[str, np.ndarray], flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = w["v"][flat]
    s = np.add.reduceat(v, begin, axis=0)
    squares = np.add.reduceat(np.einsum("ij,ij->i", v, v), begin)
    z = w["b"][0] + np.add.reduceat(w["w"][flat], begin) + 0.5 * (np.einsum("ij,ij->i", s, s) - squares)
    return z, v, s


def descend(docs: list[np.ndarray], labels: np.ndarray, size: int, penalty: float, epochs: int) -> Iterator[dict[str, np.ndarray]]:
    """Adam on the log loss with decayed weights, in a fixed order; the parameters after each epoch. Row 0 is spare."""
    flat, starts = _segments(docs)
    n, prior = len(docs), float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
    rng = np.random.default_rng(8)
    w = {"b": np.array([np.log(prior / (1 - prior))]), "w": np.zeros(size), "v": rng.normal(0, 0.05, (size, FACTORS))}
    m, u = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            batch = order[at : at + BATCH]
            lens = starts[batch + 1] - starts[batch]
            begin = np.cumsum(lens) - lens
            idx = flat[np.repeat(starts[batch] - begin, lens) + np.arange(lens.sum())]
            z, v, s = _forward(w, idx, begin)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            each = np.repeat(g, lens)
            pull = each[:, None] * (np.repeat(s, lens, axis=0) - v)
            grads = {"b": np.array([g.sum()]), "w": np.bincount(idx, weights=each, minlength=size)}
            grads["v"] = np.stack([np.bincount(idx, weights=pull[:, f], minlength=size) for f in range(FACTORS)], axis=1)
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                u[k] = 0.999 * u[k] + 0.001 * grads[k] ** 2
                w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(u[k] / (1 - 0.999**step)) + 1e-8)
                if k != "b":
                    w[k] *= 1 - RATE * penalty
            w["w"][0], w["v"][0] = 0.0, 0.0
        yield {k: x.copy() for k, x in w.items()}


def fit(docs: list[np.ndarray], labels: np.ndarray, checked: np.ndarray, best: np.ndarray) -> Machine:
    """``docs`` has each document's rows of ``best``, the hashed terms that are kept. The penalty and the number of epochs are
    those with the least log loss on the ``checked`` documents, learnt from the rest; the machine is then fitted on all."""
    place = np.full(1 << HASH_BITS, -1, np.int32)
    n, toxic = len(docs), float(labels.sum())
    prior = toxic / n if n else 0.0
    if toxic in (0.0, float(n)):
        return Machine(float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))), place, np.zeros(1), np.zeros((1, FACTORS)))
    place[best] = np.arange(1, len(best) + 1)
    docs, size = [d + 1 for d in docs], len(best) + 1
    inner, outer = np.flatnonzero(~checked), np.flatnonzero(checked)
    chosen = (PENALTIES[0], EPOCHS)
    if len(outer) and 0 < labels[inner].sum() < len(inner):
        flat, starts = _segments([docs[i] for i in outer])
        losses = {}
        for penalty in PENALTIES:
            for epoch, w in enumerate(descend([docs[i] for i in inner], labels[inner], size, penalty, EPOCHS), 1):
                z = np.clip(_forward(w, flat, starts[:-1])[0], -30, 30)
                losses[penalty, epoch] = float((np.logaddexp(0, z) - labels[outer] * z).mean())
        chosen = min(losses, key=lambda k: (losses[k], k))
    *_, w = descend(docs, labels, size, *chosen)
    return Machine(float(w["b"][0]), place, w["w"], w["v"])


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # bounded, so it can be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "toxic", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, _SLICE):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.sort(terms(t)) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))], ["id", "toxic", "terms"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_batches(texts, work, f"id {kind}, toxic int, terms array<int>")
    found = cut_lineage(found.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms")))
    telling, frequent = telling_terms(found)
    candidates = np.union1d(telling, frequent)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.flatnonzero(np.isin(candidates, np.asarray(t.values), assume_unique=True)).astype(np.int32).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["id", "toxic", "rows"])

    # at most ``rows`` documents, each with those of its terms that are candidates
    checked = (F.pmod(F.xxhash64(F.lit("inner"), "id"), F.lit(4)) == 0).alias("checked")
    got = map_batches(found, keep, f"id {kind}, toxic int, rows binary").orderBy(F.xxhash64("id"), "id").select("toxic", checked, "rows").collect()
    members, toxic = [np.frombuffer(bytes(r["rows"]), np.int32) for r in got], np.array([r["toxic"] for r in got], float)
    kept = np.isin(candidates, telling)
    kept[paired_rows(members, toxic, np.flatnonzero(np.isin(candidates, frequent)), len(candidates))] = True
    place = np.cumsum(kept, dtype=np.int32) - 1
    return fit([place[m[kept[m]]] for m in members], toxic, np.array([r["checked"] for r in got], bool), candidates[kept])


def telling_terms(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of ``found(toxic, terms)`` the hashed terms that tell the classes apart, alone or among the documents that have one of
    the ``COMPANY`` terms that tell most; and the ``FREQUENT`` most frequent ones. Both in order."""
    n, toxic = found.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    none = np.zeros(0, np.int64)
    if toxic in (0, n):
        return none, none
    gather = lambda frame: np.sort(np.array([r["term"] for r in frame.select("term").distinct().collect()], np.int64))
    counted = found.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("hit"))
    counted = cut_lineage(counted.where("df >= 3"))  # at most the sample's terms
    frequent = gather(counted.orderBy(F.col("df").desc(), "term").limit(FREQUENT))

    def surprise(prior: Column) -> Column:
        """Likelihood ratio of ``hit`` among ``df`` against a share of ``prior``; trustworthy for small counts too."""
        rate, miss = F.col("hit") / F.col("df"), F.col("df") - F.col("hit")
        part = lambda n, p, q: F.when(n > 0, n * F.log(p / q)).otherwise(0.0)
        return 2 * (part(F.col("hit"), rate, prior) + part(miss, 1 - rate, 1 - prior))

    scored = counted.withColumn("chi", surprise(F.lit(toxic / n)))
    company = scored.where(f"chi >= {LEAST_CHI} and hit < df and hit > 0").orderBy(F.col("chi").desc(), "term").limit(COMPANY)
    company = company.select(F.col("term").alias("beside"), (F.col("hit") / F.col("df")).alias("prior"), F.col("df").alias("whole")).collect()
    beside = [np.zeros(0, np.int64)]
    for at in range(0, len(company), _COMPANY_STEP):
        some = F.broadcast(found.sparkSession.createDataFrame(company[at : at + _COMPANY_STEP]))
        both = found.select("toxic", "terms", F.explode("terms").alias("beside")).join(some, "beside")
        both = both.select("beside", "prior", "whole", "toxic", F.explode("terms").alias("term")).where("term <> beside")
        both = both.groupBy("beside", "prior", "whole", "term").agg(F.count("*").alias("df"), F.sum("toxic").alias("hit"))
        both = both.where("df >= 5 and df < whole").withColumn("chi", surprise(F.col("prior"))).where(f"chi >= {PAIR_CHI}")
        beside.append(gather(both.select(F.explode(F.array("beside", "term")).alias("term"))))
    alone = gather(scored.where(f"chi >= {LEAST_CHI}"))
    return np.union1d(alone, np.concatenate(beside)), frequent


def paired_rows(docs: list[np.ndarray], labels: np.ndarray, frequent: np.ndarray, size: int) -> np.ndarray:
    """Of the ``frequent`` rows (of ``size`` in all) those that tell the classes apart together with another one, whatever they
    tell alone: pairs whose centred product goes with the label more than chance explains."""
    n, used = len(docs), len(frequent)
    if not n or not used or labels.min() == labels.max():
        return np.zeros(0, np.int64)
    place = np.full(size, -1)
    place[frequent] = np.arange(used)
    share = np.bincount(np.concatenate([place[d][place[d] >= 0] for d in docs]), minlength=used) / n
    rest = labels - labels.mean()
    products = np.zeros((used, used), np.float32)
    for at in range(0, n, 1024):
        block = np.zeros((min(1024, n - at), used), np.float32)
        for i, d in enumerate(docs[at : at + 1024]):
            block[i, place[d][place[d] >= 0]] = 1
        block -= share.astype(np.float32)
        products += block.T @ (block * rest[at : at + 1024, None].astype(np.float32))
    spread = share * (1 - share)
    variance = n * rest.var() * np.outer(spread, spread)
    chi = np.where(variance >= 5, products**2 / np.maximum(variance, 1e-9), 0.0)  # fewer cases are no evidence
    np.fill_diagonal(chi, 0)
    return frequent[(chi >= PAIR_CHI).any(axis=1)]


def score(docs: DataFrame, model: Machine, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with one more column, the probability that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c != into]
    frame = docs.select(*columns, F.col(text_col).alias(*free_names(docs, "scored")))
    schema = docs.select(*columns).schema.add(into, "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        known: dict[str, tuple[int, ...]] = {}
        for b in sliced(batches, _SLICE):
            scores = []
            for text in b.column(b.num_columns - 1).to_pylist():
                rows: set[int] = set()
                for word in set(_WORDS.findall((text or "").lower())):
                    got = known.get(word)
                    if got is None:
                        if len(known) >= _CACHE:
                            known.clear()
                        got = known[word] = tuple(p for p in machine.place[list(word_terms(word))].tolist() if p >= 0)
                    if got:
                        rows.update(got)
                scores.append(machine.score(np.array(sorted(rows), np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*columns, into])

    return map_batches(frame, work, schema)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = score(rows, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that the model calls toxic."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    (into,) = free_names(docs, "toxic_score")
    return score(docs, model, text_col, into).where(F.col(into) < 0.5).drop(into)
