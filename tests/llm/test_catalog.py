"""The queries with SQL against DuckDB; all queries by name; the pipeline's stages against plain versions."""

import itertools

import duckdb
import pytest

import corpus_pipeline
from scoreloom.llm import catalog, chunks, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_names():
    names = list(catalog.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    got = catalog.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    text = lambda rows: sorted(str([round(x, 8) if isinstance(x, float) else x for x in r]) for r in rows)
    assert text(got.select(names).collect()) == text(cur.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    # toxicity: exactly the rows that the scores reject go
    after = stages["toxicity"](spark, kept, SF).cache()
    toxic = {r.doc_id for r in toxicity.score_documents(kept, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    assert after.columns == columns and {r.doc_id for r in after.collect()} == {r.doc_id for r in kept.collect()} - toxic
    # near duplicates: the smallest id of every group of pairs at most three bits apart
    rows = {r.doc_id: simhash.fingerprint(r.text) for r in after.collect()}
    group = {i: i for i in rows}
    for _ in range(6):
        for i in rows:
            group[i] = min(group[j] for j in rows if (rows[i] ^ rows[j]).bit_count() <= 3)
    kept_ids = sorted(set(group.values()))
    # and of those the smallest id of every group of pairs with a Jaccard similarity of 0.8 over five-word shingles
    sets = {}
    for r in after.collect():
        words = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}
    near = {i: i for i in kept_ids}
    for _ in range(4):
        for a, b in itertools.combinations(kept_ids, 2):
            if near[a] != near[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                near[a] = near[b] = min(near[a], near[b])
    one = stages["near_dedup"](spark, after, SF).cache()
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(set(near.values()))
    # repeated passages: of each chunk that several texts have, only the first keeps it inside a long repeat; others stay whole
    cut = stages["substring_dedup"](spark, one, SF).cache()
    before, texts = ({r.doc_id: r.text for r in d.collect()} for d in (one, cut))
    flagged = {r.doc_id for r in chunks.repeated_spans(one).collect()}
    assert cut.columns == columns and all(texts[i] == before[i] for i in texts if i not in flagged)
    assert all(len(texts[i]) < len(before[i]) for i in flagged & set(texts)) and set(before) - set(texts) <= flagged
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    # mix: each source has its share, up to a document
    mixed = stages["mixing"](spark, cut, SF).cache()
    size = {i: len((t or "").encode().split()) for i, t in texts.items()}
    taken = {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    goal = {}
    for r in cut.collect():
        goal.setdefault(r.source, []).append(size[r.doc_id])
    assert mixed.columns == columns and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= sum(max(v) for v in goal.values())
    assert all(taken.get(s, 0) <= 2 * sum(v) + max(v) for s, v in goal.items())
    # packing: every piece of every row once, none overlapping
    out = stages["packing"](spark, mixed, SF).collect()
    assert sum(r.piece == 0 for r in out) == mixed.count()
    fill = {}
    for r in out:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
