"""Identity components and splits that no identity spans."""

from __future__ import annotations

from heapq import heapify, heapreplace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settle import settle


def identity_components(items: DataFrame, key: str = "item_id", ids: tuple[str, ...] = ("subject_id", "source_subject_id")) -> DataFrame:
    """(key, component): items that share an identity, through any chain, have one component, named by its smallest
    identity; an item without one is its own. Minima run along identities, not pairs of items, and a round also jumps
    from a label to that label's label, so long chains take few rounds. Rounds are checkpointed in the shared folder."""
    rows = items.select(key, F.array_compact(F.array(*ids)).alias("ids"))
    pairs = rows.where("size(ids) = 2").select(F.col("ids")[0].alias("a"), F.col("ids")[1].alias("b")).where("a <> b").distinct()
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = settle(edges)
    label = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    done = False
    while not done:  # labels only ever fall
        near = edges.join(label, edges["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = label.join(near, label["node"] == near["a"]).select("node", "label", F.least("label", "m").alias("new"))
        up = step.select(F.col("node").alias("_n"), F.col("new").alias("_l"))
        step = settle(step.join(up, step["new"] == up["_n"], "left").select("node", "label", F.least("new", F.coalesce("_l", "new")).alias("new")))
        done = step.where("label <> new").isEmpty()
        label = step.select("node", F.col("new").alias("label"))
    first = rows.withColumn("node", F.try_element_at("ids", F.lit(1)))
    out = first.join(label, "node", "left")
    return out.select(key, F.coalesce(F.concat(F.lit("id:"), F.coalesce("label", "node")), F.concat(F.lit("item:"), F.col(key))).alias("component"))


def dealt(n: int, size: int, have: dict[str, float], share: dict[str, float]) -> dict[str, int]:
    """How many of ``n`` components of one size each split gets, dealt one by one to the split furthest below its share, the
    first of equal ones. A split's need falls with each that it gets, so the ``n`` greatest needs are met; a search for the
    least of them spares dealing all but the last few one by one."""
    need = lambda s, k: (share[s] - have[s] - k * size) / max(share[s], 1e-9)
    got = dict.fromkeys(share, 0)
    low, high = min(need(s, n) for s in share), max(need(s, 0) for s in share)
    for _ in range(60):
        level = (low + high) / 2
        least = {s: max(0, min(n, int((share[s] - have[s] - level * max(share[s], 1e-9)) // size))) for s in share}
        if sum(least.values()) <= max(0, n - len(share)):
            high, got = level, least
        else:
            low = level
    heap = [(-need(s, got[s]), i, s) for i, s in enumerate(share)]
    heapify(heap)
    for _ in range(n - sum(got.values())):
        _, i, s = heap[0]
        got[s] += 1
        heapreplace(heap, (-need(s, got[s]), i, s))
    return got


def identity_split(items: DataFrame, fractions: dict[str, float], seed: int = 0, key: str = "item_id") -> DataFrame:
    """(key, component, split): components, the largest first and by hash within a size, go to the split that is furthest below
    its share of all items; no identity spans two splits. Components of one size are dealt as a run, so the driver sees the
    distinct sizes and their counts alone."""
    if abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError(f"fractions must sum to 1, got {fractions}")
    comps = settle(identity_components(items, key=key))
    rank = F.sha1(F.concat(F.lit(f"{seed}:"), "component"))
    sizes = comps.groupBy("component").agg(F.count("*").alias("n"))
    sizes = settle(sizes.withColumn("hash", rank).withColumn("part", F.substring("hash", 1, 3)))
    counts = sizes.groupBy("n", "part").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("n").orderBy("part")) - F.col("m")
    starts = counts.select("n", "part", before.alias("before"))  # ranks are counted in parts of the hash and over them
    local = F.row_number().over(Window.partitionBy("n", "part").orderBy("hash", "component")) - 1
    ranked = sizes.withColumn("local", local).join(starts, ["n", "part"]).select("component", "n", (F.col("before") + F.col("local")).alias("rank"))

    runs = counts.groupBy("n").agg(F.sum("m").alias("m")).orderBy(F.col("n").desc()).collect()
    total = sum(r["n"] * r["m"] for r in runs)
    share, have, spans = {s: f * total for s, f in fractions.items()}, dict.fromkeys(fractions, 0.0), []
    for r in runs:
        at = 0
        for s, m in dealt(r["m"], r["n"], have, share).items():
            have[s] += m * r["n"]
            spans.append((r["n"], at, at + m, s))
            at += m
    spans = items.sparkSession.createDataFrame(spans, "of long, first long, end long, split string")
    chosen = ranked.join(F.broadcast(spans), F.expr("n = of and rank >= first and rank < end")).select("component", "split")
    return comps.join(chosen, "component").select(key, "component", "split")
