"""Provenance: closures of derivation, contamination verdicts, restricted lineage, registry checks.

The registry's tables are small (a row for each configured model, dataset or set), so they are broadcast by the planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Verdicts from best to worst.
VERDICTS = ("clean", "source_overlap", "overlap_excluded", "contaminated")
#: The modalities that a model of each modality can score.
ACCEPTS = {"video": ("video", "image", "audio_video"), "image": ("image",), "audio": ("audio", "audio_video"), "audio_video": ("audio_video",)}


def closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(node)``, ``edges(node, parent)`` to (source, node): each node and all that it derives from, itself included.
    Each step keeps only pairs that are new, so cycles end."""
    found = nodes.select(F.col("node").alias("source"), "node").distinct().cache()
    front = found
    while True:
        step = front.join(edges, "node").select("source", F.col("parent").alias("node")).distinct()
        front = step.join(found, ["source", "node"], "left_anti").cache()
        if front.isEmpty():
            return found
        found = found.unionByName(front).cache()


def verdicts(components: DataFrame, training: DataFrame, lineage: DataFrame) -> DataFrame:
    """``components(evalset, position, dataset, splits array)`` and ``training(model, position, dataset, level, split,
    items_file)`` to (model, evalset, verdict, reasons, exclude): the worst finding over all pairs, the reasons in order.

    A model trained on the component's own dataset: another official split is a reason only; pretraining overlaps; with a
    list of items seen the items are excluded; else it is contaminated. Otherwise any shared ancestor is an overlap."""
    c = components.select("evalset", F.col("position").alias("cp"), F.col("dataset").alias("cd"), "splits")
    t = training.select("model", F.col("position").alias("tp"), F.col("dataset").alias("td"), "level", "split", "items_file")
    ancestors = lineage.groupBy("source").agg(F.array_sort(F.collect_set("node")).alias("up"))
    pairs = c.crossJoin(t)  # configured components times configured training rows
    pairs = pairs.join(ancestors.select(F.col("source").alias("cd"), F.col("up").alias("cu")), "cd", "left").join(ancestors.select(F.col("source").alias("td"), F.col("up").alias("tu")), "td", "left")
    shared = F.array_sort(F.array_intersect(F.coalesce("cu", F.array("cd")), F.coalesce("tu", F.array("td"))))
    same = F.col("td") == F.col("cd")
    disjoint = F.coalesce(~F.array_contains("splits", F.col("split")), F.lit(False))
    severity = F.when(same & disjoint, 0).when(same & (F.col("level") == "pretrain"), 1).when(same & F.col("items_file").isNotNull(), 2).when(same, 3).when(F.size(shared) > 0, 1).otherwise(0)
    reason = (
        F.when(same & disjoint, F.concat(F.lit("other split of "), "td", F.lit(": "), "split"))
        .when(same & (F.col("level") == "pretrain"), F.concat(F.lit("pretrained on "), "td"))
        .when(same & F.col("items_file").isNotNull(), F.concat("level", F.lit(" data includes "), "td", F.lit("; excluding "), "items_file"))
        .when(same, F.concat("level", F.lit(" data includes "), "td"))
        .when(F.size(shared) > 0, F.concat("level", F.lit(" data "), "td", F.lit(" shares "), F.array_join(shared, "+"), F.lit(" with "), "cd"))
    )
    rows = pairs.select("model", "evalset", severity.alias("v"), F.when(reason.isNotNull(), F.struct("cp", "tp", reason.alias("reason"))).alias("r"), F.when(severity == 2, F.col("items_file")).alias("x"))
    got = rows.groupBy("model", "evalset").agg(F.max("v").alias("v"), F.array_sort(F.collect_list("r")).alias("r"), F.array_sort(F.collect_set("x")).alias("x"))
    names = F.array(*(F.lit(v) for v in VERDICTS))
    return got.select("model", "evalset", F.element_at(names, F.col("v") + 1).alias("verdict"), F.array_join("r.reason", "; ").alias("reasons"), F.array_join("x", ",").alias("exclude"))


def restricted(runs: DataFrame, components: DataFrame, lineage: DataFrame, no_copy: list[str]) -> DataFrame:
    """``runs`` with ``restricted``: whether any ancestor of the set's datasets may not be copied; unknown sets count as yes."""
    bad = components.join(lineage, components["dataset"] == lineage["source"], "left").groupBy("evalset").agg(F.max(F.coalesce("node", "dataset").isin(*no_copy)).alias("bad"))
    return runs.join(bad, "evalset", "left").withColumn("restricted", F.coalesce("bad", F.lit(True))).drop("bad")


def accept_matrix(models: DataFrame, sets: DataFrame) -> DataFrame:
    """(model, evalset, accepted) for ``models(model, modality)`` and ``sets(evalset, modality)``."""
    table = F.create_map(*(x for k, v in ACCEPTS.items() for x in (F.lit(k), F.array(*(F.lit(m) for m in v)))))
    m = models.select("model", F.coalesce(table[F.col("modality")], F.array()).alias("takes"))
    pairs = m.crossJoin(sets.select("evalset", "modality"))  # configured models times configured sets: the result itself
    return pairs.select("model", "evalset", F.array_contains("takes", F.col("modality")).alias("accepted"))


def registry_problems(models: DataFrame, datasets: DataFrame, corpora: DataFrame, components: DataFrame, training: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem): unknown references, ids that clash, modalities that don't fit, roles that mix, labels that aren't there."""
    known = datasets.select(F.col("dataset").alias("node")).unionByName(corpora.select(F.col("corpus").alias("node")))
    clash = datasets.join(corpora, datasets["dataset"] == corpora["corpus"], "left_semi").select(F.concat(F.lit("dataset and corpus: "), "dataset").alias("problem"))
    train = training.join(known, training["dataset"] == known["node"], "left_anti").select(F.concat(F.lit("model "), "model", F.lit(": unknown training data "), "dataset").alias("problem"))
    derived = edges.join(known, edges["parent"] == known["node"], "left_anti").select(F.concat(F.lit("dataset "), edges["node"], F.lit(": unknown source "), "parent").alias("problem"))
    wave = models.where("wave is not null and status not in ('ready', 'workable')").select(F.concat(F.lit("model "), "model", F.lit(": in a wave but "), "status").alias("problem"))
    d = datasets.select(F.col("dataset").alias("d"), F.col("modality").alias("dm"), F.col("role").alias("dr"), "contains")
    c = components.join(d, components["dataset"] == d["d"], "left")
    unknown = c.where("d is null").select(F.concat(F.lit("set "), "evalset", F.lit(": unknown dataset "), "dataset").alias("problem"))
    c = c.where("d is not null")
    fits = c.where("modality <> dm and dm <> 'audio_video'").select(F.concat(F.lit("set "), "evalset", F.lit(": "), "modality", F.lit(" set uses "), "dm", F.lit(" "), "dataset").alias("problem"))
    roles = c.where("(dr = 'pipeline_test') <> (role = 'pipeline_test')").select(F.concat(F.lit("set "), "evalset", F.lit(": mixes roles with "), "dataset").alias("problem"))
    labels = c.where("label_rule in ('real', 'fake') and not array_contains(contains, label_rule)").select(F.concat(F.lit("set "), "evalset", F.lit(": "), "dataset", F.lit(" has no "), "label_rule", F.lit(" items")).alias("problem"))
    tracks = c.where("label_rule in ('from_video', 'from_audio') and dm <> 'audio_video'").select(F.concat(F.lit("set "), "evalset", F.lit(": no tracks in "), "dataset").alias("problem"))
    out = clash
    for part in (train, derived, wave, unknown, fits, roles, labels, tracks):
        out = out.unionByName(part)
    return out
