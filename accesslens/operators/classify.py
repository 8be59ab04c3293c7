"""Attack-type classification with Spark ML trees, oversampling and class weights."""

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier, OneVsRestModel, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from accesslens import constants as C
from accesslens.functions.scalar import hash_uniform, lookup_map
from accesslens.operators.boosting import fit_one_vs_rest
from accesslens.operators.encode import label_name
from accesslens.operators.features import assemble
from accesslens.operators.forest import fit_random_forest
from accesslens.operators.risk import baseline_combined
from accesslens.plans.neighbours import nearest_neighbours
from accesslens.plans.ranks import values_at_ranks
from accesslens.plans.replicate import replicate
from accesslens.plans.segments import ID
from accesslens.plans.tables import local_table
from accesslens.session import materialize

def training_frame(df: DataFrame, features) -> DataFrame:
    return assemble(df, features).select(ID, "label", F.col("label_enc").cast("double").alias("label_enc"), "features")


def augment(scaled: DataFrame, scores: DataFrame) -> DataFrame:
    """Scaled features with the statistical, isolation and one-class scores of each event and their combination."""
    joined = scaled.join(scores.select(ID, *C.SCORE_FEATURES[:3]), ID)
    return joined.withColumn(C.SCORE_FEATURES[3], baseline_combined(*[F.col(c) for c in C.SCORE_FEATURES[:3]]))


def class_counts(df: DataFrame):
    """Rows per label; at most the eight fixed labels, so they fit on the driver."""
    return {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}


def smote_oversample(df: DataFrame, features, k=C.SMOTE_NEIGHBOURS, seed=42) -> DataFrame:
    """Bring every class up to the size of the largest: x + u * (neighbour - x).

    Neighbours are the k nearest other members of the class, by the same exact join at every size. Each member makes
    floor(need / have) rows; the members with the smallest hashes take the remainder. The copies are spread over tasks
    before they are made. A class of one member repeats it.
    """
    spark = df.sparkSession
    counts = class_counts(df)
    largest = max(counts.values(), default=0)
    todo = {c: (n, largest - n) for c, n in counts.items() if n < largest}
    base = df.select(ID, "label", F.col("label_enc").cast("double").alias("label_enc"), *[F.col(f).cast("double").alias(f) for f in features])
    real = base.withColumn("synthetic", F.lit(0))
    if not todo:
        return real
    plan = local_table(spark, [(c, n, need) for c, (n, need) in todo.items()], "label string, have long, need long")
    members = materialize(base.join(F.broadcast(plan), "label").withColumn("_u", hash_uniform(F.col(ID), seed=seed + 1)), "members")
    # Hash of the last member that takes one row of the remainder, per class.
    rest = [(c, 0, need % n - 1) for c, (n, need) in todo.items() if need % n]
    cuts = {}
    if rest:
        ranks = local_table(spark, rest, "label string, tag long, rank long")
        cuts = {r["label"]: r["v"] for r in values_at_ranks(members, ["label"], "_u", ranks).collect()}
    edge = F.coalesce(F.try_element_at(lookup_map({**cuts, "": -1.0}), F.col("label")), F.lit(-1.0))
    times = F.floor(F.col("need") / F.col("have")) + (F.col("_u") <= edge).cast("long")
    vectors = members.select(ID, "label", "label_enc", times.alias("_times"), F.array(*[F.col(f) for f in features]).alias("x"))
    near = nearest_neighbours(vectors, "label", ID, "x", k).withColumnRenamed("id", ID)
    alone = F.when(F.size("near") > 0, F.col("near")).otherwise(F.array("x"))
    found = vectors.join(near, ["label", ID]).withColumn("near", alone)
    copies = replicate(found, F.col("_times"), ID)
    pick = F.floor(hash_uniform(F.col(ID), F.col("copy"), seed=seed + 2) * F.size("near")).cast("int")
    step = hash_uniform(F.col(ID), F.col("copy"), seed=seed + 3)
    mixed = F.zip_with("x", F.element_at("near", F.col("_pick") + 1), lambda a, b: a + F.col("_step") * (b - a))
    made = copies.withColumns({"_pick": pick, "_step": step}).withColumn("y", mixed).select(
        F.xxhash64(ID, "copy").alias(ID), "label", "label_enc",
        *[F.element_at("y", i + 1).alias(f) for i, f in enumerate(features)], F.lit(1).alias("synthetic"))
    return real.unionByName(made)


def bounded_rows(df: DataFrame, max_rows=None, seed=42) -> DataFrame:
    """All labelled rows, or about ``max_rows`` of them: the same share of every label (at least a row where it has
    one), chosen by keyed hash."""
    if max_rows is None:
        return df
    counts = class_counts(df)
    share = max_rows / max(1, sum(counts.values()))
    if share >= 1:
        return df
    keep = {label: max(share, min(1.0, 20.0 / n)) for label, n in counts.items()}
    return df.where(hash_uniform(F.col(ID), seed=seed) < F.try_element_at(lookup_map(keep), F.col("label")))


def with_class_weights(df: DataFrame) -> DataFrame:
    """Add ``class_weight`` = N / (classes * count): eight literals, no join."""
    counts = class_counts(df)
    total, k = sum(counts.values()), len(counts)
    weights = {c: total / (k * n) for c, n in counts.items()}
    return df.withColumn("class_weight", F.try_element_at(lookup_map(weights), F.col("label")))


def whole_waves(df: DataFrame) -> DataFrame:
    """The same rows in a multiple of the cores, where more partitions than cores do not divide evenly.

    Tree fits pass over their rows once a level and node group; a last wave of a few tasks would cost as much as a full
    one in each of these passes.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(-(-parts // cores) * cores) if parts > cores and parts % cores else df


def fit_forest(train: DataFrame, trees=300, depth=10, seed=42) -> RandomForestClassificationModel:
    """Balanced random forest (``class_weight`` column)."""
    return fit_random_forest(train, RandomForestClassifier(
        featuresCol="features", labelCol="label_enc", weightCol="class_weight", numTrees=trees, maxDepth=depth, seed=seed,
        subsamplingRate=1.0))


def fit_boosted(train: DataFrame, rounds=300, depth=6, rate=0.1, seed=42) -> OneVsRestModel:
    """One boosted-tree model per label."""
    return fit_one_vs_rest(train, GBTClassifier(
        featuresCol="features", labelCol="label_enc", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed))


def with_probabilities(predicted: DataFrame) -> DataFrame:
    """``p``: class probabilities. One-vs-rest has raw margins only: normalised sigmoid(2 * margin)."""
    if "probability" in predicted.columns:
        return predicted.withColumn("p", vector_to_array("probability"))
    sig = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    total = F.aggregate(sig, F.lit(0.0), lambda s, v: s + v)
    return predicted.withColumn("p", F.transform(sig, lambda v: v / total))


def anomaly_confidence(p="p"):
    """1 - P(normal); normal has the largest code."""
    return 1 - F.element_at(F.col(p), C.NORMAL_CODE + 1)


def predict(model, df: DataFrame) -> DataFrame:
    """Label, probabilities and confidence per event."""
    out = with_probabilities(model.transform(df))
    return out.withColumn("predicted_label", label_name("prediction")).withColumn("confidence", anomaly_confidence())


def feature_importance(spark, model, features, top=None) -> DataFrame:
    """Ranked importances; averaged over the per-label models of a one-vs-rest model."""
    parts = model.models if isinstance(model, OneVsRestModel) else [model]
    mean = np.mean([m.featureImportances.toArray() for m in parts], axis=0)
    ranked = sorted(((f, C.DISPLAY_NAMES.get(f, f), float(w)) for f, w in zip(features, mean)), key=lambda r: (-r[2], r[0]))
    return local_table(spark, ranked[:top], "feature string, display_name string, importance double")


# --- path attribution over saved trees --------------------------------------------------------------------

def tree_nodes(spark, path):
    """Node table of a saved forest: tree, node, children, split and class shares.

    The saved model is a table of nodes; its size follows trees * 2^depth, not the data.
    """
    data = spark.read.parquet(f"{path}/data")
    n = F.col("nodeData")
    return data.select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        n["impurityStats"].alias("stats"))


def attribute_paths(df: DataFrame, nodes: DataFrame, features, target="prediction") -> DataFrame:
    """Signed contribution of each feature to the predicted class, for every given event.

    Walking a tree, each split changes the share of the class; the change belongs to the split's feature.
    The contributions of all trees and the root shares add up to the forest's probability.
    """
    spark = df.sparkSession
    pdf = nodes.toPandas().sort_values(["tree", "node"])
    trees = []
    for _, t in pdf.groupby("tree"):
        stats = np.stack([np.asarray(s, dtype=float) for s in t["stats"]])
        share = stats / np.maximum(stats.sum(1, keepdims=True), 1e-300)
        trees.append((t["feature"].to_numpy(), t["threshold"].fillna(0.0).to_numpy(dtype=float),
                      t["left"].to_numpy(), t["right"].to_numpy(), share))
    model = spark.sparkContext.broadcast(trees)
    width = len(features)

    def walk(batches):
        for b in batches:
            x = np.stack(b["_x"].to_numpy())
            cls = b["_c"].to_numpy().astype(int)
            rows = np.arange(len(x))
            total, base = np.zeros((len(x), width)), np.zeros(len(x))
            for feature, threshold, left, right, share in model.value:
                at = np.zeros(len(x), dtype=int)
                base += share[0, cls]
                while True:
                    inner = left[at] >= 0
                    if not inner.any():
                        break
                    f = np.maximum(feature[at], 0)
                    nxt = np.where(inner, np.where(x[rows, f] <= threshold[at], left[at], right[at]), at)
                    np.add.at(total, (rows, f), np.where(inner, share[nxt, cls] - share[at, cls], 0.0))
                    at = nxt
            out = b[[ID]].copy()
            out["base"] = base / len(model.value)
            out["contributions"] = list(total / len(model.value))
            yield out

    given = df.select(ID, vector_to_array("features").alias("_x"), F.col(target).alias("_c"))
    return given.mapInPandas(walk, f"{ID} long, base double, contributions array<double>")
