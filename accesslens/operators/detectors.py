"""Trained detectors over the feature matrix: isolation forest, one-class kernel rule, sequence reconstruction.

Training data is a bounded sample or a one-pass aggregate; scoring is row-local on the executors.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F, types as T

from accesslens import constants as C
from accesslens.functions.scalar import hash_uniform
from accesslens.operators.queue import uniform_sample
from accesslens.operators.sequences import event_sequences, map_window_error, normal_threshold, normalise_error
from accesslens.plans.segments import ID, KEY, EntitySegments
from accesslens.session import input_splits, materialize

# --- isolation forest -------------------------------------------------------------------------------------

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double, drawn int"


def average_path(n):
    """Expected path length of an unsuccessful search among n points (Liu, Ting and Zhou 2008)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x, depth, limit, rng, rows, tree):
    """Append the nodes below one point set; returns the node number."""
    node = len(rows)
    rows.append(None)
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else np.array([], dtype=int)
    if depth >= limit or len(spread) == 0:
        rows[node] = (tree, node, -1, 0.0, -1, -1, depth + average_path(len(x)))
        return node
    feature = int(rng.choice(spread))
    column = x[:, feature]
    threshold = float(rng.uniform(column.min(), column.max()))
    below = column <= threshold
    left = _grow(x[below], depth + 1, limit, rng, rows, tree)
    right = _grow(x[~below], depth + 1, limit, rng, rows, tree)
    rows[node] = (tree, node, feature, threshold, left, right, 0.0)
    return node


def tree_samples(df: DataFrame, columns, trees, sample, seed=42) -> DataFrame:
    """For every tree the ``sample`` rows with the smallest keyed hashes: (tree, hash, event key, columns).

    Each row draws a hash for every tree and goes on only where it is below a threshold that lets slightly more than
    ``sample`` rows of a tree pass, so about trees * sample rows leave the scan, whatever its size. Should a tree get
    too few (as rare as six deviations), the threshold is doubled; the result is the exact bottom-k of each tree.
    """
    total = df.count()
    want, share = min(sample, total), (sample + 6 * sample ** 0.5 + 6) / max(total, 1)
    trees_of = F.sequence(F.lit(0), F.lit(trees - 1))
    while True:
        drawn = df.select(ID, *columns, F.explode(trees_of).alias("tree")).withColumn(
            "u", F.shiftrightunsigned(F.xxhash64(F.col(ID), F.col("tree"), F.lit(seed)), 11) / float(1 << 53))
        near = drawn.where(F.col("u") < min(share, 1.1))
        near = materialize(near.select("tree", "u", ID, *columns), "tree-samples")
        counts = near.groupBy("tree").agg(F.count("*").alias("n")).agg(F.count("*").alias("t"), F.min("n").alias("n")).first()
        if share >= 1 or total == 0 or (counts["t"] == trees and counts["n"] >= want):
            break
        share *= 2
    w = Window.partitionBy("tree").orderBy("u", ID)
    return near.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= sample).drop("_place")


def fit_isolation_forest(df: DataFrame, features, trees=C.ISOLATION_TREES, sample=C.ISOLATION_SAMPLE, seed=42) -> DataFrame:
    """Node table of a forest; each tree is grown by one task from its own ``sample`` rows (all rows, if fewer).

    The root of a tree holds the number of rows drawn for it, which normalises its path lengths.
    """
    names = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100_003 + t)
        rows = []
        limit = max(1, math.ceil(math.log2(max(len(pdf), 2))))
        _grow(pdf.sort_values(["u", ID])[names].to_numpy(dtype=float), 0, limit, rng, rows, t)
        return pd.DataFrame([(*r, len(pdf)) for r in rows], columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    return tree_samples(df, names, trees, sample, seed).groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def _forest_arrays(nodes):
    """Node rows (bounded: trees * 2 * sample) as arrays per tree, children as row numbers, and the normal path length."""
    trees, normal = [], []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        trees.append(tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")))
        normal.append(average_path(int(t["drawn"].iloc[0])))
    return trees, max(float(np.mean(normal)), 1e-9) if normal else 1.0


def isolation_scores(model, x):
    """2^(-mean path / normal path) of every row of ``x``: near 1 is isolated early."""
    trees, norm = model
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for feature, threshold, left, right, path in trees:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go_left = x[rows, np.maximum(f, 0)] <= threshold[at]
            at = np.where(inner, np.where(go_left, left[at], right[at]), at)
        total += path[at]
    return 2.0 ** (-total / max(len(trees), 1) / norm)


def vector_scorer(spark, fn, model):
    """A column function of an array of numbers: ``fn(model, matrix)`` per Arrow batch, other columns stay in the JVM.

    The model travels as a broadcast; its size does not depend on the data.
    """
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(fn(held.value, np.stack(rows.to_numpy()).astype(float)) if len(rows) else [], dtype=float)

    return score


def score_isolation_forest(df: DataFrame, forest: DataFrame, features, name="isolation_raw") -> DataFrame:
    """Add the anomaly score of each event."""
    score = vector_scorer(df.sparkSession, isolation_scores, _forest_arrays(forest.toPandas()))
    return df.withColumn(name, score(F.array(*[F.col(f).cast("double") for f in features])))


def minmax(df: DataFrame, column, name) -> DataFrame:
    """(x - min) / (max - min) over this frame, 0.5 if constant: the inverted min-max of a normality score."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    value = F.when(span > 0, (F.col(column) - F.col("_lo")) / span).otherwise(0.5)
    return df.crossJoin(F.broadcast(ends)).withColumn(name, value).drop("_lo", "_hi")


# --- one-class kernel rule --------------------------------------------------------------------------------

def random_fourier(dims, components=512, seed=42):
    """Weights of random Fourier features (Rahimi and Recht 2007) for the RBF kernel with gamma = 1 / dims.

    That is gamma = 1 / (dims * variance) for features scaled to unit variance.
    """
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, math.sqrt(2.0 / dims), size=(components, dims)), rng.uniform(0, 2 * math.pi, size=components)


def fourier(x, weights, shifts):
    return np.cos(x @ weights.T + shifts) * math.sqrt(2.0 / len(shifts))


def fit_one_class(normal: DataFrame, features, sample=None, seed=42, components=512):
    """Mean embedding of all normal events (or of a uniform ``sample``): per-batch sums on the executors, one vector on the driver."""
    weights, shifts = random_fourier(len(features), components, seed)
    names = list(features)
    train = normal.select(ID, *names) if sample is None else uniform_sample(normal.select(ID, *names), sample, seed)

    def partial(batches):
        total, n = np.zeros(len(shifts)), 0
        for pdf in batches:
            total += fourier(pdf[names].to_numpy(dtype=float), weights, shifts).sum(0)
            n += len(pdf)
        yield pd.DataFrame({"z": [total], "n": [n]})

    sums = train.mapInPandas(partial, "z array<double>, n long")
    row = sums.agg(Summarizer.sum(array_to_vector("z")).alias("z"), F.sum("n").alias("n")).first()
    return weights, shifts, row["z"].toArray() / max(row["n"], 1)


def one_class_distances(model, x):
    weights, shifts, centre = model
    return -(fourier(x, weights, shifts) @ centre)


def one_class_score(df: DataFrame, model, features, name="one_class_raw") -> DataFrame:
    """Distance from normal behaviour: minus the mean RBF similarity to the normal events.

    The similarity is a dot product with the mean embedding of the normal events. This is the
    uniform-weight (Parzen) one-class rule; the support-vector weights of a kernel machine are not solved.
    """
    score = vector_scorer(df.sparkSession, one_class_distances, model)
    return df.withColumn(name, score(F.array(*[F.col(f).cast("double") for f in features])))


# --- sequence reconstruction ------------------------------------------------------------------------------

#: Bytes of stored windows that a task of the fit reads at most.
WINDOW_SPLIT = 16 << 20


def sequence_vectors(df: DataFrame, features, segments: EntitySegments, length=C.SEQUENCE_LENGTH) -> DataFrame:
    """Flattened windows of scaled features as ML vectors (``window``)."""
    one = df.select(ID, KEY, "timestamp", F.array(*[F.col(f) for f in features]).alias("_x"))
    seqs = event_sequences(one, "_x", segments, length)
    return seqs.select(ID, KEY, "end_position", array_to_vector(F.flatten("sequence")).alias("window"))


def fit_principal(windows: DataFrame, k=32):
    """Linear autoencoder: the principal components of the training windows."""
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="window", outputCol="centred").fit(windows)
    pca = PCA(k=k, inputCol="centred", outputCol="code").fit(scaler.transform(windows))
    return scaler, pca


def principal_error(windows: DataFrame, model, name="error") -> DataFrame:
    """Mean squared residual after projection on the components: (|x|^2 - |code|^2) / dimensions."""
    scaler, pca = model
    coded = pca.transform(scaler.transform(windows))
    square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, v: s + v * v)
    dims = F.size(vector_to_array("centred"))
    return coded.withColumn(name, F.greatest(square("centred") - square("code"), F.lit(0.0)) / dims).drop("centred", "code")


def fit_prototypes(windows: DataFrame, k=16, seed=42, iterations=10):
    """Prototype windows of normal behaviour."""
    return KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="window", predictionCol="prototype").fit(windows)


def prototype_error(windows: DataFrame, model, name="error") -> DataFrame:
    """Squared distance to the nearest prototype per dimension, computed in batches."""
    centres = np.array(model.clusterCenters())
    cols = [c for c in windows.columns if c != "window"]

    def score(batches):
        for pdf in batches:
            x = np.stack(pdf["_w"].to_numpy())
            gap = (x ** 2).sum(1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(1)[None, :]
            out = pdf[cols].copy()
            out[name] = np.maximum(gap.min(1), 0.0) / x.shape[1]
            yield out

    schema = T.StructType([*windows.select(*cols).schema.fields, T.StructField(name, T.DoubleType())])
    return windows.select(*cols, vector_to_array("window").alias("_w")).mapInPandas(score, schema)


def training_windows(scaled: DataFrame, features, segments: EntitySegments) -> DataFrame:
    """Windows over the normal events of the train part (column ``split``), gaps bridged.

    These events are a subset with positions of their own, so their segments are probed anew.
    """
    normal = scaled.where("split = 'train' and label = 'normal'")
    own = EntitySegments.probe(normal) if segments.hot else EntitySegments.none(scaled.sparkSession)
    return sequence_vectors(normal, features, own)


def fit_sequences(scaled: DataFrame, features, segments: EntitySegments, kind="principal"):
    """(models, threshold) from all windows of the normal train events; the threshold is the 97.5th percentile of their
    errors, a table of one row. ``kind``: ``principal`` (linear autoencoder) or ``prototype`` (nearest typical window)."""
    train = materialize(training_windows(scaled, features, segments), "train-windows")
    # Overlapping windows shrink to a tenth in Parquet; clustering holds its input as it is, so a task takes a small split.
    with input_splits(scaled.sparkSession, WINDOW_SPLIT):
        model = fit_principal(train) if kind == "principal" else (fit_prototypes(train),)
    # The percentile passes over the errors several times; they are computed once.
    errors = materialize(window_errors(train, model).select(F.lit("normal").alias("label"), "error"), "train-errors")
    return model, materialize(normal_threshold(errors, "error"), "threshold")


def window_errors(windows: DataFrame, model) -> DataFrame:
    return principal_error(windows, model) if len(model) == 2 else prototype_error(windows, model[0])


def apply_sequences(scaled: DataFrame, features, segments: EntitySegments, model, threshold: DataFrame) -> DataFrame:
    """(event, entity, label, error, score, threshold) of every event of a frame: 0..1 against its own maximum."""
    found = window_errors(sequence_vectors(scaled, features, segments), model).select(ID, KEY, "end_position", "error")
    events = scaled.select(ID, KEY, "timestamp", "label")
    mapped = map_window_error(events, materialize(found, "window-errors"), segments)
    mapped = materialize(mapped.select(ID, KEY, "label", "event_error"), "event-errors")
    return normalise_error(mapped, "event_error", threshold, "sequence_score").crossJoin(
        F.broadcast(threshold.select("threshold")))


def score_sequences(scaled: DataFrame, features, segments: EntitySegments, kind="principal") -> DataFrame:
    """Event scores 0..1 from window reconstruction, fitted on the normal train events (columns ``split``, ``label``)."""
    model, threshold = fit_sequences(scaled, features, segments, kind)
    return apply_sequences(scaled, features, segments, model, threshold)
