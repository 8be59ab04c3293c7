"""Trained detectors, classifiers, attributions and saved models.

The detector is fitted on the train part once for a data folder and application, saved to the shared folder, and loaded
by every query that applies it. Forests and boosted trees have their full size: 300 trees, and 300 rounds for each of
eight labels. Rows, tables and texts are always whole.
"""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from accesslens import constants as C
from accesslens.catalog.base_queries import _SPLIT
from accesslens.catalog.registry import Views, query, rnd, sql_rnd
from accesslens.catalog.sql_base import sql
from accesslens.models import detection
from accesslens.models.stages import INPUTS, AttackClassifierModel, Z, model_metrics
from accesslens.operators import classify as M, detectors as D, encode as E, explain as X, queue as Q
from accesslens.operators import evaluate as V, risk
from accesslens.plans.segments import KEY
from accesslens.session import materialize, scratch_path
from accesslens.sources import access_log as L

NAMES = [c[:-2] if c.endswith("_z") else c for c in INPUTS]
_SAVED = {}
#: The train events as the fit of the detector scored them, for an application and data folder.
_TRAIN = {}


def saved_once(v: Views, name, make):
    """The folder that ``make(path)`` filled for this application and data folder."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir, name)
    if key not in _SAVED:
        path = scratch_path(v.spark, name)
        make(path)
        _SAVED[key] = path
    return _SAVED[key]


def part(v: Views, name):
    """The train (first 80 % by time) or test events."""
    return v.split_log.where(F.col("split") == name).drop("split")


def detector(v: Views) -> PipelineModel:
    def fit(path):
        train = materialize(part(v, "train"), "train-log")
        model, applied = detection.fit_and_apply(detection.detection_pipeline(), train)
        model.write().save(path)
        _TRAIN[(v.spark.sparkContext.applicationId, v.sf_dir)] = applied

    return PipelineModel.load(saved_once(v, "detector", fit))


def scored(v: Views, name="test"):
    """Events of a part scored as one batch by the saved detector; written once."""
    def apply(path):
        model = detector(v)
        applied = _TRAIN.get((v.spark.sparkContext.applicationId, v.sf_dir)) if name == "train" else None
        (model.transform(part(v, name)) if applied is None else applied).write.parquet(path)

    return v.spark.read.parquet(saved_once(v, f"scored-{name}", apply))


def boosted(v: Views) -> AttackClassifierModel:
    def fit(path):
        train = scored(v, "train").drop("forest_label", "forest_confidence")
        detection.boosted_classifier().fit(train).write().save(path)

    return AttackClassifierModel.load(saved_once(v, "boosted", fit))


def forest_path(v: Views):
    """The saved forest within the saved detector."""
    stages = detector(v).stages
    at = next(i for i, s in enumerate(stages) if s.options.get("kind") == "forest")
    return f"{_SAVED[(v.spark.sparkContext.applicationId, v.sf_dir, 'detector')]}/stages/{at:0{len(str(len(stages)))}d}_{stages[at].uid}/models/model"


def scaled_features(v: Views):
    """Scaled features of all events, the scaler fitted on the train part; written once."""
    stored = v.stored_features
    parts = Q.temporal_split(stored)
    stats = E.fit_scaler(parts.where("split = 'train'"), C.FEATURES)
    scaled = E.scale(parts, stats, C.FEATURES)
    return materialize(scaled.select("event_id", KEY, "timestamp", "label", "label_enc", "split", *Z), "scaled")


@query("d2_isolation_forest")
def d2(v: Views):
    """Score and flag of the test events as a batch: above the score that 97.5 % of the normal train events stay below."""
    scaled = scaled_features(v)
    train = scaled.where("split = 'train' and label = 'normal'")
    forest = materialize(D.fit_isolation_forest(train, Z), "isolation-forest")
    raw = materialize(D.score_isolation_forest(scaled, forest, Z).select("event_id", "label", "split", "isolation_raw"), "isolation")
    cut = V.exact_quantiles(raw.where("split = 'train' and label = 'normal'"), [], "isolation_raw", [1 - C.ISOLATION_CONTAMINATION])
    test = D.minmax(raw.where("split = 'test'"), "isolation_raw", "isolation_forest_score")
    return test.crossJoin(F.broadcast(cut.select(F.col("q").alias("_cut")))).select(
        "event_id", "isolation_forest_score", (F.col("isolation_raw") > F.col("_cut")).cast("long").alias("flagged"))


@query("d3_one_class_kernel")
def d3(v: Views):
    scaled = scaled_features(v)
    model = D.fit_one_class(scaled.where("split = 'train' and label = 'normal'"), Z)
    raw = materialize(D.one_class_score(scaled.where("split = 'test'"), model, Z).select("event_id", "one_class_raw"), "one-class")
    return D.minmax(raw, "one_class_raw", "one_class_svm_score").select("event_id", "one_class_svm_score")


def _sequence(v, kind):
    scaled = scaled_features(v)
    return sequence_query(D.score_sequences(scaled, Z, v.segments, kind))


def sequence_query(scored):
    cut = F.col("threshold") / F.greatest(2 * F.col("threshold"), F.lit(1e-6))
    return scored.select("event_id", "event_error", "sequence_score", (F.col("sequence_score") > cut).cast("long").alias("flagged"))


@query("d5_sequence_principal")
def d5(v: Views):
    return _sequence(v, "principal")


@query("d6_sequence_prototype")
def d6(v: Views):
    return _sequence(v, "prototype")


@query("c1_augment_features")
def c1(v: Views):
    """The classifier input of every test event: 28 scaled features and four detector scores."""
    return scored(v).select("event_id", *INPUTS)


_MOMENTS = "z AS (SELECT " + ", ".join(f"avg({f}) AS {f}_m, CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS {f}_s" for f in C.FEATURES) + " FROM features)"


@query("c1_augment_closed_form", sql("scored", "SELECT event_id, " + ", ".join(sql_rnd(f"({f} - {f}_m) / {f}_s", f"{f}_z", 4) for f in C.FEATURES)
       + f", {sql_rnd('statistical_score')}, {sql_rnd('isolation_forest_score')}, {sql_rnd('hour / 24.0', 'one_class_svm_score')}, {sql_rnd('0.3 * statistical_score + 0.4 * isolation_forest_score + 0.3 * hour / 24.0', 'baseline_combined_score')} FROM scored, z", _MOMENTS))
def c1c(v: Views):
    """The same 32 columns from scores that need no trained model."""
    features = v.stored_features
    scores = risk.closed_form_scores(features, v.segments, v.log).select(
        "event_id", "statistical_score", "isolation_forest_score", (F.col("hour") / 24.0).alias("one_class_svm_score"))
    scaled = E.scale(features, E.fit_scaler(features, C.FEATURES), C.FEATURES)
    return M.augment(scaled, scores).select("event_id", *[rnd(z, 4) for z in Z], *[rnd(s) for s in C.SCORE_FEATURES])


@query("c2_smote_oversample", sql("log", "SELECT label, n AS real, max(n) OVER () AS total FROM (SELECT label, count(*) AS n FROM split WHERE split.split = 'train' GROUP BY label)", _SPLIT))
def c2(v: Views):
    """Class sizes before and after; synthetic rows lie between members of their class."""
    train = scaled_features(v).where("split = 'train'")
    balanced = M.smote_oversample(train, Z)
    return balanced.groupBy("label").agg(F.count_if(F.col("synthetic") == 0).alias("real"), F.count("*").alias("total"))


@query("c3_weighted_training")
def c3(v: Views):
    """Class weights as row weights of the forest; predictions per label on the test part."""
    return scored(v).select("event_id", "label", F.col("forest_label").alias("predicted_label"))


@query("c4_boosted_trees")
def c4(v: Views):
    found = boosted(v).transform(scored(v))
    return found.select("event_id", "label", F.col("boosted_label").alias("predicted_label"), F.col("boosted_confidence").alias("confidence"))


@query("c5_random_forest")
def c5(v: Views):
    return scored(v).select("event_id", "label", F.col("forest_label").alias("predicted_label"), F.col("forest_confidence").alias("confidence"))


@query("c6_anomaly_confidence")
def c6(v: Views):
    """Confidence of every event, train and test, each part scored as a batch of its own."""
    both = scored(v, "train").unionByName(scored(v))
    return both.select("event_id", F.col("forest_confidence").alias("confidence"))


_SHARES = [f"(1 + (event_id * {j + 3}) % 17)" for j in range(len(C.LABELS))]


@query("c6_confidence_of_probabilities", sql("log", f"SELECT event_id, {sql_rnd(f'1 - cast({_SHARES[C.NORMAL_CODE]} AS double) / ({" + ".join(_SHARES)})', 'confidence')} FROM access_log"))
def c6p(v: Views):
    """1 - P(normal) of given class probabilities."""
    weights = [F.expr(s).cast("double") for s in _SHARES]
    total = sum(weights[1:], weights[0])
    given = v.log.select("event_id", F.array(*[w / total for w in weights]).alias("p"))
    return given.select("event_id", rnd(M.anomaly_confidence(), name="confidence"))


@query("c7_feature_importance")
def c7(v: Views):
    model = detection.stage(detector(v), "AttackClassifierModel", kind="forest").models["model"]
    return M.feature_importance(v.spark, model, NAMES, 15)


@query("s6_model_persistence")
def s6(v: Views):
    """The detector is fitted and saved; loaded, it scores the test events as a new batch, with entity statistics of the
    batch alone and going on from the train events."""
    model = detector(v)
    names = ["event_id", "predicted_label", "risk_score", "severity", "statistical_score", "isolation_forest_score"]
    batch = scored(v).select(*names, F.lit("batch").alias("scope"))
    history = detection.with_scope(model, "history").transform(part(v, "test"))
    return batch.unionByName(history.select(*names, F.lit("history").alias("scope")))


def _attributed(v, minimum_confidence=0.5):
    model = detection.stage(detector(v), "AttackClassifierModel", kind="forest").models["model"]
    test = scored(v)
    flagged = test.where((F.col("forest_label") != "normal") | (F.col("forest_confidence") > minimum_confidence))
    given = M.predict(model, M.training_frame(flagged, INPUTS)).select(
        "event_id", "label", "predicted_label", "prediction", "confidence", "features")
    paths = M.attribute_paths(materialize(given, "predicted"), M.tree_nodes(v.spark, forest_path(v)), INPUTS)
    raw = test.select("event_id", *C.FEATURES, *C.SCORE_FEATURES, "label", F.col("forest_label").alias("predicted_label"),
                      F.col("forest_confidence").alias("confidence"))
    rows = materialize(paths, "paths").join(raw, "event_id")
    parts = [(f, F.element_at("contributions", i + 1), F.col(f).cast("double")) for i, f in enumerate(NAMES)]
    return rows, parts


@query("x1_attribute_paths")
def x1(v: Views):
    """Top three factors of every flagged test event, from the raw feature values."""
    rows, parts = _attributed(v)
    out = rows.withColumn("factors", X.factor_struct(X.ranked_factors(parts, 3)))
    return X.explode_factors(out, ("event_id", "predicted_label"))


@query("b5_top_alert_factors")
def b5(v: Views):
    """Factors of the most confident alert."""
    rows, parts = _attributed(v)
    top = Q.argmax_event(materialize(rows, "attributed"), "confidence")
    out = top.withColumn("factors", X.factor_struct(X.ranked_factors(parts, 10)))
    return X.explode_factors(out, ("event_id", "predicted_label"))


@query("x3_fallback_by_importance")
def x3i(v: Views):
    """The most important features of the forest, for every event, with their values and texts."""
    model = detection.stage(detector(v), "AttackClassifierModel", kind="forest").models["model"]
    ranked = M.feature_importance(v.spark, model, NAMES).where(F.col("feature").isin(C.FEATURES)).limit(3)
    top = {r["feature"]: r["importance"] for r in ranked.collect()}
    return X.explode_factors(X.attribute_by_importance(v.stored_features, top))


@query("r1_trained_risk")
def r1t(v: Views):
    """Risk and severity from the trained parts: isolation, sequence, classifier confidence and history."""
    return scored(v).select("event_id", KEY, "label", "predicted_label", "risk_score", "severity")


def trained_comparison(v: Views):
    """One metrics row for each of six detectors on the test part."""
    return V.model_comparison(model_metrics(boosted(v).transform(scored(v))))


@query("v9_trained_comparison")
def v9t(v: Views):
    return trained_comparison(v)


@query("s5_write_comparison")
def s5c(v: Views):
    """Evaluation of the trained risk (eleven fields) as JSON and the comparison of six detectors as CSV, read back."""
    summary = V.evaluation_summary(scored(v).select("event_id", "label", "predicted_label", "risk_score"))
    comparison = trained_comparison(v)
    path = scratch_path(v.spark, "evaluation")
    L.write_json_records(summary, f"{path}/metrics")
    comparison.write.option("header", True).csv(f"{path}/comparison")
    back = v.spark.read.schema(comparison.schema).option("header", True).csv(f"{path}/comparison")
    metrics = L.read_json_records(v.spark, f"{path}/metrics", summary.schema)
    return back.crossJoin(F.broadcast(metrics))
