"""The parts of a detector as estimators: ``fit`` learns from train events, the fitted ``Model`` scores any batch.

Fitted state is tables (Parquet) and Spark ML models, so every stage can be written to a folder, loaded in another
session and applied unchanged. Stages chain in a ``pyspark.ml.Pipeline``; each adds columns to the events it is given.
"""

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import OneVsRestModel, RandomForestClassificationModel
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import PCAModel, StandardScalerModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import functions as F

from accesslens import constants as C
from accesslens.operators import classify as M, detectors as D, encode as E, features as X, profiles as P, risk
from accesslens.plans.ranks import exact_quantiles
from accesslens.plans.segments import ID, KEY, EntitySegments
from accesslens.plans.tables import local_table
from accesslens.session import materialize

Z = [f"{f}_z" for f in C.FEATURES]
INPUTS = [*Z, *C.SCORE_FEATURES]


class _Writer(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path):
        stage = self.stage
        kinds = {name: type(model).__name__ for name, model in stage.models.items()}
        DefaultParamsWriter.saveMetadata(stage, path, self.sparkSession, extraMetadata={
            "options": stage.options, "tables": sorted(stage.tables), "models": kinds})
        for name, table in stage.tables.items():
            table.write.parquet(f"{path}/tables/{name}")
        for name, model in stage.models.items():
            model.write().save(f"{path}/models/{name}")


_MODELS = {m.__name__: m for m in (OneVsRestModel, RandomForestClassificationModel, KMeansModel, PCAModel, StandardScalerModel)}


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = {name: self.sparkSession.read.parquet(f"{path}/tables/{name}") for name in metadata["tables"]}
        models = {name: _MODELS[kind].load(f"{path}/models/{name}") for name, kind in metadata["models"].items()}
        stage = self.cls(tables, models, metadata["options"])
        stage._resetUid(metadata["uid"])
        return stage


class Fitted(Model, MLWritable, MLReadable):
    """A fitted stage: ``tables``, ``models`` and plain ``options`` are all of its state."""

    def __init__(self, tables=None, models=None, options=None):
        super().__init__()
        self.tables, self.models, self.options = tables or {}, models or {}, options or {}

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Stage(Estimator):
    """An estimator with plain options."""

    def __init__(self, **options):
        super().__init__()
        self.options = {**self.DEFAULTS, **options}

    DEFAULTS = {}


# --- features and scaling ---------------------------------------------------------------------------------

class EventFeaturesModel(Fitted):
    """Log columns to the 28 features. ``scope`` "batch" takes entity statistics from the batch alone, "history" goes on
    from the entity state of the train events."""

    def with_scope(self, scope):
        return EventFeaturesModel(self.tables, self.models, {**self.options, "scope": scope})

    def _transform(self, log):
        segments = EntitySegments.probe(log)
        encoder = E.CategoryEncoder.of({c: self.tables[f"codes_{c}"] for c in X.ENCODED})
        if self.options["scope"] == "batch":
            features = X.build_features(log, segments, encoder)
        else:
            plain = X.features_after((self.tables["entities"], self.tables["resources"]), log, segments)
            features = encoder.transform(plain.withColumn("label_enc", E.label_code()), X.ENCODED)
        # Written once: the scaler is fitted on these columns and every later stage passes over them.
        return materialize(features, "event-features")

    def updated(self, log):
        """The same stage with the events of ``log`` added to the entity state; no earlier event is read again."""
        entities, resources = X.merge_history((self.tables["entities"], self.tables["resources"]), X.entity_history(log))
        tables = {**self.tables, "entities": materialize(entities, "entities"), "resources": materialize(resources, "resources")}
        return EventFeaturesModel(tables, self.models, self.options)


class EventFeatures(_Stage):
    DEFAULTS = {"scope": "batch"}

    def _fit(self, log):
        encoder = E.CategoryEncoder.fit(log, list(X.ENCODED))
        entities, resources = X.entity_history(log)
        tables = {f"codes_{c}": encoder.dictionary(c) for c in X.ENCODED}
        tables.update(entities=materialize(entities, "entities"), resources=materialize(resources, "resources"))
        return EventFeaturesModel(tables, options=self.options)


class FeatureScalerModel(Fitted):
    def _transform(self, df):
        return E.scale(df, self.tables["moments"], C.FEATURES)


class FeatureScaler(_Stage):
    def _fit(self, df):
        return FeatureScalerModel({"moments": materialize(E.fit_scaler(df, C.FEATURES), "moments")})


# --- detectors --------------------------------------------------------------------------------------------

class ProfileScorerModel(Fitted):
    def _transform(self, df):
        segments = EntitySegments.probe(df)
        scored = P.with_statistical_score(df, self.tables["profiles"], segments)
        return P.with_risk_history(scored, self.tables["history"], segments)


class ProfileScorer(_Stage):
    """Profiles, peer groups and risk history of the train events: ``statistical_score`` and ``entity_risk``."""

    def _fit(self, df):
        profiles = materialize(P.entity_profiles(df, EntitySegments.probe(df)), "profiles")
        return ProfileScorerModel({"profiles": profiles, "peers": materialize(P.peer_groups(profiles), "peers"),
                                   "history": materialize(P.entity_risk_history(df), "history")})


class IsolationScorerModel(Fitted):
    def _transform(self, df):
        raw = materialize(D.score_isolation_forest(df, self.tables["nodes"], Z), "isolation")
        cut = self.tables["cut"].select(F.col("q").alias("_cut"))
        return (D.minmax(raw, "isolation_raw", "isolation_forest_score").crossJoin(F.broadcast(cut))
                .withColumn("isolation_flag", (F.col("isolation_raw") > F.col("_cut")).cast("long")).drop("_cut"))


class IsolationScorer(_Stage):
    """Isolation forest of the normal train events; ``isolation_flag`` marks scores that 97.5 % of these stay below."""

    DEFAULTS = {"trees": C.ISOLATION_TREES, "sample": C.ISOLATION_SAMPLE, "seed": 42}

    def _fit(self, df):
        # Written once with what the trees need: counting, drawing and scoring each pass over these rows.
        normal = materialize(df.where("label = 'normal'").select(ID, *Z), "isolation-normal")
        o = self.options
        nodes = materialize(D.fit_isolation_forest(normal, Z, o["trees"], o["sample"], o["seed"]), "isolation-nodes")
        raw = D.score_isolation_forest(normal, nodes, Z)
        cut = exact_quantiles(materialize(raw.select("isolation_raw"), "isolation-train"), [], "isolation_raw", [1 - C.ISOLATION_CONTAMINATION])
        return IsolationScorerModel({"nodes": nodes, "cut": materialize(cut, "isolation-cut")}, options=o)


class OneClassScorerModel(Fitted):
    def _transform(self, df):
        weights, shifts = D.random_fourier(len(Z), self.options["components"], self.options["seed"])
        centre = np.array(self.tables["centre"].first()["z"])
        raw = materialize(D.one_class_score(df, (weights, shifts, centre), Z), "one-class")
        scored = D.minmax(raw, "one_class_raw", "one_class_svm_score")
        return scored.withColumn("baseline_combined_score", risk.baseline_combined(
            F.col("statistical_score"), F.col("isolation_forest_score"), F.col("one_class_svm_score")))


class OneClassScorer(_Stage):
    """Mean random-Fourier embedding of the normal train events; also the combined score of the three baselines."""

    DEFAULTS = {"components": 512, "seed": 42}

    def _fit(self, df):
        o = self.options
        _, _, centre = D.fit_one_class(df.where("label = 'normal'"), Z, seed=o["seed"], components=o["components"])
        row = df.sparkSession.createDataFrame([(centre.tolist(),)], "z array<double>")
        return OneClassScorerModel({"centre": materialize(row, "centre")}, options=o)


class SequenceScorerModel(Fitted):
    def _transform(self, df):
        kind = self.options["kind"]
        names = ("scaler", "pca") if kind == "principal" else ("prototypes",)
        scored = D.apply_sequences(df, Z, EntitySegments.probe(df), tuple(self.models[n] for n in names), self.tables["threshold"])
        cut = F.col("threshold") / F.greatest(2 * F.col("threshold"), F.lit(1e-6))
        return df.join(scored.select(ID, F.col("sequence_score").alias(f"{kind}_score"),
                                     (F.col("sequence_score") > cut).cast("long").alias(f"{kind}_flag")), ID)


class SequenceScorer(_Stage):
    """Window reconstruction: ``kind`` "principal" or "prototype" adds its score and flag."""

    DEFAULTS = {"kind": "principal"}

    def _fit(self, df):
        kind = self.options["kind"]
        train = df.withColumn("split", F.lit("train"))
        model, threshold = D.fit_sequences(train, Z, EntitySegments.probe(df), kind)
        names = ("scaler", "pca") if kind == "principal" else ("prototypes",)
        return SequenceScorerModel({"threshold": threshold}, dict(zip(names, model)), self.options)


# --- classifiers and risk ---------------------------------------------------------------------------------

class AttackClassifierModel(Fitted):
    def _transform(self, df):
        name = self.options["name"]
        predicted = M.predict(self.models["model"], M.assemble(df.withColumn("label_enc", F.col("label_enc").cast("double")), INPUTS))
        found = predicted.select(ID, F.col("predicted_label").alias(f"{name}_label"), F.col("confidence").alias(f"{name}_confidence"))
        return df.join(found, ID)


class AttackClassifier(_Stage):
    """``forest``: class-weighted random forest; ``boosted``: boosted trees per label on oversampled classes.

    ``max_rows`` bounds the labelled rows a fit uses: above it, the rows with the smallest keyed hashes of each label are
    kept, in proportion. None uses all.
    """

    DEFAULTS = {"name": "forest", "kind": "forest", "trees": 300, "depth": 10, "max_rows": None}

    def _fit(self, df):
        o = self.options
        train = M.bounded_rows(df.select(ID, "label", "label_enc", *INPUTS), o["max_rows"])
        if o["kind"] == "forest":
            weighted = M.with_class_weights(materialize(M.training_frame(train, INPUTS), "train"))
            model = M.fit_forest(weighted, o["trees"], o["depth"])
        else:
            train = materialize(train, "labelled")      # oversampling passes over the rows several times
            balanced = materialize(M.training_frame(M.smote_oversample(train, INPUTS), INPUTS), "balanced")
            model = M.fit_boosted(balanced, o["trees"], o["depth"])
        return AttackClassifierModel(models={"model": model}, options=o)


class RiskFusionModel(Fitted):
    def _transform(self, df):
        o = self.options
        ready = df.withColumns({"sequence_score": F.col(o["sequence"]), "confidence": F.col(f"{o['classifier']}_confidence")})
        return risk.fuse(ready).withColumn("predicted_label", F.col(f"{o['classifier']}_label"))


class RiskFusion(_Stage):
    DEFAULTS = {"sequence": "principal_score", "classifier": "forest"}

    def _fit(self, df):
        return RiskFusionModel(options=self.options)


def model_metrics(scored, percentile=C.FLAG_PERCENTILE):
    """Long (model, y_true, y_pred) counts of six detectors from one stacked pass over scored events.

    Isolation and one-class scores are cut at their exact percentile in this frame, the sequence scores at their train
    threshold, the classifiers by their label.
    """
    scored = materialize(scored.select(
        ID, "label", F.col("isolation_forest_score").alias("a"), F.col("one_class_svm_score").alias("b"),
        "principal_flag", "prototype_flag", "forest_label", "boosted_label"), "scored-models")
    stacked = scored.select(F.explode(F.array(*[F.struct(F.lit(n).alias("m"), F.col(n).alias("s")) for n in ("a", "b")])).alias("x")).select("x.*")
    cuts = {r["m"]: r["q"] for r in exact_quantiles(stacked, ["m"], "s", [percentile]).collect()}
    flags = {"Isolation Forest": F.col("a") > cuts.get("a"), "One-Class": F.col("b") > cuts.get("b"),
             "Sequence Principal": F.col("principal_flag") == 1, "Sequence Prototype": F.col("prototype_flag") == 1,
             "Boosted Trees": F.col("boosted_label") != "normal", "Random Forest": F.col("forest_label") != "normal"}
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), f.cast("long").alias("y_pred")) for m, f in flags.items()]))
    return scored.select((F.col("label") != "normal").cast("long").alias("y_true"), long.alias("m")).select("y_true", "m.*")
