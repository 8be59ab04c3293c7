"""Trained stages: saved equals fitted, history goes on exactly, samples, attributions and metric floors."""

import tempfile

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from accesslens import constants as C
from accesslens.catalog import model_queries as Q
from accesslens.catalog.registry import Views
from accesslens.models import detection
from accesslens.models.stages import INPUTS, EventFeatures, EventFeaturesModel, FeatureScaler, IsolationScorer, Z
from accesslens.operators import classify as M, detectors as D
from accesslens.operators.encode import CategoryEncoder
from accesslens.operators.features import build_features, entity_history, features_after, merge_history
from accesslens.operators.queue import temporal_split
from accesslens.plans.segments import EntitySegments
from accesslens.session import materialize
from accesslens.sources.access_log import access_log

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    log = temporal_split(access_log(spark, SF))
    return tuple(materialize(log.where(F.col("split") == p).drop("split"), p) for p in ("train", "test"))


@pytest.fixture(scope="module")
def small(spark, parts):
    """A detector with few trees, fitted on the train part."""
    return detection.detection_pipeline(trees=5, depth=4, isolation_trees=20,
                                        classifiers=[detection.boosted_classifier(1, 2)]).fit(parts[0])


def cells(df, digits=9):
    names = [c for c in df.columns if dict(df.dtypes)[c] in ("bigint", "double", "string", "int")]
    show = lambda v: round(v, digits) if isinstance(v, float) else v
    return sorted((tuple(show(r[c]) for c in names) for r in df.select(*names).collect()), key=str)


@pytest.mark.parametrize("scope", ["batch", "history"])
def test_loaded_equals_fitted(spark, parts, small, scope):
    path = tempfile.mkdtemp() + "/detector"
    small.write().save(path)
    loaded = PipelineModel.load(path)
    a, b = (cells(detection.with_scope(m, scope).transform(parts[1])) for m in (small, loaded))
    assert len(a) == parts[1].count() and a == b


CAUSAL = ["time_gap_seconds", "geo_distance_km", "geo_velocity_kmh", "cumulative_unique_resources", "entity_event_count"]


def test_history_goes_on_where_the_train_part_ends(spark, parts):
    """Causal features of the test part equal those of the whole log, from states of two halves merged."""
    train, test = parts
    whole = build_features(train.unionByName(test)).join(test.select("event_id"), "event_id")
    first, second = (train.where(c) for c in ("event_id % 2 = 0", "event_id % 2 = 1"))
    for history in (entity_history(train), merge_history(entity_history(first), entity_history(second))):
        for segments in (EntitySegments.none(spark), EntitySegments.probe(test, hot_rows=20, segment_rows=8)):
            found = features_after(history, test, segments)
            pick = lambda df: cells(df.select("event_id", *CAUSAL), 6)
            assert pick(found) == pick(whole)
    stats = train.groupBy("entity_id").agg(F.avg(F.hour("timestamp")).alias("m"), F.stddev_samp(F.hour("timestamp")).alias("s"))
    joined = features_after(entity_history(train), test, EntitySegments.none(spark)).join(stats, "entity_id")
    for r in joined.select("hour", "m", "s", "hour_deviation").collect():
        assert r["hour_deviation"] == pytest.approx(abs(r["hour"] - r["m"]) / max(r["s"] if r["s"] is not None else 1.0, 0.1), rel=1e-6)


def test_new_day_updates_the_state(spark, parts, small):
    train, test = parts
    stage = small.stages[0]
    updated = stage.updated(test)
    assert isinstance(updated, EventFeaturesModel)
    again = entity_history(train.unionByName(test))
    assert cells(updated.tables["entities"]) == cells(again[0]) and cells(updated.tables["resources"]) == cells(again[1])
    assert cells(stage.tables["entities"]) == cells(entity_history(train)[0])


def test_tree_samples_are_the_exact_bottom_k(spark):
    df = spark.range(3000).select(F.col("id").alias("event_id"), F.rand(1).alias("a"))
    for sample in (50, 5000):
        drawn = D.tree_samples(df, ["a"], 7, sample, seed=3)
        got = {t: sorted(r["event_id"] for r in rows) for t, rows in _by(drawn.collect(), "tree").items()}
        every = df.crossJoin(spark.range(7).select(F.col("id").cast("int").alias("tree"))).withColumn(
            "u", F.shiftrightunsigned(F.xxhash64("event_id", "tree", F.lit(3)), 11))
        for t, rows in _by(every.collect(), "tree").items():
            assert got[t] == sorted(r["event_id"] for r in sorted(rows, key=lambda r: (r["u"], r["event_id"]))[:sample])
    assert D.tree_samples(df.where("false"), ["a"], 3, 10).count() == 0


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def planted(spark, n=3000, far=30):
    rng = np.random.default_rng(0)
    rows = [(i, *rng.normal(size=3).tolist(), "normal") for i in range(n)]
    rows += [(n + i, *(rng.normal(size=3) + 9).tolist(), "brute_force") for i in range(far)]
    return spark.createDataFrame(rows, "event_id long, a double, b double, c double, label string")


def test_isolation_and_one_class_find_planted_outliers(spark):
    df = planted(spark)
    names = ["a", "b", "c"]
    forest = D.fit_isolation_forest(df.where("label = 'normal'"), names, trees=50, sample=128)
    assert forest.groupBy("tree").agg(F.max("drawn").alias("d")).where("d <> 128").count() == 0
    for scored, name in ((D.score_isolation_forest(df, forest, names), "isolation_raw"),
                         (D.one_class_score(df, D.fit_one_class(df.where("label = 'normal'"), names), names), "one_class_raw")):
        top = scored.orderBy(F.col(name).desc()).limit(30).collect()
        assert sum(r["label"] != "normal" for r in top) >= 27
    # Fewer rows than a sample: path lengths are normalised by the rows drawn.
    few = D.fit_isolation_forest(df.limit(40), names, trees=5, sample=256)
    assert {r["drawn"] for r in few.collect()} == {40}
    scores = [r[0] for r in D.score_isolation_forest(df.limit(40), few, names).select("isolation_raw").collect()]
    assert 0.3 < np.mean(scores) < 0.7


def test_one_class_is_the_mean_kernel(spark):
    """Random features approach the mean Gaussian similarity to all normal rows."""
    df = planted(spark, 400, 5)
    names = ["a", "b", "c"]
    model = D.fit_one_class(df.where("label = 'normal'"), names, components=20_000)
    x = np.array([[r[c] for c in names] for r in df.orderBy("event_id").collect()])
    normal = x[:400]
    exact = np.exp(-((x[:, None] - normal[None]) ** 2).sum(2) / 3).mean(1)
    found = [-r["one_class_raw"] for r in D.one_class_score(df, model, names).orderBy("event_id").collect()]
    assert np.abs(exact - found).max() < 0.03


@pytest.mark.parametrize("kind", ["principal", "prototype"])
def test_sequences_flag_what_training_never_saw(spark, kind):
    """Windows of a regular pattern rebuild well; a broken pattern exceeds the threshold."""
    rows = []
    for e in range(8):
        for i in range(60):
            odd = e == 0 and i >= 50
            values = [np.sin(i + e) * (1 if not odd else 6), np.cos(i + e) if not odd else 7.0]
            rows.append((e * 100 + i, f"e{e}", i, "brute_force" if odd else "normal", "train" if i < 40 else "test", *map(float, values)))
    df = spark.createDataFrame(rows, "event_id long, entity_id string, s int, label string, split string, f double, g double")
    df = df.withColumn("timestamp", F.timestamp_seconds("s").cast("timestamp_ntz"))
    found = {r["event_id"]: r for r in D.score_sequences(df, ["f", "g"], EntitySegments.none(spark), kind).collect()} \
        if kind == "prototype" else None
    if found is None:
        train = D.training_windows(df, ["f", "g"], EntitySegments.none(spark))
        model = D.fit_principal(train, k=2)
        every = {r["event_id"]: r["error"] for r in D.window_errors(D.sequence_vectors(df, ["f", "g"], EntitySegments.none(spark)), model).collect()}
        # Brute force: residual of the centred window off the first two right singular vectors.
        x = np.array([r["window"].toArray() for r in train.collect()])
        centre = x.mean(0)
        axes = np.linalg.svd(x - centre, full_matrices=False)[2][:2]
        for r in D.sequence_vectors(df, ["f", "g"], EntitySegments.none(spark)).collect():
            w = r["window"].toArray() - centre
            assert every[r["event_id"]] == pytest.approx(((w - axes.T @ (axes @ w)) ** 2).mean(), abs=1e-8)
        assert min(every[i] for i in range(55, 60)) > max(every[100 + i] for i in range(10, 60))
    else:
        assert min(found[i]["sequence_score"] for i in range(55, 60)) > max(found[100 + i]["sequence_score"] for i in range(60))


def test_contributions_add_up(spark, parts, small):
    """Base share plus contributions is the probability of the predicted class."""
    stage = detection.stage(small, "AttackClassifierModel", kind="forest")
    path = tempfile.mkdtemp() + "/forest"
    stage.models["model"].write().save(path)
    scored = materialize(small.transform(parts[1]), "scored")
    given = M.predict(stage.models["model"], M.training_frame(scored, INPUTS))
    paths = M.attribute_paths(given.select("event_id", "features", "prediction"), M.tree_nodes(spark, path), INPUTS)
    both = paths.join(given.select("event_id", "p", "prediction"), "event_id").collect()
    assert len(both) == parts[1].count()
    for r in both:
        assert r["base"] + sum(r["contributions"]) == pytest.approx(r["p"][int(r["prediction"])], abs=1e-9)


def test_bounded_rows_keep_every_label(spark, parts):
    train = parts[0]
    assert M.bounded_rows(train).count() == M.bounded_rows(train, 10 ** 9).count() == train.count()
    kept = M.bounded_rows(train, 200)
    assert 100 < kept.count() < 400
    assert {r[0] for r in kept.select("label").distinct().collect()} == {r[0] for r in train.select("label").distinct().collect()}


def test_registered_detector(spark):
    """Full-size forest: floors for the classifiers, the comparison and the written evaluation."""
    v = Views(spark, SF)
    rows = {r["model"]: r for r in Q.trained_comparison(v).collect()}
    assert len(rows) == 6
    assert rows["Random Forest"]["f1"] > 0.6 and rows["Boosted Trees"]["recall"] > 0.6
    assert all(r["accuracy"] > 0.5 for r in rows.values())
    model = detection.stage(Q.detector(v), "AttackClassifierModel", kind="forest").models["model"]
    assert model.getNumTrees == 300 and model.getOrDefault("maxDepth") == 10
    written = Q.s5c(v).collect()
    assert len(written) == 6 and {r["binary_f1"] for r in written} == {rows["Random Forest"]["f1"]}
    assert len(written[0].asDict()) == 5 + 11
    scored = Q.scored(v)
    assert scored.count() == Q.part(v, "test").count()
    assert scored.where("risk_score < 0 or risk_score > 100 or risk_score is null").count() == 0
    assert CategoryEncoder.of({"entity_type": Q.detector(v).stages[0].tables["codes_entity_type"]}).small["entity_type"]


@pytest.mark.parametrize("cell_rows", [4, 40, 2000])
def test_neighbours_of_every_size(spark, cell_rows):
    """The same neighbours as brute force, whatever the cells; equal rows, small groups and a group of copies included."""
    from accesslens.plans.neighbours import nearest_neighbours

    rng = np.random.default_rng(4)
    rows = [(i, "a", (rng.normal(size=4) + 8 * (i % 3)).tolist()) for i in range(300)]
    rows += [(1000 + i, "a", [1.0, 1.0, 1.0, 1.0]) for i in range(60)]
    rows += [(2000 + i, "b", [float(i), 0.0, 0.0, 0.0]) for i in range(3)] + [(3000, "c", [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "event_id long, label string, x array<double>")
    found = {r["id"]: r["near"] for r in nearest_neighbours(df, "label", "event_id", "x", 3, cell_rows, 16).collect()}
    assert len(found) == len(rows)
    for i, g, x in rows:
        others = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, h, y in rows if h == g and j != i)[:3]
        got = [sum((a - b) ** 2 for a, b in zip(x, y)) for y in found[i]]
        assert got == pytest.approx([d for d, _ in others], abs=1e-9)


def test_neighbours_travel_as_ids(spark, monkeypatch):
    """Units return ids and distances, no vectors, and the nearest of several parts of other cells at once."""
    from accesslens.plans import neighbours as N

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, "a", rng.normal(size=4).tolist()) for i in range(200)], "id long, label string, x array<double>")
    grouped, seen = type(df.groupBy("id").cogroup(df.groupBy("id"))), []
    apply = grouped.applyInPandas

    def counted(self, fn, schema):
        out = materialize(apply(self, fn, schema), "met")
        seen.append((schema, out.count()))
        return out

    monkeypatch.setattr(grouped, "applyInPandas", counted)
    assert N.nearest_neighbours(df, "label", "id", "x", 3, 10, 16).count() == 200
    schema, n = seen[0]
    assert "array" not in schema and n <= 200 * 4 * -(-3 * 16 // N.UNIT_PARTS)


def test_nearest_rows_with_ties_and_missing_numbers():
    from accesslens.plans.neighbours import _nearest

    y = np.array([[1.0], [0.0], [1.0], [np.nan], [-1.0], [5.0]])
    row, column, gap = _nearest(np.array([[0.0], [np.nan], [5.0]]), y, 3)
    assert row.tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert column[:3].tolist() == [1, 0, 2] and column[6:].tolist() == [5, 0, 2] and gap[:3].tolist() == [0.0, 1.0, 1.0]
    crowd = _nearest(np.zeros((1, 1)), np.ones((100, 1)), 4)
    assert crowd[1].tolist() == [0, 1, 2, 3]


def test_fit_scores_the_train_events(spark, parts):
    """The frame that a fit leaves is what the fitted pipeline makes of the same events, without features computed anew."""
    model, applied = detection.fit_and_apply(Pipeline(stages=[EventFeatures(), FeatureScaler()]), parts[0])
    again = model.transform(parts[0])
    assert applied.columns == again.columns and cells(applied) == cells(again)


def test_train_part_is_scored_once(spark, monkeypatch):
    """Scored train events come from the fit of the detector: no stage is applied to them a second time."""
    v = Views(spark, SF)
    Q.detector(v)
    key = (spark.sparkContext.applicationId, SF)
    kept = {k: p for k, p in Q._SAVED.items() if k != (*key, "scored-train")}
    monkeypatch.setattr(Q, "_SAVED", kept)
    monkeypatch.setattr(Q.PipelineModel, "transform", lambda *a: pytest.fail("scored again"))
    assert Q.scored(v, "train").count() == Q.part(v, "train").count()


def test_distant_cells_do_not_meet():
    from accesslens.plans.neighbours import _cell_pairs

    pivots = {"a": np.array([[float(100 * i), 0.0] for i in range(10)])}
    pairs = _cell_pairs(pivots, {"a": (np.full(10, 50), np.full(10, 3.0))}, 4)
    assert [(i, j) for _, i, j, _ in pairs] == [(i, i) for i in range(10)]


def test_profile_states_merge_by_day(spark, parts):
    """Profiles of merged states, days cut anywhere, equal those of all events at once."""
    from accesslens.operators import profiles as P

    features = materialize(build_features(parts[0].unionByName(parts[1])).select(*P.PROFILED), "profiled")
    whole = cells(P.entity_profiles(features).withColumn("typical_resources", F.array_join("typical_resources", ",")), 6)
    noon = "timestamp < '2024-01-12 12:00:00'"
    states = P.merge_profile_states(P.profile_states(features.where(noon)), P.profile_states(features.where(f"not ({noon})")))
    merged = P.profiles_of_states(states).withColumn("typical_resources", F.array_join("typical_resources", ","))
    assert cells(merged, 6) == whole and len(whole) > 5
    assert P.profiles_of_states(P.profile_states(features.where("false"))).count() == 0


def test_statistical_scores_take_one_feature_pass(spark):
    """The plan of d1 reads the written columns only; the features ran once, when these were written."""
    import __spark_entry__ as entry

    plan = entry.queries()["d1_statistical_score"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan


def plan(df):
    return df._jdf.queryExecution().toString()


def test_features_are_computed_once(spark, parts, small):
    """What the scaler is fitted on and what later stages read is stored: no window runs again."""
    features = small.stages[0].transform(parts[1])
    assert "Window" not in plan(features) and features.count() == parts[1].count()
    history = detection.with_scope(small, "history").stages[0].transform(parts[1])
    assert "Window" not in plan(history) and history.count() == parts[1].count()


def test_time_cut_is_found_once(spark, monkeypatch):
    from accesslens.catalog import registry

    calls = []
    monkeypatch.setattr(registry, "temporal_split", lambda log: calls.append(1) or temporal_split(log), raising=False)
    v = Views(spark, SF)
    rows = [Q.part(v, name).count() for name in ("train", "test")]
    assert len(calls) == 1 and sum(rows) == v.log.count() and rows[0] == int(sum(rows) * 0.8)


@pytest.mark.parametrize("kind", ["principal", "prototype"])
def test_window_fit_reads_small_splits_and_scores_once(spark, monkeypatch, kind):
    rows = [(i, f"e{i % 3}", float(i % 7), float(i % 5), "normal", "train") for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, entity_id string, f double, g double, label string, split string") \
        .withColumn("timestamp", F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, event_id)"))
    seen, key = {}, "spark.sql.files.maxPartitionBytes"
    fit, cut, before = getattr(D, f"fit_{'principal' if kind == 'principal' else 'prototypes'}"), D.normal_threshold, spark.conf.get(key)

    def fitted(windows):
        seen["split"] = spark.conf.get(key)
        return fit(windows, 2)

    def threshold(errors, name):
        seen["plan"] = plan(errors)
        return cut(errors, name)

    monkeypatch.setattr(D, fit.__name__, fitted)
    monkeypatch.setattr(D, "normal_threshold", threshold)
    D.fit_sequences(df, ["f", "g"], EntitySegments.none(spark), kind)
    assert seen["split"] == str(D.WINDOW_SPLIT) and spark.conf.get(key) == before
    assert "UDF" not in seen["plan"] and "MapInPandas" not in seen["plan"]


def test_tree_fits_take_whole_waves(spark):
    """More partitions than cores are dealt to a multiple of the cores; all others, and all rows, stay as they are."""
    cores = spark.sparkContext.defaultParallelism
    for parts, wanted in ((1, 1), (cores, cores), (cores + 1, 2 * cores), (2 * cores, 2 * cores), (3 * cores - 1, 3 * cores)):
        df = M.whole_waves(spark.range(0, 1000, 1, parts))
        assert df.rdd.getNumPartitions() == wanted and sorted(r["id"] for r in df.collect()) == list(range(1000))


def test_isolation_fit_reads_stored_rows(spark, monkeypatch):
    """Drawing and scoring read the normal rows as written once, not what they were derived from."""
    rows = [(i, "normal" if i % 10 else "brute_force", *[float((i * (j + 3)) % 17) for j in range(len(Z))]) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, label string, " + ", ".join(f"{z} double" for z in Z))
    df = df.withColumn(Z[0], F.udf(lambda x: x, "double")(Z[0]))
    plans, score, draw = [], D.score_isolation_forest, D.tree_samples

    def scored(frame, *args):
        plans.append(plan(frame))
        return score(frame, *args)

    def drawn(frame, *args):
        plans.append(plan(frame))
        assert frame.count() == 360
        return draw(frame, *args)

    monkeypatch.setattr(D, "score_isolation_forest", scored)
    monkeypatch.setattr(D, "tree_samples", drawn)
    IsolationScorer(trees=5, sample=32).fit(df)
    assert len(plans) == 2 and not any("UDF" in p or "BatchEvalPython" in p for p in plans)


def test_tree_draws_are_rows_not_lambdas(spark):
    """A draw is a generated row and a compiled hash; lambdas over an array of draws run interpreted."""
    plans, write = [], D.materialize
    D.materialize = lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1]
    try:
        D.tree_samples(spark.range(500).select(F.col("id").alias("event_id"), F.lit(1.0).alias("a")), ["a"], 5, 8).count()
    finally:
        D.materialize = write
    assert plans and not any("lambda" in p for p in plans)


def test_registered_queries_bound_generated_methods(spark):
    """Wide stages stay below the size of a method that the JVM compiles."""
    import __spark_entry__ as E

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    E.queries()["p3_is_weekend"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_boosted_trees_of_all_labels_are_those_of_spark(spark):
    """Grown for all labels at once from binned rows, in chunks, the trees predict what Spark ML's trees of each label do."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.linalg import Vectors

    from accesslens.operators import boosting as B

    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4))
    x[:, 2], x[:, 3] = np.round(x[:, 2]), 1.0
    x[600:] = x[:300]       # equal rows are counted together
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] * x[:, 0] > 0.2)
    df = spark.createDataFrame([(i, Vectors.dense(x[i]), float(y[i])) for i in range(900)], ["event_id", "features", "label_enc"])
    gbt = GBTClassifier(featuresCol="features", labelCol="label_enc", maxIter=4, maxDepth=3, stepSize=0.1, seed=42)
    slow = OneVsRest(classifier=gbt, featuresCol="features", labelCol="label_enc").fit(df)
    cuts, forests = B.boost(df, 4, 3, 0.1, chunk_rows=100)
    few = B.as_models(spark, cuts, forests, gbt)
    whole = M.fit_boosted(df, 4, 3)
    margins = lambda model: np.array([list(r[0]) for r in model.transform(df).orderBy("event_id").select("rawPrediction").collect()])
    assert np.abs(margins(whole) - margins(slow)).max() < 1e-9
    for a, b in zip(few, slow.models):
        assert a.getNumTrees == 4 and np.abs(margins(a) - margins(b)).max() < 1e-9
        assert np.abs(a.featureImportances.toArray() - b.featureImportances.toArray()).max() < 1e-9
    path = tempfile.mkdtemp() + "/boosted"
    whole.write().save(path)
    assert np.abs(margins(type(whole).load(path)) - margins(whole)).max() == 0


def test_boosted_candidate_splits():
    from accesslens.operators.trees import candidate_splits

    assert candidate_splits(np.array([3.0, 1.0, 1.0, np.nan])).tolist() == [2.0]
    assert len(candidate_splits(np.ones(5))) == 0
    many = candidate_splits(np.arange(3200.0))
    assert len(many) == 31 and np.abs(np.diff(many) - 100).max() <= 1


def test_boosted_trees_have_all_rounds(spark):
    """The registered boosted trees: 300 rounds of depth 6 for each of eight labels."""
    models = Q.boosted(Views(spark, SF)).models["model"].models
    assert [m.getNumTrees for m in models] == [300] * 8 and {m.getOrDefault("maxDepth") for m in models} == {6}


def forest_rows(spark, n=1500):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 5))
    x[:, 2], x[:, 3] = np.round(x[:, 2]), 1.0
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] * x[:, 0] > 0.9)
    y[rng.random(n) < 0.05] = 0
    x[n // 2:], y[n // 2:] = x[:n - n // 2], y[:n - n // 2]      # equal rows are counted together
    rows = [(i, Vectors.dense(x[i]), float(y[i]), str(y[i])) for i in range(n)]
    return materialize(M.with_class_weights(spark.createDataFrame(rows, ["event_id", "features", "label_enc", "label"])), "forest-rows")


def shares(model, df):
    from pyspark.ml.functions import vector_to_array

    return np.array([r[0] for r in model.transform(df).orderBy("event_id").select(vector_to_array("probability")).collect()])


def test_a_tree_of_the_forest_is_that_of_spark(spark, monkeypatch):
    """All rows once and all features at each node: probabilities, nodes and importances are those of Spark ML's tree."""
    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier

    from accesslens.operators import forest as R

    df, grow = forest_rows(spark), R.grow_forest
    columns = dict(featuresCol="features", labelCol="label_enc", weightCol="class_weight", maxDepth=5)
    slow = DecisionTreeClassifier(**columns).fit(df)
    monkeypatch.setattr(R, "grow_forest", lambda *a: grow(*a, draw=lambda n, tree, chunk: n.astype(np.int64), chunk_rows=200))
    fast = R.fit_random_forest(df, RandomForestClassifier(numTrees=1, seed=42, **columns))
    assert fast.totalNumNodes == slow.numNodes and np.abs(shares(fast, df) - shares(slow, df)).max() < 1e-9
    assert np.abs(fast.featureImportances.toArray() - slow.featureImportances.toArray()).max() < 1e-9


def test_the_forest_is_as_near_to_that_of_spark_as_another_seed(spark):
    from pyspark.ml.classification import RandomForestClassifier

    df = forest_rows(spark)
    one, other = (RandomForestClassifier(featuresCol="features", labelCol="label_enc", weightCol="class_weight", numTrees=60, maxDepth=5,
                                         seed=s).fit(df) for s in (1, 2))
    found = M.fit_forest(df, 60, 5)
    gap = lambda a, b: np.abs(shares(a, df) - shares(b, df)).mean()
    assert gap(found, one) < 2 * gap(one, other) and abs(found.totalNumNodes / one.totalNumNodes - 1) < 0.1


def test_the_forest_does_not_depend_on_partitions(spark):
    df = forest_rows(spark)
    a, b = (shares(M.fit_forest(df.repartition(n, "event_id"), 10, 4), df) for n in (3, 7))
    assert np.abs(a - b).max() == 0


def test_forest_draws_are_poisson_and_repeat():
    from accesslens.operators.forest import draws

    n = np.repeat([1.0, 4.0], 50_000)
    found = draws(n, 42, 3, 0)
    assert (found == draws(n, 42, 3, 0)).all() and (found != draws(n, 42, 4, 0)).any()
    for rows, mean in ((found[:50_000], 1), (found[50_000:], 4)):
        assert rows.mean() == pytest.approx(mean, abs=0.03) and rows.var() == pytest.approx(mean, rel=0.04)
