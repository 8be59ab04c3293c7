"""Plans for hot entities against the plain plans, and properties of sampling, state and trained operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslens import constants as C
from accesslens.operators import classify as M, detectors as D, drift as G
from accesslens.operators.features import plain_features
from accesslens.operators.profiles import entity_profiles
from accesslens.operators.queue import uniform_sample
from accesslens.plans.replicate import replicate
from accesslens.plans.segments import EntitySegments, with_lead
from accesslens.sources.access_log import access_log
from tests.log_generator import generate_access_log

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    """One entity holds a third of all rows."""
    hot = F.when(F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0, "USR_HOT").otherwise(F.col("entity_id"))
    return access_log(spark, SF).withColumn("entity_id", hot).cache()


@pytest.fixture(scope="module")
def segments(log):
    return EntitySegments.probe(log, hot_rows=100, segment_rows=40)


def rows(df, *cols):
    def cell(x):
        return float(f"{x:.6g}") if isinstance(x, float) else x
    return sorted(tuple(str(cell(r[c])) for c in cols) for r in df.select(*cols).collect())


def test_hot_entity_is_cut(segments):
    assert "USR_HOT" in segments.cuts and len(segments.cuts["USR_HOT"]) > 5


def test_features_and_profiles(log, segments):
    none = EntitySegments.none(log.sparkSession)
    cols = ["event_id", *[c for c in C.FEATURES if not c.endswith("_enc")]]
    hot, plain = plain_features(log, segments), plain_features(log, none)
    assert rows(hot, *cols) == rows(plain, *cols)
    cols = ["entity_id", "duration_p95", "geo_distance_p95", "hour_std", "unique_resources", "primary_auth"]
    assert rows(entity_profiles(hot, segments), *cols) == rows(entity_profiles(plain, none), *cols)


def test_drift_events_with_reset(log, segments):
    none = EntitySegments.none(log.sparkSession)
    cols = ["entity_id", "event_id", "deviation"]
    a = rows(G.drift_events(log, "session_duration", segments, threshold=3.0), *cols)
    assert a == rows(G.drift_events(log, "session_duration", none, threshold=3.0), *cols) and a


def test_lead(log, segments):
    none = EntitySegments.none(log.sparkSession)
    assert rows(with_lead(log, ["resource_accessed"], segments), "event_id", "next_resource_accessed") == rows(
        with_lead(log, ["resource_accessed"], none), "event_id", "next_resource_accessed")


def test_sample_and_replicate(spark, log):
    s = uniform_sample(log.select("event_id"), 50)
    assert s.count() == 50 and s.distinct().count() == 50
    r = replicate(spark.createDataFrame([(1, 25), (2, 0), (3, 3)], "k long, t long"), F.col("t"), "k", chunk=10)
    assert sorted((x["k"], x["copy"]) for x in r.collect()) == [(1, i) for i in range(25)] + [(3, i) for i in range(3)]


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    x[:5] += 12
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "event_id long, a double, b double, c double")
    forest = D.fit_isolation_forest(df, ["a", "b", "c"], trees=40, sample=128)
    assert forest.select("tree").distinct().count() == 40
    top = D.score_isolation_forest(df, forest, ["a", "b", "c"]).orderBy(F.col("isolation_raw").desc()).limit(5)
    assert {r["event_id"] for r in top.collect()} == set(range(5))
    model = D.fit_one_class(df.where("event_id >= 5"), ["a", "b", "c"])
    # The kernel is approximated, so outliers rank among the top 5 %, not exactly first.
    top = D.one_class_score(df, model, ["a", "b", "c"]).orderBy(F.col("one_class_raw").desc()).limit(30)
    assert {r["event_id"] for r in top.collect()} >= set(range(5))


def test_smote_balances_on_segments(spark):
    pts = [(i, "normal", 7.0, float(i), 0.0) for i in range(40)] + [(100 + i, "brute_force", 0.0, float(i), 5.0) for i in range(7)]
    df = spark.createDataFrame(pts, "event_id long, label string, label_enc double, a double, b double")
    out = M.smote_oversample(df, ["a", "b"])
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {"normal": 40, "brute_force": 40}
    made = out.where("synthetic = 1").collect()
    assert all(r["b"] == 5.0 and 0 <= r["a"] <= 6 for r in made)


def test_generated_log(spark):
    log = generate_access_log(spark.range(60).withColumnRenamed("id", "entity_no"), 3000)
    got = {r["label"]: r["count"] for r in log.groupBy("label").count().collect()}
    assert set(got) == set(C.LABELS) and got["impossible_travel"] == 8 and got["device_spoofing"] == 9
    normal = log.where("label = 'normal'").groupBy("entity_id").count()
    assert normal.count() == 60 and normal.agg(F.min("count")).first()[0] >= 5
    assert log.select("event_id").distinct().count() == log.count()


def test_many_medium_entities_are_all_cut(spark):
    """The row limit is fixed: thousands of entities above it are all cut, none into a segment over twice the limit."""
    from pyspark.sql import functions as F

    log = spark.range(3000 * 200).select(
        F.col("id").alias("event_id"), F.concat(F.lit("e"), F.col("id") % 3000).alias("entity_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 3000)).alias("timestamp"))
    plan = EntitySegments.probe(log, hot_rows=100)
    assert len(plan.cuts) == 3000
    assert {len(parts) for parts in plan.cuts.values()} == {2}
    assert plan.tag(log).groupBy("entity_id", "_seg").count().agg(F.max("count")).first()[0] == 100
