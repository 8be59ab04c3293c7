"""Hand-computed micro frames (FIXTURES.md, section 4)."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from accesslens import constants as C
from accesslens.functions import scalar as S
from accesslens.operators import coldstart as K, drift as G, encode as E, evaluate as V, profiles as P
from accesslens.operators.features import build_features
from accesslens.operators.sequences import event_sequences
from accesslens.plans.ranks import exact_quantiles
from accesslens.plans.segments import EntitySegments
from accesslens.streaming.replay import write_replay_files

T0 = datetime(2024, 1, 1, 5, 59)


def event(i, entity="USR_0001", at=T0, geo="40.7128,-74.0060", resource="/r", commands='["a"]', **kw):
    base = dict(event_id=i, entity_id=entity, entity_type="user", timestamp=at, source_ip="10.0.0.1", geo_location=geo,
                geo_city="New York", resource_accessed=resource, auth_method="password", session_duration=100,
                command_sequence=commands, device_fingerprint="os|mac|HTTPS", auth_success=True, label="normal")
    base.update(kw)
    return tuple(base[c] for c in C.ACCESS_LOG_COLUMNS)


def log(spark, rows):
    return spark.createDataFrame(rows, C.ACCESS_LOG_SCHEMA)


def by_id(df):
    return {r["event_id"]: r for r in df.collect()}


def test_single_event_entity(spark):
    df = log(spark, [event(1)])
    r = by_id(build_features(df))[1]
    assert (r["hour_deviation"], r["time_gap_seconds"], r["geo_distance_km"], r["entity_event_count"]) == (0, 0, 0, 1)
    seq = event_sequences(df.select("event_id", "entity_id", "timestamp", F.lit(7.0).alias("x")), "x",
                          EntitySegments.none(spark)).collect()
    assert [s["sequence"] for s in seq] == [[0.0] * 9 + [7.0]]


def test_same_second_jump(spark):
    r = by_id(build_features(log(spark, [event(1), event(2, geo="35.6762,139.6503")])))[2]
    assert r["geo_distance_km"] > 10000 and r["geo_velocity_kmh"] == 0


def test_bad_geo_and_commands(spark):
    rows = [event(1, geo="abc"), event(2, geo="12.5"), event(3, geo=None, commands='{"a":1}'),
            event(4, commands="zz"), event(5, commands='["a","b"]')]
    r = by_id(log(spark, rows).withColumns({**S.coordinates(), "n": S.cmd_count()}))
    assert all((r[i]["latitude"], r[i]["longitude"]) == (0, 0) for i in (1, 2, 3))
    assert [r[i]["n"] for i in (3, 4, 5)] == [0, 0, 2]


def test_night_edges(spark):
    times = [datetime(2024, 1, 1, 5, 59), datetime(2024, 1, 1, 6), datetime(2024, 1, 1, 21, 59), datetime(2024, 1, 1, 22)]
    r = by_id(log(spark, [event(i, at=t) for i, t in enumerate(times)]).withColumns(S.temporal()))
    assert [r[i]["is_night"] for i in range(4)] == [1, 0, 0, 1]


def test_unseen_category(spark):
    train, test = log(spark, [event(1, resource="/a"), event(2, resource="/b")]), log(spark, [event(3, resource="/c"), event(4, resource="/b")])
    for limit in (50, 1):     # dictionary broadcast, then the salted join
        out = by_id(E.CategoryEncoder.fit(train, ["resource_accessed"], limit).transform(test, {"resource_accessed": "code"}))
        assert (out[3]["code"], out[4]["code"]) == (-1, 1)


def test_severity_holes(spark):
    scores = [84.0, 84.5, 85.0, 64.5, 39.5, 19.0]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    r = df.select("s", S.severity(F.col("s")).alias("a"), S.severity(F.col("s"), True).alias("b")).collect()
    assert [x["a"] for x in r] == ["High", "Low", "Critical", "Low", "Low", "Low"]
    assert [x["b"] for x in r] == ["High", "High", "Critical", "Medium", "Low", "Low"]


def test_risk_history(spark):
    df = log(spark, [event(i, label="normal" if i >= 2 else "brute_force") for i in range(10)])
    assert P.entity_risk_history(df).first()["entity_risk"] == pytest.approx(0.195)


def test_constant_minmax_and_modal_tie(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0)], "event_id long, s double")
    assert {r["o"] for r in E.minmax_inverted(df, "s", "o").collect()} == {0.5}
    tie = log(spark, [event(i, auth_method=m) for i, m in enumerate(["token", "password", "token", "password"])])
    assert P.modal_value(tie, ["entity_id"], "auth_method", "m").first()["m"] == "password"


def test_auc_and_one_class(spark):
    df = spark.createDataFrame([(1, .1, 0), (2, .4, 0), (3, .35, 1), (4, .8, 1)], "event_id long, s double, y_true int")
    assert V.auc_roc(df, "s").first()[0] == pytest.approx(0.75)
    assert V.auc_roc(df.where("y_true = 0"), "s").first()[0] is None
    m = V.binary_metrics(V.confusion_counts(df.where("y_true = 0").withColumn("y_pred", F.lit(0)))).first()
    assert (m["precision"], m["recall"]) == (0, 0)


def test_precision_at_k(spark):
    df = spark.range(150).select(F.col("id").alias("event_id"), F.lit(0.5).alias("s"), (F.col("id") == 0).cast("int").alias("y_true"))
    r = V.precision_at(df, "s", [0.01, 0.02]).orderBy("fraction").collect()
    assert [(x["k"], x["precision"]) for x in r] == [(1, 1.0), (3, pytest.approx(1 / 3))]


def test_page_hinkley(spark):
    df = spark.createDataFrame([("e", i, T0 + timedelta(seconds=i), float(x)) for i, x in enumerate([0, 0, 0, 1])],
                               "entity_id string, event_id long, timestamp timestamp_ntz, x double")
    r = by_id(G.page_hinkley(df, "x", EntitySegments.none(spark)))
    assert [r[i]["drift"] for i in range(4)] == [0, 0, 0, 1]
    assert r[3]["ph"] == pytest.approx(0.745)


def test_cold_start(spark):
    r = K.cold_start_info(spark.createDataFrame([("e", "user", 5)], "entity_id string, entity_type string, event_count long")).first()
    assert (r["peer_weight"], r["individual_weight"], r["progress_pct"], r["monitoring_level"]) == (.75, .25, 25, "Elevated")


@pytest.mark.parametrize("tp,flagged,fp,fn,p,r,f1", [
    (78, 330, 252, 151, .2364, .3406, .2791), (173, 611, 438, 56, .2831, .7555, .4119), (41, 42, 1, 188, .9762, .1790, .3026),
    (56, 83, 27, 173, .6747, .2445, .3590), (179, 198, 19, 50, .9040, .7817, .8384), (210, 1429, 1219, 19, .1470, .9170, .2533)])
def test_published_confusions(spark, tp, flagged, fp, fn, p, r, f1):
    m = V.binary_metrics(spark.createDataFrame([(tp, fp, fn, 10031 - tp - fp - fn)], "tp long, fp long, fn long, tn long")).first()
    assert [round(m[c], 4) for c in ("precision", "recall", "f1")] == [p, r, f1]


def test_quantiles_with_ties_and_negatives(spark):
    values = [-5.0, -5.0, 0.0, 0.25, 0.25, 0.25, 7.5, 1e6]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = {r["p"]: r["q"] for r in exact_quantiles(df, ["k"], "v", [0, .1, .5, .9, 1]).collect()}
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in (0.0, .1, .5, .9, 1.0)]))).first()[0]
    assert [got[p] for p in (0, .1, .5, .9, 1)] == pytest.approx(want)


def test_replay_files_keep_all_rows(spark, tmp_path):
    write_replay_files(log(spark, [event(i, at=T0 + timedelta(minutes=i)) for i in range(25)]), str(tmp_path / "r"), 10)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 25


def test_factors_are_completed_in_their_own_rows(spark):
    """Ranked factors become records after they got rows of their own, where unread texts are not computed."""
    from accesslens.operators import explain as X

    df = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else float(i % 3), float(i)) for i in range(40)],
                               "event_id long, cmd_count double, hour_deviation double, risk double")
    names = ["cmd_count", "hour_deviation"]
    surrogate = X.linear_surrogate(df, names, "risk")
    records = X.explode_factors(X.attribute_linear(df, surrogate, names, 2))
    ranked = X.explode_factors(X.attribute_linear(df, surrogate, names, 2, records=False))
    assert ranked.columns == records.columns and ranked.count() == 80
    assert sorted(ranked.collect()) == sorted(records.collect())
    short = ranked.select("event_id", "rank", "feature", "attribution")
    assert "format_string" not in short._jdf.queryExecution().optimizedPlan().toString()
