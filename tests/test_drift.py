"""Drift with reset on feature vectors: the block scan against a row-by-row walk."""

import math

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from accesslens import constants as C
from accesslens.operators import drift as G
from accesslens.operators.drift import DriftWalk
from accesslens.plans.segments import EntitySegments


def row_by_row(x, threshold, delta, window, decay, warmup):
    """Page-Hinkley as its definition says, one event at a time."""
    hits, mean, std = [], None, None
    n = total = cum = 0.0
    low = math.inf

    def baseline(i):
        rows = x[max(0, i + 1 - window):i + 1]
        w = np.array([decay ** (len(rows) - 1 - k) for k in range(len(rows))])
        m = (w[:, None] * rows).sum(0) / w.sum()
        return m, np.sqrt((w[:, None] * (rows - m) ** 2).sum(0) / w.sum())

    for i, row in enumerate(x):
        if mean is None:
            if i + 1 >= warmup:
                mean, std = baseline(i)
            continue
        d = float(np.mean(np.abs(row - mean) / np.maximum(std, 1e-6)))
        n, total = n + 1, total + d
        cum += d - total / n - delta
        low = min(low, cum)
        if cum - low > threshold:
            hits.append((i, d))
            mean, std = baseline(i)
            n, total, cum, low = 0.0, 0.0, 0.0, math.inf
    return hits


@pytest.mark.parametrize("threshold", [0.05, 2.0, 30.0])
@pytest.mark.parametrize("length", [0, 19, 20, 700])
def test_block_scan(threshold, length):
    rng = np.random.default_rng(length)
    x = rng.normal(size=(length, 28)) + np.linspace(0, 6, length)[:, None]
    x[:, 3] = 1.0
    expected = row_by_row(x, threshold, 0.005, 50, 0.95, 20)
    for cuts in ([], [1, 2, 3, 19, 20, 21, 300], list(range(7, length, 7))):
        walk = DriftWalk(threshold, 0.005, 50, 0.95, 20)
        walk.begin(28)
        edges, found = [0, *[c for c in cuts if c < length], length], []
        for low, high in zip(edges, edges[1:]):
            found += [(low + i, d) for i, d in walk.push(x[low:high])]
        assert [i for i, _ in found] == [i for i, _ in expected]
        assert [d for _, d in found] == pytest.approx([d for _, d in expected], rel=1e-9)
    if length == 700:
        assert expected


def test_state_can_be_handed_over():
    """A walk that starts in the middle with state and history goes on exactly as the one before."""
    x = np.random.default_rng(1).normal(size=(400, 3))
    whole = DriftWalk(1.0, 0.005, 40, 0.95, 20)
    whole.begin(3)
    first = whole.push(x[:230])
    state = whole.state()
    rest = [(i, d) for i, d in whole.push(x[230:])]
    other = DriftWalk(1.0, 0.005, 40, 0.95, 20)
    other.begin(3, 230, state)
    other.recall(x[190:230])
    assert other.push(x[230:]) == rest and first and rest
    assert other.state() == whole.state()


def test_hot_entities_equal_the_plain_walk(spark):
    from accesslens.operators.drift import drift_events
    from accesslens.operators.features import build_features
    from accesslens.plans.segments import EntitySegments
    from accesslens.session import materialize
    from accesslens.sources.access_log import access_log

    log = access_log(spark, "/root/testdata/sf0.001")
    features = materialize(build_features(log).drop("_seg"), "test-features")
    rows = lambda segments, threshold: sorted(
        (r["entity_id"], r["event_id"], round(r["deviation"], 4))
        for r in drift_events(features, C.FEATURES, segments, threshold=threshold, window=30).collect())
    for threshold in (0.05, 3.0):
        plain = rows(EntitySegments.none(spark), threshold)
        assert plain and plain == rows(EntitySegments.probe(features, hot_rows=60, segment_rows=25), threshold)


def test_vector_baseline_streams_rows(spark):
    """Vectors pass once in Arrow batches, no list of vectors for each row; the numbers are those of the lists."""
    rows = [(f"e{i % 5}" if i % 11 else "few", i, None if i % 13 == 0 else float(i * i % 37), float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "entity_id string, event_id long, a double, b double").withColumn(
        "timestamp", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, event_id)"))
    w = Window.partitionBy("entity_id").orderBy("timestamp", "event_id")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for previous, frame in ((True, w.rowsBetween(-6, -1)), (False, w.rowsBetween(-5, 0))):
            out = G.vector_baseline(df, ["a", "b"], EntitySegments.none(spark), 6, previous=previous)
            assert "collect_list" not in out._jdf.queryExecution().toString()
            found = {r["event_id"]: (r["adaptive_mean"], r["adaptive_std"]) for r in out.collect()}
            lists = df.withColumn("rows", F.collect_list(F.array("a", "b")).over(frame))
            wanted = G.with_decayed(lists, "rows", 2, "w").collect()
            assert len(found) == len(wanted) == 300
            for r in wanted:
                assert found[r["event_id"]] == (r["w_mean"], r["w_std"])
            assert any(r["w_mean"] is None for r in wanted) == previous
            assert any(r["w_mean"] and r["w_mean"][0] is None and not math.isnan(r["w_mean"][1]) for r in wanted)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
