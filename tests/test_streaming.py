"""Ordered replay, event-time entity state and their restarts, over several micro-batches."""

import tempfile

import pytest
from pyspark.sql import functions as F

from accesslens.functions.scalar import epoch_micros, hash_uniform
from accesslens.operators.encode import CategoryEncoder
from accesslens.plans.ranks import dense_codes, ranked_by_range
from accesslens.sources.access_log import access_log
from accesslens.streaming.entity_state import track_entities
from accesslens.streaming.monitor import latest_feed, totals_to_table
from accesslens.streaming.replay import TICK_SIZES, event_stream, replay_stream, run_available, run_to_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    """The log from a table stored as a folder that several tasks wrote, in no order of time."""
    folder = tempfile.mkdtemp(prefix="accesslens-test-")
    spark.read.parquet(f"{SF}/events.parquet").repartition(7, F.rand(1)).write.parquet(f"{folder}/events.parquet")
    return access_log(spark, folder)


def batches_of(stream, **options):
    got = {}

    def keep(rows, number):
        got[number] = sorted((r["rank"], r["tick"], r["event_id"], r["timestamp"]) for r in rows.collect())

    run_available(stream, "test-replay", each_batch=keep, ordered=True, **options)
    return got


@pytest.mark.parametrize("size", TICK_SIZES)
def test_ticks_are_in_time_order(log, size):
    few = log.where("event_id % 5 = 0").select("event_id", "timestamp")
    expected = [(r["timestamp"], r["event_id"]) for r in few.orderBy("timestamp", "event_id").collect()]
    got = batches_of(replay_stream(few, size, ticks_per_batch=max(1, 60 // size), bucket_rows=37))
    assert len(got) >= 3
    rows = [row for number in sorted(got) for row in got[number]]
    assert [(t, e) for _, _, e, t in rows] == expected
    assert [(rank, tick) for rank, tick, _, _ in rows] == [(i, i // size) for i in range(len(expected))]


def test_one_tick_a_batch_and_restart(log):
    """A failed micro-batch is repeated by a new reader, which then goes on from the offset of the checkpoint."""
    few = log.where("event_id % 40 = 0").select("event_id", "timestamp")
    stream, checkpoint, got = replay_stream(few, 10, 1, bucket_rows=20), tempfile.mkdtemp(), []

    def fail_once(rows, number):
        if number == 2 and not any(n == -1 for n, _ in got):
            got.append((-1, None))
            raise ValueError("lost")
        got.append((number, [r["rank"] for r in rows.orderBy("rank").collect()]))

    with pytest.raises(Exception, match="lost"):
        run_available(stream, "r", each_batch=fail_once, ordered=True, checkpoint=checkpoint)
    run_available(stream, "r", each_batch=fail_once, ordered=True, checkpoint=checkpoint)
    done = [(n, ranks) for n, ranks in got if n >= 0]
    assert [n for n, _ in done] == list(range(len(done)))
    assert all(len(ranks) == 10 for _, ranks in done[:-1])
    assert [r for _, ranks in done for r in ranks] == list(range(few.count()))
    before = len(got)
    run_available(stream, "r", each_batch=fail_once, ordered=True, checkpoint=checkpoint)
    assert len(got) == before


def test_empty_replay(spark, log):
    empty = log.where("false").select("event_id", "entity_id", "timestamp").withColumns(
        {"risk_score": F.lit(1.0), "severity": F.lit("Low")})
    assert not any(batches_of(replay_stream(empty, 5, 1)).values())
    assert latest_feed(replay_stream(empty, 5, 1)).count() == 0
    totals = totals_to_table(replay_stream(empty, 5, 1)).collect()
    assert totals == [] or totals[0]["processed"] == 0


def test_event_stream_reads_files_and_folders(spark, log):
    folder = tempfile.mkdtemp(prefix="accesslens-test-")
    spark.read.parquet(f"{SF}/events.parquet").repartition(5).write.parquet(f"{folder}/events.parquet")
    expected = log.count()
    assert run_to_table(event_stream(spark, SF), "from-file").count() == expected
    assert run_to_table(event_stream(spark, folder, 2), "from-folder").count() == expected


NAMES = ("time_gap_seconds", "geo_distance_km", "cumulative_unique_resources", "entity_event_count", "ph")


def tracked(log, seed, **options):
    """Events up to a day out of order, one huge entity among them, in at least five micro-batches."""
    late = F.floor(hash_uniform(F.col("event_id"), seed=seed) * 86_400_000_000).cast("long")
    arriving = log.withColumn("arrival", epoch_micros("timestamp") + late)
    stream = replay_stream(arriving, 25, max(1, log.count() // 25 // 5), order=("arrival", "event_id"))
    found = run_to_table(track_entities(stream, delay="1 day", **options), "tracked", ordered=True)
    return {r["event_id"]: tuple(round(r[c], 5) for c in NAMES) for r in found.collect()}


def test_state_does_not_depend_on_arrival(log):
    hot = log.withColumn("entity_id", F.when(F.col("event_id") % 3 == 0, "HOT").otherwise(F.col("entity_id")))
    rows = sorted(hot.collect(), key=lambda r: (r["timestamp"], r["event_id"]))
    first = tracked(hot, 1, bucket_seconds=3600)
    assert first == tracked(hot, 2, bucket_seconds=3600)
    # Every released event carries the gap and count of its entity's whole history so far.
    last, count, seen = {}, {}, {}
    newest = rows[-1]["timestamp"].timestamp() - 86_400
    for r in rows:
        name, at = r["entity_id"], r["timestamp"].timestamp()
        count[name] = count.get(name, 0) + 1
        seen.setdefault(name, set()).add(r["resource_accessed"])
        if at // 3600 * 3600 + 3600 <= newest:
            gap, _, unique, number, _ = first.pop(r["event_id"])
            assert (unique, number) == (len(seen[name]), count[name])
            assert gap == pytest.approx(at - last.get(name, at), abs=1e-4)
        last[name] = at
    assert not first


def test_idle_entities_are_forgotten(log):
    """Two spells of activity: with a time to live every entity starts anew in the second one."""
    day = F.dayofmonth("timestamp")
    spells = log.where((F.month("timestamp") == 1) & ((day < 10) | (day >= 20)))
    found = tracked(spells, 3, bucket_seconds=3600, idle_seconds=5 * 86_400)
    kept = tracked(spells, 3, bucket_seconds=3600)
    assert found.keys() == kept.keys()
    rows = [r for r in spells.collect() if r["event_id"] in kept]
    first = lambda f: sum(1 for values in f.values() if values[3] == 1)
    assert first(kept) == len({r["entity_id"] for r in rows})
    assert first(found) == len({(r["entity_id"], r["timestamp"].day >= 20) for r in rows}) > first(kept)


def test_ranks_and_codes_under_one_prefix(spark):
    """A million values that share their first characters: right codes, and no task with a large share of them."""
    n = 1_000_000
    words = spark.range(n).select(F.format_string("shared-prefix-of-all/%08d", (F.col("id") * 7919) % n).alias("w"))
    codes = dense_codes(words.unionByName(words.limit(1000)), "w")
    assert codes.count() == n
    assert codes.where(F.col("code") != F.substring("w", -8, 8).cast("long")).count() == 0
    spread = ranked_by_range(words, ["w"], partitions=16).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1
    encoder = CategoryEncoder.fit(words.where("w < 'shared-prefix-of-all/00001000'"), ["w"], limit=10)
    out = encoder.transform(words.withColumn("event_id", F.monotonically_increasing_id()), {"w": "code"})
    assert out.where("code = -1").count() == n - 1000 and out.agg(F.max("code")).first()[0] == 999


def test_ranges_hold_even_shares(spark):
    """The written ranges of values under one prefix are about equal, so no task holds the group as a whole."""
    from accesslens.plans import ranks

    written = []
    keep, ranks.materialize = ranks.materialize, lambda df, name: written.append(keep(df, name)) or written[-1]
    try:
        words = spark.range(200_000).select(F.format_string("shared-prefix-of-all/%08d", "id").alias("w"))
        ranks.ranked_by_range(words, ["w"], partitions=16).count()
    finally:
        ranks.materialize = keep
    sizes = [r["count"] for r in written[0].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 200_000 / 16


def test_short_buckets_are_walked_together():
    """Many short buckets of an entity read and write its state once."""
    from types import SimpleNamespace

    from accesslens.streaming.entity_state import EntityTracker

    class Store(dict):
        exists, getValue, removeKey = lambda s: "v" in s, dict.__getitem__, dict.pop
        get = lambda s: s["v"]
        containsKey = dict.__contains__
        updateValue = dict.__setitem__

        def update(self, value):
            self["v"], self.writes = value, getattr(self, "writes", 0) + 1

    tracker = EntityTracker(1000)
    tracker.handle = SimpleNamespace(registerTimer=lambda t: None, deleteTimer=lambda t: None)
    tracker.last, tracker.resources, tracker.waiting, tracker.timer = Store(), Store(), Store(), Store()
    for b in range(9):
        tracker.waiting[(b, b)] = ([b * 1_000_000], [b], [0.0], [0.0], ["r"], [1.0])
    tracker.timer.update((1000, 9))
    out = list(tracker.handleExpiredTimer(("e",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 8000), None))
    assert [n for pdf in out for n in pdf["entity_event_count"]] == list(range(1, 9))
    assert tracker.last.writes == 1 and list(tracker.waiting) == [(8, 8)]
