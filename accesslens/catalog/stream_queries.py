"""Streaming queries, run to the end of the available data; their final state has SQL twins."""

from pyspark.sql import functions as F

from accesslens.catalog.registry import Views, query, rnd, sql_rnd, sql_time, text_time
from accesslens.catalog.sql_base import sql
from accesslens.functions.scalar import epoch_micros, hash_uniform
from accesslens.plans.segments import KEY
from accesslens.session import scratch_path
from accesslens.streaming.entity_state import track_entities
from accesslens.streaming.monitor import latest_feed, totals_to_table
from accesslens.streaming.replay import event_stream, replay_stream, run_available, run_to_table
from accesslens.streaming.rules import brute_force_windows, credential_stuffing_windows


def _alert_stream(v: Views):
    """A finished alert table, replayed in time order in four micro-batches."""
    return replay_stream(v.alerts.select("event_id", KEY, "timestamp", "risk_score", "severity"), 25, None, name="replay-alerts")


_REPLAY_SQL = """rp AS (SELECT event_id, entity_id, row_number() OVER (ORDER BY "timestamp", event_id) - 1 AS rank FROM access_log),
rt AS (SELECT max(rank) // 25 + 1 AS ticks FROM rp)"""


@query("u1_replay", sql("log", "SELECT event_id, entity_id, rank, rank // 25 AS tick, (rank // 25) // ((ticks + 3) // 4) AS batch FROM rp, rt", _REPLAY_SQL))
def u1(v: Views):
    """25 events a tick in time order, in four micro-batches: the tick of each event and the micro-batch that brought it."""
    path = scratch_path(v.spark, "replayed")
    stream = replay_stream(v.log.select("event_id", KEY, "timestamp"), 25, None)

    def keep(rows, number):
        rows.select("event_id", KEY, "rank", "tick").write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(stream, "replayed", each_batch=keep, ordered=True)
    schema = f"event_id long, {KEY} string, rank long, tick long, batch long"
    return v.spark.read.schema(schema).parquet(path)


@query("u2_running_totals", sql("alerts", f"SELECT count(*) AS processed, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high, {sql_rnd('100 * count(*) FILTER (risk_score > 40) / count(*)', 'anomaly_rate_pct', 4)} FROM alerts"))
def u2(v: Views):
    return totals_to_table(_alert_stream(v)).select("processed", "critical", "high", rnd("anomaly_rate_pct", 4))


@query("u3_latest_feed", sql("alerts", f"SELECT event_id, entity_id, {sql_time()}, risk_score, severity FROM alerts ORDER BY alerts.\"timestamp\" DESC, event_id DESC LIMIT 20"))
def u3(v: Views):
    return latest_feed(_alert_stream(v)).select("event_id", KEY, text_time(), "risk_score", "severity")


_STATE_SQL = """st1 AS (SELECT *, log_session_duration AS x, avg(log_session_duration) OVER o AS m FROM features WINDOW o AS (PARTITION BY entity_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING)),
st2 AS (SELECT *, sum(x - m - 0.005) OVER (PARTITION BY entity_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS c FROM st1),
st3 AS (SELECT *, c - min(c) OVER (PARTITION BY entity_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS ph FROM st2)"""


_DELAY_DAYS, _BUCKET = 2, 86_400


@query("u4_entity_state", sql("features", f"""SELECT event_id, entity_id, {sql_rnd('time_gap_seconds')}, {sql_rnd('geo_distance_km', digits=4)}, cumulative_unique_resources, entity_event_count, {sql_rnd('ph', digits=4)}, cast(ph > 0.05 AS bigint) AS drift FROM st3
  WHERE (epoch_ms("timestamp") // {_BUCKET * 1000} + 1) * {_BUCKET * 1000} <= (SELECT epoch_ms(max("timestamp")) - {_DELAY_DAYS * _BUCKET * 1000} FROM access_log)""", _STATE_SQL))
def u4(v: Views):
    """Causal features from state. Events arrive up to two days out of order in four micro-batches; days that the
    watermark has not passed are still waiting."""
    late = hash_uniform(F.col("event_id"), seed=4) * (_DELAY_DAYS * 86_400_000_000)
    arriving = v.log.withColumn("arrival", epoch_micros("timestamp") + F.floor(late).cast("long"))
    stream = replay_stream(arriving, 25, None, order=("arrival", "event_id"))
    tracked = run_to_table(track_entities(stream, delay=f"{_DELAY_DAYS} days", bucket_seconds=_BUCKET), "tracked", ordered=True)
    return tracked.select("event_id", KEY, rnd("time_gap_seconds"), rnd("geo_distance_km", 4),
                          "cumulative_unique_resources", "entity_event_count", rnd("ph", 4), "drift")


# A window is final once the watermark (latest event - 10 minutes) has passed its end.
@query("u5_brute_force_windows", sql("log", """SELECT window_start, entity_id, source_ip, fails FROM (
  SELECT cast(floor(epoch("timestamp")) AS bigint) // 300 * 300 AS window_start, entity_id, source_ip, count(*) AS fails FROM access_log WHERE NOT auth_success GROUP BY 1, 2, 3)
  WHERE fails >= 10 AND window_start + 300 <= (SELECT epoch(max("timestamp")) - 600 FROM access_log WHERE NOT auth_success)"""))
def u5(v: Views):
    return run_to_table(brute_force_windows(event_stream(v.spark, v.sf_dir)), "brute-force")


@query("u5_credential_stuffing_windows", sql("log", """SELECT window_start, source_ip, count(*) AS entities, cast(sum(n) AS bigint) AS attempts, cast(sum(f) AS bigint) AS fails
  FROM (SELECT source_ip, cast(floor(epoch("timestamp")) AS bigint) // 1800 * 1800 AS window_start, entity_id, count(*) AS n, count(*) FILTER (NOT auth_success) AS f FROM access_log GROUP BY ALL)
  WHERE window_start + 1800 <= (SELECT epoch(max("timestamp")) - 600 FROM access_log)
  GROUP BY source_ip, window_start HAVING count(*) >= 15 AND sum(f) / sum(n) >= 0.7"""))
def u5b(v: Views):
    return run_to_table(credential_stuffing_windows(event_stream(v.spark, v.sf_dir)), "stuffing")
