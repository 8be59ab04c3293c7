"""Alert queue, splits, samples and per-entity reads."""

from pyspark.sql import DataFrame, Window, functions as F

from accesslens import constants as C
from accesslens.functions.scalar import epoch_micros, geo_part, hash_uniform
from accesslens.plans.ranks import cut_rows, minute_of_micros, within_cut
from accesslens.plans.segments import ID, KEY, TS, EntitySegments, with_lead
from accesslens.sources.access_log import read_access_log, write_access_log


def by_risk():
    return [F.col("risk_score").desc(), F.col(ID).asc()]


def top_alerts(alerts: DataFrame, n) -> DataFrame:
    """The n highest risks: a per-task top-n, never a full sort."""
    return alerts.orderBy(*by_risk()).limit(n)


def filter_alerts(alerts: DataFrame, severities=(), types=()) -> DataFrame:
    """Keep the given severities and predicted types; an empty list keeps all."""
    if severities:
        alerts = alerts.where(F.col("severity").isin(list(severities)))
    if types:
        alerts = alerts.where(F.col("predicted_label").isin(list(types)))
    return alerts


ALERT_VIEW = ["entity_id", "entity_type", "timestamp", "geo_city", "resource_accessed",
              "risk_score", "severity", "predicted_label", "label"]


def alert_view(alerts: DataFrame, severities=(), types=(), cap=200) -> DataFrame:
    """The nine display columns of the filtered queue, highest risk first."""
    return top_alerts(filter_alerts(alerts, severities, types), cap).select(*ALERT_VIEW)


def entity_events(df: DataFrame, entity_id) -> DataFrame:
    return df.where(F.col(KEY) == entity_id)


def history_of_alerted(alerts: DataFrame, minimum, segments: EntitySegments) -> DataFrame:
    """All events of entities that have an alert above ``minimum``.

    The number of alerted entities is not bounded, so they join by key; hot entities spread over segments.
    """
    flagged = alerts.where(F.col("risk_score") > minimum).groupBy(KEY).agg(F.count("*").alias("entity_alerts"))
    return segments.lookup(alerts, flagged).where("entity_alerts is not null")


def _time_cut(log: DataFrame, size):
    """The row that ends the first ``size`` events by time."""
    return cut_rows(log, epoch_micros(TS), ID, [size], minute_of_micros).get(size) if size > 0 else None


def temporal_split(log: DataFrame, share=0.8) -> DataFrame:
    """Mark the first int(n * share) events by time as train, the rest as test: no global sort."""
    cut = _time_cut(log, int(log.count() * share))
    return log.withColumn("split", F.when(within_cut(epoch_micros(TS), ID, cut), "train").otherwise("test"))


def write_parts(log: DataFrame, path, fmt="csv", share=0.8):
    """Write the whole log and its train (first ``share`` by time) and test parts below ``path``: full, train, test."""
    write_access_log(log, f"{path}/full", fmt)
    # The parts are cut from the written rows, so they always add up to them.
    parts = temporal_split(read_access_log(log.sparkSession, f"{path}/full", fmt), share)
    for name in ("train", "test"):
        write_access_log(parts.where(F.col("split") == name), f"{path}/{name}", fmt)


def replay_prefix(log: DataFrame, rows) -> DataFrame:
    """The first ``rows`` events by time."""
    cut = _time_cut(log, min(rows, log.count()))
    return log.where(within_cut(epoch_micros(TS), ID, cut))


def argmax_event(df: DataFrame, score) -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col(ID).asc()).limit(1)


def uniform_sample(df: DataFrame, n, seed=42) -> DataFrame:
    """n rows without replacement, the same on every run: the n smallest hashes of the key.

    A hash threshold a little above n / rows first drops what cannot be among them, so only about n rows
    are ranked. Should the threshold keep fewer than n, the ranking runs over all rows instead.
    """
    total = df.count()
    if total <= n:
        return df
    u = hash_uniform(F.col(ID), seed=seed)
    keep = min(1.0, (n + 6 * n ** 0.5 + 50) / total)
    near = df.where(u < keep)
    if keep < 1.0 and near.count() < n:
        near = df
    return near.orderBy(u, F.col(ID)).limit(n)


def jittered(points: DataFrame, reach=0.5, seed=7) -> DataFrame:
    """Map points moved by up to ``reach`` degrees, seeded by severity and event."""
    move = lambda k: (hash_uniform(F.col("severity"), F.col(ID), seed=seed + k) * 2 - 1) * reach
    return points.withColumns({"latitude": F.col("latitude") + move(0), "longitude": F.col("longitude") + move(1)})


def geo_points(alerts: DataFrame, with_low=False) -> DataFrame:
    """Alerts with a position that parses, of the upper tiers (and Low on request)."""
    tiers = [n for n, *_ in C.SEVERITY_TIERS if with_low or n != "Low"]
    return (alerts.where(F.col("severity").isin(tiers))
            .withColumns({"latitude": geo_part(0), "longitude": geo_part(1)})
            .dropna(subset=["latitude", "longitude"])
            .select(ID, KEY, "geo_city", "latitude", "longitude", "risk_score", "severity", "predicted_label"))


def travel_segments(alerts: DataFrame) -> DataFrame:
    """Consecutive predicted impossible-travel events of an entity as from/to pairs."""
    hits = alerts.where(F.col("predicted_label") == "impossible_travel").select(
        ID, KEY, TS, "geo_city", "latitude", "longitude")
    segments = EntitySegments.probe(hits)
    pairs = with_lead(hits, ["geo_city", "latitude", "longitude"], segments)
    return pairs.where("next_geo_city is not null").select(
        ID, KEY, F.col("geo_city").alias("from_city"), F.col("latitude").alias("from_lat"), F.col("longitude").alias("from_lon"),
        F.col("next_geo_city").alias("to_city"), F.col("next_latitude").alias("to_lat"), F.col("next_longitude").alias("to_lon"))


def resource_codes(log: DataFrame) -> DataFrame:
    """Per entity: resources numbered by first use (ties by name), from 0."""
    first = log.groupBy(KEY, "resource_accessed").agg(F.min(F.struct(TS, ID)).alias("_f"))
    w = Window.partitionBy(KEY).orderBy("_f")
    return first.select(KEY, "resource_accessed", (F.row_number().over(w) - 1).cast("long").alias("resource_code"))


def entity_timeline(alerts: DataFrame, entity_id) -> DataFrame:
    """Events of one entity with risk, duration, resource code and anomaly flag."""
    own = entity_events(alerts, entity_id)
    codes = resource_codes(own).drop(KEY)
    return own.join(codes, "resource_accessed").select(
        ID, KEY, TS, "risk_score", "session_duration", "resource_code",
        (F.col("risk_score") > C.ANOMALY_RISK).cast("long").alias("is_anomaly"))
