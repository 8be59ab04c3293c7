"""Sources, projections, filters, joins and aggregations."""

from pyspark.sql import functions as F

from accesslens import constants as C
from accesslens.catalog.registry import Views, query, rnd, sql_rnd, sql_time, text_time
from accesslens.catalog.sql_base import sql
from accesslens.functions import scalar as S
from accesslens.operators import coldstart as K, encode as E, evaluate as V, patterns as PT, profiles as P, queue as Q
from accesslens.operators import summary as A
from accesslens.operators.features import feature_matrix, plain_features, scalar_features
from accesslens.plans.segments import KEY, EntitySegments
from accesslens.session import materialize, scratch_path
from accesslens.sources import access_log as L

LOG_TEXT = [c for c in C.ACCESS_LOG_COLUMNS if c not in ("timestamp", "auth_success")]
_log_cols = ", ".join(LOG_TEXT)


def _log_out(df):
    return df.select(*LOG_TEXT, text_time(), F.col("auth_success").cast("long").alias("auth_success"))


_LOG_SQL = sql("log", f"SELECT {_log_cols}, {sql_time()}, cast(auth_success AS bigint) AS auth_success FROM access_log")


# --- sources and sinks ---

@query("s1_read_access_log", _LOG_SQL)
def s1(v: Views):
    """Write the log as CSV, then scan it with the fixed schema."""
    path = scratch_path(v.spark, "log-csv")
    L.write_access_log(v.log, path, "csv")
    return _log_out(L.read_access_log(v.spark, path, "csv"))


@query("s2_write_access_log", sql("log", "SELECT strftime(\"timestamp\", '%Y-%m-%d') AS event_date, count(*) AS events FROM access_log GROUP BY 1"))
def s2(v: Views):
    """Parquet laid out by date; the count per date only reads the partition column."""
    path = scratch_path(v.spark, "log-by-date")
    L.write_access_log(v.log, path, "parquet", partition_by_date=True)
    back = v.spark.read.parquet(path)
    return back.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(F.count("*").alias("events"))


@query("s2_write_parts", sql("log", f"SELECT split AS part, event_id, {sql_time()}, geo_location, command_sequence, auth_success FROM (SELECT event_id, \"timestamp\", geo_location, command_sequence, auth_success, 'full' AS split FROM access_log UNION ALL SELECT event_id, \"timestamp\", geo_location, command_sequence, auth_success, split FROM split)",
       """ranked2 AS (SELECT *, row_number() OVER (ORDER BY "timestamp", event_id) AS rn, count(*) OVER () AS total FROM access_log),
split AS (SELECT *, CASE WHEN rn <= cast(floor(total * 0.8) AS bigint) THEN 'train' ELSE 'test' END AS split FROM ranked2)"""))
def s2p(v: Views):
    """The whole log, its train and its test part as CSV with a header, read back."""
    path = scratch_path(v.spark, "log-parts")
    Q.write_parts(v.log, path)
    back = [L.read_access_log(v.spark, f"{path}/{p}").select(
        F.lit(p).alias("part"), "event_id", text_time(), "geo_location", "command_sequence", "auth_success")
        for p in ("full", "train", "test")]
    return back[0].unionByName(back[1]).unionByName(back[2])


@query("s3_write_profiles_json", sql("profiles", f"SELECT entity_id, entity_type, event_count, {sql_rnd('hour_mean')}, unique_resources, array_to_string(typical_resources, ',') AS typical_resources, primary_auth FROM profiles"))
def s3(v: Views):
    path = scratch_path(v.spark, "profiles-json")
    profiles = v.profiles
    L.write_json_records(profiles, path)
    back = L.read_json_records(v.spark, path, profiles.schema)
    return back.select(KEY, "entity_type", "event_count", rnd("hour_mean"), "unique_resources",
                       F.array_join("typical_resources", ",").alias("typical_resources"), "primary_auth")


@query("s4_write_alert_queue", sql("alerts", "SELECT event_id, entity_id, risk_score, severity, predicted_label FROM alerts"))
def s4(v: Views):
    return v.stored_alerts("event_id", KEY, "risk_score", "severity", "predicted_label")


_FLAGGED = """flagged AS (SELECT *, cast(label <> 'normal' AS bigint) AS y_true, cast(predicted_label <> 'normal' AS bigint) AS y_pred FROM alerts),
counts AS (SELECT count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn FROM flagged)"""


# --- projections ---

def feature_query(name, ints=(), doubles=(), extra=None):
    """A query over feature columns: integers as they are, doubles rounded."""
    text = ", ".join(["event_id", *ints, *[sql_rnd(d) for d in doubles]])

    @query(name, sql("features", f"SELECT {text} FROM features"))
    def run(v: Views):
        return v.plain.select("event_id", *ints, *[rnd(d) for d in doubles])
    return run


def scalar_query(name, ints=(), doubles=()):
    """Row-local features only: a scan and a projection, no shuffle."""
    text = ", ".join(["event_id", *ints, *[sql_rnd(d) for d in doubles]])

    @query(name, sql("features", f"SELECT {text} FROM features"))
    def run(v: Views):
        return scalar_features(v.log).select("event_id", *ints, *[rnd(d) for d in doubles])
    return run


scalar_query("p1_clock_fields", ["hour", "minute_of_day", "day_of_month"])
scalar_query("p2_day_of_week", ["day_of_week"])
scalar_query("p3_is_weekend", ["is_weekend"])
scalar_query("p4_is_night", ["is_night"])
scalar_query("p5_cyclic_time", [], ["hour_sin", "hour_cos", "dow_sin", "dow_cos"])
scalar_query("p6_coordinates", [], ["latitude", "longitude"])
scalar_query("p7_cmd_count", ["cmd_count"])
scalar_query("p8_has_suspicious_cmd", ["has_suspicious_cmd"])
scalar_query("p9_fingerprint_parts", ["fingerprint_parts"])
scalar_query("p10_auth_success_int", ["auth_success_int"])
scalar_query("p11_log_session_duration", [], ["log_session_duration"])


@query("p12_haversine_km", sql("features", f"""SELECT event_id, {sql_rnd('''12742.0 * atan2(
    sqrt(pow(sin(radians(40.7128 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(40.7128)) * pow(sin(radians(-74.0060 - longitude) / 2), 2)),
    sqrt(1 - (pow(sin(radians(40.7128 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(40.7128)) * pow(sin(radians(-74.0060 - longitude) / 2), 2))))''', 'km_from_new_york', 4)} FROM features"""))
def p12(v: Views):
    """Distance of every event from New York."""
    _, lat, lon = C.CITIES[0]
    pos = v.log.select("event_id", "geo_location").withColumns(S.coordinates())
    return pos.select("event_id", rnd(S.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)), 4, "km_from_new_york"))


@query("p13_feature_vector", sql("features", "SELECT event_id, " + ", ".join(sql_rnd(f) for f in C.FEATURES) + " FROM features"))
def p13(v: Views):
    """All 28 features in model order, repaired."""
    return feature_matrix(v.features).select("event_id", *[rnd(f) for f in C.FEATURES])


@query("p14_format_timestamp", sql("log", f"SELECT event_id, {sql_time(name='shown')} FROM access_log"))
def p14(v: Views):
    return v.log.select("event_id", S.format_timestamp("timestamp").alias("shown"))


feature_query("p15_log_time_gap", [], ["log_time_gap"])

_names_sql = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in C.DISPLAY_NAMES.items()) + " ELSE feature END"
_attack_sql = "CASE label " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in C.ATTACK_DESCRIPTIONS.items()) + " ELSE label END"
_color_sql = "CASE severity " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, _, _, c in C.SEVERITY_TIERS) + f" ELSE '{C.DEFAULT_COLOR}' END"


@query("p16_descriptions", sql("log", f"SELECT event_id, label, {_attack_sql} AS description FROM access_log"))
def p16(v: Views):
    return v.log.select("event_id", "label", S.attack_description(F.col("label")).alias("description"))


@query("p16_display_names", sql("features", f"SELECT feature, {_names_sql} AS display_name, events FROM (SELECT unnest(['hour', 'latitude', 'geo_velocity_kmh', 'unlisted']) AS feature, count(*) AS events FROM features GROUP BY 1)"))
def p16_names(v: Views):
    """Feature names with their display names; an unknown name stays as it is."""
    names = F.array(*[F.lit(x) for x in ("hour", "latitude", "geo_velocity_kmh", "unlisted")])
    rows = v.log.select(F.explode(names).alias("feature")).groupBy("feature").agg(F.count("*").alias("events"))
    return rows.select("feature", S.display_name(F.col("feature")).alias("display_name"), "events")


@query("p17_severity_color", sql("alerts", f"SELECT event_id, severity, {_color_sql} AS color FROM alerts"))
def p17(v: Views):
    return v.alerts.select("event_id", "severity", S.severity_color(F.col("severity")).alias("color"))


# --- filters ---

@query("f1_normal_only", sql("log", "SELECT event_id, entity_id FROM access_log WHERE label = 'normal'"))
def f1(v: Views):
    return P.normal_only(v.log).select("event_id", KEY)


@query("f1_anomaly_only", sql("log", "SELECT event_id, entity_id, label FROM access_log WHERE label <> 'normal'"))
def f1b(v: Views):
    return P.anomaly_only(v.log).select("event_id", KEY, "label")


@query("f2_alert_filter", sql("alerts", "SELECT event_id, severity, predicted_label FROM alerts WHERE severity IN ('High', 'Medium') AND predicted_label IN ('lateral_movement', 'impossible_travel')"))
def f2(v: Views):
    return Q.filter_alerts(v.alerts, ["High", "Medium"], ["lateral_movement", "impossible_travel"]).select(
        "event_id", "severity", "predicted_label")


@query("f3_risk_thresholds", sql("alerts", "SELECT event_id, risk_score, cast(risk_score > 40 AS bigint) AS is_anomaly FROM alerts WHERE risk_score > 20"))
def f3(v: Views):
    return v.alerts.where(F.col("risk_score") > C.ALERT_RISK).select(
        "event_id", "risk_score", (F.col("risk_score") > C.ANOMALY_RISK).cast("long").alias("is_anomaly"))


@query("f4_entity_filter", sql("log", f"SELECT event_id, {sql_time()}, resource_accessed FROM access_log WHERE entity_id = 'USR_0001'"))
def f4(v: Views):
    return Q.entity_events(v.log, "USR_0001").select("event_id", text_time(), "resource_accessed")


@query("f5_valid_geo", sql("log", "SELECT event_id, try_cast(split_part(geo_location, ',', 1) AS double) AS latitude, try_cast(split_part(geo_location, ',', 2) AS double) AS longitude FROM access_log WHERE try_cast(split_part(geo_location, ',', 1) AS double) IS NOT NULL AND try_cast(split_part(geo_location, ',', 2) AS double) IS NOT NULL"))
def f5(v: Views):
    return v.log.select("event_id", S.geo_part(0).alias("latitude"), S.geo_part(1).alias("longitude")).dropna(
        subset=["latitude", "longitude"])


@query("f6_severity_subset", sql("alerts", "SELECT event_id, severity FROM alerts WHERE severity IN ('Critical', 'High', 'Medium')"))
def f6(v: Views):
    return v.alerts.where(F.col("severity").isin("Critical", "High", "Medium")).select("event_id", "severity")


@query("f7_cold_entities", sql("log", "SELECT entity_id, count(*) AS event_count FROM access_log GROUP BY entity_id HAVING count(*) < 20"))
def f7(v: Views):
    return K.entity_counts(v.log).where(F.col("event_count") < C.MIN_HISTORY_EVENTS).select(KEY, "event_count")


@query("f8_profile_lookup", sql("profiles", f"SELECT entity_id, event_count, {sql_rnd('duration_p95')} FROM profiles WHERE entity_id = 'USR_0003'"))
def f8(v: Views):
    """The key filter reaches the scan: only the entity's rows enter the profile."""
    own = P.profile_of(v.log, "USR_0003")
    segments = EntitySegments.probe(own)
    return P.entity_profiles(plain_features(own, segments), segments, own).select(KEY, "event_count", rnd("duration_p95"))


# --- joins and set operations ---

@query("j1_event_profile", sql("scored", f"SELECT event_id, {sql_rnd('statistical_score')} FROM stat"))
def j1(v: Views):
    return P.with_statistical_score(v.profiled, v.profiles, v.segments).select("event_id", rnd("statistical_score"))


@query("j2_event_history", sql("scored", f"SELECT event_id, {sql_rnd('entity_risk')} FROM stat"))
def j2(v: Views):
    return P.with_risk_history(v.log, P.entity_risk_history(v.log), v.segments).select("event_id", rnd("entity_risk"))


@query("j3_event_peers", sql("peers", f"SELECT event_id, {sql_rnd('p.hour_mean', 'peer_hour_mean')}, {sql_rnd('p.duration_mean', 'peer_duration_mean')} FROM features f LEFT JOIN peers p USING (entity_type)"))
def j3(v: Views):
    return K.with_peers(v.log, v.peers).select("event_id", rnd("g_hour_mean", 6, "peer_hour_mean"), rnd("g_duration_mean", 6, "peer_duration_mean"))


@query("j4_attach_scores", sql("alerts", f"SELECT event_id, entity_id, {sql_rnd('statistical_score')}, {sql_rnd('isolation_forest_score')}, risk_score FROM alerts"))
def j4(v: Views):
    """Scores computed apart and attached by event key (unique, so no skew)."""
    scores = v.stored_alerts("event_id", "statistical_score", "isolation_forest_score", "risk_score")
    return v.log.select("event_id", KEY).join(scores, "event_id").select(
        "event_id", KEY, rnd("statistical_score"), rnd("isolation_forest_score"), "risk_score")


@query("j5_unusual_resource", sql("profiles", "SELECT f.event_id, f.resource_accessed FROM features f JOIN profiles p USING (entity_id) WHERE NOT list_contains(p.typical_resources, f.resource_accessed)"))
def j5(v: Views):
    """Events on a resource outside the entity's ten usual ones."""
    usual = (P.top_values(P.normal_only(v.log), [KEY], "resource_accessed", 10).groupBy(KEY)
             .agg(F.collect_list("resource_accessed").alias("usual")))
    return v.segments.lookup(v.log, usual).where(~F.array_contains("usual", F.col("resource_accessed"))).select(
        "event_id", "resource_accessed")


@query("j6_unused_resources", sql("profiles", "SELECT p.entity_id, r.resource_accessed FROM profiles p CROSS JOIN (SELECT DISTINCT resource_accessed FROM access_log) r WHERE NOT list_contains(p.typical_resources, r.resource_accessed)"))
def j6(v: Views):
    return PT.unused_resources(v.log)


@query("j7_label_decode", sql("features", "SELECT event_id, label_enc, label AS decoded FROM features"))
def j7(v: Views):
    return v.log.select("event_id", E.label_code().alias("label_enc")).withColumn("decoded", E.label_name("label_enc"))


@query("j8_union_streams", sql("log", "SELECT event_id, 'normal' AS stream FROM access_log WHERE label = 'normal' UNION ALL SELECT event_id, 'attack' FROM access_log WHERE label <> 'normal'"))
def j8(v: Views):
    return P.normal_only(v.log).select("event_id", F.lit("normal").alias("stream")).unionByName(
        P.anomaly_only(v.log).select("event_id", F.lit("attack").alias("stream")))


@query("j9_label_union", sql("alerts", "SELECT label AS name FROM alerts UNION SELECT predicted_label FROM alerts"))
def j9(v: Views):
    return V.present_labels(V.pair_counts(v.alerts))


@query("j10_alerted_history", sql("alerts", "SELECT event_id, entity_id, risk_score FROM alerts WHERE entity_id IN (SELECT entity_id FROM alerts WHERE risk_score > 40)"))
def j10(v: Views):
    stored = v.stored_alerts("event_id", KEY, "timestamp", "risk_score")
    return Q.history_of_alerted(stored, C.ANOMALY_RISK, v.segments).select("event_id", KEY, "risk_score")


# --- aggregations ---

_PROFILE_DOUBLES = ["hour_mean", "hour_std", "duration_mean", "duration_std", "duration_p95", "geo_distance_mean", "geo_distance_p95", "auth_success_rate"]


@query("a1_entity_profile", sql("profiles", "SELECT entity_id, entity_type, event_count, unique_resources, primary_auth, array_to_string(typical_resources, ',') AS typical_resources, " + ", ".join(sql_rnd(d, digits=4) for d in _PROFILE_DOUBLES) + " FROM profiles"))
def a1(v: Views):
    return v.profiles.select(KEY, "entity_type", "event_count", "unique_resources", "primary_auth",
                             F.array_join("typical_resources", ",").alias("typical_resources"), *[rnd(d, 4) for d in _PROFILE_DOUBLES])


@query("a2_top_values", sql("log", "SELECT entity_id, resource_accessed, n, rank FROM (SELECT entity_id, resource_accessed, count(*) AS n, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, resource_accessed) AS rank FROM access_log GROUP BY entity_id, resource_accessed) WHERE rank <= 10"))
def a2(v: Views):
    return P.top_values(v.log, [KEY], "resource_accessed", 10)


@query("a3_modal_auth", sql("log", "SELECT entity_id, auth_method AS primary_auth FROM (SELECT entity_id, auth_method, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, auth_method) AS rank FROM access_log GROUP BY entity_id, auth_method) WHERE rank = 1"))
def a3(v: Views):
    return P.modal_value(v.log, [KEY], "auth_method", "primary_auth")


_PEER_DOUBLES = ["hour_mean", "hour_std", "duration_mean", "duration_std", "duration_p95", "geo_distance_mean", "geo_distance_p95", "unique_resources_mean", "auth_success_rate"]


@query("a4_peer_groups", sql("peers", "SELECT entity_type, count, " + ", ".join(sql_rnd(d, digits=4) for d in _PEER_DOUBLES) + " FROM peers"))
def a4(v: Views):
    return v.peers.select("entity_type", "count", *[rnd(d, 4) for d in _PEER_DOUBLES])


@query("a5_entity_risk_history", sql("scored", f"SELECT entity_id, total_events, anomaly_events, {sql_rnd('entity_risk')} FROM history"))
def a5(v: Views):
    return P.entity_risk_history(v.log).select(KEY, "total_events", "anomaly_events", rnd("entity_risk"))


@query("a6_alert_summary", sql("alerts", f"SELECT count(*) FILTER (risk_score > 20) AS total_alerts, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low, {sql_rnd('avg(risk_score)', 'avg_risk_score', 4)}, max(risk_score) AS max_risk_score, count(DISTINCT entity_id) FILTER (risk_score > 40) AS unique_entities_flagged FROM alerts"))
def a6(v: Views):
    return A.alert_summary(v.alerts).withColumn("avg_risk_score", F.round("avg_risk_score", 4))


@query("a7_overview", sql("alerts", f"SELECT count(*) AS total_events, count(*) FILTER (risk_score > 40) AS anomalies, {sql_rnd('100 * count(*) FILTER (risk_score > 40) / count(*)', 'anomaly_rate_pct', 4)}, count(DISTINCT entity_id) AS entities, {sql_rnd('avg(risk_score)', 'avg_risk', 4)} FROM alerts"))
def a7(v: Views):
    return A.overview(v.alerts).withColumns({"anomaly_rate_pct": F.round("anomaly_rate_pct", 4), "avg_risk": F.round("avg_risk", 4)})


@query("a8_label_distribution", sql("log", f"SELECT label, n, {sql_rnd('100 * n / sum(n) OVER ()', 'pct', 4)} FROM (SELECT label, count(*) AS n FROM access_log GROUP BY label)"))
def a8(v: Views):
    return A.distribution(v.log, "label").select("label", "n", rnd("pct", 4))


@query("a9_severity_distribution", sql("alerts", "SELECT t.severity, t.tier_order, count(a.event_id) AS n FROM (VALUES ('Critical', 0::bigint), ('High', 1), ('Medium', 2), ('Low', 3)) t(severity, tier_order) LEFT JOIN alerts a USING (severity) GROUP BY 1, 2"))
def a9(v: Views):
    return A.severity_distribution(v.alerts)


@query("a10_severity_truth", sql("alerts", f"SELECT severity, count(*) AS events, {sql_rnd('''avg(cast(label <> 'normal' AS integer))''', 'anomaly_rate')} FROM alerts GROUP BY severity"))
def a10(v: Views):
    return A.severity_truth(v.alerts).select("severity", "events", rnd("anomaly_rate"))


@query("a11_daily_rollup", sql("alerts", f"SELECT strftime(\"timestamp\", '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER (risk_score > 40) AS anomalies, {sql_rnd('avg(risk_score)', 'avg_risk', 4)} FROM alerts GROUP BY 1"))
def a11(v: Views):
    return A.daily_rollup(v.alerts).select("day", "events", "anomalies", rnd("avg_risk", 4))


@query("a12_daily_volume", sql("log", "SELECT strftime(\"timestamp\", '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER (label <> 'normal') AS anomalous FROM access_log GROUP BY 1"))
def a12(v: Views):
    return A.daily_volume(v.log)


@query("a13_hourly_histogram", sql("features", "SELECT h.hour, count(*) FILTER (label = 'normal') AS normal, count(*) FILTER (label <> 'normal') AS anomalous FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN features f ON f.hour = h.hour GROUP BY h.hour"))
def a13(v: Views):
    return A.hourly_histogram(v.log)


@query("a14_duration_histogram", sql("log", f"SELECT bin, n, {sql_rnd('lo + bin * (hi - lo) / 50', 'bin_start', 4)}, {sql_rnd('n / (sum(n) OVER () * ((hi - lo) / 50))', 'density')} FROM (SELECT cast(least(floor((x - lo) / ((hi - lo) / 50)), 49) AS bigint) AS bin, lo, hi, count(*) AS n FROM x CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM x) GROUP BY ALL)", "x AS (SELECT least(cast(session_duration AS double), 2000.0) AS x FROM access_log)"))
def a14(v: Views):
    return A.histogram(v.log, "session_duration", 50, clip=2000).select("bin", "n", rnd("bin_start", 4), rnd("density"))


@query("a14_risk_histogram_by_label", sql("alerts", f"SELECT label, bin, n, {sql_rnd('lo + bin * (hi - lo) / 50', 'bin_start', 4)}, {sql_rnd('n / (sum(n) OVER (PARTITION BY label) * ((hi - lo) / 50))', 'density')} FROM (SELECT label, cast(least(floor((risk_score - lo) / ((hi - lo) / 50)), 49) AS bigint) AS bin, lo, hi, count(*) AS n FROM alerts CROSS JOIN (SELECT min(risk_score) AS lo, max(risk_score) AS hi FROM alerts) GROUP BY ALL)"))
def a14b(v: Views):
    stored = v.stored_alerts("label", "risk_score")
    return A.histogram(stored, "risk_score", 50, keys=["label"]).select("label", "bin", "n", rnd("bin_start", 4), rnd("density"))


@query("a15_label_crosstab", sql("log", "SELECT entity_type, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in C.LABELS) + " FROM access_log GROUP BY entity_type"))
def a15(v: Views):
    return A.label_crosstab(v.log)


@query("a16_auth_counts", sql("log", "SELECT auth_method, count(*) AS n FROM access_log GROUP BY auth_method"))
def a16(v: Views):
    return A.auth_counts(v.log)


@query("a16_auth_success_by_label", sql("log", f"SELECT label, {sql_rnd('avg(cast(auth_success AS integer))', 'success_rate')} FROM access_log GROUP BY label ORDER BY success_rate"))
def a16b(v: Views):
    return A.auth_success_by_label(v.log).select("label", rnd("success_rate")).orderBy("success_rate", "label")


@query("a17_imbalance", sql("log", f"SELECT max(n) AS largest, min(n) AS smallest, {sql_rnd('max(n) / min(n)', 'ratio')} FROM (SELECT count(*) AS n FROM access_log GROUP BY label)"))
def a17(v: Views):
    return A.imbalance(v.log).select("largest", "smallest", rnd("ratio"))


_COLDEST = """counts AS (SELECT entity_id, min(entity_type) AS entity_type, count(*) AS event_count FROM access_log GROUP BY entity_id),
coldest AS (SELECT * FROM (SELECT * FROM counts WHERE event_count < 20 ORDER BY event_count, entity_id LIMIT 10)
  UNION ALL SELECT * FROM (SELECT * FROM counts WHERE NOT EXISTS (SELECT 1 FROM counts WHERE event_count < 20) ORDER BY event_count, entity_id LIMIT 5))"""


@query("a18_coldest_entities", sql("log", "SELECT * FROM coldest", _COLDEST))
def a18(v: Views):
    return K.coldest_entities(K.entity_counts(v.log))


@query("a19_entity_cards", sql("alerts", f"SELECT entity_id, min(entity_type) AS entity_type, count(*) AS events, count(*) FILTER (risk_score > 40) AS anomalies, {sql_rnd('avg(risk_score)', 'avg_risk', 4)} FROM alerts GROUP BY entity_id"))
def a19(v: Views):
    return A.entity_cards(v.alerts).select(KEY, "entity_type", "events", "anomalies", rnd("avg_risk", 4))


@query("a20_score_box_stats", sql("alerts", "SELECT label, " + ", ".join(sql_rnd(f"quantile_cont(risk_score, {p})", n, 4) for n, p in [("low", 0.0), ("q1", .25), ("median", .5), ("q3", .75), ("high", 1.0)]) + " FROM alerts GROUP BY label"))
def a20(v: Views):
    box = A.box_stats(v.stored_alerts("label", "risk_score"), ["label"], "risk_score")
    return box.select("label", *[rnd(c, 4) for c in ("low", "q1", "median", "q3", "high")])


@query("a20_feature_box_stats", sql("features", "SELECT label, " + ", ".join(sql_rnd(f"quantile_cont(greatest(least(duration_deviation, 5.0), -5.0), {p})", n, 4) for n, p in [("low", 0.0), ("q1", .25), ("median", .5), ("q3", .75), ("high", 1.0)]) + " FROM features GROUP BY label"))
def a20b(v: Views):
    """Deviation clipped to five sigmas, by label."""
    stored = materialize(v.plain.select("label", "duration_deviation"), "deviation")
    box = A.box_stats(stored, ["label"], "duration_deviation", clip=5)
    return box.select("label", *[rnd(c, 4) for c in ("low", "q1", "median", "q3", "high")])


@query("a21_mean_score_by_attack", sql("alerts", f"SELECT a.label, {sql_rnd('coalesce(m, 0.0)', 'mean_score')} FROM (SELECT unnest({C.ATTACKS!r}) AS label) a LEFT JOIN (SELECT label, avg(statistical_score) AS m FROM alerts GROUP BY label) USING (label)"))
def a21(v: Views):
    return A.mean_score_by_attack(v.alerts, "statistical_score").select("label", rnd("mean_score"))


_pairs = [(a, b) for i, a in enumerate(C.FEATURES) for b in C.FEATURES[i + 1:]]
_corr_sql = "WITH_CORR AS (SELECT " + ", ".join(f"corr({a}, {b}) AS c{i}" for i, (a, b) in enumerate(_pairs)) + " FROM features)"
_corr_rows = "SELECT p[1] AS feature_a, p[2] AS feature_b, CASE WHEN isnan(r) THEN NULL ELSE r END AS r FROM (SELECT unnest(" + str([list(p) for p in _pairs]) + ") AS p, unnest([" + ", ".join(f"c{i}" for i in range(len(_pairs))) + "]) AS r FROM WITH_CORR)"


@query("a22_correlations", sql("features", f"SELECT feature_a, feature_b, {sql_rnd('r')} FROM pairs", _corr_sql, f"pairs AS ({_corr_rows})"))
def a22(v: Views):
    return A.correlations(feature_matrix(v.features), C.FEATURES).select("feature_a", "feature_b", rnd("r"))


@query("a22_strong_correlations", sql("features", f"SELECT feature_a, feature_b, {sql_rnd('r')} FROM pairs WHERE abs(r) > 0.8", _corr_sql, f"pairs AS ({_corr_rows})"))
def a22b(v: Views):
    return A.correlations(feature_matrix(v.features), C.FEATURES, 0.8).select("feature_a", "feature_b", rnd("r"))


@query("a23_travel_totals", sql("alerts", "SELECT count(*) AS events, count(DISTINCT entity_id) AS entities FROM alerts WHERE predicted_label = 'impossible_travel'"))
def a23(v: Views):
    return A.travel_totals(v.alerts)


@query("a24_class_weights", sql("log", f"SELECT label, n, {sql_rnd('sum(n) OVER () / (count(*) OVER () * n)', 'class_weight')} FROM (SELECT label, count(*) AS n FROM access_log GROUP BY label)"))
def a24(v: Views):
    return A.class_weights(v.log).select("label", "n", rnd("class_weight"))


_SPLIT = """ranked AS (SELECT *, row_number() OVER (ORDER BY "timestamp", event_id) AS rn, count(*) OVER () AS total FROM access_log),
split AS (SELECT *, CASE WHEN rn <= cast(floor(total * 0.8) AS bigint) THEN 'train' ELSE 'test' END AS split FROM ranked)"""


@query("a25_split_summary", sql("log", f"SELECT split, count(*) AS events, count(*) FILTER (label <> 'normal') AS anomalies, count(DISTINCT entity_id) AS entities, {sql_time('min(\"timestamp\")', 'first_event')}, {sql_time('max(\"timestamp\")', 'last_event')} FROM split GROUP BY split", _SPLIT))
def a25(v: Views):
    return A.split_summary(Q.temporal_split(v.log))


@query("a25_split_labels", sql("log", "SELECT split, label, count(*) AS n FROM split GROUP BY ALL", _SPLIT))
def a25b(v: Views):
    return Q.temporal_split(v.log).groupBy("split", "label").agg(F.count("*").alias("n"))
