"""Windows, top-k and splits, encoders, cold start, drift, patterns, evaluation and reports."""

from pyspark.sql import functions as F

from accesslens import constants as C
from accesslens.catalog.base_queries import _COLDEST, _FLAGGED, _SPLIT, feature_query
from accesslens.catalog.registry import Views, query, rnd, sql_rnd, sql_time, text_time
from accesslens.catalog.sql_base import sql
from accesslens.functions import scalar as S
from accesslens.operators import coldstart as K, drift as G, encode as E, evaluate as V, explain as X
from accesslens.operators import patterns as PT, profiles as P, queue as Q, reports as R, risk
from accesslens.operators.sequences import (
    event_sequences, map_window_error, normal_threshold, normalise_error, sequence_predict)
from accesslens.plans.segments import KEY
from accesslens.session import materialize, scratch_path
from accesslens.sources import access_log as L

# --- windows ---

feature_query("w1_hour_deviation", [], ["hour_deviation"])
feature_query("w2_duration_deviation", [], ["duration_deviation"])
feature_query("w3_time_gap", [], ["time_gap_seconds"])
feature_query("w4_geo_distance", [], ["geo_distance_km"])
feature_query("w5_geo_velocity", [], ["geo_velocity_kmh"])
feature_query("w6_cumulative_unique_resources", ["cumulative_unique_resources"])
feature_query("w7_entity_event_count", ["entity_event_count"])

# Windows of the last ten durations; entities with fewer events get one window, padded in front.
_SEQ = """pos AS (SELECT event_id, entity_id, "timestamp", cast(session_duration AS double) AS x,
  row_number() OVER (PARTITION BY entity_id ORDER BY "timestamp", event_id) AS pos, count(*) OVER (PARTITION BY entity_id) AS total FROM access_log),
win AS (SELECT *, list(x) OVER (PARTITION BY entity_id ORDER BY "timestamp", event_id ROWS 9 PRECEDING) AS xs FROM pos),
seqs AS (SELECT event_id, entity_id, pos, total, CASE WHEN len(xs) = 10 THEN xs ELSE list_concat(list_resize([0.0], 10 - len(xs), 0.0), xs) END AS xs
  FROM win WHERE pos >= 10 OR (total < 10 AND pos = total))"""
_JOINED = "list_aggregate(list_transform(xs, lambda x: cast(cast(x AS bigint) AS varchar)), 'string_agg', ',')"


@query("w8_event_sequences", sql("log", f"SELECT event_id, entity_id, {_JOINED} AS durations FROM seqs", _SEQ))
def w8(v: Views):
    seqs = event_sequences(v.log.select("event_id", KEY, "timestamp", F.col("session_duration").cast("double").alias("x")),
                           "x", v.segments)
    return seqs.select("event_id", KEY, F.array_join(F.transform("sequence", lambda x: x.cast("long").cast("string")), ",").alias("durations"))


@query("w9_window_error_to_event", sql("log", f"""SELECT p.event_id, {sql_rnd('coalesce(s.err, first_err.err)', 'window_error', 4)} FROM pos p
  LEFT JOIN errs s ON s.event_id = p.event_id
  LEFT JOIN (SELECT e.entity_id, e.err FROM errs e QUALIFY row_number() OVER (PARTITION BY e.entity_id ORDER BY e.pos) = 1) first_err ON first_err.entity_id = p.entity_id""",
    _SEQ, "errs AS (SELECT event_id, entity_id, pos, list_sum(list_transform(xs, lambda x: pow(x / 1000, 2))) / 10 AS err FROM seqs)"))
def w9(v: Views):
    """Mean square of the window as its error, handed to the last event; early events take the first window's."""
    log = v.log.select("event_id", KEY, "timestamp", F.col("session_duration").cast("double").alias("x"))
    seqs = event_sequences(log, "x", v.segments)
    err = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + F.pow(x / 1000, 2)) / C.SEQUENCE_LENGTH
    return map_window_error(log, seqs.withColumn("error", err), v.segments).select("event_id", rnd("event_error", 4, "window_error"))


@query("w10_travel_segments", sql("alerts", """SELECT event_id, entity_id, geo_city AS from_city, latitude AS from_lat, longitude AS from_lon, to_city, to_lat, to_lon
  FROM (SELECT *, lead(geo_city) OVER o AS to_city, lead(latitude) OVER o AS to_lat, lead(longitude) OVER o AS to_lon FROM alerts
    WHERE predicted_label = 'impossible_travel' WINDOW o AS (PARTITION BY entity_id ORDER BY "timestamp", event_id)) WHERE to_city IS NOT NULL"""))
def w10(v: Views):
    return Q.travel_segments(v.stored_alerts("event_id", KEY, "timestamp", "geo_city", "latitude", "longitude", "predicted_label"))


def _adaptive(frame, extra=""):
    return f"""vals AS (SELECT event_id, entity_id, "timestamp", cast(session_duration AS double) AS x,
  row_number() OVER o AS position, list(cast(session_duration AS double)) OVER (o {frame}) AS xs
  FROM access_log WINDOW o AS (PARTITION BY entity_id ORDER BY "timestamp", event_id)),
wts AS (SELECT *, list_transform(range(len(xs)), lambda i: pow(0.95, len(xs) - 1 - i)) AS ws FROM vals),
m AS (SELECT *, list_dot_product(xs, ws) / list_sum(ws) AS mean FROM wts WHERE len(xs) > 0),
adaptive AS (SELECT *, sqrt(list_dot_product(list_transform(xs, lambda x: pow(x - mean, 2)), ws) / list_sum(ws)) AS std FROM m){extra}"""


@query("w11_adaptive_baseline", sql("log", f"SELECT event_id, {sql_rnd('mean', 'adaptive_mean', 4)}, {sql_rnd('std', 'adaptive_std', 4)}, {sql_rnd('mean + 2 * std', 'adaptive_upper', 4)}, {sql_rnd('mean - 2 * std', 'adaptive_lower', 4)} FROM adaptive", _adaptive("ROWS 19 PRECEDING")))
def w11(v: Views):
    out = G.adaptive_baseline(v.log.select("event_id", KEY, "timestamp", "session_duration"), "session_duration", v.segments)
    return out.select("event_id", *[rnd(c, 4) for c in ("adaptive_mean", "adaptive_std", "adaptive_upper", "adaptive_lower")])


_STATIC = """numbered AS (SELECT entity_id, cast(session_duration AS double) AS x, row_number() OVER (PARTITION BY entity_id ORDER BY "timestamp", event_id) AS rn FROM access_log),
static AS (SELECT entity_id, count(*) AS points, avg(x) AS mean, stddev_pop(x) AS std FROM numbered WHERE rn <= 40 GROUP BY entity_id)"""


@query("w12_static_baseline", sql("log", f"SELECT entity_id, points, {sql_rnd('mean', 'static_mean', 4)}, {sql_rnd('std', 'static_std', 4)}, {sql_rnd('mean + 2 * std', 'static_upper', 4)}, {sql_rnd('mean - 2 * std', 'static_lower', 4)} FROM static", _STATIC))
def w12(v: Views):
    out = G.static_baseline(v.log, "session_duration")
    return out.select(KEY, "points", *[rnd(c, 4) for c in ("static_mean", "static_std", "static_upper", "static_lower")])


_PH = """ph1 AS (SELECT event_id, entity_id, "timestamp", duration_deviation AS x, avg(duration_deviation) OVER (PARTITION BY entity_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS running_mean FROM features),
ph2 AS (SELECT *, sum(x - running_mean - 0.005) OVER (PARTITION BY entity_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS cumulative_sum FROM ph1),
ph3 AS (SELECT *, cumulative_sum - min(cumulative_sum) OVER (PARTITION BY entity_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS ph FROM ph2)"""


def _page_hinkley(v):
    cols = v.plain.select("event_id", KEY, "timestamp", "duration_deviation")
    return G.page_hinkley(cols, "duration_deviation", v.segments)


@query("w13_page_hinkley", sql("features", f"SELECT event_id, {sql_rnd('running_mean', digits=4)}, {sql_rnd('cumulative_sum', digits=4)}, {sql_rnd('ph', digits=4)}, cast(ph > 0.05 AS bigint) AS drift FROM ph3", _PH))
def w13(v: Views):
    return _page_hinkley(v).select("event_id", rnd("running_mean", 4), rnd("cumulative_sum", 4), rnd("ph", 4), "drift")


@query("w14_sliding_window", sql("log", "SELECT event_id, entity_id, recency FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY \"timestamp\" DESC, event_id DESC) AS recency FROM access_log) WHERE recency <= 500"))
def w14(v: Views):
    return G.last_events(v.log, C.DRIFT_WINDOW).select("event_id", KEY, "recency")


@query("w15_latest_feed", sql("alerts", f"SELECT event_id, entity_id, {sql_time()}, severity, risk_score FROM alerts ORDER BY alerts.\"timestamp\" DESC, event_id DESC LIMIT 20"))
def w15(v: Views):
    last = v.alerts.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(20)
    return last.select("event_id", KEY, text_time(), "severity", "risk_score")


_CODES = """firsts AS (SELECT entity_id, resource_accessed, min("timestamp") AS t, arg_min(event_id, ("timestamp", event_id)) AS e FROM access_log GROUP BY entity_id, resource_accessed),
codes AS (SELECT entity_id, resource_accessed, row_number() OVER (PARTITION BY entity_id ORDER BY t, e) - 1 AS resource_code FROM firsts)"""


@query("w16_resource_codes", sql("log", "SELECT entity_id, resource_accessed, resource_code FROM codes", _CODES))
def w16(v: Views):
    return Q.resource_codes(v.log)


# --- top-k, splits, samples ---

_SURROGATE_COLS = ["hour", "is_night", "session_duration", "has_suspicious_cmd", "auth_success_int", "hour_deviation",
                   "duration_deviation", "time_gap_seconds", "geo_distance_km", "geo_velocity_kmh",
                   "cumulative_unique_resources", "cmd_count", "entity_event_count"]


def _explained(v):
    names = ["event_id", KEY, "entity_type", "timestamp", "geo_city", "resource_accessed", "auth_method", "auth_success",
             "risk_score", "severity", "predicted_label", *_SURROGATE_COLS]
    stored = v.stored_alerts(*dict.fromkeys(names))
    surrogate = X.linear_surrogate(stored, _SURROGATE_COLS, "risk_score")
    return stored, surrogate


def _desc_sql():
    num = lambda fmt, v="value": f"printf('{fmt}', {v})"
    text = {
        "geo_velocity_kmh": f"CASE WHEN value > 500 THEN 'Travel speed of ' || {num('%.0f')} || ' km/h detected (impossible travel indicator)' ELSE 'Geographic velocity: ' || {num('%.0f')} || ' km/h' END",
        "geo_distance_km": f"CASE WHEN value > 100 THEN 'Login from ' || {num('%.0f')} || ' km away from previous location' ELSE 'Geographic distance: ' || {num('%.0f')} || ' km' END",
        "hour_deviation": f"'Login hour deviates ' || {num('%.1f')} || ' standard deviations from normal pattern'",
        "duration_deviation": f"'Session duration deviates ' || {num('%.1f')} || ' standard deviations from normal'",
        "is_night": "CASE WHEN value > 0 THEN 'Nighttime access detected (unusual for this entity)' ELSE 'Daytime access (normal)' END",
        "has_suspicious_cmd": "CASE WHEN value > 0 THEN 'Suspicious command patterns detected in session' ELSE 'Normal command patterns' END",
        "auth_success_int": "CASE WHEN value = 0 THEN 'Authentication FAILED' ELSE 'Authentication succeeded' END",
        "cumulative_unique_resources": f"'Entity has accessed ' || {num('%.0f')} || ' unique resources (resource breadth check)'",
        "session_duration": f"'Session lasted ' || {num('%.0f')} || ' seconds'",
        "time_gap_seconds": f"CASE WHEN value < 60 THEN 'Only ' || {num('%.0f')} || ' seconds since previous event' ELSE {num('%.1f', 'value / 3600')} || ' hours since previous event' END",
        "cmd_count": f"{num('%.0f')} || ' commands executed in session'",
    }
    shown = "CASE feature " + " ".join(f"WHEN '{c}' THEN '{C.DISPLAY_NAMES[c]}'" for c in _SURROGATE_COLS) + " END"
    default = f"CASE WHEN attribution > 0 THEN {shown} || ' value (' || {num('%.2f')} || ') contributed to anomaly detection' ELSE {shown} || ': ' || {num('%.2f')} END"
    return "CASE feature " + " ".join(f"WHEN '{k}' THEN {t}" for k, t in text.items()) + f" ELSE {default} END", shown


_DESC, _SHOWN = _desc_sql()
_SUMMARY_SQL = "'Entity ' || entity_id || ' (' || entity_type || ') | accessed ' || resource_accessed || ' | from ' || geo_city || ' | ' || CASE WHEN auth_success THEN 'via ' || auth_method ELSE 'with FAILED ' || auth_method || ' authentication' END"
_FACTORS = ("sur AS (SELECT " + ", ".join(
    f"avg({c}) AS {c}__m, CASE WHEN var_samp({c}) > 1e-12 THEN covar_samp({c}, risk_score) / var_samp({c}) ELSE 0.0 END AS {c}__w" for c in _SURROGATE_COLS)
    + " FROM alerts), longf AS (" + " UNION ALL ".join(
    f"SELECT event_id, '{c}' AS feature, {i} AS i, cast({c} AS double) AS value, {c}__w * ({c} - {c}__m) AS attribution FROM alerts CROSS JOIN sur" for i, c in enumerate(_SURROGATE_COLS))
    + "), factors AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(abs(attribution), 6) DESC, i) AS rank FROM longf QUALIFY rank <= 3)")


@query("t1_alert_queue", sql("alerts", f"""SELECT a.event_id, a.entity_id, a.risk_score, a.severity, a.predicted_label, {_SUMMARY_SQL.replace("'Entity ' || entity_id", "'Entity ' || a.entity_id")} AS risk_summary,
  string_agg(feature, ',' ORDER BY rank) AS top_features FROM (SELECT * FROM alerts ORDER BY risk_score DESC, event_id LIMIT 50) a JOIN factors f USING (event_id) GROUP BY ALL""", _FACTORS))
def t1(v: Views):
    """Flagship: the ranked queue with the top factors and the summary line of its 50 first alerts."""
    stored, surrogate = _explained(v)
    top = Q.top_alerts(stored, 50)
    explained = X.attribute_linear(top, surrogate, _SURROGATE_COLS)
    out = X.alert_queue(explained, 50)
    names = F.from_json("explanation", "array<struct<feature: string>>")["feature"]
    return out.select("event_id", KEY, "risk_score", "severity", "predicted_label", "risk_summary", F.array_join(names, ",").alias("top_features"))


@query("t2_top_alerts", sql("alerts", "SELECT event_id, risk_score, severity FROM alerts ORDER BY risk_score DESC, event_id LIMIT 200"))
def t2(v: Views):
    return Q.top_alerts(v.alerts, 200).select("event_id", "risk_score", "severity")


@query("t3_temporal_split", sql("log", "SELECT event_id, split FROM split", _SPLIT))
def t3(v: Views):
    return Q.temporal_split(v.log).select("event_id", "split")


@query("t4_argmax_event", sql("alerts", "SELECT event_id, entity_id, risk_score FROM alerts ORDER BY risk_score DESC, event_id LIMIT 1"))
def t4(v: Views):
    return Q.argmax_event(v.alerts, "risk_score").select("event_id", KEY, "risk_score")


@query("t5_last_events", sql("log", "SELECT event_id, entity_id, recency FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY \"timestamp\" DESC, event_id DESC) AS recency FROM access_log) WHERE recency <= 20"))
def t5(v: Views):
    return G.last_events(v.log, 20).select("event_id", KEY, "recency")


def _sql_uniform(text):
    """The number of ``hash_uniform`` for a text that ends with the seed."""
    return f"(cast('0x' || substr(md5({text}), 1, 13) AS bigint) / 4503599627370496.0)"


@query("t6_uniform_sample", sql("log", f"SELECT event_id, entity_id FROM access_log ORDER BY {_sql_uniform("event_id || ':42'")}, event_id LIMIT 500"))
def t6(v: Views):
    return Q.uniform_sample(v.log.select("event_id", KEY), 500)


@query("t7_replay_prefix", sql("log", "SELECT event_id, entity_id FROM access_log ORDER BY \"timestamp\", event_id LIMIT 500"))
def t7(v: Views):
    return Q.replay_prefix(v.log, 500).select("event_id", KEY)


_JITTER = ", ".join(sql_rnd(f"{c} + ({_sql_uniform(f"severity || ':' || event_id || ':{7 + k}'")} * 2 - 1) * 0.5", c) for k, c in enumerate(("latitude", "longitude")))


@query("t8_map_jitter", sql("alerts", f"SELECT event_id, entity_id, geo_city, {_JITTER}, risk_score, severity, predicted_label FROM alerts"))
def t8(v: Views):
    moved = Q.jittered(Q.geo_points(v.alerts, with_low=True))
    return moved.withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


# --- encoders ---

_CODE3 = "entity_type_enc, auth_method_enc, resource_enc"


@query("e1_label_encode", sql("log", f"""SELECT event_id, coalesce(d.code, -1) AS resource_enc FROM split LEFT JOIN d_train d USING (resource_accessed) WHERE split.split = 'test'""",
    _SPLIT, "d_train AS (SELECT resource_accessed, row_number() OVER (ORDER BY resource_accessed) - 1 AS code FROM (SELECT DISTINCT resource_accessed FROM split WHERE split.split = 'train'))"))
def e1(v: Views):
    """Codes fitted on the train part, applied to the test part; unseen resources get -1."""
    parts = Q.temporal_split(v.log).select("event_id", "resource_accessed", "split")
    encoder = E.CategoryEncoder.fit(parts.where("split = 'train'"), ["resource_accessed"])
    return encoder.transform(parts.where("split = 'test'"), {"resource_accessed": "resource_enc"}).select("event_id", "resource_enc")


@query("e2_target_encode", sql("features", "SELECT event_id, label, label_enc FROM features"))
def e2(v: Views):
    return v.log.select("event_id", "label", E.label_code().alias("label_enc"))


_SCALED = ["hour", "session_duration", "duration_deviation", "log_time_gap", "geo_distance_km", "cumulative_unique_resources", "fingerprint_parts"]
_SPLIT_F = """rankedf AS (SELECT *, row_number() OVER (ORDER BY "timestamp", event_id) AS rn, count(*) OVER () AS total FROM features),
st AS (SELECT """ + ", ".join(f"avg({c}) AS {c}__m, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS {c}__s" for c in _SCALED) + " FROM rankedf WHERE rn <= cast(floor(total * 0.8) AS bigint))"


@query("e3_standard_scale", sql("features", "SELECT event_id, " + ", ".join(sql_rnd(f"({c} - {c}__m) / {c}__s", f"{c}_z", 4) for c in _SCALED) + " FROM rankedf CROSS JOIN st WHERE rn > cast(floor(total * 0.8) AS bigint)", _SPLIT_F))
def e3(v: Views):
    """Statistics of the train part applied to the test part."""
    parts = Q.temporal_split(materialize(v.plain.select("event_id", "timestamp", *_SCALED), "scaled"))
    stats = E.fit_scaler(parts.where("split = 'train'"), _SCALED)
    out = E.scale(parts.where("split = 'test'"), stats, _SCALED)
    return out.select("event_id", *[rnd(f"{c}_z", 4) for c in _SCALED])


@query("e4_minmax_invert", sql("scored", f"SELECT event_id, {sql_rnd('CASE WHEN max(statistical_score) OVER () > min(statistical_score) OVER () THEN 1 - (statistical_score - min(statistical_score) OVER ()) / (max(statistical_score) OVER () - min(statistical_score) OVER ()) ELSE 0.5 END', 'inverted')} FROM stat"))
def e4(v: Views):
    scored = materialize(P.with_statistical_score(v.profiled, v.profiles, v.segments).select("event_id", "statistical_score"), "stat")
    return E.minmax_inverted(scored, "statistical_score", "inverted").select("event_id", rnd("inverted"))


# --- detectors in closed form ---

@query("d1_statistical_score", sql("scored", f"SELECT event_id, entity_id, {sql_rnd('statistical_score')} FROM stat"))
def d1(v: Views):
    return P.with_statistical_score(v.profiled, v.profiles, v.segments).select("event_id", KEY, rnd("statistical_score"))


@query("d4_baseline_combined", sql("scored", f"SELECT event_id, {sql_rnd('0.3 * statistical_score + 0.4 * isolation_forest_score + 0.3 * confidence', 'baseline_combined_score')} FROM scored"))
def d4(v: Views):
    """The fixed mix, here over the closed-form parts."""
    scored = risk.closed_form_scores(v.plain, v.segments, v.log)
    mix = risk.baseline_combined(F.col("statistical_score"), F.col("isolation_forest_score"), F.col("confidence"))
    return scored.select("event_id", rnd(mix, 6, "baseline_combined_score"))


_NORM = "seqscore AS (SELECT *, greatest(least(geo_velocity_kmh / greatest(max(geo_velocity_kmh) OVER (), 2 * t), 1.0), 0.0) AS sequence_norm, t FROM features CROSS JOIN (SELECT quantile_cont(geo_velocity_kmh, 0.975) AS t FROM features WHERE label = 'normal'))"


@query("d7_sequence_normalise", sql("features", f"SELECT event_id, {sql_rnd('sequence_norm')} FROM seqscore", _NORM))
def d7(v: Views):
    """An error scaled by the larger of the batch maximum and twice the normal threshold."""
    stored = materialize(v.plain.select("event_id", "label", "geo_velocity_kmh"), "errors")
    threshold = normal_threshold(stored, "geo_velocity_kmh")
    return normalise_error(stored, "geo_velocity_kmh", threshold, "sequence_norm").select("event_id", rnd("sequence_norm"))


@query("d8_sequence_predict", sql("features", "SELECT event_id, cast(sequence_norm > t / greatest(2 * t, 1e-6) AS bigint) AS flagged FROM seqscore", _NORM))
def d8(v: Views):
    stored = materialize(v.plain.select("event_id", "label", "geo_velocity_kmh"), "errors")
    threshold = normal_threshold(stored, "geo_velocity_kmh")
    scored = normalise_error(stored, "geo_velocity_kmh", threshold, "sequence_norm")
    return sequence_predict(scored, "sequence_norm", threshold).select("event_id", "flagged")


@query("d9_percentile_flag", sql("alerts", "SELECT event_id, cast(risk_score > (SELECT quantile_cont(risk_score, 0.975) FROM alerts) AS bigint) AS flagged FROM alerts"))
def d9(v: Views):
    return V.percentile_flag(v.stored_alerts("event_id", "risk_score"), "risk_score", "flagged").select("event_id", "flagged")


@query("r1_risk_score", sql("alerts", "SELECT event_id, risk_score FROM alerts"))
def r1(v: Views):
    return v.alerts.select("event_id", "risk_score")


@query("r2_severity", sql("alerts", "SELECT event_id, severity, CASE WHEN risk_score >= 85 THEN 'Critical' WHEN risk_score >= 65 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' ELSE 'Low' END AS contiguous FROM alerts"))
def r2(v: Views):
    return v.alerts.select("event_id", "severity", S.severity(F.col("risk_score"), contiguous=True).alias("contiguous"))


# --- explanations ---

@query("x2_attribute_linear", sql("alerts", f"SELECT event_id, rank, feature, {_SHOWN} AS display_name, {sql_rnd('attribution', digits=4)}, CASE WHEN attribution > 0 THEN 'increases' ELSE 'decreases' END AS impact FROM factors", _FACTORS))
def x2(v: Views):
    stored, surrogate = _explained(v)
    out = X.explode_factors(X.attribute_linear(stored, surrogate, _SURROGATE_COLS, records=False))
    return out.select("event_id", "rank", "feature", "display_name", rnd("attribution", 4), "impact")


@query("x3_fallback_by_value", sql("features", f"""SELECT event_id, rank, feature, {sql_rnd('value', 'feature_value', 6)} FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(abs(value), 6) DESC, i) AS rank FROM (""" + " UNION ALL ".join(
    f"SELECT event_id, '{c}' AS feature, {i} AS i, cast({c} AS double) AS value FROM features" for i, c in enumerate(C.FEATURES)) + ")) WHERE rank <= 3"))
def x3(v: Views):
    out = X.explode_factors(X.attribute_by_value(v.features, C.FEATURES))
    return out.select("event_id", "rank", "feature", rnd("feature_value", 6))


@query("x4_feature_description", sql("alerts", f"SELECT event_id, rank, feature, {_DESC} AS description FROM factors", _FACTORS))
def x4(v: Views):
    stored, surrogate = _explained(v)
    out = X.explode_factors(X.attribute_linear(stored, surrogate, _SURROGATE_COLS, records=False))
    return out.select("event_id", "rank", "feature", "description")


@query("x5_risk_summary", sql("log", f"SELECT event_id, {_SUMMARY_SQL} AS risk_summary FROM access_log"))
def x5(v: Views):
    return v.log.select("event_id", X.risk_summary().alias("risk_summary"))


@query("x6_mean_attribution", sql("alerts", f"SELECT feature, {sql_rnd('avg(abs(attribution))', 'mean_abs_attribution', 4)} FROM longf GROUP BY feature ORDER BY avg(abs(attribution)) DESC LIMIT 10", _FACTORS))
def x6(v: Views):
    """Over the full attributions of the linear surrogate; no ranking per event is needed."""
    stored, surrogate = _explained(v)
    full = X.attribute_linear(stored, surrogate, _SURROGATE_COLS, top_n=len(_SURROGATE_COLS), records=False)
    return X.mean_attribution(X.explode_factors(full), 10).select("feature", rnd("mean_abs_attribution", 4))


# --- cold start ---

_COUNTS = "counts AS (SELECT entity_id, min(entity_type) AS entity_type, count(*) AS event_count FROM access_log GROUP BY entity_id)"
_INFO_SQL = """entity_id, entity_type, cast(event_count < 20 AS bigint) AS is_cold_start, event_count, 20::bigint AS min_required,
  least(100, cast(floor(event_count / 20 * 100) AS bigint)) AS progress_pct, round(1 - least(event_count / 20, 1.0), 2) AS peer_weight,
  round(least(event_count / 20, 1.0), 2) AS individual_weight, CASE WHEN event_count < 20 THEN 'Elevated' ELSE 'Standard' END AS monitoring_level, entity_type AS peer_group"""


@query("k1_cold_start_info", sql("log", f"SELECT {_INFO_SQL} FROM counts", _COUNTS))
def k1(v: Views):
    return K.cold_start_info(K.entity_counts(v.log))


@query("k2_transition_weights", sql("log", f"SELECT entity_event_count, {sql_rnd('1 - least(entity_event_count / 20, 1.0)', 'peer_weight')}, {sql_rnd('least(entity_event_count / 20, 1.0)', 'individual_weight')}, count(*) AS events FROM (SELECT row_number() OVER (PARTITION BY entity_id ORDER BY \"timestamp\", event_id) AS entity_event_count FROM access_log) WHERE entity_event_count <= 24 GROUP BY entity_event_count"))
def k2(v: Views):
    """The transition curve over the first 24 events of the entities, with the events at each point."""
    placed = v.segments.position(v.log.select("event_id", KEY, "timestamp"), "entity_event_count").where("entity_event_count <= 24")
    peer, own = K.transition(F.col("entity_event_count"))
    return placed.groupBy("entity_event_count").agg(F.count("*").alias("events")).select(
        "entity_event_count", rnd(peer, 6, "peer_weight"), rnd(own, 6, "individual_weight"), "events")


_COLD_SQL = """cold AS (SELECT f.event_id, f.entity_event_count, least((
    least(abs(f.hour - p.hour_mean) / greatest(p.hour_std, 0.1) / 3.0, 1.0) * 0.25
    + least(abs(f.session_duration - p.duration_mean) / greatest(p.duration_std, 1.0) / 3.0, 1.0) * 0.2
    + CASE WHEN p.geo_distance_p95 > 0 THEN least(f.geo_distance_km / greatest(p.geo_distance_p95, 1.0) * 1.2, 1.0) * 0.25 ELSE 0.0 END
    + CASE WHEN f.auth_success THEN 0.0 ELSE 0.2 END + CASE WHEN f.has_suspicious_cmd = 1 THEN 0.1 ELSE 0.0 END) / 0.7, 1.0) AS cold_start_score
  FROM features f JOIN peers p USING (entity_type))"""


@query("k3_cold_start_score", sql("peers", f"SELECT event_id, {sql_rnd('cold_start_score')} FROM cold", _COLD_SQL))
def k3(v: Views):
    return K.with_cold_start_score(v.plain, v.peers).select("event_id", rnd("cold_start_score"))


@query("k4_blended_score", sql("scored_peers", f"SELECT event_id, {sql_rnd('(1 - least(c.entity_event_count / 20, 1.0)) * cold_start_score + least(c.entity_event_count / 20, 1.0) * statistical_score', 'blended_score')} FROM cold c JOIN stat USING (event_id)", _COLD_SQL))
def k4(v: Views):
    scored = P.with_statistical_score(K.with_cold_start_score(v.plain, v.peers), v.stored_profiles, v.segments)
    return K.blended_score(scored).select("event_id", rnd("blended_score"))


@query("k5_history_counter", sql("log", f"SELECT entity_id, entity_type, event_count FROM counts", _COUNTS))
def k5(v: Views):
    return K.entity_counts(v.log)


# --- drift ---

# Vectors of the 28 features by position, and decayed baselines of the last rows of an entity (weights 0.95^age).
_VECTORS = f"""vec AS (SELECT event_id, entity_id, "timestamp", row_number() OVER (PARTITION BY entity_id ORDER BY "timestamp", event_id) AS pos,
  [{", ".join(f"cast({f} AS double)" for f in C.FEATURES)}] AS x FROM features)"""


def _vector_base(frame, name="base"):
    return f"""{name}_rows AS (SELECT *, list(x) OVER (PARTITION BY entity_id ORDER BY pos {frame}) AS xs FROM vec),
{name}_means AS (SELECT *, list_transform(range(1, {len(C.FEATURES) + 1}), lambda j: list_sum(list_transform(xs, lambda r, i: r[j] * pow(0.95, len(xs) - i))) / list_sum(list_transform(xs, lambda r, i: pow(0.95, len(xs) - i)))) AS mean FROM {name}_rows),
{name} AS (SELECT * EXCLUDE (xs), list_transform(range(1, {len(C.FEATURES) + 1}), lambda j: sqrt(list_sum(list_transform(xs, lambda r, i: pow(r[j] - mean[j], 2) * pow(0.95, len(xs) - i))) / list_sum(list_transform(xs, lambda r, i: pow(0.95, len(xs) - i))))) AS std FROM {name}_means)"""


def _sql_deviation(x, mean, std):
    return f"list_avg(list_transform(range(1, {len(C.FEATURES) + 1}), lambda j: abs({x}[j] - {mean}[j]) / greatest({std}[j], 1e-6)))"


@query("g1_drift_deviation", sql("features", f"SELECT event_id, {sql_rnd('ln(1 + coalesce(d, 0.0))', 'log_deviation', 4)} FROM (SELECT event_id, {_sql_deviation('x', 'mean', 'std')} AS d FROM base)",
       _VECTORS, _vector_base("ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING")))
def g1(v: Views):
    """Mean deviation of the 28 features of every event from the decayed baseline of the 20 events before it."""
    out = G.vector_baseline(v.features.select("event_id", KEY, "timestamp", *C.FEATURES), C.FEATURES, v.segments, previous=True)
    return out.select("event_id", rnd(F.log1p(F.coalesce(G.deviation(), F.lit(0.0))), 4, "log_deviation"))


# One row an entity and position: the state after the event. The baseline is that of event 20 or of the last drift event.
_WALK = f"""walk AS (
  SELECT entity_id, 20::bigint AS pos, 20::bigint AS base_pos, 0.0::double AS n, 0.0::double AS total, 0.0::double AS cum, 'infinity'::double AS low, false AS hit, 0.0::double AS d FROM vec WHERE pos = 20
  UNION ALL
  SELECT entity_id, pos, CASE WHEN c - l > 0.05 THEN pos ELSE base_pos END, CASE WHEN c - l > 0.05 THEN 0.0 ELSE n END, CASE WHEN c - l > 0.05 THEN 0.0 ELSE total END,
    CASE WHEN c - l > 0.05 THEN 0.0 ELSE c END, CASE WHEN c - l > 0.05 THEN 'infinity'::double ELSE l END, c - l > 0.05, d
  FROM (SELECT *, least(low, c) AS l FROM (SELECT entity_id, pos, base_pos, n, total, cum + d - total / n - 0.005 AS c, low, d FROM (
    SELECT w.entity_id, v.pos, w.base_pos, w.n + 1 AS n, w.total + {_sql_deviation('v.x', 'b.mean', 'b.std')} AS total, w.cum, w.low, {_sql_deviation('v.x', 'b.mean', 'b.std')} AS d
    FROM walk w JOIN vec v ON v.entity_id = w.entity_id AND v.pos = w.pos + 1 JOIN base b ON b.entity_id = w.entity_id AND b.pos = w.base_pos))))"""
_DRIFT = [_VECTORS, _vector_base("ROWS 499 PRECEDING").replace("base_rows AS (", "base_rows AS MATERIALIZED (").replace("base AS (SELECT * EXCLUDE", "base AS MATERIALIZED (SELECT * EXCLUDE"), _WALK,
          """drifts AS (SELECT v.event_id, v.entity_id, v."timestamp", w.d AS deviation FROM walk w JOIN vec v USING (entity_id, pos) WHERE w.hit)"""]


def _recursive(text):
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def _drift_log(v: Views):
    return G.drift_events(v.features.select("event_id", KEY, "timestamp", *C.FEATURES), C.FEATURES, v.segments)


@query("g2_drift_events", _recursive(sql("features", f"SELECT event_id, entity_id, {sql_time()}, {sql_rnd('ln(1 + deviation)', 'log_deviation', 4)} FROM drifts", *_DRIFT)))
def g2(v: Views):
    """Page-Hinkley with reset on the mean deviation of the 28 features, baseline set anew at every drift event."""
    return _drift_log(v).select("event_id", KEY, text_time(), rnd(F.log1p("deviation"), 4, "log_deviation"))


_LAST = """last AS (SELECT entity_id, max(pos) AS n, max("timestamp") AS last_updated FROM vec GROUP BY entity_id),
vec_last AS (SELECT v.* FROM vec v JOIN last l ON l.entity_id = v.entity_id AND v.pos > l.n - 500)"""


@query("g3_adaptive_threshold", sql("features", f"SELECT entity_id, least(n, 500) AS n_events, {sql_time('last_updated', 'last_updated')}, {sql_rnd('list_avg(mean)', 'baseline_mean', 4)}, {sql_rnd('list_avg(std)', 'baseline_std', 4)}, {sql_rnd('CASE WHEN list_avg(std) > 1.0 THEN 0.5 * (1 + list_avg(std) * 0.1) ELSE 0.5 END', 'threshold', 4)} FROM base JOIN last USING (entity_id) WHERE pos = n",
       _VECTORS, _LAST, _vector_base("ROWS 499 PRECEDING").replace("FROM vec)", "FROM vec_last)")))
def g3(v: Views):
    """Current decayed baseline vectors (last 500 events) of each entity, as means over the features, and its widened threshold."""
    base = G.entity_baselines(v.features, C.FEATURES)
    return base.select(KEY, "n_events", text_time("last_updated"), rnd(G.vector_mean(F.col("baseline_mean")), 4, "baseline_mean"),
                       rnd(G.vector_mean(F.col("baseline_std")), 4, "baseline_std"),
                       rnd(G.adaptive_threshold(F.lit(0.5), F.col("baseline_std")), 4, "threshold"))


@query("g4_drift_summary", _recursive(sql("features", "SELECT count(*) AS total_drift_events, count(DISTINCT entity_id) AS entities_with_drift, (SELECT string_agg(cast(event_id AS varchar), ',' ORDER BY \"timestamp\" DESC, event_id DESC) FROM (SELECT * FROM drifts ORDER BY \"timestamp\" DESC, event_id DESC LIMIT 10)) AS recent_event_ids FROM drifts", *_DRIFT)))
def g4(v: Views):
    """Summary of the log of drift events with reset."""
    return G.drift_summary(materialize(_drift_log(v), "drift-log"))


@query("g5_baseline_comparison", sql("log", f"""SELECT CASE WHEN position <= 40 THEN '1 stable' WHEN position <= 70 THEN '2 shift' ELSE '3 new normal' END AS phase, count(*) AS points,
  count(*) FILTER (x < s.mean - 2 * s.std - 1e-9 OR x > s.mean + 2 * s.std + 1e-9) AS static_outside, count(*) FILTER (x < a.mean - 2 * a.std - 1e-9 OR x > a.mean + 2 * a.std + 1e-9) AS adaptive_outside
  FROM adaptive a JOIN static s USING (entity_id) GROUP BY 1""", _adaptive("ROWS 19 PRECEDING"), _STATIC))
def g5(v: Views):
    return G.compare_baselines(v.log, "session_duration", v.segments)


@query("g6_drift_phases", sql("peers", f"""SELECT entity_type, phase, shift_magnitude, 30::bigint AS duration_days, {sql_rnd('duration_mean + shift_magnitude * duration_std', 'shifted_duration_mean', 4)},
  'Behavioural baseline shifts by ' || printf('%.1f', shift_magnitude) || 'σ over 30 days' AS description FROM peers
  CROSS JOIN (VALUES ('Phase 1: Stable', 0.0::double), ('Phase 2: Gradual Shift', 0.3), ('Phase 3: New Normal', 0.6)) ph(phase, shift_magnitude)"""))
def g6(v: Views):
    return G.drift_phases(v.peers).select("entity_type", "phase", "shift_magnitude", "duration_days", rnd("shifted_duration_mean", 4), "description")


# --- attack patterns ---

@query("q1_brute_force", sql("log", """SELECT entity_id, source_ip, epoch_second, fails, fails_in_span FROM (SELECT *, cast(sum(fails) OVER (PARTITION BY entity_id, source_ip ORDER BY epoch_second RANGE 300 PRECEDING) AS bigint) AS fails_in_span
  FROM (SELECT entity_id, source_ip, cast(floor(epoch("timestamp")) AS bigint) AS epoch_second, count(*) AS fails FROM access_log WHERE NOT auth_success GROUP BY ALL)) WHERE fails_in_span >= 10"""))
def q1(v: Views):
    return PT.brute_force(v.log)


@query("q2_impossible_travel", sql("features", f"SELECT event_id, entity_id, {sql_time()}, geo_city, {sql_rnd('time_gap_seconds')}, {sql_rnd('geo_distance_km', digits=4)} FROM features WHERE geo_distance_km > 500 AND time_gap_seconds <= 2700"))
def q2(v: Views):
    return PT.impossible_travel(v.plain).select("event_id", KEY, text_time(), "geo_city", rnd("time_gap_seconds"), rnd("geo_distance_km", 4))


@query("q2_impossible_speed", sql("features", f"SELECT event_id, entity_id, geo_city, {sql_rnd('geo_distance_km', digits=4)} FROM features WHERE geo_velocity_kmh > 500"))
def q2b(v: Views):
    return PT.impossible_speed(v.plain).select("event_id", KEY, "geo_city", rnd("geo_distance_km", 4))


@query("q3_credential_stuffing", sql("log", f"""SELECT source_ip, window_start, count(*) AS entities, cast(sum(n) AS bigint) AS attempts, cast(sum(f) AS bigint) AS fails, {sql_rnd('sum(f) / sum(n)', 'fail_rate')}
  FROM (SELECT source_ip, cast(floor(epoch("timestamp")) AS bigint) // 1800 * 1800 AS window_start, entity_id, count(*) AS n, count(*) FILTER (NOT auth_success) AS f FROM access_log GROUP BY ALL)
  GROUP BY source_ip, window_start HAVING count(*) >= 15 AND sum(f) / sum(n) >= 0.7"""))
def q3(v: Views):
    return PT.credential_stuffing(v.log).select("source_ip", "window_start", "entities", "attempts", "fails", rnd("fail_rate"))


@query("q4_lateral_movement", sql("profiles", """SELECT f.entity_id, cast(floor(epoch("timestamp")) AS bigint) // 3600 * 3600 AS hour_start, count(DISTINCT resource_accessed) AS unusual_resources, count(*) AS accesses
  FROM features f LEFT JOIN profiles p USING (entity_id) WHERE p.entity_id IS NULL OR NOT list_contains(p.typical_resources, f.resource_accessed)
  GROUP BY 1, 2 HAVING count(DISTINCT resource_accessed) >= 5 AND max(has_suspicious_cmd) = 1"""))
def q4(v: Views):
    return PT.lateral_movement(v.log)


@query("q5_device_spoofing", sql("log", """SELECT event_id, l.entity_id, device_fingerprint, usual_fingerprint FROM access_log l JOIN (SELECT entity_id, device_fingerprint AS usual_fingerprint FROM (
  SELECT entity_id, device_fingerprint, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, device_fingerprint) AS rank FROM access_log WHERE label = 'normal' GROUP BY entity_id, device_fingerprint) WHERE rank = 1) u USING (entity_id)
  WHERE split_part(device_fingerprint, '|', 1) <> split_part(usual_fingerprint, '|', 1) OR split_part(device_fingerprint, '|', 2) <> split_part(usual_fingerprint, '|', 2)"""))
def q5(v: Views):
    return PT.device_spoofing(v.log, v.segments)


@query("q6_low_and_slow", sql("log", """SELECT w0.entity_id, w0.week, w0.accesses, coalesce(w1.accesses, 0) AS one_week_before, coalesce(w2.accesses, 0) AS two_weeks_before,
  cast(w0.accesses > coalesce(w1.accesses, 0) AND coalesce(w1.accesses, 0) > coalesce(w2.accesses, 0) AND coalesce(w2.accesses, 0) > 0 AS bigint) AS growing
  FROM weekly w0 LEFT JOIN weekly w1 ON w1.entity_id = w0.entity_id AND w1.week = w0.week - 1 LEFT JOIN weekly w2 ON w2.entity_id = w0.entity_id AND w2.week = w0.week - 2 WHERE w0.accesses >= 2""",
  """weekly AS (SELECT entity_id, cast(floor(epoch("timestamp")) AS bigint) // 604800 AS week, count(*) AS accesses FROM access_log WHERE extract(hour FROM "timestamp") BETWEEN 2 AND 5 AND resource_accessed LIKE '/sensitive/%' GROUP BY 1, 2)"""))
def q6(v: Views):
    return PT.low_and_slow(v.log)


@query("q7_insider_drift", sql("log", """SELECT entity_id, week, new_resources, active_weeks FROM (SELECT *, count(*) OVER (PARTITION BY entity_id ORDER BY week RANGE 3 PRECEDING) AS active_weeks FROM weekly) WHERE active_weeks >= 3""",
  """fs AS (SELECT entity_id, resource_accessed, min(cast(floor(epoch("timestamp")) AS bigint)) AS first_at FROM access_log GROUP BY 1, 2),
nw AS (SELECT *, (first_at - min(first_at) OVER (PARTITION BY entity_id)) // 604800 AS week FROM fs), weekly AS (SELECT entity_id, week, count(*) AS new_resources FROM nw WHERE week >= 1 GROUP BY 1, 2)"""))
def q7(v: Views):
    return PT.insider_drift(v.log)


# --- evaluation ---

def _flags(v, *extra):
    stored = v.stored_alerts("event_id", "label", "predicted_label", "risk_score", *extra)
    return stored.withColumns({"y_true": (F.col("label") != "normal").cast("long"), "y_pred": (F.col("predicted_label") != "normal").cast("long")})


_BIN = """(tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, fp / greatest(fp + tn, 1) AS false_positive_rate"""


@query("v1_binary_metrics", sql("alerts", ("SELECT " + ", ".join(sql_rnd(c) for c in ("accuracy", "precision", "recall", "f1")) + f" FROM (SELECT {_BIN} FROM counts)"), _FLAGGED))
def v1(v: Views):
    m = V.binary_metrics(V.confusion_counts(_flags(v)))
    return m.select(*[rnd(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("v2_confusion_counts", sql("alerts", f"SELECT tp, fp, fn, tn, {sql_rnd('fp / greatest(fp + tn, 1)', 'false_positive_rate')} FROM counts", _FLAGGED))
def v2(v: Views):
    return V.binary_metrics(V.confusion_counts(_flags(v))).select("tp", "fp", "fn", "tn", rnd("false_positive_rate"))


_AUC = """sg AS (SELECT risk_score AS s, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM flagged GROUP BY 1),
auc AS (SELECT CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)) END AS auc_roc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM sg))"""


@query("v3_auc_roc", sql("alerts", f"SELECT {sql_rnd('auc_roc')} FROM auc", _FLAGGED, _AUC))
def v3(v: Views):
    return V.auc_roc(_flags(v), "risk_score").select(rnd("auc_roc"))


@query("v4_roc_curve", sql("alerts", f"SELECT s AS threshold, {sql_rnd('sum(neg) OVER (ORDER BY s DESC) / sum(neg) OVER ()', 'fpr')}, {sql_rnd('sum(pos) OVER (ORDER BY s DESC) / sum(pos) OVER ()', 'tpr')} FROM sg", _FLAGGED, _AUC))
def v4(v: Views):
    return V.roc_curve(_flags(v), "risk_score").select("threshold", rnd("fpr"), rnd("tpr"))


@query("v5_precision_at_k", sql("alerts", f"""SELECT p AS fraction, k, {sql_rnd('avg(y_true)', 'precision')} FROM (SELECT *, row_number() OVER (ORDER BY risk_score DESC, event_id) AS rn, count(*) OVER () AS n FROM flagged) x
  JOIN (SELECT unnest([0.005::double, 0.01, 0.02, 0.05, 0.1]) AS p) ps ON true CROSS JOIN LATERAL (SELECT greatest(1, cast(floor(x.n * ps.p) AS bigint)) AS k) WHERE rn <= k GROUP BY p, k""", _FLAGGED))
def v5(v: Views):
    out = V.precision_at(_flags(v).select("event_id", "risk_score", "y_true"), "risk_score", [0.005, 0.01, 0.02, 0.05, 0.1])
    return out.select("fraction", "k", rnd("precision"))


_PER_CLASS = """pc AS (SELECT l.label, count(*) FILTER (a.label = l.label AND predicted_label = l.label) AS hit, count(*) FILTER (a.label = l.label) AS support, count(*) FILTER (predicted_label = l.label) AS predicted
  FROM (SELECT label FROM alerts UNION SELECT predicted_label FROM alerts) l CROSS JOIN alerts a GROUP BY l.label),
prf AS (SELECT label, CASE WHEN predicted = 0 THEN 0.0 ELSE hit / predicted END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE hit / support END AS recall,
  CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * hit / (predicted + support) END AS f1, support, hit FROM pc),
report AS (SELECT label, precision, recall, f1, support FROM prf
  UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), cast(sum(support) AS bigint) FROM prf
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) AS bigint) FROM prf
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), cast(sum(support) AS bigint) FROM prf)"""


@query("v6_classification_report", sql("alerts", f"SELECT label, {sql_rnd('precision')}, {sql_rnd('recall')}, {sql_rnd('f1')}, support FROM report", _PER_CLASS))
def v6(v: Views):
    return V.classification_report(_flags(v)).select("label", rnd("precision"), rnd("recall"), rnd("f1"), "support")


@query("v7_confusion_matrix", sql("alerts", f"SELECT x.l AS actual, y.l AS predicted, count(a.event_id) AS n FROM (SELECT unnest({C.LABELS!r}) AS l) x CROSS JOIN (SELECT unnest({C.LABELS!r}) AS l) y LEFT JOIN alerts a ON a.label = x.l AND a.predicted_label = y.l GROUP BY 1, 2"))
def v7(v: Views):
    return V.confusion_matrix(v.alerts, C.LABELS)


@query("v8_attack_recall", sql("alerts", f"SELECT label, {sql_rnd('avg(cast(predicted_label = label AS integer))', 'exact_recall')}, {sql_rnd('''avg(cast(predicted_label <> 'normal' AS integer))''', 'binary_recall')}, count(*) AS events FROM alerts WHERE label <> 'normal' GROUP BY label"))
def v8(v: Views):
    return V.attack_recall(v.alerts).select("label", rnd("exact_recall"), rnd("binary_recall"), "events")


_MODELS = """preds AS (SELECT event_id, y_true, 'statistical' AS model, cast(statistical_score > (SELECT quantile_cont(statistical_score, 0.975) FROM flagged) AS bigint) AS y_pred FROM flagged
  UNION ALL SELECT event_id, y_true, 'speed', cast(geo_velocity_kmh > 500 AS bigint) FROM flagged
  UNION ALL SELECT event_id, y_true, 'risk', cast(risk_score > 40 AS bigint) FROM flagged
  UNION ALL SELECT event_id, y_true, 'rules', y_pred FROM flagged),
cc AS (SELECT model, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn FROM preds GROUP BY model),
comparison AS (SELECT model, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, round(accuracy, 4) AS accuracy FROM (SELECT model, """ + _BIN + " FROM cc))"


def _comparison(v):
    stored = _flags(v, "statistical_score", "geo_velocity_kmh")
    stored = stored.withColumn("statistical_score", F.round("statistical_score", 9))
    flagged = V.percentile_flag(stored, "statistical_score", "by_stat").withColumns({
        "by_speed": (F.col("geo_velocity_kmh") > 500).cast("long"), "by_risk": (F.col("risk_score") > C.ANOMALY_RISK).cast("long")})
    return V.model_comparison(V.long_predictions(flagged, {
        "statistical": "by_stat", "speed": "by_speed", "risk": "by_risk", "rules": "y_pred"}))


_FLAGGED9 = _FLAGGED.replace("SELECT *, cast(label", "SELECT * REPLACE (round(statistical_score, 9) AS statistical_score), cast(label", 1)


@query("v9_model_comparison", sql("alerts", "SELECT * FROM comparison", _FLAGGED9, _MODELS))
def v9(v: Views):
    return _comparison(v)


@query("v9_best_model", sql("alerts", "SELECT model, f1 FROM comparison ORDER BY f1 DESC, model LIMIT 1", _FLAGGED9, _MODELS))
def v9b(v: Views):
    return V.best_model(_comparison(v))


_EVAL = """evaluation AS (SELECT round(accuracy, 4) AS binary_accuracy, round(precision, 4) AS binary_precision, round(recall, 4) AS binary_recall, round(f1, 4) AS binary_f1,
  (SELECT round(auc_roc, 4) FROM auc) AS auc_roc, (SELECT round(f1, 4) FROM report WHERE label = 'macro avg') AS f1_macro, (SELECT round(f1, 4) FROM report WHERE label = 'weighted avg') AS f1_weighted,
  round(false_positive_rate, 4) AS false_positive_rate, tp + fp + fn + tn AS total_events, tp + fn AS total_anomalies, round((tp + fn) / (tp + fp + fn + tn), 4) AS anomaly_rate FROM (SELECT *, """ + _BIN + " FROM counts))"


@query("v10_evaluation_summary", sql("alerts", "SELECT * FROM evaluation", _FLAGGED, _AUC, _PER_CLASS, _EVAL))
def v10(v: Views):
    return V.evaluation_summary(v.stored_alerts("event_id", "label", "predicted_label", "risk_score"))


@query("s5_write_metrics", sql("alerts", "SELECT * FROM evaluation", _FLAGGED, _AUC, _PER_CLASS, _EVAL))
def s5(v: Views):
    """The eleven fields of an evaluation, written as JSON and read back."""
    summary = V.evaluation_summary(v.stored_alerts("event_id", "label", "predicted_label", "risk_score"))
    path = scratch_path(v.spark, "metrics-json")
    L.write_json_records(summary, path)
    return L.read_json_records(v.spark, path, summary.schema)


# --- reports ---

@query("b1_entity_timeline", sql("alerts", f"SELECT event_id, a.entity_id, {sql_time()}, risk_score, session_duration, resource_code, cast(risk_score > 40 AS bigint) AS is_anomaly FROM alerts a JOIN codes c ON c.entity_id = a.entity_id AND c.resource_accessed = a.resource_accessed WHERE a.entity_id = 'USR_0001'", _CODES))
def b1(v: Views):
    stored = v.stored_alerts("event_id", KEY, "timestamp", "risk_score", "session_duration", "resource_accessed")
    return Q.entity_timeline(stored, "USR_0001").withColumn("timestamp", text_time())


@query("b2_geo_points", sql("alerts", "SELECT event_id, entity_id, geo_city, latitude, longitude, risk_score, severity, predicted_label FROM alerts WHERE severity IN ('Critical', 'High', 'Medium')"))
def b2(v: Views):
    return Q.geo_points(v.alerts)


@query("b3_cold_start_panel", sql("log", f"SELECT {_INFO_SQL} FROM coldest", _COLDEST))
def b3(v: Views):
    return K.cold_start_info(K.coldest_entities(K.entity_counts(v.log)))


@query("b4_report_severity", sql("alerts", "SELECT t.severity, count(a.event_id) AS n, cast(round(100 * count(a.event_id) / (SELECT greatest(count(*), 1) FROM alerts), 1) AS varchar) || '%' AS pct FROM (VALUES ('Critical'), ('High'), ('Medium'), ('Low')) t(severity) LEFT JOIN alerts a USING (severity) GROUP BY 1"))
def b4(v: Views):
    return R.report_severity(v.stored_alerts("event_id", "severity"))


@query("b4_report_summary", sql("alerts", "SELECT printf('%d access events: %d critical, %d high, %d medium and %d low alerts', count(*), count(*) FILTER (severity = 'Critical'), count(*) FILTER (severity = 'High'), count(*) FILTER (severity = 'Medium'), count(*) FILTER (severity = 'Low')) AS summary FROM alerts"))
def b4s(v: Views):
    return R.report_summary(v.alerts)


@query("b4_report_top_alerts", sql("alerts", "SELECT event_id, entity_id[1:12] AS entity, round(risk_score, 1) AS score, severity, predicted_label[1:18] AS \"type\", geo_city[1:15] AS city, resource_accessed[1:25] AS resource, strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') AS at FROM alerts ORDER BY risk_score DESC, event_id LIMIT 15"))
def b4t(v: Views):
    return R.report_top_alerts(v.alerts)


@query("b4_report_types", sql("alerts", "SELECT predicted_label, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM alerts WHERE predicted_label <> 'normal' GROUP BY predicted_label"))
def b4y(v: Views):
    return R.report_types(v.alerts)


_METRIC_NAMES = ["binary_accuracy", "binary_precision", "binary_recall", "binary_f1", "auc_roc", "f1_macro", "f1_weighted", "false_positive_rate", "total_events", "total_anomalies", "anomaly_rate"]


@query("b4_report_metrics", sql("alerts", " UNION ALL ".join(f"SELECT '{n.replace('_', ' ').title()}' AS metric, cast({n} AS double) AS value FROM evaluation" for n in _METRIC_NAMES), _FLAGGED, _AUC, _PER_CLASS, _EVAL))
def b4m(v: Views):
    return R.report_metrics(V.evaluation_summary(v.stored_alerts("event_id", "label", "predicted_label", "risk_score")))


@query("b6_alert_view", sql("alerts", "SELECT " + ", ".join(c if c != "timestamp" else sql_time() for c in Q.ALERT_VIEW) + " FROM (SELECT * FROM alerts WHERE severity IN ('High', 'Medium', 'Low') AND predicted_label <> 'normal' ORDER BY risk_score DESC, event_id LIMIT 100)"))
def b6(v: Views):
    out = Q.alert_view(v.alerts, ["High", "Medium", "Low"], C.ATTACKS, 100)
    return out.select(*[c if c != "timestamp" else text_time() for c in Q.ALERT_VIEW])
