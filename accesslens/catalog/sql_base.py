"""Shared SQL blocks (DuckDB dialect) that the SQL twins of the registered queries start from."""

from accesslens import constants as C

_cities = ", ".join(f"'{c}'" for c, _, _ in C.CITIES)
_points = ", ".join(f"'{lat:.4f},{lon:.4f}'" for _, lat, lon in C.CITIES)

ACCESS_LOG = f"""
ev AS (
  SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM events
), ev2 AS (
  SELECT *, (k >= 90 AND event_id % 3 = 0) AS inj FROM ev
), ev3 AS (
  SELECT *, CASE WHEN NOT inj THEN 'normal' WHEN k IN (90, 91) THEN 'lateral_movement'
    WHEN k = 92 THEN 'brute_force' WHEN k = 93 THEN 'device_spoofing' WHEN k = 94 THEN 'low_and_slow'
    WHEN k IN (95, 96) THEN 'impossible_travel' WHEN k = 97 THEN 'credential_stuffing'
    WHEN k = 98 THEN 'insider_drift' ELSE 'normal' END AS label FROM ev2
), ev4 AS (
  SELECT *, unnest(range(0, CASE label WHEN 'brute_force' THEN 12 WHEN 'impossible_travel' THEN 2
    WHEN 'credential_stuffing' THEN CASE WHEN event_id % 9 = 0 THEN 24 ELSE 1 END
    WHEN 'lateral_movement' THEN 6 WHEN 'low_and_slow' THEN 12 WHEN 'insider_drift' THEN 4 ELSE 1 END)) AS i FROM ev3
), access_log AS (
  SELECT event_id * 32 + i AS event_id,
    CASE WHEN label = 'credential_stuffing' THEN 'USR_' || cast(9000 + i AS varchar)
      WHEN user_id % 20 < 12 THEN 'USR_' || lpad(cast(user_id AS varchar), 4, '0')
      WHEN user_id % 20 < 17 THEN 'SVC_' || lpad(cast(user_id AS varchar), 4, '0')
      ELSE 'DEV_' || lpad(cast(user_id AS varchar), 4, '0') END AS entity_id,
    CASE WHEN label = 'credential_stuffing' OR user_id % 20 < 12 THEN 'user'
      WHEN user_id % 20 < 17 THEN 'service_account' ELSE 'edge_device' END AS entity_type,
    CASE label WHEN 'brute_force' THEN ts + to_seconds(20 * i)
      WHEN 'impossible_travel' THEN ts + to_minutes(30 * i)
      WHEN 'credential_stuffing' THEN ts + to_seconds(60 * i)
      WHEN 'lateral_movement' THEN ts + to_minutes(5 * i)
      WHEN 'insider_drift' THEN ts + to_hours(168 * i)
      WHEN 'low_and_slow' THEN cast(cast(ts AS date) AS timestamp)
        + to_hours(24 * (CASE WHEN i < 2 THEN i WHEN i < 6 THEN 5 + i ELSE 8 + i END)) + to_minutes(120 + 7 * i)
      ELSE ts END AS "timestamp",
    CASE WHEN inj AND k = 97 THEN '203.0.113.' || cast(event_id % 3 AS varchar)
      ELSE '10.0.' || cast(user_id % 200 AS varchar) || '.7' END AS source_ip,
    list_extract([{_points}], cast(CASE WHEN label = 'impossible_travel' THEN CASE WHEN i = 0 THEN 0 ELSE 2 END
      ELSE user_id % 15 END AS integer) + 1) AS geo_location,
    list_extract([{_cities}], cast(CASE WHEN label = 'impossible_travel' THEN CASE WHEN i = 0 THEN 0 ELSE 2 END
      ELSE user_id % 15 END AS integer) + 1) AS geo_city,
    CASE WHEN label = 'lateral_movement' THEN '/res/' || cast(20 + i AS varchar)
      WHEN label = 'low_and_slow' THEN '/sensitive/' || cast(i % 4 AS varchar)
      WHEN label = 'insider_drift' THEN '/res/' || cast(30 + i AS varchar)
      WHEN inj AND k IN (92, 97) THEN '/auth/login'
      ELSE '/res/' || cast((user_id + k % 5) % 12 AS varchar) END AS resource_accessed,
    CASE WHEN inj AND k IN (92, 97) THEN 'password'
      WHEN k % 20 < 17 THEN list_extract(['password', 'token', 'certificate', 'biometric'], cast(user_id % 4 AS integer) + 1)
      ELSE 'token' END AS auth_method,
    cast(floor(value * 10) AS bigint) AS session_duration,
    CASE WHEN inj AND k IN (90, 91) THEN '["login", "escalate_privileges", "dump_credentials", "exfiltrate_data"]'
      WHEN k % 3 = 0 THEN '["login", "read_file", "logout"]'
      WHEN k % 3 = 1 THEN '["login", "search", "read_file", "download", "logout"]'
      ELSE '["handshake", "send_telemetry", "ack"]' END AS command_sequence,
    CASE WHEN inj AND k = 93 THEN 'Unknown|aa:bb:cc:00:00:' || cast(k AS varchar) || '|HTTPS'
      ELSE 'os' || cast(user_id % 6 AS varchar) || '|02:00:00:00:00:' || cast(user_id AS varchar) || '|HTTPS' END
      AS device_fingerprint,
    CASE label WHEN 'brute_force' THEN false WHEN 'credential_stuffing' THEN i % 7 = 3
      ELSE NOT (event_type = 'error' AND (inj OR k % 10 = 0)) END AS auth_success,
    label
  FROM ev4
)"""

_suspicious = " OR ".join(f"lower(command_sequence) LIKE '%{t.replace('_', chr(92) + '_')}%' ESCAPE '{chr(92)}'"
                          for t in C.SUSPICIOUS_TERMS)

FEATURES = f"""
f1 AS (
  SELECT *, cast(extract(hour FROM "timestamp") AS bigint) AS hour,
    cast(isodow("timestamp") - 1 AS bigint) AS day_of_week,
    cast(extract(day FROM "timestamp") AS bigint) AS day_of_month,
    cast(extract(hour FROM "timestamp") * 60 + extract(minute FROM "timestamp") AS bigint) AS minute_of_day,
    coalesce(try_cast(split_part(geo_location, ',', 1) AS double), 0.0) AS latitude,
    coalesce(try_cast(split_part(geo_location, ',', 2) AS double), 0.0) AS longitude,
    cast(json_array_length(command_sequence) AS bigint) AS cmd_count,
    cast(({_suspicious}) AS bigint) AS has_suspicious_cmd,
    cast(len(string_split(device_fingerprint, '|')) AS bigint) AS fingerprint_parts,
    cast(auth_success AS bigint) AS auth_success_int,
    ln(1 + greatest(session_duration, 0)) AS log_session_duration
  FROM access_log
), f2 AS (
  SELECT *, cast(day_of_week >= 5 AS bigint) AS is_weekend, cast(hour >= 22 OR hour <= 5 AS bigint) AS is_night,
    sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
    sin(2 * pi() * day_of_week / 7) AS dow_sin, cos(2 * pi() * day_of_week / 7) AS dow_cos,
    abs(hour - avg(hour) OVER e) / greatest(coalesce(stddev_samp(hour) OVER e, 1.0), 0.1) AS hour_deviation,
    abs(session_duration - avg(session_duration) OVER e)
      / greatest(coalesce(stddev_samp(session_duration) OVER e, 1.0), 0.1) AS duration_deviation,
    greatest(coalesce((epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER o) / 1e6, 0.0), 0.0) AS time_gap_seconds,
    lag(latitude) OVER o AS prev_latitude, lag(longitude) OVER o AS prev_longitude,
    row_number() OVER o AS entity_event_count,
    CASE WHEN row_number() OVER (PARTITION BY entity_id, resource_accessed ORDER BY "timestamp", event_id) = 1
      THEN 1 ELSE 0 END AS fresh
  FROM f1
  WINDOW e AS (PARTITION BY entity_id), o AS (PARTITION BY entity_id ORDER BY "timestamp", event_id)
), f3 AS (
  SELECT *, pow(sin(radians(latitude - prev_latitude) / 2), 2)
      + cos(radians(prev_latitude)) * cos(radians(latitude)) * pow(sin(radians(longitude - prev_longitude) / 2), 2) AS hav
  FROM f2
), f4 AS (
  SELECT *, ln(1 + time_gap_seconds) AS log_time_gap,
    coalesce(12742.0 * atan2(sqrt(hav), sqrt(greatest(1 - hav, 0.0))), 0.0) AS geo_distance_km,
    cast(sum(fresh) OVER (PARTITION BY entity_id ORDER BY "timestamp", event_id) AS bigint) AS cumulative_unique_resources
  FROM f3
), d_type AS (SELECT entity_type, row_number() OVER (ORDER BY entity_type) - 1 AS code FROM (SELECT DISTINCT entity_type FROM access_log)),
d_auth AS (SELECT auth_method, row_number() OVER (ORDER BY auth_method) - 1 AS code FROM (SELECT DISTINCT auth_method FROM access_log)),
d_res AS (SELECT resource_accessed, row_number() OVER (ORDER BY resource_accessed) - 1 AS code FROM (SELECT DISTINCT resource_accessed FROM access_log)),
features AS (
  SELECT f4.*, CASE WHEN time_gap_seconds > 0 THEN geo_distance_km / (time_gap_seconds / 3600) ELSE 0.0 END AS geo_velocity_kmh,
    d_type.code AS entity_type_enc, d_auth.code AS auth_method_enc, d_res.code AS resource_enc,
    cast(list_position(list_sort({C.LABELS!r}), label) - 1 AS bigint) AS label_enc
  FROM f4 JOIN d_type USING (entity_type) JOIN d_auth USING (auth_method) JOIN d_res USING (resource_accessed)
)"""

PROFILES = """
rc AS (
  SELECT entity_id, resource_accessed, count(*) AS n,
    row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, resource_accessed) AS rank,
    count(*) OVER (PARTITION BY entity_id) AS unique_resources
  FROM features WHERE label = 'normal' GROUP BY entity_id, resource_accessed
), typical AS (
  SELECT entity_id, any_value(unique_resources) AS unique_resources,
    list(resource_accessed ORDER BY rank) FILTER (rank <= 10) AS typical_resources FROM rc GROUP BY entity_id
), am AS (
  SELECT entity_id, auth_method, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, auth_method) AS rank
  FROM features WHERE label = 'normal' GROUP BY entity_id, auth_method
), profiles AS (
  SELECT g.*, unique_resources, typical_resources, am.auth_method AS primary_auth FROM (
    SELECT entity_id, min(entity_type) AS entity_type, count(*) AS event_count,
      avg(hour) AS hour_mean, greatest(coalesce(stddev_samp(hour), 0.1), 0.1) AS hour_std,
      avg(session_duration) AS duration_mean, greatest(coalesce(stddev_samp(session_duration), 1.0), 1.0) AS duration_std,
      quantile_cont(session_duration, 0.95) AS duration_p95,
      avg(geo_distance_km) AS geo_distance_mean, quantile_cont(geo_distance_km, 0.95) AS geo_distance_p95,
      avg(cast(auth_success AS integer)) AS auth_success_rate
    FROM features WHERE label = 'normal' GROUP BY entity_id) g
  JOIN typical USING (entity_id) JOIN am ON am.entity_id = g.entity_id AND am.rank = 1
)"""

PEERS = """
peers AS (
  SELECT entity_type, count(*) AS count, avg(hour_mean) AS hour_mean, avg(hour_std) * 1.5 AS hour_std,
    avg(duration_mean) AS duration_mean, avg(duration_std) * 1.5 AS duration_std,
    quantile_cont(duration_p95, 0.75) AS duration_p95, avg(geo_distance_mean) AS geo_distance_mean,
    quantile_cont(geo_distance_p95, 0.9) AS geo_distance_p95, avg(unique_resources) AS unique_resources_mean,
    avg(auth_success_rate) AS auth_success_rate
  FROM profiles GROUP BY entity_type
)"""

SCORED = """
history AS (
  SELECT entity_id, count(*) AS total_events, count(*) FILTER (label <> 'normal') AS anomaly_events,
    CASE WHEN count(*) FILTER (label <> 'normal') > 0 THEN least(
      0.5 * count(*) FILTER (label <> 'normal') / count(*)
      + 0.5 * ((1 - pow(0.9, count(*) FILTER (label <> 'normal'))) / 0.1) / count(*), 1.0) ELSE 0.0 END AS entity_risk
  FROM access_log GROUP BY entity_id
), stat AS (
  SELECT f.*, coalesce(h.entity_risk, 0.0) AS entity_risk,
    CASE WHEN p.entity_id IS NULL THEN 0.5 ELSE least(
      least(abs(f.hour - p.hour_mean) / greatest(p.hour_std, 0.1) / 4.0, 1.0) * 0.2
      + least(abs(f.session_duration - p.duration_mean) / greatest(p.duration_std, 1.0) / 4.0, 1.0) * 0.15
      + CASE WHEN p.geo_distance_p95 > 0 THEN least(f.geo_distance_km / greatest(p.geo_distance_p95, 1.0), 1.0) * 0.25 ELSE 0.0 END
      + CASE WHEN list_contains(p.typical_resources, f.resource_accessed) THEN 0.0 ELSE 0.2 END
      + CASE WHEN f.auth_method <> p.primary_auth THEN 0.1 ELSE 0.0 END
      + CASE WHEN f.auth_success THEN 0.0 ELSE 0.1 END, 1.0) END AS statistical_score
  FROM features f LEFT JOIN profiles p USING (entity_id) LEFT JOIN history h USING (entity_id)
), scored AS (
  SELECT *, CASE WHEN max(geo_velocity_kmh) OVER () > min(geo_velocity_kmh) OVER ()
      THEN (geo_velocity_kmh - min(geo_velocity_kmh) OVER ()) / (max(geo_velocity_kmh) OVER () - min(geo_velocity_kmh) OVER ())
      ELSE 0.5 END AS isolation_forest_score,
    statistical_score AS sequence_score, cast(has_suspicious_cmd AS double) AS confidence
  FROM stat
)"""

ALERTS = """
risked AS (
  SELECT *, round(least(greatest(100 * (0.35 * isolation_forest_score + 0.35 * sequence_score
      + 0.20 * confidence + 0.10 * entity_risk), 0.0), 100.0), 6) AS risk_score FROM scored
), alerts AS (
  SELECT *, CASE WHEN risk_score > 100 THEN 'Critical' WHEN risk_score BETWEEN 85 AND 100 THEN 'Critical'
      WHEN risk_score BETWEEN 65 AND 84 THEN 'High' WHEN risk_score BETWEEN 40 AND 64 THEN 'Medium'
      WHEN risk_score BETWEEN 20 AND 39 THEN 'Low' ELSE 'Low' END AS severity,
    CASE WHEN has_suspicious_cmd = 1 THEN 'lateral_movement'
      WHEN geo_velocity_kmh > 500 AND geo_distance_km > 500 THEN 'impossible_travel'
      WHEN NOT auth_success AND resource_accessed = '/auth/login' THEN 'brute_force'
      WHEN split_part(device_fingerprint, '|', 1) = 'Unknown' THEN 'device_spoofing'
      WHEN resource_accessed LIKE '/sensitive/%' AND is_night = 1 THEN 'low_and_slow'
      ELSE 'normal' END AS predicted_label
  FROM risked
)"""

BLOCKS = {"log": [ACCESS_LOG]}
BLOCKS["features"] = BLOCKS["log"] + [FEATURES]
BLOCKS["profiles"] = BLOCKS["features"] + [PROFILES]
BLOCKS["peers"] = BLOCKS["profiles"] + [PEERS]
BLOCKS["scored"] = BLOCKS["profiles"] + [SCORED]
BLOCKS["scored_peers"] = BLOCKS["peers"] + [SCORED]
BLOCKS["alerts"] = BLOCKS["scored"] + [ALERTS]
BLOCKS["alerts_peers"] = BLOCKS["scored_peers"] + [ALERTS]


def sql(level, body, *ctes):
    """A query whose FROM may name the views of ``level``; ``ctes`` are further ``name AS (...)`` blocks."""
    return "WITH " + ",".join(BLOCKS[level] + list(ctes)) + "\n" + body
