"""Access-log readers and writers, and the view that derives an access log from ``events``."""

from pyspark.sql import DataFrame, functions as F

from accesslens import constants as C


def read_access_log(spark, path, fmt="csv"):
    """Read an access log with a fixed schema (no inference). CSV carries a header and plain timestamps."""
    reader = spark.read.schema(C.ACCESS_LOG_SCHEMA)
    if fmt == "csv":
        reader = reader.options(header=True, timestampNTZFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]", escape='"')
    return reader.format(fmt).load(path)


def write_access_log(df, path, fmt="parquet", partition_by_date=False, mode="overwrite"):
    """Write an access log; optionally laid out by event date so date filters prune files."""
    out = df.select(*C.ACCESS_LOG_COLUMNS)
    if partition_by_date:
        out = out.withColumn("event_date", F.to_date("timestamp"))
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", escape='"')
    if partition_by_date:
        writer = writer.partitionBy("event_date")
    writer.save(path)


def write_json_records(df, path, mode="overwrite"):
    """One JSON object per row (entity profiles, metrics)."""
    df.write.mode(mode).json(path)


def read_json_records(spark, path, schema):
    return spark.read.schema(schema).json(path)


def read_events(spark, sf_dir):
    return spark.read.schema(C.EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def access_log(spark, sf_dir):
    return access_log_from_events(read_events(spark, sf_dir))


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def access_log_from_events(events: DataFrame) -> DataFrame:
    """The 14-column access log behind every query (see FIXTURES.md, section 2).

    Row-local: a projection and one ``explode``, so it adds no shuffle and also works on a stream.
    """
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    uid = F.col("user_id")
    base = events.withColumn("k", k).withColumn("inj", (F.col("k") >= 90) & (F.col("event_id") % 3 == 0))
    k, inj = F.col("k"), F.col("inj")

    label = (
        F.when(~inj, "normal")
        .when(k <= 91, "lateral_movement")
        .when(k == 92, "brute_force")
        .when(k == 93, "device_spoofing")
        .when(k == 94, "low_and_slow")
        .when(k <= 96, "impossible_travel")
        .when(k == 97, "credential_stuffing")
        .when(k == 98, "insider_drift")
        .otherwise("normal")
    )
    base = base.withColumn("label", label)
    label = F.col("label")
    copies = (
        F.when(label == "brute_force", 12)
        .when(label == "impossible_travel", 2)
        .when((label == "credential_stuffing") & (F.col("event_id") % 9 == 0), 24)
        .when(label == "lateral_movement", 6)
        .when(label == "low_and_slow", 12)
        .when(label == "insider_drift", 4)
        .otherwise(1)
    )
    burst = base.withColumn("i", F.explode(F.sequence(F.lit(0), copies - 1)))
    i = F.col("i")

    bucket = uid % 20
    kind = F.when(bucket < 12, "user").when(bucket < 17, "service_account").otherwise("edge_device")
    prefix = F.when(bucket < 12, "USR_").when(bucket < 17, "SVC_").otherwise("DEV_")
    stuffing = label == "credential_stuffing"

    seconds = (
        F.when(label == "brute_force", 20 * i)
        .when(label == "impossible_travel", 1800 * i)
        .when(stuffing, 60 * i)
        .when(label == "lateral_movement", 300 * i)
        .when(label == "insider_drift", 7 * 86400 * i)
        .otherwise(0)
    )
    slow_days = F.when(i < 2, i).when(i < 6, 7 + i - 2).otherwise(14 + i - 6)
    shifted = F.when(
        label == "low_and_slow",
        F.col("ts").cast("date").cast("timestamp_ntz")
        + F.make_dt_interval(slow_days, F.lit(0), 120 + 7 * i),
    ).otherwise(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")))

    city = F.when((label == "impossible_travel") & (i == 0), F.lit(0)).when(
        label == "impossible_travel", F.lit(2)).otherwise(uid % len(C.CITIES))
    resource = (
        F.when(label == "lateral_movement", F.concat(F.lit("/res/"), (20 + i).cast("string")))
        .when(label == "low_and_slow", F.concat(F.lit("/sensitive/"), (i % 4).cast("string")))
        .when(label == "insider_drift", F.concat(F.lit("/res/"), (30 + i).cast("string")))
        .when(inj & k.isin(92, 97), "/auth/login")
        .otherwise(F.concat(F.lit("/res/"), ((uid + k % 5) % 12).cast("string")))
    )
    auth = (
        F.when(inj & k.isin(92, 97), "password")
        .when(k % 20 < 17, _pick(["password", "token", "certificate", "biometric"], uid % 4))
        .otherwise("token")
    )
    commands = F.when(
        inj & k.isin(90, 91), '["login", "escalate_privileges", "dump_credentials", "exfiltrate_data"]'
    ).otherwise(_pick([
        '["login", "read_file", "logout"]',
        '["login", "search", "read_file", "download", "logout"]',
        '["handshake", "send_telemetry", "ack"]',
    ], k % 3))
    fingerprint = F.when(
        inj & (k == 93), F.concat(F.lit("Unknown|aa:bb:cc:00:00:"), k.cast("string"), F.lit("|HTTPS"))
    ).otherwise(F.concat(
        F.lit("os"), (uid % 6).cast("string"), F.lit("|02:00:00:00:00:"), uid.cast("string"), F.lit("|HTTPS")))
    success = (
        F.when(label == "brute_force", False)
        .when(stuffing, i % 7 == 3)
        .otherwise(~((F.col("event_type") == "error") & (inj | (k % 10 == 0))))
    )
    ip = F.when(
        inj & (k == 97), F.concat(F.lit("203.0.113."), (F.col("event_id") % 3).cast("string"))
    ).otherwise(F.concat(F.lit("10.0."), (uid % 200).cast("string"), F.lit(".7")))

    return burst.select(
        (F.col("event_id") * 32 + i).alias("event_id"),
        F.when(stuffing, F.concat(F.lit("USR_"), (9000 + i).cast("string")))
        .otherwise(F.concat(prefix, F.lpad(uid.cast("string"), 4, "0"))).alias("entity_id"),
        F.when(stuffing, "user").otherwise(kind).alias("entity_type"),
        shifted.alias("timestamp"),
        ip.alias("source_ip"),
        _pick([f"{lat:.4f},{lon:.4f}" for _, lat, lon in C.CITIES], city).alias("geo_location"),
        _pick([name for name, _, _ in C.CITIES], city).alias("geo_city"),
        resource.alias("resource_accessed"),
        auth.alias("auth_method"),
        F.floor(F.col("value") * 10).cast("long").alias("session_duration"),
        commands.alias("command_sequence"),
        fingerprint.alias("device_fingerprint"),
        success.alias("auth_success"),
        label.alias("label"),
    )
