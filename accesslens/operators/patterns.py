"""Attack-pattern queries. Thresholds are parameters; each query aggregates before it orders anything."""

from pyspark.sql import DataFrame, Window, functions as F

from accesslens.functions.scalar import epoch_seconds, has_suspicious_cmd
from accesslens.operators.profiles import modal_value, normal_only, top_values
from accesslens.plans.lookup import SALTS
from accesslens.plans.ranks import dense_codes
from accesslens.plans.segments import KEY, TS, EntitySegments
from accesslens.session import materialize

WEEK = 7 * 86400

#: Names in a page of the resource dictionary.
CODE_PAGE = 1024


def brute_force(log: DataFrame, min_fails=10, span=300, bucket=3600) -> DataFrame:
    """Seconds at which one entity and address reached ``min_fails`` failures within ``span`` seconds.

    Failures are first counted per second. The range frame then runs inside time buckets; the last
    ``span`` seconds of a bucket are copied into the next, so one hot address still splits by time.
    """
    per_second = (log.where(~F.col("auth_success"))
                  .groupBy(KEY, "source_ip", epoch_seconds(TS).alias("at"))
                  .agg(F.count("*").alias("fails")))
    own = F.floor(F.col("at") / bucket).cast("long")
    late = F.col("at") % bucket >= bucket - span
    spread = per_second.withColumn("_b", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(KEY, "source_ip", "_b").orderBy("at").rangeBetween(-span, 0)
    return (spread.withColumn("fails_in_span", F.sum("fails").over(w))
            .where((F.col("_b") == own) & (F.col("fails_in_span") >= min_fails))
            .select(KEY, "source_ip", F.col("at").alias("epoch_second"), "fails", "fails_in_span"))


def impossible_travel(features: DataFrame, min_km=500.0, max_gap=2700.0) -> DataFrame:
    """Events more than ``min_km`` from the entity's previous event within ``max_gap`` seconds."""
    far = (F.col("geo_distance_km") > min_km) & (F.col("time_gap_seconds") <= max_gap)
    return features.where(far).select(
        "event_id", KEY, TS, "geo_city", "time_gap_seconds", "geo_distance_km", "geo_velocity_kmh")


def impossible_speed(features: DataFrame, min_kmh=500.0) -> DataFrame:
    return features.where(F.col("geo_velocity_kmh") > min_kmh).select(
        "event_id", KEY, TS, "geo_city", "geo_distance_km", "geo_velocity_kmh")


def credential_stuffing(log: DataFrame, min_entities=15, min_fail_rate=0.7, span=1800) -> DataFrame:
    """Addresses that touched many entities with mostly failed logins inside one time window."""
    start = (F.floor(epoch_seconds(TS) / span) * span).cast("long")
    # Per entity first: a busy address shrinks to one row per entity and window before the final step.
    per_entity = log.groupBy("source_ip", start.alias("window_start"), KEY).agg(
        F.count("*").alias("n"), F.count_if(~F.col("auth_success")).alias("f"))
    return (per_entity.groupBy("source_ip", "window_start")
            .agg(F.count("*").alias("entities"), F.sum("n").alias("attempts"), F.sum("f").alias("fails"))
            .withColumn("fail_rate", F.col("fails") / F.col("attempts"))
            .where((F.col("entities") >= min_entities) & (F.col("fail_rate") >= min_fail_rate)))


def unusual_accesses(log: DataFrame, *extra) -> DataFrame:
    """Accesses to resources outside the entity's ten usual ones, counted per entity, resource and ``extra``."""
    usual = top_values(normal_only(log), [KEY], "resource_accessed", 10).select(KEY, "resource_accessed")
    seen = log.groupBy(KEY, "resource_accessed", *extra).agg(
        F.count("*").alias("n"), F.max(has_suspicious_cmd()).alias("suspicious"))
    return seen.join(usual, [KEY, "resource_accessed"], "left_anti")


def unused_resources(log: DataFrame) -> DataFrame:
    """Resources of the common pool that are not among an entity's ten usual ones.

    Resources are coded by rank, and an entity's ten codes are removed from the code range: what is left are the runs of
    codes between them, at most eleven per entity. The runs meet the dictionary page by page, each page an array of
    ``CODE_PAGE`` names, so rows multiply only in the last step, which makes the result itself.
    """
    usual = top_values(normal_only(log), [KEY], "resource_accessed", 10).select(KEY, "resource_accessed")
    codes = materialize(dense_codes(log, "resource_accessed"), "resource-codes")
    size = codes.count()
    coded = usual.join(codes, "resource_accessed")
    held = coded.groupBy(KEY).agg(F.sort_array(F.collect_list("code")).alias("_c"))
    edges = F.concat(F.array(F.lit(-1).cast("long")), F.col("_c"), F.array(F.lit(size).cast("long")))
    runs = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1),
                      lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last")))
    runs = held.select(KEY, F.explode(F.filter(runs, lambda r: r["first"] <= r["last"])).alias("r")).select(KEY, "r.*")
    page = lambda c: F.floor(F.col(c) / CODE_PAGE)
    cut = runs.withColumn("page", F.explode(F.sequence(page("first"), page("last"))))
    pages = codes.groupBy(page("code").alias("page")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("code", "resource_accessed"))), lambda s: s["resource_accessed"]).alias("names"))
    low = F.greatest(F.col("first") - F.col("page") * CODE_PAGE, F.lit(0))
    high = F.least(F.col("last") - F.col("page") * CODE_PAGE, F.lit(CODE_PAGE - 1))
    # Every page may be wanted by every entity, so its copies are spread.
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(KEY), F.lit(SALTS)).cast("int"))
    copies = pages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["page", "salt"]).select(
        KEY, F.explode(F.slice("names", (low + 1).cast("int"), (high - low + 1).cast("int"))).alias("resource_accessed"))


def lateral_movement(log: DataFrame, min_resources=5) -> DataFrame:
    """Entity-hours with many unusual resources and a suspicious command."""
    hour = (F.floor(epoch_seconds(TS) / 3600) * 3600).cast("long").alias("hour_start")
    return (unusual_accesses(log, hour).groupBy(KEY, "hour_start")
            .agg(F.count("*").alias("unusual_resources"), F.sum("n").alias("accesses"), F.max("suspicious").alias("suspicious"))
            .where((F.col("unusual_resources") >= min_resources) & (F.col("suspicious") == 1))
            .drop("suspicious"))


def device_spoofing(log: DataFrame, segments: EntitySegments) -> DataFrame:
    """Events whose operating system or address differs from the entity's most frequent fingerprint."""
    usual = modal_value(normal_only(log), [KEY], "device_fingerprint", "usual_fingerprint")
    part = lambda c, i: F.split(c, r"\|")[i]
    differs = (part("device_fingerprint", 0) != part("usual_fingerprint", 0)) | (
        part("device_fingerprint", 1) != part("usual_fingerprint", 1))
    return (segments.lookup(log, usual).where(differs)
            .select("event_id", KEY, "device_fingerprint", "usual_fingerprint"))


def low_and_slow(log: DataFrame, prefix="/sensitive/", min_accesses=2) -> DataFrame:
    """Weekly off-hours accesses to sensitive resources, with the two weeks before and a growth flag."""
    at = epoch_seconds(TS)
    quiet = F.hour(TS).between(2, 5) & F.col("resource_accessed").startswith(prefix)
    weekly = log.where(quiet).groupBy(KEY, F.floor(at / WEEK).cast("long").alias("week")).agg(F.count("*").alias("accesses"))
    w = Window.partitionBy(KEY).orderBy("week")
    before = lambda k: F.coalesce(
        F.sum("accesses").over(w.rangeBetween(-k, -k)), F.lit(0)).cast("long")
    out = weekly.select("*", before(1).alias("one_week_before"), before(2).alias("two_weeks_before"))
    grows = (F.col("accesses") > F.col("one_week_before")) & (F.col("one_week_before") > F.col("two_weeks_before")) & (
        F.col("two_weeks_before") > 0)
    return out.where(F.col("accesses") >= min_accesses).withColumn("growing", grows.cast("long"))


def first_seen(log: DataFrame, value="resource_accessed") -> DataFrame:
    """First second at which each entity used each value."""
    return log.groupBy(KEY, value).agg(F.min(epoch_seconds(TS)).alias("first_at"))


def insider_drift(log: DataFrame, min_weeks=3, span_weeks=4) -> DataFrame:
    """Entities that keep adding resources: new ones in ``min_weeks`` of ``span_weeks`` weeks after the first week."""
    start = Window.partitionBy(KEY)
    new = first_seen(log).withColumn(
        "week", F.floor((F.col("first_at") - F.min("first_at").over(start)) / WEEK).cast("long"))
    weekly = new.where("week >= 1").groupBy(KEY, "week").agg(F.count("*").alias("new_resources"))
    w = Window.partitionBy(KEY).orderBy("week").rangeBetween(-(span_weeks - 1), 0)
    return (weekly.withColumn("active_weeks", F.count("*").over(w))
            .where(F.col("active_weeks") >= min_weeks))
