"""Entity profiles, peer groups, risk history and the statistical score."""

from pyspark.sql import DataFrame, Window, functions as F

from accesslens import constants as C
from accesslens.plans.ranks import exact_quantiles
from accesslens.plans.segments import KEY, EntitySegments


def normal_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("label") == "normal")


def anomaly_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("label") != "normal")


def value_counts(df: DataFrame, keys, value) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, keys, value, k=10) -> DataFrame:
    """The k most frequent values per group, ties by value; counts shrink the input before the ranking."""
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col(value).asc())
    return value_counts(df, keys, value).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def modal_value(df: DataFrame, keys, value, name) -> DataFrame:
    """Most frequent value per group; a tie goes to the smallest value."""
    # min over (-n, value) needs no sort and combines before the shuffle.
    counted = value_counts(df, keys, value)
    best = F.min(F.struct((-F.col("n")).alias("c"), F.col(value).alias("v")))
    return counted.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(name))


def entity_profiles(features: DataFrame, segments: EntitySegments = None, log: DataFrame = None) -> DataFrame:
    """What is normal for each entity, learned from its normal events.

    Value counts come from the plain ``log`` where given: they combine before the shuffle and need no window.
    """
    segments = segments or EntitySegments.none(features.sparkSession)
    normal = normal_only(features)
    plain = normal_only(features if log is None else log)
    p95 = lambda c: F.percentile(c, 0.95)
    base = [
        F.min("entity_type").alias("entity_type"),
        F.count("*").alias("event_count"),
        F.avg("hour").alias("hour_mean"),
        F.greatest(F.coalesce(F.stddev_samp("hour"), F.lit(0.1)), F.lit(0.1)).alias("hour_std"),
        F.avg("session_duration").alias("duration_mean"),
        F.greatest(F.coalesce(F.stddev_samp("session_duration"), F.lit(1.0)), F.lit(1.0)).alias("duration_std"),
        F.avg("geo_distance_km").alias("geo_distance_mean"),
        F.avg(F.col("auth_success").cast("double")).alias("auth_success_rate"),
    ]
    tails = [p95("session_duration").alias("duration_p95"), p95("geo_distance_km").alias("geo_distance_p95")]
    if not segments.hot:
        profile = normal.groupBy(KEY).agg(*base, *tails)
    else:
        # Exact percentiles hold all distinct values of a group: for hot entities they come from bins.
        names = segments.hot_names()
        hot = normal.join(segments.small(names), KEY, "left_semi")
        cold = normal.join(segments.small(names), KEY, "left_anti")
        q = lambda c, n: exact_quantiles(hot, [KEY], c, [0.95]).select(KEY, F.col("q").alias(n))
        hot_profile = (hot.groupBy(KEY).agg(*base)
                       .join(segments.small(q("session_duration", "duration_p95")), KEY)
                       .join(segments.small(q("geo_distance_km", "geo_distance_p95")), KEY))
        profile = cold.groupBy(KEY).agg(*base, *tails).unionByName(hot_profile)

    # Resource counts serve both the distinct number and the top ten.
    counts = value_counts(plain, [KEY], "resource_accessed")
    unique = counts.groupBy(KEY).agg(F.count("*").alias("unique_resources"))
    w = Window.partitionBy(KEY).orderBy(F.col("n").desc(), F.col("resource_accessed"))
    typical = (counts.withColumn("rank", F.row_number().over(w)).where("rank <= 10")
               .groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("rank", "resource_accessed"))).alias("_t"))
               .select(KEY, F.col("_t.resource_accessed").alias("typical_resources")))
    auth = modal_value(plain, [KEY], "auth_method", "primary_auth")
    return (profile.join(unique, KEY).join(typical, KEY).join(auth, KEY, "left")
            .select(KEY, "entity_type", "event_count", "hour_mean", "hour_std", "duration_mean", "duration_std",
                    "duration_p95", "geo_distance_mean", "geo_distance_p95", "unique_resources",
                    "typical_resources", "primary_auth", "auth_success_rate"))


#: The feature columns that profiles and statistical scores need.
PROFILED = ["event_id", KEY, "timestamp", "entity_type", "label", "hour", "session_duration", "geo_distance_km",
            "resource_accessed", "auth_method", "auth_success"]


def profile_states(features: DataFrame):
    """Mergeable state of the normal events per entity and day: (moments, counts).

    ``moments``: number, exact sums and sums of squares, first type. ``counts``: how often each duration, distance,
    resource and login method occurs, one long table that combines before its only shuffle. Days add up, so a new day is
    merged without reading an older event again.
    """
    normal = normal_only(features).withColumn("day", F.to_date("timestamp"))
    hour, duration = F.col("hour").cast("long"), F.col("session_duration").cast("decimal(20,0)")
    moments = normal.groupBy(KEY, "day").agg(
        F.min("entity_type").alias("entity_type"), F.count("*").alias("n"),
        F.sum(hour).alias("hour_sum"), F.sum(hour * hour).alias("hour_sq"), F.count("session_duration").alias("duration_n"),
        F.sum(duration).cast("decimal(38,0)").alias("duration_sum"),
        F.sum((duration * duration).cast("decimal(38,0)")).cast("decimal(38,0)").alias("duration_sq"),
        F.sum("geo_distance_km").alias("geo_sum"), F.count("geo_distance_km").alias("geo_n"),
        F.count_if("auth_success").alias("ok"), F.count("auth_success").alias("ok_n"))
    entry = lambda kind, number, text: F.struct(
        F.lit(kind).alias("kind"), number.cast("double").alias("number"), text.cast("string").alias("text"))
    none = F.lit(None)
    entries = F.explode(F.array(
        entry("duration", F.col("session_duration"), none), entry("distance", F.col("geo_distance_km"), none),
        entry("resource", none, F.col("resource_accessed")), entry("auth", none, F.col("auth_method"))))
    counts = (normal.select(KEY, "day", entries.alias("e")).select(KEY, "day", "e.*")
              .groupBy(KEY, "day", "kind", "number", "text").agg(F.count("*").alias("n")))
    return moments, counts


def merge_profile_states(first, second):
    """The state of both, days that stand in either or in both."""
    moments, counts = (a.unionByName(b) for a, b in zip(first, second))
    sums = [F.sum(c).cast(t).alias(c) for c, t in moments.dtypes if c not in (KEY, "day", "entity_type")]
    return (moments.groupBy(KEY, "day").agg(F.min("entity_type").alias("entity_type"), *sums),
            counts.groupBy(KEY, "day", "kind", "number", "text").agg(F.sum("n").alias("n")))


def profiles_of_states(states) -> DataFrame:
    """The profiles of ``entity_profiles`` from states of any days: exact, percentiles from counted values."""
    moments, counts = states
    total = lambda c: F.sum(c).cast("double")
    spread = lambda n, s, q: F.when(total(n) > 1, F.sqrt(F.greatest(
        total(q) - total(s) * F.try_divide(total(s), total(n)), F.lit(0.0)) / (total(n) - 1)))
    floor = lambda value, least: F.greatest(F.coalesce(value, F.lit(least)), F.lit(least))
    base = moments.groupBy(KEY).agg(
        F.min("entity_type").alias("entity_type"), F.sum("n").alias("event_count"),
        F.try_divide(total("hour_sum"), total("n")).alias("hour_mean"), floor(spread("n", "hour_sum", "hour_sq"), 0.1).alias("hour_std"),
        F.try_divide(total("duration_sum"), total("duration_n")).alias("duration_mean"),
        floor(spread("duration_n", "duration_sum", "duration_sq"), 1.0).alias("duration_std"),
        F.try_divide(F.sum("geo_sum"), total("geo_n")).alias("geo_distance_mean"),
        F.try_divide(total("ok"), total("ok_n")).alias("auth_success_rate"))
    values = counts.groupBy(KEY, "kind", "number", "text").agg(F.sum("n").alias("n"))
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    w = Window.partitionBy(KEY, "kind").orderBy(F.col("n").desc(), F.col("text"))
    p95 = lambda kind: F.percentile(of(kind, "number"), 0.95, F.col("n"))
    # One exchange by entity serves the ranks and all aggregates of the counted values.
    ranked = values.repartition(KEY).withColumn("rank", F.row_number().over(w))
    listed = F.sort_array(F.collect_list(F.when((F.col("kind") == "resource") & (F.col("rank") <= 10), F.struct("rank", "text"))))
    found = ranked.groupBy(KEY).agg(
        p95("duration").alias("duration_p95"), p95("distance").alias("geo_distance_p95"),
        F.count(of("resource", "text")).alias("unique_resources"), listed["text"].alias("typical_resources"),
        F.max(F.when(F.col("rank") == 1, of("auth", "text"))).alias("primary_auth"))
    return base.join(found, KEY).select(
        KEY, "entity_type", "event_count", "hour_mean", "hour_std", "duration_mean", "duration_std", "duration_p95",
        "geo_distance_mean", "geo_distance_p95", "unique_resources", "typical_resources", "primary_auth", "auth_success_rate")


def profile_of(profiles: DataFrame, entity_id) -> DataFrame:
    return profiles.where(F.col(KEY) == entity_id)


def peer_groups(profiles: DataFrame) -> DataFrame:
    """Aggregate profile per entity type; quantiles over entities come from bins, as a type may hold most."""
    means = profiles.groupBy("entity_type").agg(
        F.count("*").alias("count"),
        F.avg("hour_mean").alias("hour_mean"),
        (F.avg("hour_std") * 1.5).alias("hour_std"),
        F.avg("duration_mean").alias("duration_mean"),
        (F.avg("duration_std") * 1.5).alias("duration_std"),
        F.avg("geo_distance_mean").alias("geo_distance_mean"),
        F.avg("unique_resources").alias("unique_resources_mean"),
        F.avg("auth_success_rate").alias("auth_success_rate"),
    )
    q = lambda c, p: exact_quantiles(profiles, ["entity_type"], c, [p]).select("entity_type", F.col("q").alias(c))
    return (means.join(q("duration_p95", 0.75), "entity_type").join(q("geo_distance_p95", 0.90), "entity_type")
            .select("entity_type", "count", "hour_mean", "hour_std", "duration_mean", "duration_std", "duration_p95",
                    "geo_distance_mean", "geo_distance_p95", "unique_resources_mean", "auth_success_rate"))


def capped(value, limit):
    return F.least(value / limit, F.lit(1.0))


def statistical_score_expr(prefix="p_"):
    """Deviation of an event from its entity's profile, 0..1; 0.5 where there is no profile."""
    p = lambda c: F.col(prefix + c)
    hour_z = F.abs(F.col("hour") - p("hour_mean")) / F.greatest(p("hour_std"), F.lit(0.1))
    dur_z = F.abs(F.col("session_duration") - p("duration_mean")) / F.greatest(p("duration_std"), F.lit(1.0))
    reach = F.col("geo_distance_km") / F.greatest(p("geo_distance_p95"), F.lit(1.0))
    flag = lambda cond, w: F.when(cond, w).otherwise(0.0)
    total = (
        capped(hour_z, 4.0) * 0.2
        + capped(dur_z, 4.0) * 0.15
        + F.when(p("geo_distance_p95") > 0, F.least(reach, F.lit(1.0)) * 0.25).otherwise(0.0)
        + flag(~F.array_contains(p("typical_resources"), F.col("resource_accessed")), 0.2)
        + flag(F.col("auth_method") != p("primary_auth"), 0.1)
        + flag(~F.col("auth_success"), 0.1)
    )
    return F.when(p("hour_mean").isNull(), 0.5).otherwise(F.least(total, F.lit(1.0)))


PROFILE_INPUTS = ["hour_mean", "hour_std", "duration_mean", "duration_std", "geo_distance_p95",
                  "typical_resources", "primary_auth"]


def with_statistical_score(features: DataFrame, profiles: DataFrame, segments: EntitySegments) -> DataFrame:
    """Left join to the profile (skew-safe for hot entities) and one projection."""
    dim = profiles.select(KEY, *[F.col(c).alias(f"p_{c}") for c in PROFILE_INPUTS])
    joined = segments.lookup(features, dim)
    return joined.withColumn("statistical_score", statistical_score_expr()).drop(*[f"p_{c}" for c in PROFILE_INPUTS])


def entity_risk_history(log: DataFrame, decay=C.RISK_DECAY) -> DataFrame:
    """Share of anomalies plus their decay weight. The weights only depend on their number, so no order is needed."""
    n = F.count_if(F.col("label") != "normal")
    total = F.count("*")
    weight = (1 - F.pow(F.lit(decay), n)) / (1 - decay)
    risk = F.when(n > 0, F.least(0.5 * n / total + 0.5 * weight / total, F.lit(1.0))).otherwise(0.0)
    return log.groupBy(KEY).agg(total.alias("total_events"), n.alias("anomaly_events"), risk.alias("entity_risk"))


def with_risk_history(df: DataFrame, history: DataFrame, segments: EntitySegments) -> DataFrame:
    joined = segments.lookup(df, history.select(KEY, "entity_risk"))
    return joined.withColumn("entity_risk", F.coalesce("entity_risk", F.lit(0.0)))
