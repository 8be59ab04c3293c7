"""The 28 event features: per-row projections plus per-entity windows over one exchange."""

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from accesslens import constants as C
from accesslens.functions.scalar import behaviour, coordinates, epoch_micros, haversine_km, repaired, temporal
from accesslens.operators.encode import CategoryEncoder, label_code
from accesslens.plans.segments import ID, KEY, SEG, TS, EntitySegments


def scalar_features(log: DataFrame) -> DataFrame:
    return log.withColumns({**temporal(), **coordinates(), **behaviour()})


def _deviation(value, mean, std):
    return F.abs(F.col(value) - F.col(mean)) / F.greatest(F.coalesce(F.col(std), F.lit(1.0)), F.lit(0.1))


def cumulative_unique(df: DataFrame, segments: EntitySegments, value="resource_accessed",
                      name="cumulative_unique_resources") -> DataFrame:
    """Running distinct count per entity: flag the first sight of a value, then a running sum of flags."""
    df = segments.tag(df)
    first = F.row_number().over(
        Window.partitionBy(*segments.partition(value)).orderBy(TS, ID)) == 1
    df = df.withColumn("_new", first)
    if segments.hot:
        # In a hot entity the value must also be unseen in the earlier segments.
        seen = (segments.only_hot(df).groupBy(KEY, value).agg(F.min(SEG).alias(SEG))
                .withColumn("_fresh", F.lit(True)))
        hot = segments.hot_names().withColumn("_hot", F.lit(True))
        df = (df.join(segments.small(hot), KEY, "left").join(seen, [KEY, value, SEG], "left")
              .withColumn("_new", F.col("_new") & (F.col("_hot").isNull() | F.coalesce("_fresh", F.lit(False))))
              .drop("_hot", "_fresh"))
    return segments.running(df, name, F.col("_new").cast("long")).drop("_new")


def travel_features(df: DataFrame) -> DataFrame:
    """Gap, distance and speed from ``prev_*`` columns."""
    seconds = (epoch_micros(TS) - epoch_micros(f"prev_{TS}")) / 1e6
    gap = F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))
    km = F.coalesce(haversine_km(F.col("prev_latitude"), F.col("prev_longitude"),
                                 F.col("latitude"), F.col("longitude")), F.lit(0.0))
    return (df.withColumns({"time_gap_seconds": gap, "geo_distance_km": km})
            .withColumns({
                "log_time_gap": F.log1p("time_gap_seconds"),
                "geo_velocity_kmh": F.when(
                    F.col("time_gap_seconds") > 0,
                    F.col("geo_distance_km") / (F.col("time_gap_seconds") / 3600)).otherwise(0.0)})
            .drop(f"prev_{TS}", "prev_latitude", "prev_longitude"))


def entity_features(df: DataFrame, segments: EntitySegments) -> DataFrame:
    """Deviation, gap, distance, speed, running distinct resources and running count per entity."""
    stats = {
        "_hour_mean": F.avg("hour"), "_hour_std": F.stddev_samp("hour"),
        "_dur_mean": F.avg("session_duration"), "_dur_std": F.stddev_samp("session_duration"),
    }
    df = segments.tag(df)
    # One exchange by entity (and segment, if any); every window below reuses it.
    df = df.repartition(*[F.col(c) for c in segments.partition()])
    df = cumulative_unique(df, segments)
    df = segments.position(df, "entity_event_count")
    df = segments.whole(df, stats)
    if segments.hot:
        df = segments.halo(df, 1)
    w = segments.window()
    df = df.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in (TS, "latitude", "longitude")])
    if segments.hot:
        df = df.where(~F.col("_halo")).drop("_halo")
    df = travel_features(df)
    return df.withColumns({
        "hour_deviation": _deviation("hour", "_hour_mean", "_hour_std"),
        "duration_deviation": _deviation("session_duration", "_dur_mean", "_dur_std"),
    }).drop(*stats)


def entity_history(log: DataFrame):
    """What a batch needs to know of the events before it: (entities, resources), both mergeable.

    ``entities``: count, sums and sums of squares of hour and duration, and the last event; ``resources``: the distinct
    (entity, resource) pairs. States of two parts of a log merge to the state of both, so a new day reads no old event.
    """
    df = scalar_features(log)
    hour, duration = F.col("hour").cast("long"), F.col("session_duration").cast("decimal(20,0)")
    entities = df.groupBy(KEY).agg(
        F.count("*").alias("n"), F.sum(hour).alias("hour_sum"), F.sum(hour * hour).alias("hour_sq"),
        F.count("session_duration").alias("duration_n"), F.sum(duration).cast("decimal(38,0)").alias("duration_sum"),
        F.sum((duration * duration).cast("decimal(38,0)")).cast("decimal(38,0)").alias("duration_sq"),
        F.max(F.struct(TS, ID, "latitude", "longitude")).alias("last"))
    return entities, df.select(KEY, "resource_accessed").distinct()


def merge_history(first, second):
    """The state of both parts, in any order of time."""
    total = lambda c: F.sum(c).cast("decimal(38,0)" if c.startswith("duration_s") else "long").alias(c)
    entities = first[0].unionByName(second[0]).groupBy(KEY).agg(
        *[total(c) for c in ("n", "hour_sum", "hour_sq", "duration_n", "duration_sum", "duration_sq")], F.max("last").alias("last"))
    return entities, first[1].unionByName(second[1]).distinct()


def _moments(n, total, squares):
    """Mean and sample deviation from exact sums; null without, or with too few, values."""
    n, total, squares = (F.col(c).cast("double") for c in (n, total, squares))
    mean = F.try_divide(total, n)
    spread = F.when(n > 1, F.sqrt(F.greatest(squares - total * mean, F.lit(0.0)) / (n - 1)))
    return mean, spread


def features_after(history, batch: DataFrame, segments: EntitySegments) -> DataFrame:
    """Features of a batch that go on where ``history`` ends: counts, resources seen and the last position carry over,
    and deviations are taken from the history, so they are causal. An entity without history starts here; its deviations
    are taken from the batch, as with the batch scope."""
    entities, resources = history
    hour_mean, hour_std = _moments("n", "hour_sum", "hour_sq")
    dur_mean, dur_std = _moments("duration_n", "duration_sum", "duration_sq")
    known = entities.join(resources.groupBy(KEY).agg(F.count("*").alias("_had")), KEY, "left").select(
        KEY, F.col("n").alias("_n"), F.coalesce("_had", F.lit(0)).alias("_had"), F.col("last").alias("_last"),
        hour_mean.alias("_h_mean"), hour_std.alias("_h_std"), dur_mean.alias("_d_mean"), dur_std.alias("_d_std"))
    df = entity_features(scalar_features(batch), segments)
    # First sight in the batch of a resource that the history has does not count as new.
    seen = resources.withColumn("_old", F.lit(1))
    firsts = df.groupBy(KEY, "resource_accessed").agg(F.min(F.struct(TS, ID)).alias("_at")).join(seen, [KEY, "resource_accessed"])
    repeats = firsts.select(KEY, F.col("_at")[ID].alias(ID), F.lit(1).cast("long").alias("_repeat"))
    df = segments.lookup(df, known).join(repeats, [KEY, ID], "left")
    df = segments.running(df, "_repeats", F.coalesce("_repeat", F.lit(0)))
    had = F.col("_n").isNotNull()
    first = had & (F.col("entity_event_count") == 1)
    gap = F.greatest((epoch_micros(TS) - epoch_micros(f"_last.{TS}")) / 1e6, F.lit(0.0))
    km = haversine_km(F.col("_last")["latitude"], F.col("_last")["longitude"], F.col("latitude"), F.col("longitude"))
    df = df.withColumns({
        "time_gap_seconds": F.when(first, gap).otherwise(F.col("time_gap_seconds")),
        "geo_distance_km": F.when(first, F.coalesce(km, F.lit(0.0))).otherwise(F.col("geo_distance_km"))})
    deviation = lambda value, mean, std: F.abs(F.col(value) - F.col(mean)) / F.greatest(
        F.coalesce(F.col(std), F.lit(1.0)), F.lit(0.1))
    return df.withColumns({
        "log_time_gap": F.log1p("time_gap_seconds"),
        "geo_velocity_kmh": F.when(F.col("time_gap_seconds") > 0, F.col("geo_distance_km") / (F.col("time_gap_seconds") / 3600)).otherwise(0.0),
        "hour_deviation": F.when(had, deviation("hour", "_h_mean", "_h_std")).otherwise(F.col("hour_deviation")),
        "duration_deviation": F.when(had, deviation("session_duration", "_d_mean", "_d_std")).otherwise(F.col("duration_deviation")),
        "cumulative_unique_resources": (F.col("cumulative_unique_resources") - F.col("_repeats") + F.coalesce("_had", F.lit(0))).cast("long"),
        "entity_event_count": (F.col("entity_event_count") + F.coalesce("_n", F.lit(0))).cast("long"),
    }).drop("_n", "_had", "_last", "_h_mean", "_h_std", "_d_mean", "_d_std", "_repeat", "_repeats")


ENCODED = {"entity_type": "entity_type_enc", "auth_method": "auth_method_enc", "resource_accessed": "resource_enc"}


def plain_features(log: DataFrame, segments: EntitySegments = None) -> DataFrame:
    """All features but the category codes: no dictionary has to be fitted."""
    segments = segments or EntitySegments.probe(log)
    return entity_features(scalar_features(log), segments).withColumn("label_enc", label_code())


def build_features(log: DataFrame, segments: EntitySegments = None, encoder: CategoryEncoder = None) -> DataFrame:
    """Access log -> log columns, 28 features, day_of_month, label_enc and the segment column.

    Entity statistics cover exactly the given frame, as scoring a batch on its own does. Pass the encoder
    fitted on the training frame to score another batch.
    """
    encoder = encoder or CategoryEncoder.fit(log, list(ENCODED))
    return encoder.transform(plain_features(log, segments), ENCODED)


def feature_matrix(features: DataFrame, names=None) -> DataFrame:
    """Event key and the repaired features as doubles, in model order."""
    return features.select("event_id", *[repaired(F.col(f)).alias(f) for f in (names or C.FEATURES)])


def assemble(df: DataFrame, names, output="features") -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol=output, handleInvalid="error").transform(df)
