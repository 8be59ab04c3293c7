"""Event sequences: windows over the last events of an entity and scores derived from them."""

from pyspark.sql import DataFrame, functions as F

from accesslens import constants as C
from accesslens.plans.ranks import exact_quantiles
from accesslens.plans.segments import ID, KEY, EntitySegments


def event_sequences(df: DataFrame, value, segments: EntitySegments, length=C.SEQUENCE_LENGTH) -> DataFrame:
    """Windows of ``length`` consecutive values per entity, one per event from the ``length``-th on.

    An entity with fewer events gets a single window, padded in front. ``value`` is a double or an
    array<double> column; padding is 0.0 or an array of zeros. Adds ``sequence`` and ``end_position``.
    """
    placed = segments.position(df, "end_position")
    placed = segments.whole(placed, {"_total": F.count(F.lit(1))})
    out = segments.halo(placed, length - 1)
    frame = segments.window().rowsBetween(-(length - 1), 0)
    out = out.withColumn("sequence", F.collect_list(value).over(frame))
    out = out.where(~F.col("_halo")).drop("_halo")
    full = F.col("end_position") >= length
    short = (F.col("_total") < length) & (F.col("end_position") == F.col("_total"))
    is_array = dict(df.dtypes)[value].startswith("array")
    zero = F.transform(F.col(value), lambda x: F.lit(0.0)) if is_array else F.lit(0.0)
    padding = F.array_repeat(zero, (length - F.size("sequence")).cast("int"))
    return out.where(full | short).withColumn("sequence", F.concat(padding, "sequence")).drop("_total")


def map_window_error(events: DataFrame, windows: DataFrame, segments: EntitySegments) -> DataFrame:
    """Error of the window that ends at an event; events before the first window take that window's error.

    ``windows`` has ``event_id``, entity, ``end_position`` and ``error``.
    """
    own = windows.select(ID, F.col("error").alias("_own"))
    first = windows.groupBy(KEY).agg(F.min(F.struct("end_position", "error")).alias("_f"))
    first = first.select(KEY, F.col("_f.error").alias("_first"))
    joined = segments.lookup(events.join(own, ID, "left"), first)
    return joined.withColumn("event_error", F.coalesce("_own", "_first")).drop("_own", "_first")


def normal_threshold(df: DataFrame, error, p=C.FLAG_PERCENTILE) -> DataFrame:
    """Exact percentile of the error over normal events, as one row (threshold)."""
    return exact_quantiles(df.where("label = 'normal'"), [], error, [p]).select(F.col("q").alias("threshold"))


def normalise_error(df: DataFrame, error, threshold: DataFrame, name="sequence_score") -> DataFrame:
    """error / max(batch maximum, 2 * threshold), clipped to 0..1."""
    top = df.agg(F.max(error).alias("_max")).crossJoin(F.broadcast(threshold))
    scale = F.greatest("_max", 2 * F.col("threshold"))
    value = F.when(scale > 0, F.greatest(F.least(F.col(error) / scale, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    return df.crossJoin(F.broadcast(top)).withColumn(name, value).drop("_max", "threshold")


def sequence_predict(df: DataFrame, score, threshold: DataFrame) -> DataFrame:
    """1 where the normalised score exceeds threshold / max(2 * threshold, 1e-6); 0.5 without a threshold."""
    cut = F.coalesce(F.col("threshold") / F.greatest(2 * F.col("threshold"), F.lit(1e-6)), F.lit(0.5))
    return (df.join(F.broadcast(threshold), F.lit(True), "left")
            .withColumn("flagged", (F.col(score) > cut).cast("long")).drop("threshold"))
