"""Attack rules over event-time windows with a watermark. Results appear once a window is closed."""

from pyspark.sql import DataFrame, functions as F

from accesslens.plans.segments import KEY, TS


def _timed(log: DataFrame, delay):
    return log.withColumn("at", F.col(TS).cast("timestamp")).withWatermark("at", delay)


def brute_force_windows(log: DataFrame, min_fails=10, span="5 minutes", delay="10 minutes") -> DataFrame:
    """Failures per entity and address in tumbling windows; only failures enter the state."""
    fails = _timed(log.where(~F.col("auth_success")), delay)
    return (fails.groupBy(F.window("at", span), KEY, "source_ip").agg(F.count("*").alias("fails"))
            .where(F.col("fails") >= min_fails)
            .select(F.unix_seconds("window.start").alias("window_start"), KEY, "source_ip", "fails"))


def credential_stuffing_windows(log: DataFrame, min_entities=15, min_fail_rate=0.7, span="30 minutes",
                                delay="10 minutes") -> DataFrame:
    """Entities and failure rate per address and window: first per entity, then per address.

    The first step spreads a busy address over its entities, so neither step holds a list of entities.
    """
    per_entity = (_timed(log, delay).groupBy(F.window("at", span), "source_ip", KEY)
                  .agg(F.count("*").alias("n"), F.count_if(~F.col("auth_success")).alias("f")))
    per_address = (per_entity.groupBy(F.window(F.window_time("window"), span), "source_ip")
                   .agg(F.count("*").alias("entities"), F.sum("n").alias("attempts"), F.sum("f").alias("fails")))
    rate = F.col("fails") / F.col("attempts")
    return (per_address.where((F.col("entities") >= min_entities) & (rate >= min_fail_rate))
            .select(F.unix_seconds("window.start").alias("window_start"), "source_ip", "entities", "attempts", "fails"))
