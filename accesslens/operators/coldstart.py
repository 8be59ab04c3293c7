"""New entities: peer-group scoring and the transition to their own profile."""

from pyspark.sql import DataFrame, functions as F

from accesslens import constants as C
from accesslens.operators.profiles import capped
from accesslens.plans.segments import KEY


def transition(count, minimum=C.MIN_HISTORY_EVENTS):
    """(peer weight, individual weight); they add up to 1."""
    own = F.least(count / minimum, F.lit(1.0))
    return 1 - own, own


def cold_start_info(entities: DataFrame, minimum=C.MIN_HISTORY_EVENTS) -> DataFrame:
    """Status of each entity from its ``event_count``."""
    n = F.col("event_count")
    peer, own = transition(n, minimum)
    return entities.select(
        KEY, "entity_type", (n < minimum).cast("long").alias("is_cold_start"), "event_count",
        F.lit(minimum).cast("long").alias("min_required"),
        F.least(F.lit(100), (n / minimum * 100).cast("long")).cast("long").alias("progress_pct"),
        F.round(peer, 2).alias("peer_weight"), F.round(own, 2).alias("individual_weight"),
        F.when(n < minimum, "Elevated").otherwise("Standard").alias("monitoring_level"),
        F.col("entity_type").alias("peer_group"))


def entity_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(KEY).agg(F.min("entity_type").alias("entity_type"), F.count("*").alias("event_count"))


def coldest_entities(counts: DataFrame, show=10, fallback=5, minimum=C.MIN_HISTORY_EVENTS) -> DataFrame:
    """The entities with the least history: up to ``show`` cold ones, else the ``fallback`` coldest of all."""
    order = [F.col("event_count").asc(), F.col(KEY).asc()]
    cold = counts.where(F.col("event_count") < minimum).orderBy(*order).limit(show)
    rest = counts.orderBy(*order).limit(fallback)
    any_cold = counts.agg(F.max((F.col("event_count") < minimum).cast("int")).alias("_any"))
    rest = rest.crossJoin(F.broadcast(any_cold)).where("_any = 0").drop("_any")
    return cold.unionByName(rest)


PEER_INPUTS = ["hour_mean", "hour_std", "duration_mean", "duration_std", "geo_distance_p95"]


def with_peers(features: DataFrame, peers: DataFrame) -> DataFrame:
    """Left join to the peer group by entity type: one row per type, so the broadcast side is bounded."""
    dim = peers.select("entity_type", *[F.col(c).alias(f"g_{c}") for c in PEER_INPUTS])
    return features.join(F.broadcast(dim), "entity_type", "left")


def cold_start_score_expr(multiplier=C.COLD_START_MULTIPLIER, prefix="g_"):
    g = lambda c: F.col(prefix + c)
    hour_z = F.abs(F.col("hour") - g("hour_mean")) / F.greatest(g("hour_std"), F.lit(0.1))
    dur_z = F.abs(F.col("session_duration") - g("duration_mean")) / F.greatest(g("duration_std"), F.lit(1.0))
    reach = F.col("geo_distance_km") / F.greatest(g("geo_distance_p95"), F.lit(1.0))
    total = (
        capped(hour_z, 3.0) * 0.25 + capped(dur_z, 3.0) * 0.2
        + F.when(g("geo_distance_p95") > 0, F.least(reach * 1.2, F.lit(1.0)) * 0.25).otherwise(0.0)
        + F.when(~F.col("auth_success"), 0.2).otherwise(0.0)
        + F.when(F.col("has_suspicious_cmd") == 1, 0.1).otherwise(0.0)
    )
    return F.when(g("hour_mean").isNull(), 0.5).otherwise(F.least(total / multiplier, F.lit(1.0)))


def with_cold_start_score(features: DataFrame, peers: DataFrame) -> DataFrame:
    out = with_peers(features, peers).withColumn("cold_start_score", cold_start_score_expr())
    return out.drop(*[f"g_{c}" for c in PEER_INPUTS])


def blended_score(df: DataFrame, minimum=C.MIN_HISTORY_EVENTS) -> DataFrame:
    """Peer and own score weighted by the history an entity had at the event (``entity_event_count``)."""
    peer, own = transition(F.col("entity_event_count"), minimum)
    return df.withColumn("blended_score", peer * F.col("cold_start_score") + own * F.col("statistical_score"))
