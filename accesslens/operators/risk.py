"""Risk fusion, severity and the rule labels used where no trained classifier takes part."""

from pyspark.sql import DataFrame, functions as F

from accesslens import constants as C
from accesslens.functions.scalar import severity
from accesslens.operators.profiles import entity_profiles, entity_risk_history, with_risk_history, with_statistical_score
from accesslens.plans.segments import EntitySegments


def risk_score(isolation, sequence, confidence, history):
    """0-100 from four 0-1 parts; a missing part counts as 0."""
    w = C.RISK_WEIGHTS
    part = lambda c, k: F.coalesce(c, F.lit(0.0)) * w[k]
    total = part(isolation, "isolation") + part(sequence, "sequence") + part(confidence, "confidence") + part(history, "history")
    return F.least(F.greatest(total * 100, F.lit(0.0)), F.lit(100.0))


def baseline_combined(statistical, isolation, one_class):
    return 0.3 * statistical + 0.4 * isolation + 0.3 * one_class


def rule_label():
    """Attack type by rule: the first rule that holds."""
    failed_login = ~F.col("auth_success") & (F.col("resource_accessed") == "/auth/login")
    return (
        F.when(F.col("has_suspicious_cmd") == 1, "lateral_movement")
        .when((F.col("geo_velocity_kmh") > 500) & (F.col("geo_distance_km") > 500), "impossible_travel")
        .when(failed_login, "brute_force")
        .when(F.split("device_fingerprint", r"\|")[0] == "Unknown", "device_spoofing")
        .when(F.col("resource_accessed").startswith("/sensitive/") & (F.col("is_night") == 1), "low_and_slow")
        .otherwise("normal")
    )


def speed_share(df: DataFrame, name="isolation_forest_score") -> DataFrame:
    """Min-max of the travel speed over the frame: the closed-form isolation part of the rule scores."""
    ends = df.agg(F.min("geo_velocity_kmh").alias("_lo"), F.max("geo_velocity_kmh").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    value = F.when(span > 0, (F.col("geo_velocity_kmh") - F.col("_lo")) / span).otherwise(0.5)
    return df.crossJoin(F.broadcast(ends)).withColumn(name, value).drop("_lo", "_hi")


def closed_form_scores(features: DataFrame, segments: EntitySegments, log: DataFrame = None) -> DataFrame:
    """Scores that need no trained model: statistical, speed and command rule, with the risk history.

    Profiles and history have one row per entity; the frame is read once to learn them and once to be scored.
    """
    plain = features if log is None else log
    profiles = entity_profiles(features, segments, plain)
    df = with_statistical_score(features, profiles, segments)
    df = with_risk_history(df, entity_risk_history(plain), segments)
    df = speed_share(df)
    return df.withColumns({
        "sequence_score": F.col("statistical_score"),
        "confidence": F.col("has_suspicious_cmd").cast("double"),
    })


def fuse(scored: DataFrame, contiguous=False, digits=None) -> DataFrame:
    """Risk and severity from isolation, sequence, confidence and history columns.

    ``digits`` rounds the risk first, so that rankings do not depend on the last bits of a sum.
    """
    risk = risk_score(F.col("isolation_forest_score"), F.col("sequence_score"), F.col("confidence"), F.col("entity_risk"))
    return (scored.withColumn("risk_score", risk if digits is None else F.round(risk, digits))
            .withColumn("severity", severity(F.col("risk_score"), contiguous)))


def alerts(features: DataFrame, segments: EntitySegments, log: DataFrame = None, digits=6) -> DataFrame:
    """Features with scores, risk, severity and predicted label."""
    return fuse(closed_form_scores(features, segments, log), digits=digits).withColumn("predicted_label", rule_label())
