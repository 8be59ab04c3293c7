"""Report tables."""

from pyspark.sql import DataFrame, functions as F

from accesslens import constants as C
from accesslens.operators.queue import top_alerts
from accesslens.operators.summary import severity_distribution


def report_severity(alerts: DataFrame) -> DataFrame:
    """Four tiers with count and share text."""
    total = alerts.agg(F.greatest(F.count("*"), F.lit(1)).alias("_t"))
    return severity_distribution(alerts).crossJoin(F.broadcast(total)).select(
        "severity", "n", F.concat(F.round(F.col("n") / F.col("_t") * 100, 1).cast("string"), F.lit("%")).alias("pct"))


def report_summary(alerts: DataFrame) -> DataFrame:
    """The summary sentence."""
    tier = lambda n: F.count_if(F.col("severity") == n)
    return alerts.agg(F.format_string(
        "%d access events: %d critical, %d high, %d medium and %d low alerts",
        F.count("*"), *[tier(n) for n, *_ in C.SEVERITY_TIERS]).alias("summary"))


def report_top_alerts(alerts: DataFrame, n=15) -> DataFrame:
    """Top alerts with texts cut to their column widths (12, 18, 15, 25 and 19 characters)."""
    cut = lambda c, k: F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, k)
    return top_alerts(alerts, n).select(
        "event_id", cut(F.col("entity_id"), 12).alias("entity"), F.round("risk_score", 1).alias("score"), "severity",
        cut(F.col("predicted_label"), 18).alias("type"), cut(F.col("geo_city"), 15).alias("city"),
        cut(F.col("resource_accessed"), 25).alias("resource"),
        cut(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), 19).alias("at"))


def report_types(alerts: DataFrame) -> DataFrame:
    """Predicted anomaly types with their share of all predicted anomalies."""
    counts = (alerts.where(F.col("predicted_label") != "normal").groupBy("predicted_label").agg(F.count("*").alias("n")))
    total = counts.agg(F.greatest(F.sum("n"), F.lit(1)).alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(
        "predicted_label", "n", F.round(F.col("n") / F.col("_t") * 100, 1).alias("pct"))


def report_metrics(summary: DataFrame) -> DataFrame:
    """Metrics as title-cased name and value rows, missing values left out."""
    names = summary.columns
    rows = F.array(*[F.struct(F.initcap(F.replace(F.lit(c), F.lit("_"), F.lit(" "))).alias("metric"),
                              F.col(c).cast("double").alias("value")) for c in names])
    return summary.select(F.explode(rows).alias("x")).select("x.*").where("value is not null")
