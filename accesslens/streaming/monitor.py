"""Running totals and the latest-events feed over replayed alerts."""

from pyspark.sql import DataFrame, functions as F

from accesslens import constants as C
from accesslens.plans.segments import ID, TS
from accesslens.session import scratch_path
from accesslens.streaming.replay import run_available


def running_totals(alerts: DataFrame) -> DataFrame:
    """Streaming aggregate: events, Critical, High and the share above the anomaly threshold."""
    n = F.count("*")
    return alerts.groupBy().agg(
        n.alias("processed"), F.count_if(F.col("severity") == "Critical").alias("critical"),
        F.count_if(F.col("severity") == "High").alias("high"),
        (F.try_divide(F.count_if(F.col("risk_score") > C.ANOMALY_RISK), n) * 100).alias("anomaly_rate_pct"))


def _versions(df: DataFrame, name, merge, mode="append") -> DataFrame:
    """Run a stream whose every micro-batch writes a new version of a small table; the last version, or an empty one.

    ``merge(batch, before)`` makes the version; ``before`` is the version of the last batch. Versions are never
    overwritten by a later one, and writing a repeated batch again gives the same version.
    """
    spark = df.sparkSession
    base = scratch_path(spark, name)
    last = {"batch": None}

    def write(batch, number):
        before = spark.read.schema(df.schema).parquet(f"{base}/v{number - 1}") if number > 0 else None
        merge(batch, before).write.mode("overwrite").parquet(f"{base}/v{number}")
        last["batch"] = number

    run_available(df, name, mode=mode, each_batch=write, ordered=True)
    if last["batch"] is None:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{base}/v{last['batch']}")


def totals_to_table(alerts: DataFrame) -> DataFrame:
    """The newest totals as a one-row table; complete mode brings all of them with every micro-batch."""
    return _versions(running_totals(alerts), "totals", lambda batch, before: batch, mode="complete")


def latest_feed(alerts: DataFrame, n=20) -> DataFrame:
    """The newest ``n`` events so far: version b = top n of (version b-1, batch b)."""
    newest = lambda df: df.orderBy(F.col(TS).desc(), F.col(ID).desc()).limit(n)
    return _versions(alerts, "feed", lambda batch, before: newest(
        batch if before is None else before.unionByName(newest(batch))))
