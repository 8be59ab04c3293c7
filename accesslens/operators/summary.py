"""Distributions, rollups and key figures over logs, features and alerts."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window, functions as F

from accesslens import constants as C
from accesslens.plans.ranks import exact_quantiles
from accesslens.plans.segments import KEY, TS
from accesslens.plans.tables import local_table


def alert_summary(alerts: DataFrame) -> DataFrame:
    tier = lambda name: F.count_if(F.col("severity") == name)
    return alerts.agg(
        F.count_if(F.col("risk_score") > C.ALERT_RISK).alias("total_alerts"),
        *[tier(name).alias(name.lower()) for name, *_ in C.SEVERITY_TIERS],
        F.avg("risk_score").alias("avg_risk_score"), F.max("risk_score").alias("max_risk_score"),
        F.count_distinct(F.when(F.col("risk_score") > C.ANOMALY_RISK, F.col(KEY))).alias("unique_entities_flagged"))


def overview(alerts: DataFrame) -> DataFrame:
    flagged = F.count_if(F.col("risk_score") > C.ANOMALY_RISK)
    return alerts.agg(F.count("*").alias("total_events"), flagged.alias("anomalies"),
                      (flagged / F.count("*") * 100).alias("anomaly_rate_pct"),
                      F.count_distinct(KEY).alias("entities"), F.avg("risk_score").alias("avg_risk"))


def distribution(df: DataFrame, column) -> DataFrame:
    """Counts with their share of the total in percent (the window runs over the few counted rows)."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_t") * 100).alias("pct"))


def tiers_table(spark):
    return local_table(spark, [(n, i) for i, (n, *_) in enumerate(C.SEVERITY_TIERS)], "severity string, tier_order long")


def severity_distribution(alerts: DataFrame) -> DataFrame:
    """All four tiers, 0 where none."""
    counts = alerts.groupBy("severity").agg(F.count("*").alias("n"))
    return tiers_table(alerts.sparkSession).join(counts, "severity", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def severity_truth(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(
        F.count("*").alias("events"), F.avg((F.col("label") != "normal").cast("double")).alias("anomaly_rate"))


def daily_rollup(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.date_format(TS, "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("events"), F.count_if(F.col("risk_score") > C.ANOMALY_RISK).alias("anomalies"),
        F.avg("risk_score").alias("avg_risk"))


def daily_volume(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_format(TS, "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("events"), F.count_if(F.col("label") != "normal").alias("anomalous"))


def hourly_histogram(log: DataFrame) -> DataFrame:
    """24 rows: normal and anomalous events per hour."""
    hours = log.sparkSession.range(24).select(F.col("id").alias("hour"))
    counts = log.groupBy(F.hour(TS).cast("long").alias("hour")).agg(
        F.count_if(F.col("label") == "normal").alias("normal"), F.count_if(F.col("label") != "normal").alias("anomalous"))
    return hours.join(counts, "hour", "left").na.fill(0)


def histogram(df: DataFrame, column, bins=50, clip=None, keys=()) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; with density per key."""
    x = F.col(column).cast("double")
    x = F.least(x, F.lit(float(clip))) if clip is not None else x
    data = df.select(*keys, x.alias("_x"))
    ends = data.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    bin_no = F.least(F.floor((F.col("_x") - F.col("lo")) / width), F.lit(bins - 1)).cast("long")
    counts = (data.crossJoin(F.broadcast(ends)).groupBy(*keys, bin_no.alias("bin"), "lo", "hi")
              .agg(F.count("*").alias("n")))
    total = F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)])))
    return counts.select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"), "n",
                         (F.col("n") / (total * width)).alias("density"))


def label_crosstab(log: DataFrame) -> DataFrame:
    return log.groupBy("entity_type").pivot("label", C.LABELS).agg(F.count("event_id")).na.fill(0)


def auth_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("auth_method").agg(F.count("*").alias("n"))


def auth_success_by_label(log: DataFrame) -> DataFrame:
    return log.groupBy("label").agg(F.avg(F.col("auth_success").cast("double")).alias("success_rate"))


def imbalance(log: DataFrame) -> DataFrame:
    counts = log.groupBy("label").agg(F.count("*").alias("n"))
    return counts.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), (F.max("n") / F.min("n")).alias("ratio"))


def class_weights(log: DataFrame) -> DataFrame:
    """N / (classes * count) per label."""
    counts = log.groupBy("label").agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("_t"), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(totals)).select(
        "label", "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("class_weight"))


def entity_cards(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(KEY).agg(
        F.min("entity_type").alias("entity_type"), F.count("*").alias("events"),
        F.count_if(F.col("risk_score") > C.ANOMALY_RISK).alias("anomalies"), F.avg("risk_score").alias("avg_risk"))


def box_stats(df: DataFrame, keys, value, clip=None) -> DataFrame:
    """Minimum, quartiles and maximum per group, exact and without a per-group value map."""
    x = F.col(value).cast("double")
    x = x if clip is None else F.greatest(F.least(x, F.lit(float(clip))), F.lit(-float(clip)))
    q = exact_quantiles(df.select(*keys, x.alias("_x")), keys, "_x", [0.0, 0.25, 0.5, 0.75, 1.0])
    names = {0.0: "low", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "high"}
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in names.items()])


def mean_score_by_attack(df: DataFrame, score) -> DataFrame:
    """Average score of every attack type, 0 where a type has no events."""
    names = local_table(df.sparkSession, [(a,) for a in C.ATTACKS], "label string")
    means = df.groupBy("label").agg(F.avg(score).alias("mean_score"))
    return names.join(means, "label", "left").withColumn("mean_score", F.coalesce("mean_score", F.lit(0.0)))


def correlations(df: DataFrame, names, minimum=None) -> DataFrame:
    """Pearson correlation of every pair of columns, from one distributed Gramian; null for a constant column.

    Only the names x names matrix reaches the driver.
    """
    vectors = VectorAssembler(inputCols=list(names), outputCol="_v").transform(df).select("_v")
    matrix = Correlation.corr(vectors, "_v").first()[0].toArray()
    rows = []
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            r = float(matrix[i, j])
            rows.append((a, names[j], None if r != r else r))
    if minimum is not None:
        rows = [x for x in rows if x[2] is not None and abs(x[2]) > minimum]
    return local_table(df.sparkSession, rows, "feature_a string, feature_b string, r double")


def travel_totals(alerts: DataFrame) -> DataFrame:
    hit = F.col("predicted_label") == "impossible_travel"
    return alerts.where(hit).agg(F.count("*").alias("events"), F.count_distinct(KEY).alias("entities"))


def split_summary(split: DataFrame) -> DataFrame:
    """Per split: size, anomalies, entities and date range."""
    return split.groupBy("split").agg(
        F.count("*").alias("events"), F.count_if(F.col("label") != "normal").alias("anomalies"),
        F.count_distinct(KEY).alias("entities"),
        F.date_format(F.min(TS), "yyyy-MM-dd HH:mm:ss").alias("first_event"),
        F.date_format(F.max(TS), "yyyy-MM-dd HH:mm:ss").alias("last_event"))
