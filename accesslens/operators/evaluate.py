"""Detector evaluation. Counts and ratios are one-pass aggregates; rank statistics use binned prefixes."""

from pyspark.sql import DataFrame, functions as F

from accesslens import constants as C
from accesslens.plans.ranks import cut_rows, exact_quantiles, prefix_by_value, within_cut
from accesslens.plans.tables import local_table


def ratio(num, den):
    """num / den, 0 where the denominator is 0."""
    return F.when(den == 0, 0.0).otherwise(num / den)


def confusion_counts(df: DataFrame, keys=(), actual="y_true", predicted="y_pred") -> DataFrame:
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    aggs = [F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"),
            F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and false-positive rate from confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": fp / F.greatest(fp + tn, F.lit(1)),
    })


def score_groups(df: DataFrame, score, actual="y_true") -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(F.col(score).alias("v")).agg(
        F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) == 0).alias("neg"))


def auc_roc(df: DataFrame, score, actual="y_true") -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null if one class is missing."""
    ranked = prefix_by_value(score_groups(df, score, actual), [], ["neg"])
    total = F.sum("pos") * F.sum("neg")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return ranked.agg(F.when(total > 0, wins / total).alias("auc_roc"))


def roc_curve(df: DataFrame, score, actual="y_true") -> DataFrame:
    """One point per distinct threshold: rates of events scored at or above it."""
    ranked = prefix_by_value(score_groups(df, score, actual), [], ["pos", "neg"], descending=True)
    totals = df.agg(F.count_if(F.col(actual) == 1).alias("_p"), F.count_if(F.col(actual) == 0).alias("_n"))
    return ranked.crossJoin(F.broadcast(totals)).select(
        F.col("v").alias("threshold"),
        ratio(F.col("neg_before") + F.col("neg"), F.col("_n")).alias("fpr"),
        ratio(F.col("pos_before") + F.col("pos"), F.col("_p")).alias("tpr"))


def precision_at(df: DataFrame, score, fractions, actual="y_true", key="event_id") -> DataFrame:
    """Share of anomalies among the top max(1, int(n * fraction)) events; ties are cut by key.

    All cuts come from one selection and all shares from one aggregation pass.
    """
    total = df.count()
    order = F.col(score).cast("double")
    sizes = {f: min(max(1, int(total * f)), total) for f in fractions}
    cuts = cut_rows(df, order, key, list(sizes.values()), descending=True) if total else {}
    rows = df.agg(*[
        F.avg(F.when(within_cut(order, key, cuts.get(k), True), F.col(actual).cast("double"))).alias(f"p{i}")
        for i, k in enumerate(sizes.values())])
    return rows.select(F.explode(F.array(*[
        F.struct(F.lit(float(f)).alias("fraction"), F.lit(k).cast("long").alias("k"), F.col(f"p{i}").alias("precision"))
        for i, (f, k) in enumerate(sizes.items())])).alias("x")).select("x.*")


def pair_counts(df: DataFrame, actual="label", predicted="predicted_label") -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, labels=None, actual="label", predicted="predicted_label") -> DataFrame:
    """Every pair of labels with its count, 0 where unseen. Labels: the given ones, or all that occur."""
    pairs = pair_counts(df, actual, predicted)
    if labels:
        names = local_table(df.sparkSession, [(x,) for x in labels], "name string")
    else:
        names = present_labels(pairs)
    # The grid is labels x labels, a handful of rows.
    grid = names.select(F.col("name").alias("actual")).join(names.select(F.col("name").alias("predicted")), how="cross")
    return grid.join(pairs, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def present_labels(pairs: DataFrame) -> DataFrame:
    """Labels that occur as actual or predicted value."""
    return pairs.select(F.col("actual").alias("name")).union(pairs.select("predicted")).distinct()


def per_class(df: DataFrame, labels=None, actual="label", predicted="predicted_label") -> DataFrame:
    """Precision, recall, F1 and support per label."""
    pairs = pair_counts(df, actual, predicted)
    side = F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p"))))
    flat = pairs.select("actual", "predicted", "n", side.alias("s")).groupBy(F.col("s.label").alias("label")).agg(
        F.sum(F.col("n") * F.col("s.a")).alias("support"),
        F.sum(F.col("n") * F.col("s.p")).alias("predicted"),
        F.sum(F.when((F.col("actual") == F.col("predicted")) & (F.col("s.a") == 1), F.col("n")).otherwise(0)).alias("hit"))
    if labels:
        names = local_table(df.sparkSession, [(x,) for x in labels], "label string")
        flat = names.join(flat, "label", "left").na.fill(0, ["support", "predicted", "hit"])
    return flat.select(
        "label", ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"),
        F.col("support").cast("long").alias("support"), "hit")


def classification_report(df: DataFrame, labels=None, actual="label", predicted="predicted_label") -> DataFrame:
    """Per class rows, then accuracy, macro and weighted averages."""
    classes = per_class(df, labels, actual, predicted)
    n = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / n
    sums = classes.agg(
        n.alias("support"), (F.sum("hit") / n).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")])
    row = lambda name, p, r, f: F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"))
    averages = sums.select(F.explode(F.array(
        row("accuracy", F.col("acc"), F.col("acc"), F.col("acc")),
        row("macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")),
        row("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")))).alias("x"), "support")
    return classes.drop("hit").unionByName(averages.select("x.*", F.col("support").cast("long").alias("support")))


def attack_recall(df: DataFrame, actual="label", predicted="predicted_label") -> DataFrame:
    """Per attack type: share named exactly, share flagged at all, number of events."""
    return (df.where(F.col(actual) != "normal").groupBy(F.col(actual).alias("label")).agg(
        F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("exact_recall"),
        F.avg((F.col(predicted) != "normal").cast("double")).alias("binary_recall"),
        F.count("*").alias("events")))


def percentile_flag(df: DataFrame, score, name, p=C.FLAG_PERCENTILE) -> DataFrame:
    """1 where the score exceeds the exact percentile of this frame."""
    cut = exact_quantiles(df, [], score, [p]).select(F.col("q").alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn(name, (F.col(score) > F.col("_cut")).cast("long")).drop("_cut")


def long_predictions(df: DataFrame, models, actual="y_true") -> DataFrame:
    """One row per model and event from flag columns: ``models`` maps a model name to its flag column."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(flag).cast("long").alias("y_pred")) for name, flag in models.items()]))
    return df.select("event_id", actual, pairs.alias("m")).select("event_id", actual, "m.model", "m.y_pred")


def model_comparison(predictions: DataFrame, digits=4) -> DataFrame:
    """One rounded metrics row per model."""
    metrics = binary_metrics(confusion_counts(predictions, ["model"]))
    return metrics.select("model", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def best_model(comparison: DataFrame) -> DataFrame:
    """The model with the highest F1; equal ones by name."""
    best = F.min(F.struct((-F.col("f1")).alias("k"), F.col("model"), F.col("f1")))
    return comparison.agg(best.alias("b")).select("b.model", "b.f1")


def evaluation_summary(df: DataFrame, score="risk_score", digits=4) -> DataFrame:
    """The flat result row: binary metrics, AUC, F1 averages, false-positive rate and counts."""
    flags = df.select("event_id", score, "label", "predicted_label",
                      (F.col("label") != "normal").cast("long").alias("y_true"),
                      (F.col("predicted_label") != "normal").cast("long").alias("y_pred"))
    counts = confusion_counts(flags)
    binary = binary_metrics(counts)
    report = classification_report(flags)
    f1 = report.agg(F.max(F.when(F.col("label") == "macro avg", F.col("f1"))).alias("f1_macro"),
                    F.max(F.when(F.col("label") == "weighted avg", F.col("f1"))).alias("f1_weighted"))
    r = lambda c, name=None: F.round(c, digits).alias(name or c)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return (binary.crossJoin(F.broadcast(auc_roc(flags, score))).crossJoin(F.broadcast(f1)).select(
        r("accuracy", "binary_accuracy"), r("precision", "binary_precision"), r("recall", "binary_recall"),
        r("f1", "binary_f1"), r("auc_roc"), r("f1_macro"), r("f1_weighted"), r("false_positive_rate"),
        total.cast("long").alias("total_events"), (F.col("tp") + F.col("fn")).cast("long").alias("total_anomalies"),
        F.round((F.col("tp") + F.col("fn")) / total, digits).alias("anomaly_rate")))
