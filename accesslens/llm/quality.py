"""Quality classifier: a sparse rule ensemble over text statistics, scored by Spark column expressions."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from accesslens.llm.common import pieces, stored
from accesslens.llm.labels import training_labels

_CLASSES = {
    "letters": [*range(65, 91), *range(97, 123)],
    "upper": [*range(65, 91)],
    "digits": [*range(48, 58)],
    "spaces": [32, 9, 13],
    "sentence_marks": [ord(c) for c in ".,;:'\"-()"],
    "loud_marks": [ord(c) for c in "!?"],
    "odd_marks": [ord(c) for c in "#$%&*+/<=>@\\^_`|~[]{}"],
    "pipes": [ord("|")],
}
#: Statistics of a text, in order; shares are of its bytes unless named otherwise.
STATISTICS = ["log_bytes", "log_words", "word_length", *_CLASSES, "not_ascii", "lines_per_word", "repeated_words",
              "repeated_lines", "line_words", "marks_per_word", "byte_entropy"]


def _masks():
    masks = np.zeros((256, len(_CLASSES)))
    for k, members in enumerate(_CLASSES.values()):
        masks[members, k] = 1
    return masks


def text_statistics(text, masks):
    """The numbers named in STATISTICS; an empty text has zeros throughout."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts @ masks / len(raw)
    words, lines = text.split(), text.split("\n")
    n, p = max(1, len(words)), counts[counts > 0] / len(raw)
    marks = float(shares[4] + shares[5] + shares[6]) * len(raw) / n
    return [math.log1p(len(raw)), math.log1p(len(words)), len(text) / n, *map(float, shares),
            float(counts[128:].sum() / len(raw)), len(lines) / n, 1 - len(set(words)) / n,
            1 - len(set(lines)) / len(lines), n / len(lines), marks, float(-(p * np.log2(p)).sum())]


def statistics_table(docs, id_col="doc_id", text_col="text"):
    """(doc_id, statistics: array of doubles) of every row, over the whole text; a null text counts as empty."""
    def run(batches):
        masks = _masks()
        for ids, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()),
                 pa.array([text_statistics(t or "", masks) for t in texts], pa.list_(pa.float64()))],
                names=["doc_id", "statistics"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, statistics array<double>"))


def with_statistics(docs, name, text_col="text"):
    """All columns of ``docs`` and the statistics of its text, computed in one pass over the texts."""
    at = docs.columns.index(text_col)

    def run(batches):
        masks = _masks()
        for batch in batches:
            values = [text_statistics(t or "", masks) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64()))],
                                             names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def tree_rules(tree):
    """Every path of a Spark ML tree from its root to an inner node or leaf, as a set of (feature, is_above, threshold)."""
    rules, path = [], []
    for line in tree.toDebugString.split("\n"):
        depth = (len(line) - len(line.lstrip())) // 1
        match = re.search(r"(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if match:
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (int(match[2]), match[3] == ">", float(match[4]))))
            rules.append(frozenset(condition for _, condition in path))
    return rules


def rule_column(rule, statistics):
    """A rule as a Spark condition."""
    out = F.lit(True)
    for feature, above, threshold in sorted(rule):
        value = statistics[feature]
        out = out & (value > threshold if above else value <= threshold)
    return out


class RuleEnsemble:
    """``rules`` with ``weights`` and an intercept; compiles to one probability column."""

    def __init__(self, rules, weights, intercept):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def score(self, statistics):
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule_column(rule, statistics), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    @classmethod
    def fit(cls, rows, trees=12, depth=4, penalty=0.002, seed=17):
        """``rows``: label (0/1), statistics. Rules come from a random forest, weights from lasso logistic regression.

        All labelled rows are used. With no row the score is 0.5 throughout, with a single class that class's share
        (0 or 1) softened by one row of each class.
        """
        found = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(found) < 2:
            n, ones = sum(found.values()), found.get(1, 0)
            return cls([], [], math.log((ones + 1) / (n - ones + 1)))
        vectors = rows.select(F.col("label").cast("double").alias("label"),
                              array_to_vector("statistics").alias("features"))
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed,
                                        featureSubsetStrategy="0.5").fit(vectors)
        rules = sorted({r for t in forest.trees for r in tree_rules(t)}, key=sorted)
        if not rules:
            n, ones = sum(found.values()), found.get(1, 0)
            return cls([], [], math.log((ones + 1) / (n - ones + 1)))
        flags = F.array(*[rule_column(r, F.col("statistics")).cast("double") for r in rules])
        binary = rows.select(F.col("label").cast("double").alias("label"), array_to_vector(flags).alias("features"))
        fitted = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(binary)
        kept = [(r, w) for r, w in zip(rules, fitted.coefficients.toArray()) if w]
        return cls([r for r, _ in kept], [w for _, w in kept], fitted.intercept)


def _fitted(table, labels, label_col):
    return RuleEnsemble.fit(stored(table.join(training_labels(labels, label_col), "doc_id")
                                   .select("label", "statistics"), "quality-training"))


def quality_scores(docs, labels, id_col="doc_id", text_col="text", label_col="quality", cut=0.3):
    """(doc_id, held_out, score, predicted) of every row of ``docs``; learned from the labels outside fold 0.

    One pass over the texts writes their statistics; training and scoring read those. Each input row gives one row:
    repeated rows repeat, a null text counts as empty, a null id is kept. Other columns are ignored. Without labels the
    score is 0.5.
    """
    from accesslens.llm.labels import held_out

    table = stored(statistics_table(docs, id_col, text_col), "quality-statistics")
    model = _fitted(table, labels, label_col)
    score = model.score(F.col("statistics"))
    return (table.select("doc_id", held_out().alias("held_out"), score.alias("score"))
            .withColumn("predicted", (F.col("score") >= cut).cast("int")))


def keep_good(docs, labels, id_col="doc_id", text_col="text", label_col="quality", cut=0.3):
    """The rows of ``docs`` whose own text scores ``cut`` or more, with all their columns.

    The model is that of ``quality_scores``. Each row is judged by its text alone, so repeated and null ids need no
    care; no text is shuffled. An input column ``_statistics`` is dropped while scoring.
    """
    rows = docs.drop("_statistics")
    table = stored(statistics_table(rows, id_col, text_col), "quality-statistics")
    model = _fitted(table, labels, label_col)
    scored = with_statistics(rows, "_statistics", text_col)
    return scored.where(model.score(F.col("_statistics")) >= cut).drop("_statistics")
