"""Toxicity: a factorization machine over hashed terms."""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from accesslens.llm.common import pieces, stored
from accesslens.llm.labels import held_out, training_labels

BINS = 1 << 20
PREFIXES = (5, 7)
_STRIP = ".,;:!?\"'()[]{}<>|#$%&*+-_/=~"
#: Words whose bins a worker remembers at most; beyond, the memory starts anew. It changes speed only.
REMEMBERED = 300_000
_bins = {}


def word_bins(word):
    """Bins of one blank-separated piece: the bare lower-case word and its prefixes, as crc32 modulo BINS."""
    bare = word.lower().strip(_STRIP)
    if not bare:
        return ()
    terms = [bare] + [bare[:n] + "*" for n in PREFIXES if len(bare) >= n]
    return tuple(zlib.crc32(t.encode()) % BINS for t in terms)


def text_bins(text):
    """All term bins of a text, one entry for each occurrence."""
    out = []
    if len(_bins) > REMEMBERED:
        _bins.clear()
    for word in text.split():
        found = _bins.get(word)
        if found is None:
            found = _bins[word] = word_bins(word)
        out += found
    return np.array(out, np.int64)


def _counts(docs):
    """Training step 1: for each bin the number of toxic and of other documents that have it, summed for each piece."""
    def run(batches):
        for texts, labels in pieces(batches, 0):
            groups = {0: [], 1: []}
            for text, label in zip(texts, labels):
                groups[1 if label else 0].append(np.unique(text_bins(text or "")))
            both = [np.bincount(np.concatenate(g), minlength=BINS) if g else np.zeros(BINS, np.int64)
                    for g in (groups[0], groups[1])]
            at = np.flatnonzero(both[0] + both[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0][at]), pa.array(both[1][at])],
                                             names=["bin", "n0", "n1"])

    return docs.select("text", "label").mapInArrow(run, "bin long, n0 long, n1 long") \
        .groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


class FactorizationMachine:
    """Logistic factorization machine: bias, linear weights and rank-``k`` pairwise weights over selected bins."""

    def __init__(self, bins, bias, weights, factors):
        self.bins, self.bias, self.weights, self.factors = np.asarray(bins, np.int64), bias, weights, factors

    def features(self, found):
        """(positions, values): which selected bins a text has, and 1 + log of how often, scaled by 1/2."""
        at = np.searchsorted(self.bins, found)
        at[at == len(self.bins)] = 0
        hits = at[self.bins[at] == found] if len(self.bins) else at[:0]
        where, n = np.unique(hits, return_counts=True)
        return where, (1 + np.log(n)) / 2

    def margin(self, where, values):
        linear = self.bias + float(self.weights[where] @ values)
        terms = self.factors[where] * values[:, None]
        return linear + 0.5 * float((terms.sum(0) ** 2).sum() - (terms ** 2).sum())

    @classmethod
    def fit(cls, bins, rows, rank=6, epochs=30, rate=0.02, decay=1e-4, batch=256, seed=5):
        """``rows``: (positions, values, label) of the training documents; Adam on the logistic loss."""
        rng, d = np.random.default_rng(seed), len(bins)
        n, ones = len(rows), sum(r[2] for r in rows)
        bias = math.log((ones + 1) / (n - ones + 1))
        if not d or not n:
            return cls(bins, bias, np.zeros(d), np.zeros((d, rank)))
        params = [np.zeros(1) + bias, np.zeros(d), rng.normal(0, 0.05, (d, rank))]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(n)
            for start in range(0, n, batch):
                part = order[start:start + batch]
                x = np.zeros((len(part), d), np.float32)
                for i, j in enumerate(part):
                    x[i, rows[j][0]] = rows[j][1]
                y = np.array([rows[j][2] for j in part], float)
                b, w, v = params
                s = x @ v.astype(np.float32)
                margin = b[0] + x @ w + 0.5 * ((s ** 2).sum(1) - (x ** 2) @ (v ** 2).sum(1))
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(part)
                grads = [np.array([g.sum()]), x.T @ g + decay * w,
                         x.T @ (g[:, None] * s) - ((x ** 2).T @ g)[:, None] * v + decay * v]
                step += 1
                lr = rate * (1 - epoch / epochs * 0.9)
                for p, grad, (m1, m2) in zip(params, grads, moments):
                    m1 += 0.1 * (grad - m1)
                    m2 += 0.001 * (grad ** 2 - m2)
                    p -= lr * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
        return cls(bins, float(params[0][0]), params[1], params[2])


def fit_toxicity(docs, labels, max_rows=40_000, max_terms=2048, common_terms=512, least_documents=5, least_z=4.0, seed=5):
    """Learn from at most ``max_rows`` labelled documents outside fold 0, chosen by hash (docs: doc_id, text).

    The chosen ids and labels are bounded, so they are broadcast and the texts need no shuffle. Step 1 counts every term
    bin over the chosen documents. Features are the bins whose rate among toxic documents differs from that among the
    others (two-proportion z of ``least_z``, the ``max_terms`` strongest), and, whatever they say alone, the
    ``common_terms`` bins that most toxic documents have but not nearly all documents: pairs of terms that mark a toxic
    document only together are learned from these. Step 2 fits the machine on the driver;
    a document brings only the positions of its features, so the driver holds max_rows * max_terms numbers at most.
    """
    known = stored(training_labels(labels, "toxic"), "toxic-labels")
    share = min(1.0, 0.97 * max_rows / max(1, known.count()))
    chosen_rows = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000).limit(max_rows)
    rows = stored(docs.join(F.broadcast(chosen_rows), "doc_id").select("doc_id", "text", "label"), "toxic-training")
    total = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1 = sum(c for k, c in total.items() if k)
    n0 = sum(total.values()) - n1
    if not n0 or not n1:
        return FactorizationMachine.fit([], [((), (), 1)] * min(n1, 1000) + [((), (), 0)] * min(n0, 1000))
    p1, p0 = F.col("n1") / n1, F.col("n0") / n0
    pooled = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = (p1 - p0) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n0 + 1 / n1))
    counts = stored(_counts(rows).where(F.col("n0") + F.col("n1") >= least_documents)
                    .select("bin", "n1", pooled.alias("share"), z.alias("z")), "toxic-terms")
    strong = counts.where(F.abs("z") >= least_z).orderBy(F.abs("z").desc(), "bin").limit(max_terms)
    common = counts.where(F.col("share") < 0.9).orderBy(F.desc("n1"), "bin").limit(common_terms)
    bins = sorted({r["bin"] for part in (strong, common) for r in part.select("bin").collect()})
    empty = FactorizationMachine(bins, 0.0, np.zeros(len(bins)), np.zeros((len(bins), 1)))

    def encode(batches):
        for texts, labels_ in pieces(batches, 0):
            found = [empty.features(text_bins(t or "")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                 pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32())),
                 pa.array(labels_, pa.int32())], names=["positions", "amounts", "label"])

    sample = rows.select("text", "label").mapInArrow(
        encode, "positions array<int>, amounts array<float>, label int").toArrow()
    positions, amounts = sample.column("positions").combine_chunks(), sample.column("amounts").combine_chunks()
    offsets, y = positions.offsets.to_numpy(), sample.column("label").to_numpy()
    flat, values = positions.values.to_numpy(), amounts.values.to_numpy()
    examples = [(flat[a:b], values[a:b], int(bool(k))) for a, b, k in zip(offsets[:-1], offsets[1:], y)]
    return FactorizationMachine.fit(bins, examples, seed=seed)


def toxicity_scores(docs, labels, id_col="doc_id", text_col="text", **options):
    """(doc_id, held_out, score, predicted) of every row of ``docs``, over whole texts.

    Each input row gives one row: repeated rows repeat, a null text counts as empty, a null id is kept. Other columns are
    ignored. An empty text gets the model's bias. Without labels of both classes the score is the smoothed share.
    The model sent to the tasks has (max_terms + common_terms) * (rank + 2) numbers at most.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit_toxicity(source, labels, **options)

    def score(batches):
        for ids, texts in pieces(batches):
            margins = np.array([model.margin(*model.features(text_bins(t or ""))) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(margins, -500, 500))))],
                names=["doc_id", "score"])

    return (source.mapInArrow(score, "doc_id long, score double")
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
