"""Hard-negative mining: exact integer scores by Strassen multiplication of tiles, positive and window heaps."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from accesslens.llm.common import stored

#: Rows in a block of anchors or candidates; every pair of blocks is one unit of work.
BLOCK_ROWS = 16_384
TILE_ANCHORS = 256
TILE_ROWS = 2048
#: Matrices with a side of at most this are multiplied directly.
LEAF = 32
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def integers(batch, scale):
    """floor(scale * x) of every component of a list column as a matrix, shorter rows padded with zeros.

    int64 where every inner product surely fits it, else Python integers (extreme components), which stay exact.
    """
    batch = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    lengths = np.diff(batch.offsets.to_numpy())
    values = np.floor(batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    width = int(lengths.max()) if len(lengths) else 0
    inside = np.arange(width)[None, :] < lengths[:, None]
    largest = float(np.abs(values).max()) if len(values) else 0.0
    if largest * largest * max(1, width) < 2.0 ** 61:
        matrix = np.zeros((len(lengths), width), np.int64)
        matrix[inside] = values.astype(np.int64)
    else:
        matrix = np.zeros((len(lengths), width), object)
        matrix[inside] = [int(v) for v in values]
    return matrix


def strassen(a, b):
    """a @ b by Strassen's seven products: exact, because only integers are added and multiplied.

    Sides are padded with zeros to a common multiple of two to the depth. int64 sums of halves may wrap around; the
    result is right modulo 2^64 and so exact whenever the true products fit.
    """
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    depth = max(0, math.ceil(math.log2(max(1, min(rows, inner, columns)) / LEAF)))
    step = 1 << depth

    def padded(m):
        shape = tuple(-(-side // step) * step for side in m.shape)
        if shape == m.shape:
            return m
        wide = np.zeros(shape, m.dtype)
        wide[:m.shape[0], :m.shape[1]] = m
        return wide

    return _strassen(padded(a), padded(b), depth)[:rows, :columns]


def _strassen(a, b, depth):
    if depth == 0:
        return a @ b
    n, k, m = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:n, :k], a[:n, k:], a[n:, :k], a[n:, k:]
    b11, b12, b21, b22 = b[:k, :m], b[:k, m:], b[k:, :m], b[k:, m:]
    p1 = _strassen(a11 + a22, b11 + b22, depth - 1)
    p2 = _strassen(a21 + a22, b11, depth - 1)
    p3 = _strassen(a11, b12 - b22, depth - 1)
    p4 = _strassen(a22, b21 - b11, depth - 1)
    p5 = _strassen(a11 + a12, b22, depth - 1)
    p6 = _strassen(a21 - a11, b11 + b12, depth - 1)
    p7 = _strassen(a12 - a22, b21 + b22, depth - 1)
    out = np.empty((2 * n, 2 * m), p1.dtype)
    out[:n, :m], out[:n, m:] = p1 + p4 - p5 + p7, p3 + p5
    out[n:, :m], out[n:, m:] = p2 + p4, p1 - p2 + p3 + p6
    return out


class Heaps:
    """The first ``size`` (score, candidate) of each of ``count`` heaps, higher scores first, then earlier candidates.

    Candidates must be offered in ascending order, so an equal score never displaces one that a heap holds.
    """

    def __init__(self, count, size, dtype):
        self.size, self.heap = size, np.empty(0, np.int64)
        self.scores, self.candidates = np.empty(0, dtype), np.empty(0, np.int64)
        self.full, self.worst = np.zeros(count, bool), np.zeros(count, dtype)

    def offer(self, scores, allowed, low, high, candidates):
        """Merge the scores of a tile (one heap a row) that are allowed and within [low, high] of their row."""
        fits = allowed & (scores >= low[:, None]) & (scores <= high[:, None])
        fits &= ~self.full[:, None] | (scores > self.worst[:, None])
        i, j = np.nonzero(fits)
        if not len(i):
            return
        heap, scores = np.concatenate([self.heap, i]), np.concatenate([self.scores, scores[i, j]])
        candidates = np.concatenate([self.candidates, candidates[j]])
        # Stable sorts keep candidates in their order; ~score falls as the score rises.
        order = np.argsort(~scores, kind="stable")
        order = order[np.argsort(heap[order], kind="stable")]
        heap, scores, candidates = heap[order], scores[order], candidates[order]
        starts = np.flatnonzero(np.concatenate([[True], heap[1:] != heap[:-1]]))
        place = np.arange(len(heap)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(heap)]])))
        kept, last = place < self.size, place == self.size - 1
        self.heap, self.scores, self.candidates = heap[kept], scores[kept], candidates[kept]
        self.full[heap[last]], self.worst[heap[last]] = True, scores[last]


def _joined(parts):
    """(numbers, scores, candidates) of several heaps, given with the number of each heap."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, object), np.empty(0, np.int64)
    return (np.concatenate([numbers[h.heap] for numbers, h in parts]),
            np.concatenate([h.scores.astype(object) for _, h in parts]),
            np.concatenate([h.candidates for _, h in parts]))


def unit_positives(x, labels, rows, y, y_labels, y_rows, size):
    """(anchor, score, candidate) of the first same-label candidates of each anchor, itself left out.

    Candidates are in order of id. A score that a long cannot hold is not ranked.
    """
    parts = []
    by_label = np.argsort(y_labels, kind="stable")
    for label in np.unique(labels):
        mine = np.flatnonzero(labels == label)
        theirs = by_label[slice(*np.searchsorted(y_labels[by_label], [label, label + 1]))]
        turned = np.ascontiguousarray(y[theirs].T)
        for a in range(0, len(mine), TILE_ANCHORS):
            stripe = mine[a:a + TILE_ANCHORS]
            heaps = Heaps(len(stripe), size, x.dtype)
            low, high = np.full(len(stripe), _LOW, x.dtype), np.full(len(stripe), _HIGH, x.dtype)
            for b in range(0, len(theirs), TILE_ROWS):
                offered = theirs[b:b + TILE_ROWS]
                heaps.offer(strassen(x[stripe], turned[:, b:b + TILE_ROWS]),
                            rows[stripe][:, None] != y_rows[offered][None, :], low, high, offered)
            parts.append((stripe, heaps))
    return _joined(parts)


def unit_windows(x, labels, anchors, tops, y, y_labels, size, percent):
    """(slot, score, candidate) of the first other-label candidates in the score window of each slot.

    Slot i belongs to anchor ``anchors[i]`` (ascending) and to a positive that scores ``tops[i]``: its window holds the
    scores with percent * top <= 100 * score <= 100 * top, none if the top is negative.
    """
    parts, turned = [], np.ascontiguousarray(y.T)
    low = np.array([-(-percent * int(top) // 100) for top in tops], x.dtype)
    high = np.array([int(top) for top in tops], x.dtype)
    for a in range(0, len(x), TILE_ANCHORS):
        slots = np.arange(*np.searchsorted(anchors, [a, a + TILE_ANCHORS]))
        if not len(slots):
            continue
        heaps = Heaps(len(slots), size, x.dtype)
        for b in range(0, len(y), TILE_ROWS):
            scores = strassen(x[a:a + TILE_ANCHORS], turned[:, b:b + TILE_ROWS])[anchors[slots] - a]
            offered = np.arange(b, min(len(y), b + TILE_ROWS))
            other = labels[anchors[slots]][:, None] != y_labels[offered][None, :]
            heaps.offer(scores, other, low[slots], high[slots], offered)
        parts.append((slots, heaps))
    return _joined(parts)


def _same_type(a, b):
    """Both matrices padded to one width and of one type, int64 where every inner product fits it."""
    width = max(a.shape[1], b.shape[1])
    dtype = object if object in (a.dtype, b.dtype) else np.int64
    if dtype is np.int64 and a.size and b.size and int(np.abs(a).max()) * int(np.abs(b).max()) * width >= 1 << 62:
        dtype = object
    return tuple(np.pad(m.astype(dtype), ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def _units(anchors, candidates, blocks_of_anchors, blocks):
    """Both sides dealt by hash to blocks and sent to every block of the other side; a unit is a pair of blocks."""
    block = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (anchors.withColumn("_mine", block(blocks_of_anchors)).withColumn("_theirs", every(blocks))
            .withColumn("_unit", F.col("_mine") * blocks + F.col("_theirs")).drop("_mine", "_theirs"))
    right = (candidates.withColumn("_theirs", block(blocks)).withColumn("_mine", every(blocks_of_anchors))
             .withColumn("_unit", F.col("_mine") * blocks + F.col("_theirs")).drop("_mine", "_theirs"))
    return left.groupBy("_unit").cogroup(right.groupBy("_unit"))


def _sorted(t, keys):
    return t.combine_chunks().sort_by([(k, "ascending") for k in keys])


def _label_codes(left, right):
    """Labels of both sides as integers that are equal where the labels are."""
    known, codes = np.unique(np.concatenate([left.to_numpy(), right.to_numpy()]), return_inverse=True)
    return codes[:len(left)], codes[len(left):]


def _table(schema, columns):
    return pa.table({field.split()[0]: pa.array(values, pa.int64()) for field, values in zip(schema.split(", "), columns)})


def hard_negatives(anchors, candidates, positives=5, negatives=5, percent=80, scale=256, block_rows=BLOCK_ROWS):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    Both frames have (_row: long, id: long, label: long, embedding: array<double>); ``anchors`` are rows of
    ``candidates``, and ``_row`` tells rows of equal id apart. Scores are inner products of floor(``scale`` * x).

    The matrix of anchors times candidates is cut into units of two blocks of about ``block_rows`` rows, so nothing
    grows with the data in a task. A unit multiplies int64 tiles by Strassen's scheme. A first pass keeps the same-label
    heaps of its anchors, a second the heaps of other-label rows in each positive's window; heaps of all units are merged
    by a ranked window that cuts each partition to the heap size before the shuffle.

    Higher scores come first, ties by smaller id (then row number, for repeated ids). A shorter vector counts as padded
    with zeros. Where an inner product might not fit a long, a unit multiplies Python integers; a pair whose score a long
    cannot hold is not ranked. An empty input, or an anchor without positives or without negatives in its windows, gives
    no rows.
    """
    n_anchors, n_rows = anchors.count(), candidates.count()
    blocks_of_anchors, blocks = max(1, -(-n_anchors // block_rows)), max(1, -(-n_rows // block_rows))
    best = "_row long, positive_id long, _positive long, positive_score long"
    mined = ("_row long, anchor_id long, _place long, positive_id long, positive_score long, negative_id long, "
             "_negative long, negative_score long")

    def prepared(left, right):
        left, right = left.combine_chunks(), right.combine_chunks().sort_by([("id", "ascending"), ("_row", "ascending")])
        x, y = _same_type(integers(left.column("embedding"), scale), integers(right.column("embedding"), scale))
        return left, right, x, y, *_label_codes(left.column("label"), right.column("label"))

    def first_pass(left, right):
        if not len(left) or not len(right):
            return _table(best, [[]] * 4)
        left, right, x, y, labels, y_labels = prepared(left, right)
        rows, y_rows = left.column("_row").to_numpy(), right.column("_row").to_numpy()
        at, scores, found = unit_positives(x, labels, rows, y, y_labels, y_rows, positives)
        return _table(best, [rows[at], right.column("id").take(pa.array(found)).to_pylist(), y_rows[found], scores])

    def second_pass(left, right):
        if not len(left) or not len(right):
            return _table(mined, [[]] * 8)
        left, right, x, y, labels, y_labels = prepared(left, right)
        rows, ids = left.column("_row").to_pylist(), left.column("id").to_pylist()
        slots = [(a, s) for a, held in enumerate(left.column("slots").to_pylist()) for s in held]
        at, scores, found = unit_windows(x, labels, np.array([a for a, _ in slots], np.int64),
                                         [s["positive_score"] for _, s in slots], y, y_labels, negatives, percent)
        mine = [slots[i] for i in at]
        return _table(mined, [[rows[a] for a, _ in mine], [ids[a] for a, _ in mine],
                              *([s[name] for _, s in mine] for name in ("_place", "positive_id", "positive_score")),
                              right.column("id").take(pa.array(found)).to_pylist(),
                              right.column("_row").to_numpy()[found], scores])

    found = _units(anchors, candidates, blocks_of_anchors, blocks).applyInArrow(first_pass, best)
    merged = W.partitionBy("_row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "_positive")
    found = found.withColumn("_place", F.row_number().over(merged)).where(F.col("_place") <= positives)
    slots = F.collect_list(F.struct("_place", "positive_id", "positive_score")).alias("slots")
    ready = stored(anchors.select("_row", "id", "label", "embedding").join(found.groupBy("_row").agg(slots), "_row"),
                   "negative-anchors")
    found = _units(ready, candidates, blocks_of_anchors, blocks).applyInArrow(second_pass, mined)
    merged = W.partitionBy("_row", "_place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "_negative")
    return (found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def mine_embeddings(vectors, id_col="vec_id", label_col="label", vector_col="embedding", anchor_every=100,
                    relabel_every=7, classes=10, **options):
    """``hard_negatives`` of the rows whose id is divisible by ``anchor_every``, against all rows.

    Rows with a null label or vector, or any null or non-finite component, take no part; a null id is no anchor, but a
    candidate, and comes last in ties. Where the id is divisible by ``relabel_every`` the label becomes
    (label + 1) mod ``classes`` first. Repeated rows are rows of their own; other columns are ignored.
    """
    value = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                          value.alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    moved = F.when(F.col("id") % relabel_every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    rows = rows.where(F.col("label").isNotNull() & sound).withColumn("label", moved)
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "negative-rows")
    return hard_negatives(rows.where(F.col("id") % anchor_every == 0), rows, **options)
