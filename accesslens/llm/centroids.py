"""Centroid clustering in exact integers: PCA-rotated coordinates and residual norms rule most centroids out."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from accesslens.llm.common import stored

#: Rotated coordinates that are stored; the rest of a vector is kept as one norm.
LEADING = 16
#: Components below this keep every squared distance and its sums over a batch within a long.
_PLAIN = 1 << 24


def _matrix(column, dim):
    """An integer matrix of a column of lists of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def rotation(points, dim):
    """(mean, orthogonal axes by falling variance) of the points, from sums of a pass over all of them."""
    def moments(batches):
        total = np.zeros((dim + 1, dim))
        count = 0
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype(float)
            total[0] += x.sum(0)
            total[1:] += x.T @ x
            count += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim + 1), pa.int32()), pa.array([count] * (dim + 1), pa.int64()),
             pa.array(list(total), pa.list_(pa.float64()))], names=["i", "n", "row"])

    sums = [F.sum(F.get("row", F.lit(j))) for j in range(dim)]
    rows = (points.select("v").mapInArrow(moments, "i int, n long, row array<double>")
            .groupBy("i").agg(F.sum("n").alias("n"), F.array(*sums).alias("row")).orderBy("i").collect())
    total, n = np.array([r["row"] for r in rows]), max(1, rows[0]["n"])
    mean = total[0] / n
    spread = total[1:] / n - np.outer(mean, mean)
    if not np.isfinite(spread).all():
        return np.zeros(dim), np.eye(dim)
    return mean, np.linalg.eigh(spread)[1][:, ::-1]


def project(x, mean, axes, leading):
    """Leading rotated coordinates of each row of ``x`` and the norm of what they leave out."""
    turned = (x.astype(float) - mean) @ axes
    return turned[:, :leading], np.sqrt((turned[:, leading:] ** 2).sum(1))


def nearest(x, coordinates, rest, centroids, mean, axes):
    """(number, squared distance) of the nearest centroid of each row in integers, ties to the smaller number.

    The squared distance in the leading coordinates plus the squared difference of the residual norms never exceeds the
    true one. The centroid with the least bound is measured first; only centroids whose bound, less a slack for
    rounding, does not exceed that exact distance are measured as well.
    """
    largest = max(int(np.abs(x.astype(float)).max(initial=0)), max((abs(int(c)) for c in centroids.flat), default=0))
    dtype = np.int64 if largest < _PLAIN else object
    x, centroids = x.astype(dtype), centroids.astype(dtype)

    def measure(i, c):
        difference = x[i] - centroids[c]
        return (difference * difference).sum(1)

    place, tail = project(centroids, mean, axes, coordinates.shape[1])
    own, other = (coordinates ** 2).sum(1)[:, None], (place ** 2).sum(1)[None, :]
    bound = own + other - 2 * coordinates @ place.T + (rest[:, None] - tail[None, :]) ** 2
    # Rounding grows with the squares that cancel and with the size of the vectors before they were centred.
    bound -= 1e-9 * (own + other + rest[:, None] ** 2 + tail[None, :] ** 2) + 1e-12 * (x.shape[1] * float(largest) ** 2 + 1)
    best = np.argmin(bound, axis=1)
    least = measure(np.arange(len(x)), best)
    open_ = bound <= least.astype(float)[:, None] * (1 + 1e-12)
    open_[np.arange(len(x)), best] = False
    for c in np.flatnonzero(open_.any(axis=0)):
        i = np.flatnonzero(open_[:, c])
        d = measure(i, np.full(len(i), c))
        better = (d < least[i]) | ((d == least[i]) & (c < best[i]))
        best[i[better]], least[i[better]] = c, d[better]
    return best, least


def _point_columns(batch, dim):
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    return _matrix(column("v"), dim), _matrix(column("near"), min(LEADING, dim)), column("rest").to_numpy()


def _moved(points, centroids, mean, axes):
    """The next centroids: componentwise floor of sum / count over the nearest points; an empty one stays."""
    dim = centroids.shape[1]

    def add(batches):
        counts, totals = [0] * len(centroids), np.zeros(centroids.shape, object)
        for batch in batches:
            x, near, rest = _point_columns(batch, dim)
            best, _ = nearest(x, near, rest, centroids, mean, axes)
            plain = len(x) and np.abs(x.astype(float)).max() < _PLAIN
            for c in np.unique(best):
                part = x[best == c]
                counts[c] += len(part)
                totals[c] += (part if plain else part.astype(object)).sum(0).astype(object)
        held = [c for c, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array([counts[c] for c in held], pa.int64()),
             pa.array([[str(t) for t in totals[c]] for c in held], pa.list_(pa.string()))], names=["c", "n", "sums"])

    total = [F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).cast("string") for j in range(dim)]
    rows = (points.select("v", "near", "rest").mapInArrow(add, "c int, n long, sums array<string>")
            .groupBy("c").agg(F.sum("n").alias("n"), F.array(*total).alias("sums")).collect())
    moved = centroids.copy()
    for r in rows:
        moved[r["c"]] = [int(s) // r["n"] for s in r["sums"]]
    return moved


def _assigned(points, centroids, mean, axes):
    dim = centroids.shape[1]

    def assign(batches):
        for batch in batches:
            x, near, rest = _point_columns(batch, dim)
            best, least = nearest(x, near, rest, centroids, mean, axes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.int32()),
                 pa.array([int(d) if d < 1 << 63 else None for d in least], pa.int64())],
                names=["vec_id", "cluster", "distance"])

    return points.select("vec_id", "v", "near", "rest").mapInArrow(assign, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors, id_col="vec_id", vector_col="embedding", k=16, rounds=3, dim=64, scale=64, seed=1):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; a component x becomes floor(``scale`` * x)
    (one that a long cannot hold becomes the nearest long). The first centroids are the ``k`` vectors with the smallest
    sha256 of ``seed:id`` (null ids last, repeated ids by their vectors), fewer if fewer are kept. All sums, means and
    distances are exact integers; ties go to the smaller number. A distance or inertia that a long cannot hold is null.

    The rotated coordinates are fitted on all vectors and written once with the integers; each round is one pass over
    that table, of which k counts and sums reach the driver. k and dim bound everything outside the tasks. Repeated rows
    are vectors of their own, other columns are ignored, an empty input gives an empty result.
    """
    value = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = (F.size(vector_col) == dim) & F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = stored(vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), value.alias("v")), "points")
    first = (kept.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
             .orderBy(F.asc_nulls_last("h"), "v").limit(k).collect())
    shape = "cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        empty = [F.lit(None).cast(kind).alias(name) for name, kind in (f.split() for f in f"cluster int, distance long, {shape}".split(", "))]
        return kept.select("vec_id", *empty)
    centroids = np.array([r["v"] for r in first], object)
    mean, axes = rotation(kept, dim)
    leading = min(LEADING, dim)

    def rotate(batches):
        for batch in batches:
            near, rest = project(_matrix(batch.column(1), dim), mean, axes, leading)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(near), pa.list_(pa.float64())), pa.array(rest)],
                names=["vec_id", "v", "near", "rest"])

    points = stored(kept.mapInArrow(rotate, "vec_id long, v array<long>, near array<double>, rest double"), "rotated")
    for _ in range(rounds):
        centroids = _moved(points, centroids, mean, axes)
    found = stored(_assigned(points, centroids, mean, axes), "assigned")
    sums = found.groupBy("cluster").agg(
        F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()
    held = {r["cluster"]: None if r["s"] is None else int(r["s"]) for r in sums}
    whole = None if None in held.values() else sum(held.values())
    fit = lambda s: F.lit(s if s is not None and s < 1 << 63 else None).cast("long")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    pick = lambda values: F.get(F.array(*values), F.col("cluster"))
    return found.select("vec_id", "cluster", "distance", pick([fit(held.get(c, 0)) for c in range(len(digest))]).alias("cluster_inertia"),
                        fit(whole).alias("inertia"), pick([F.lit(d) for d in digest]).alias("centroid_sha256"))
