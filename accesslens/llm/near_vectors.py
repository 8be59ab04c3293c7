"""Embedding near-dedup: exact cosine links by PCA-ordered tiled comparison."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from accesslens.llm.common import connected_components, join_labels, stored

#: Vectors in a group; every pair of groups is one unit of work.
GROUP_ROWS = 4096
TILE = 512
LEADING = 16
_SLACK = 1e-9


def _matrix(column, dim):
    """Rows of a list column, each scaled by a power of two to a largest component of about 1.

    Cosines stay as they are, to the last bit, and squares neither underflow nor overflow.
    """
    if not len(column):
        return np.empty((0, dim))
    x = column.values.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
    exponent = np.frexp(np.abs(x).max(axis=1))[1]
    # Two steps: 2 ** 1074 alone is no double.
    half = exponent // 2
    return np.ldexp(np.ldexp(x, -half[:, None]), (half - exponent)[:, None])


def principal_axes(unique, dim):
    """Orthogonal axes of the unit vectors by falling second moment (not centred, so cosines stay)."""
    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            x = x / np.linalg.norm(x, axis=1)[:, None]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                         names=["i", "row"])

    sums = [F.sum(F.get("row", F.lit(j))) for j in range(dim)]
    rows = (unique.select("embedding").mapInArrow(moments, "i int, row array<double>")
            .groupBy("i").agg(F.array(*sums).alias("row")).orderBy("i").collect())
    axes = np.linalg.eigh(np.array([r["row"] for r in rows]))[1][:, ::-1]
    if not np.isfinite(axes).all():
        raise ValueError("principal axes are not finite")
    return axes


def tile_links(x, y, threshold):
    """(i, j) with dot(x[i], y[j]) >= threshold - slack, and the dots; rows are unit vectors in principal order.

    Leading dimensions are accumulated first. What the rest can add is at most the product of the two suffix norms; a
    pair that cannot reach the threshold goes. A tile where most pairs survive is finished densely.
    """
    dim = x.shape[1]
    cuts = [*range(min(LEADING, dim), dim, LEADING), dim]
    dots = x[:, :cuts[0]] @ y[:, :cuts[0]].T
    i = j = None
    for k, cut in enumerate(cuts):
        if k:
            if i is None:
                dots += x[:, cuts[k - 1]:cut] @ y[:, cuts[k - 1]:cut].T
            else:
                values += np.einsum("nd,nd->n", x[i, cuts[k - 1]:cut], y[j, cuts[k - 1]:cut])
        rest_x = np.sqrt(np.maximum(0, (x[:, cut:] ** 2).sum(1)))
        rest_y = np.sqrt(np.maximum(0, (y[:, cut:] ** 2).sum(1)))
        if i is None:
            alive = dots + rest_x[:, None] * rest_y[None, :] >= threshold - _SLACK
            if cut == dim or alive.sum() < 0.05 * alive.size:
                i, j = np.nonzero(alive)
                values = dots[i, j]
        else:
            alive = values + rest_x[i] * rest_y[j] >= threshold - _SLACK
            i, j, values = i[alive], j[alive], values[alive]
        if i is not None and not len(i):
            break
    return i, j, values


def group_links(x, y, weights_x, weights_y, same, threshold, axes):
    """Links between two groups: (links of x, links of y, label of each node of both); y is x if ``same``."""
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    px, py = x / norm_x[:, None] @ axes, y / norm_y[:, None] @ axes
    links_x, links_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    labels = np.arange(len(x) if same else len(x) + len(y))
    for a in range(0, len(x), TILE):
        for b in range(a if same else 0, len(y), TILE):
            i, j, dots = tile_links(px[a:a + TILE], py[b:b + TILE], threshold)
            i, j = i + a, j + b
            if same:
                keep = i < j
                i, j, dots = i[keep], j[keep], dots[keep]
            near = np.flatnonzero(np.abs(dots - threshold) <= _SLACK)
            if len(near):
                # At the threshold the unrotated vectors decide.
                p, q = x[i[near]], y[j[near]]
                exact = np.array([float(u @ v) for u, v in zip(p, q)]) / (norm_x[i[near]] * norm_y[j[near]])
                keep = np.ones(len(i), bool)
                keep[near] = exact >= threshold
                i, j = i[keep], j[keep]
            if len(i):
                np.add.at(links_x, i, weights_y[j])
                np.add.at(links_x if same else links_y, j, weights_x[i])
                join_labels(labels, i, j if same else j + len(x))
    return links_x, links_y, labels


def _links(unique, dim, threshold, group_rows):
    """(node, links, label): per unit of work, the weight that a node links to, and a node it is connected with."""
    axes = principal_axes(unique, dim)
    groups = max(1, math.ceil(unique.count() / group_rows))
    dealt = unique.withColumn("g", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int"))
    # Each vector goes to the units (its group, other group), the smaller number first.
    units = dealt.select("node", "copies", "embedding", "g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("h"))
    units = units.select("node", "copies", "embedding", (F.col("g") > F.col("h")).alias("right"),
                         (F.least("g", "h") * groups + F.greatest("g", "h")).cast("long").alias("unit"))

    def compare(t):
        t = t.combine_chunks()
        right = t.column("right").to_numpy()
        same = not right.any() and t.column("unit")[0].as_py() % (groups + 1) == 0
        x = _matrix(t.column("embedding").combine_chunks(), dim)
        nodes, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        left = ~right
        n = int(left.sum())
        ordered = np.concatenate([nodes[left], nodes[right]])
        lx, ly, labels = group_links(x[left], x[left] if same else x[right], copies[left],
                                     copies[left] if same else copies[right], same, threshold, axes)
        links = lx if same else np.concatenate([lx, ly])
        hit = np.flatnonzero(links)
        assert same or n == len(lx)
        return pa.table({"node": ordered[hit], "links": links[hit], "label": ordered[labels[hit]]})

    return units.groupBy("unit").applyInArrow(compare, "node long, links long, label long")


def near_vectors(vectors, id_col="vec_id", vector_col="embedding", threshold=0.9, group_rows=GROUP_ROWS):
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Equal vectors are joined to one node with a count first, so a group of copies costs one comparison. All pairs of
    nodes of equal length are compared in units of two groups of about ``group_rows`` vectors; a unit returns sums and
    a spanning set of links, at most one row per vector. The cosine is in double precision. Null, zero or unequally long
    vectors, and those with null or non-finite components, link with nothing. Repeated ids are separate vectors (each
    counts); a component is named by its smallest id; null ids stay null. An empty input gives an empty result.
    """
    value = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), value.alias("embedding"))
    sound = (F.col("embedding").isNotNull()
             & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
             & F.exists("embedding", lambda v: v != 0))
    rows = stored(rows.withColumn("sound", F.coalesce(sound, F.lit(False))), "vectors")
    nodes = stored(rows.where("sound").groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
                   .withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")),
                   "vector-nodes")
    found = None
    for r in nodes.select("dim").distinct().orderBy("dim").collect():
        part = _links(nodes.where(F.col("dim") == r["dim"]), r["dim"], threshold, group_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = nodes.select("node", F.col("copies").alias("links"), F.col("node").alias("label"))
    found = stored(found, "vector-links")
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("label").alias("b")), "vector-components")
    info = (nodes.drop("dim").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
            .join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
    names = info.groupBy("component").agg(F.min("first").alias("component_id"))
    info = info.join(names, "component").select(
        "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = rows.where("sound").join(info, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
