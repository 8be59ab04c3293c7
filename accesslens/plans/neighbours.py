"""Exact k nearest neighbours within groups: a pivot-partitioned join whose cells are ruled out by triangle bounds."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from accesslens.plans.tables import local_table
from accesslens.session import materialize

#: Pivots of a group at most; their pairwise distances are all that the driver holds.
MAX_PIVOTS = 256
CELL_ROWS = 2000
#: Parts that a part of a cell meets in one unit; a unit returns the k nearest of them all.
UNIT_PARTS = 8


def _gaps(x, y):
    """Squared distances of all rows of x to all rows of y."""
    return np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ y.T + (y ** 2).sum(1)[None, :], 0.0)


def _nearest(x, y, take):
    """(row of x, row of y, squared distance) of the ``take`` nearest of each row, earlier rows of y first where equal.

    A partition of rounded distances leaves those that may be among them; these few are measured and sorted.
    """
    d, size = _gaps(x, y), (y ** 2).sum(1)
    slack = 1e-12 * ((x ** 2).sum(1) + size.max(initial=0.0, where=np.isfinite(size)))
    near = d <= (np.partition(d, take - 1, axis=1)[:, take - 1] + slack)[:, None]
    found = near.sum(1)
    for r in np.flatnonzero((found < take) | (found > 16 * take)):      # missing numbers, or a crowd at one distance
        near[r] = False
        near[r, np.argsort(d[r], kind="stable")[:take]] = True
    row, column = np.nonzero(near)
    gap = ((x[row] - y[column]) ** 2).sum(1)
    order = np.lexsort((column, gap, row))
    place = np.arange(len(row)) - np.searchsorted(row, row)     # within the row: sorting leaves the rows where they are
    order = order[place < take]
    return row[order], column[order], gap[order]


def _pivots(rows: DataFrame, group, cell_rows, max_pivots):
    """{group: matrix}: distinct vectors with the smallest hashes, one for ``cell_rows`` of them and max_pivots at most."""
    sizes = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count("*").alias("n")).collect()}
    wanted = local_table(rows.sparkSession, [(g, max(1, min(max_pivots, -(-n // cell_rows)))) for g, n in sizes.items()],
                         f"{group} string, _pivots long")
    w = Window.partitionBy(group).orderBy(F.xxhash64("x", F.lit(11)), "x")
    chosen = (rows.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= max_pivots)
              .join(F.broadcast(wanted), group).where(F.col("_p") <= F.col("_pivots")).orderBy(group, "_p").collect())
    found = {}
    for r in chosen:
        found.setdefault(r[group], []).append(r["x"])
    return {g: np.array(v) for g, v in found.items()}


def _cell_pairs(pivots, stats, k):
    """(group, i, j, reach): cells j that may hold one of the k nearest of a row of cell i, and how far from its pivot
    a row of j may at least lie to matter (``reach``: rows with a smaller distance cannot).

    Any row of cell c is within radius(i) + |p_i p_c| + radius(c) of any row of i, so the nearest cells that hold k
    rows together bound the k-th distance; and it is no nearer than |p_i p_j| - radius(i) - its distance to p_j.
    """
    out = []
    for g, p in pivots.items():
        count, radius = stats[g]
        between = np.sqrt(_gaps(p, p))
        np.fill_diagonal(between, 0.0)
        for i in np.flatnonzero(count):
            far = np.where(count > 0, between[i] + radius[i] + radius, np.inf)
            order = np.argsort(far, kind="stable")
            enough = np.searchsorted(np.cumsum(count[order]), k)
            bound = far[order[min(enough, len(order) - 1)]]
            if not np.isfinite(bound):
                bound = np.inf
            slack = 1e-6 * (1 + between[i].max() + radius.max())
            reach = between[i] - radius[i] - bound - slack
            out += [(g, int(i), int(j), float(reach[j])) for j in np.flatnonzero((count > 0) & (radius >= reach))]
    return out


def nearest_neighbours(df: DataFrame, group, id_col, vector, k, cell_rows=CELL_ROWS, max_pivots=MAX_PIVOTS) -> DataFrame:
    """(group, id, ``near``: array of vectors): the k nearest other rows of the same group (all, if fewer), by Euclidean
    distance, ties by id; the same rule at every size.

    Equal vectors are compared once: k + 1 copies of each stand for all. Vectors are dealt to the cell of their nearest
    pivot, cells are cut into parts of ``cell_rows`` rows, and a part meets those of a cell only as far as triangle bounds
    cannot rule them out. A unit holds a part and UNIT_PARTS others and returns ids and distances; the best of all units of
    a row are merged by a ranked window, and vectors are joined to these alone.
    """
    spark = df.sparkSession
    rows = df.select(F.col(group), F.col(id_col).alias("id"), F.col(vector).alias("x"))
    copy = Window.partitionBy(group, F.xxhash64("x"), "x").orderBy("id")
    few = materialize(rows.withColumn("copy", F.row_number().over(copy)).where(F.col("copy") <= k + 1), "neighbour-rows")
    distinct = few.where("copy = 1")
    pivots = _pivots(distinct, group, cell_rows, max_pivots)
    held = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for pdf in batches:
            cell, gap = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for g, at in pdf.groupby(group).indices.items():
                d = _gaps(np.stack(pdf["x"].to_numpy()[at]), held.value[g])
                cell[at] = d.argmin(1)
                gap[at] = np.sqrt(d.min(1))
            yield pdf.assign(cell=cell, gap=gap)

    dealt = few.mapInPandas(assign, f"{group} string, id long, x array<double>, copy int, cell int, gap double")
    cells = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "neighbour-cells")     # ids may repeat
    stats = {g: (np.zeros(len(p), np.int64), np.zeros(len(p))) for g, p in pivots.items()}
    for r in cells.groupBy(group, "cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect():
        stats[r[group]][0][r["cell"]], stats[r[group]][1][r["cell"]] = r["n"], r["radius"]
    pairs = _cell_pairs(pivots, stats, k + 1)
    parts = {(g, c): max(1, -(-int(n) // cell_rows)) for g, (count, _) in stats.items() for c, n in enumerate(count)}
    # The parts that a cell meets are numbered, and a unit takes UNIT_PARTS of them in turn.
    met, table = {}, []
    for g, i, j, reach in pairs:
        table.append((g, i, j, reach, parts[(g, i)], parts[(g, j)], met.get((g, i), 0)))
        met[(g, i)] = met.get((g, i), 0) + parts[(g, j)]
    table = local_table(spark, table, f"{group} string, i int, j int, reach double, mine long, theirs long, first long")
    units = local_table(spark, [(g, i, parts[(g, i)], -(-n // UNIT_PARTS)) for (g, i), n in met.items()],
                        f"{group} string, i int, mine long, units long")
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    unit = ["i", "a", "u"]
    left = (cells.where("copy = 1").join(F.broadcast(units.withColumn("cell", F.col("i"))), [group, "cell"])
            .withColumn("a", part("mine")).withColumn("u", every("units")).select(group, *unit, "id", "x"))
    right = (cells.join(F.broadcast(table.withColumn("cell", F.col("j"))), [group, "cell"]).where(F.col("gap") >= F.col("reach"))
             .withColumn("u", F.floor((F.col("first") + part("theirs")) / UNIT_PARTS))
             .withColumn("a", every("mine")).select(group, *unit, "id", "at", "x"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [group, "id", "other", "at", "gap"]
        if not len(a) or not len(b):
            types = ("object", "int64", "int64", "int64", "float64")
            return pd.DataFrame({n: pd.Series([], dtype=t) for n, t in zip(names, types)})
        b = b.sort_values("r_id", kind="stable")
        x, y, out = np.stack(a["x"].to_numpy()), np.stack(b["r_x"].to_numpy()), []
        for start in range(0, len(x), 256):
            row, best, gap = _nearest(x[start:start + 256], y, min(k + 1, len(y)))
            out.append(pd.DataFrame({group: a[group].iloc[0], "id": a["id"].to_numpy()[row + start], "other": b["r_id"].to_numpy()[best],
                                     "at": b["r_at"].to_numpy()[best], "gap": gap}))
        return pd.concat(out, ignore_index=True)[names]

    right = right.toDF(*[f"r_{c}" for c in right.columns])
    met = left.groupBy(group, *unit).cogroup(right.groupBy(f"r_{group}", *[f"r_{c}" for c in unit])).applyInPandas(
        meet, f"{group} string, id long, other long, at long, gap double")
    order = Window.partitionBy(group, "id").orderBy("gap", "other")
    best = met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    # Only the vectors that were chosen travel.
    best = best.join(cells.select("at", F.col("x").alias("y")), "at").groupBy(group, "id").agg(
        F.sort_array(F.collect_list(F.struct("_r", "other", "y"))).alias("best"))
    # Every row takes the list of its vector, without itself.
    lists = best.join(distinct.select(group, "id", "x"), [group, "id"]).select(group, "x", "best")
    others = F.filter("best", lambda s: s["other"] != F.col("id"))
    return rows.join(lists, [group, "x"]).select(
        group, "id", F.transform(F.slice(others, 1, k), lambda s: s["y"]).alias("near"))
