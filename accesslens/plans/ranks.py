"""Global order statistics without a window over unpartitioned data.

Every helper follows the same steps: map values to ordered bins, count per bin (combined before the
shuffle), prefix over the bins, and touch single rows only inside the bins that matter.
"""

from pyspark.sql import DataFrame, Window, functions as F

from accesslens.plans.tables import local_table
from accesslens.session import materialize

BINS_PER_OCTAVE = 4096


def magnitude_bin(value, per_octave=BINS_PER_OCTAVE):
    """A monotone map of a number to an integer bin; finer near zero, like a floating-point grid."""
    v = value.cast("double")
    size = F.floor(F.log2(1 + F.abs(v)) * per_octave).cast("long")
    return F.when(v < 0, -size - 1).otherwise(size)


def minute_of_micros(value):
    return F.floor(value / 60_000_000).cast("long")


def bin_prefix(counts: DataFrame, keys, measures):
    """Add ``<measure>_before``: totals of the lower ``_bin`` values within ``keys``.

    The input holds one row per key and bin. Two levels (coarse, then fine) keep each window small.
    """
    coarse = counts.withColumn("_coarse", F.floor(F.col("_bin") / 1024))
    w_fine = Window.partitionBy(*keys, "_coarse").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    w_coarse = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_coarse")
                .rowsBetween(Window.unboundedPreceding, -1))
    totals = coarse.groupBy(*keys, "_coarse").agg(*[F.sum(m).alias(f"_c_{m}") for m in measures])
    totals = totals.select(*keys, "_coarse", *[
        F.coalesce(F.sum(f"_c_{m}").over(w_coarse), F.lit(0)).alias(f"_o_{m}") for m in measures])
    inner = coarse.select("*", *[
        F.coalesce(F.sum(m).over(w_fine), F.lit(0)).alias(f"_i_{m}") for m in measures])
    out = inner.join(totals, [*keys, "_coarse"])
    return out.select(*counts.columns, *[(F.col(f"_i_{m}") + F.col(f"_o_{m}")).alias(f"{m}_before") for m in measures])


def prefix_by_value(values: DataFrame, keys, measures, value="v", bin_expr=None, descending=False):
    """Prefix totals over distinct values.

    ``values`` has one row per key and distinct value; the result adds ``<measure>_before`` for all
    smaller (or, descending, larger) values.
    """
    bins = bin_expr if bin_expr is not None else magnitude_bin(F.col(value))
    ranked = values.withColumn("_bin", -bins if descending else bins)
    counts = ranked.groupBy(*keys, "_bin").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = bin_prefix(counts, keys, measures).drop(*measures)
    order = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*keys, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranked.join(offsets, [*keys, "_bin"])
    return joined.select(*values.columns, *[
        (F.col(f"{m}_before") + F.coalesce(F.sum(m).over(w), F.lit(0))).alias(f"{m}_before") for m in measures])


def values_at_ranks(df: DataFrame, keys, value, ranks: DataFrame, bin_expr=None, descending=False):
    """The value at given 0-based ranks within ``keys``.

    ``ranks`` has the key columns, ``tag`` and ``rank``. Returns keys, tag, rank, ``v`` and
    ``v_before`` (rows strictly before the value). Only bins that contain a wanted rank are opened.
    """
    bins = bin_expr if bin_expr is not None else magnitude_bin(F.col(value))
    data = df.select(*keys, F.col(value).alias("v"), (-bins if descending else bins).alias("_bin"))
    counts = data.groupBy(*keys, "_bin").agg(F.count("*").alias("n"))
    spans = bin_prefix(counts, keys, ["n"])
    hit = (F.col("rank") >= F.col("n_before")) & (F.col("rank") < F.col("n_before") + F.col("n"))
    wanted = (spans.join(ranks, keys) if keys else spans.crossJoin(F.broadcast(ranks))).where(hit)
    wanted = wanted.select(*keys, "_bin", "tag", "rank", F.col("n_before").alias("_offset"))
    opened = wanted.select(*keys, "_bin").distinct()
    inside = (data.join(opened, [*keys, "_bin"], "left_semi")
              .groupBy(*keys, "_bin", "v").agg(F.count("*").alias("n")))
    order = F.col("v").desc() if descending else F.col("v").asc()
    w = Window.partitionBy(*keys, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_in", F.coalesce(F.sum("n").over(w), F.lit(0)))
    before = F.col("_offset") + F.col("_in")
    return (inside.join(wanted, [*keys, "_bin"])
            .where((F.col("rank") >= before) & (F.col("rank") < before + F.col("n")))
            .select(*keys, "tag", "rank", "v", before.alias("v_before")))


def exact_quantiles(df: DataFrame, keys, value, probabilities, bin_expr=None):
    """Exact quantiles with linear interpolation: keys, ``p``, ``q``. Nulls are ignored."""
    df = df.where(F.col(value).isNotNull())
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")) if keys else df.agg(F.count("*").alias("n"))
    sizes = sizes.where(F.col("n") > 0)
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    spots = sizes.select(*keys, F.explode(ps).alias("p"), "n").withColumn("at", F.col("p") * (F.col("n") - 1))
    low, high = F.floor("at"), F.ceil("at")
    ranks = spots.select(
        *keys, "p", F.explode(F.array(F.struct(F.lit("lo").alias("side"), low.alias("rank")),
                                      F.struct(F.lit("hi").alias("side"), high.alias("rank")))).alias("s"),
        (F.col("at") - low).alias("frac"))
    ranks = ranks.select(*keys, F.struct("p", "s.side", "frac").alias("tag"), F.col("s.rank").alias("rank"))
    found = values_at_ranks(df, keys, value, ranks, bin_expr)
    side = lambda s: F.max(F.when(F.col("tag.side") == s, F.col("v").cast("double")))
    ends = found.groupBy(*keys, F.col("tag.p").alias("p"), F.col("tag.frac").alias("frac")).agg(
        side("lo").alias("lo"), side("hi").alias("hi"))
    return ends.select(*keys, "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")).alias("q"))


def cut_rows(df: DataFrame, order, id_col, sizes, bin_expr=None, descending=False):
    """For each size k, the k-th row under (order, id): ``{k: (order value, id)}``.

    ``order`` is a numeric column expression. Two selections over bins find the value and then, among the
    rows tied on it, the id; only one row per size reaches the driver and nothing is sorted as a whole.
    """
    spark = df.sparkSession
    data = df.select(order.alias("v"), F.col(id_col).alias("id"))
    kind = dict(data.dtypes)["v"].replace("bigint", "long")
    table = local_table(spark, [(k, k - 1) for k in sorted(set(sizes))], "tag long, rank long")
    bins = bin_expr(F.col("v")) if bin_expr else None
    edges = values_at_ranks(data, [], "v", table, bins, descending).collect()
    values = sorted({r["v"] for r in edges})
    # Rows tied with an edge value; a tie may be large, so its ids go through bins as well.
    tied = data.where(F.col("v").isin(values)).select(F.col("v").alias("edge"), "id")
    spots = local_table(spark, [(r["v"], r["tag"], r["rank"] - r["v_before"]) for r in edges],
                        f"edge {kind}, tag long, rank long")
    found = values_at_ranks(tied, ["edge"], "id", spots).collect()
    return {r["tag"]: (r["edge"], r["v"]) for r in found}


def within_cut(order, id_col, cut, descending=False):
    """True for rows up to the cut row: a row-local comparison with two literals."""
    if cut is None:
        return F.lit(False)
    value, last = cut
    ahead = (order > value) if descending else (order < value)
    return ahead | ((order == value) & (F.col(id_col) <= last))


def ranked_by_range(df: DataFrame, order, name="rank", partitions=None) -> DataFrame:
    """Add the 0-based rank of each row by the ``order`` columns, without any window.

    Pass one cuts the rows into ranges of about equal size at sampled boundaries of the whole key, sorts each range and
    writes it with its position, which fixes the ranges. Pass two counts the ranges (one row per partition) and shifts
    the positions by the rows of the ranges before. A range splits anywhere between two keys, so a prefix, a minute or
    any other group that many rows share never lands in one task as a whole; only rows equal in every key stay together.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    # The number of a row: its partition in the upper bits, its place in the sorted partition in the lower 33.
    placed = materialize(ranged.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    before, offsets = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    table = local_table(df.sparkSession, offsets, "_part long, _before long")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("_part", part).join(F.broadcast(table), "_part")
            .withColumn(name, (F.col("_before") + place).cast("long")).drop("_at", "_part", "_before"))


def dense_codes(df: DataFrame, column) -> DataFrame:
    """0-based rank of each distinct text value, in binary order: (column, ``code``)."""
    words = df.select(column).where(F.col(column).isNotNull()).distinct()
    return ranked_by_range(words, [column], "code").select(column, "code")
