"""Uniform random shuffle into shards of exact size through a hypergeometric communication matrix."""

import math
import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from accesslens.llm.common import stored


def hypergeometric(rng, good, bad, draws):
    """How many of ``draws`` picks without return are good: inversion outwards from the mode, in a few deviations."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    peak = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - peak
    down = up = mode
    p_down = p_up = peak
    while left >= 0 and (p_down > 0 or p_up > 0):
        p_up = p_up * (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)) if up < high else 0.0
        up += 1
        left -= p_up
        if left < 0:
            return up
        p_down = p_down * down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)) if down > low else 0.0
        down -= 1
        left -= p_down
        if left < 0:
            return down
    return mode


def communication_matrix(sizes, shards, seed):
    """Rows of each block (``sizes``) that go to each shard, drawn as a uniform permutation of all rows would deal them.

    Shard sizes differ by one at most. Row by row and cell by cell, each count is hypergeometric in what is left.
    """
    rng, total = random.Random(seed), sum(sizes)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for size in sizes:
        row, open_ = [], sum(left)
        for s in range(shards):
            open_ -= left[s]
            count = hypergeometric(rng, left[s], open_, size)
            row.append(count)
            size -= count
            left[s] -= count
        matrix.append(row)
    return matrix


def _ranked(df, group, key, groups, total, window_rows, name):
    """Add ``name``: the rank from 0 of each row by ``key`` within ``group``, without a window over a whole group.

    The key (a uniform long) is cut into equal ranges; ranks within a range are shifted by the counts of those before.
    """
    ranges = max(1, math.ceil(total / max(1, groups) / window_rows))
    # The upper 31 bits, scaled to 0 .. ranges-1.
    df = df.withColumn("_range", F.shiftright(F.shiftrightunsigned(key, 33) * F.lit(ranges), 31).cast("int"))
    before = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (df.groupBy(group, "_range").agg(F.count("*").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .select(group, "_range", "_before"))
    inside = W.partitionBy(group, "_range").orderBy(key, "_row")
    return (df.withColumn("_rank", F.row_number().over(inside) - 1)
            .join(offsets, [group, "_range"])
            .withColumn(name, (F.col("_rank") + F.col("_before")).cast("long"))
            .drop("_range", "_rank", "_before"))


def shuffle_to_shards(df, shards, seed=0, blocks=256, window_rows=50_000):
    """Give every row of ``df`` a ``shard`` and a ``slot`` (gapless from 0 in its shard), uniformly at random.

    1. The rows are written with a row number, which fixes them, and dealt to ``blocks`` blocks by its hash.
    2. The block sizes (``blocks`` numbers at most) give the communication matrix: how many rows of each block each
       shard gets. It is drawn on the driver; its size does not depend on the data.
    3. Each block is permuted by a keyed hash and cut as its matrix row says. That is the exchange.
    4. Each shard is permuted again by another keyed hash; the rank is the slot.

    Shard sizes differ by one at most. Only DataFrame functions touch rows. A given input written once always gives the
    same result for a seed; repeated rows, nulls and ties are rows like any other, because the row number decides.
    An empty input gives an empty result. Columns named ``shard`` or ``slot`` in the input are replaced; names
    beginning with an underscore are reserved.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    rows = stored(df.select(*kept).withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_row", F.lit(f"block{seed}")), F.lit(blocks)).cast("int"))
    found = {r["_block"]: r["n"] for r in rows.groupBy("_block").agg(F.count("*").alias("n")).collect()}
    sizes = [found.get(b, 0) for b in range(blocks)]
    ends = []
    for row in communication_matrix(sizes, shards, seed):
        ends.append([sum(row[:s + 1]) for s in range(shards)])
    table = F.from_json(F.lit(str(ends)), "array<array<bigint>>")
    total = sum(sizes)
    rows = _ranked(rows.withColumn("_key", F.xxhash64("_row", F.lit(f"local{seed}"))), "_block", F.col("_key"),
                   blocks, total, window_rows, "_place")
    # The shard is the number of cumulative counts that do not exceed the place in the block.
    ends_here = F.get(table, F.col("_block"))
    rows = rows.withColumn("shard", F.size(F.filter(ends_here, lambda e: e <= F.col("_place"))).cast("int"))
    rows = stored(rows.select(*kept, "_row", "shard"), "shard-dealt")
    rows = _ranked(rows.withColumn("_key", F.xxhash64("_row", F.lit(f"slot{seed}"))), "shard", F.col("_key"),
                   shards, total, window_rows, "slot")
    return rows.select(*kept, "shard", "slot")
