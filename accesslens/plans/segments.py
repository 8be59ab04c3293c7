"""Ordered per-entity work that survives one entity holding a large share of all rows.

An ordered window over ``entity_id`` puts all rows of an entity into one task. ``EntitySegments`` first
counts rows per entity (one column, combined before the shuffle). Entities above a fixed number of rows
are "hot", however many they are. Each hot entity is cut by time into segments of that size; windows then
run per (entity, segment), and what must pass from one segment to the next is carried over:

* running sums and minima: per-segment totals, prefixed over segments, joined back by broadcast;
* lag and ROWS frames: the last rows of the earlier segments are copied in front ("halo").

The segment table has one row for every ``MIN_HOT_ROWS`` rows of hot entities. It is broadcast while it
has at most ``MAX_BROADCAST`` rows and joined by key beyond.

Without hot entities every helper collapses to the plain window plan: one exchange, no extra join.
"""

from pyspark.sql import DataFrame, Window, functions as F

from accesslens.plans.tables import local_table

MIN_HOT_ROWS = 4_000_000
MAX_BROADCAST = 200_000

KEY, TS, ID = "entity_id", "timestamp", "event_id"
SEG = "_seg"


class EntitySegments:
    """Segment plan of one frame; the same rows must be used for the probe and for the windows."""

    def __init__(self, spark, cuts):
        # cuts: {entity: [(segment number, first epoch second, rows before it), ...]}, total rows / limit entries.
        self.spark = spark
        self.cuts = cuts

    @classmethod
    def none(cls, spark):
        return cls(spark, {})

    @classmethod
    def probe(cls, df: DataFrame, hot_rows=None, segment_rows=None):
        """Find hot entities and their cut points: at most total rows / limit of each reach the driver."""
        spark = df.sparkSession
        limit = hot_rows or int(spark.conf.get("accesslens.hotRows", str(MIN_HOT_ROWS)))
        counts = df.groupBy(KEY).agg(F.count("*").alias("n"))
        hot = [r[KEY] for r in counts.where(F.col("n") > limit).select(KEY).collect()]
        if not hot:
            return cls(spark, {})
        names = local_table(spark, [(h,) for h in hot], f"{KEY} string")
        if len(hot) <= MAX_BROADCAST:
            names = F.broadcast(names)
        size = segment_rows or limit
        second = F.unix_seconds(F.col(TS).cast("timestamp"))
        # Rows per second of the hot entities only; the per-entity prefix runs over seconds, not rows.
        ticks = (df.select(KEY, second.alias("s")).join(names, KEY, "left_semi")
                 .groupBy(KEY, "s").agg(F.count("*").alias("n")))
        w = Window.partitionBy(KEY).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        starts = (ticks.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
                  .groupBy(KEY, F.floor(F.col("before") / size).alias("part"))
                  .agg(F.min("s").alias("s"), F.min("before").alias("before")))
        cuts = {}
        for r in starts.orderBy(KEY, "s").collect():
            parts = cuts.setdefault(r[KEY], [])
            parts.append((len(parts), r["s"], r["before"]))
        return cls(spark, cuts)

    def small(self, df):
        """Mark a table of at most one row per segment for broadcast, unless there are too many segments."""
        return F.broadcast(df) if sum(map(len, self.cuts.values())) <= MAX_BROADCAST else df

    @property
    def hot(self):
        return bool(self.cuts)

    @property
    def keys(self):
        return [KEY, SEG]

    def table(self):
        """(entity, segment, first second, rows before): one row per segment of a hot entity."""
        rows = [(e, n, s, b) for e, parts in self.cuts.items() for n, s, b in parts]
        return local_table(self.spark, rows, f"{KEY} string, {SEG} int, _from long, _before long")

    def tag(self, df):
        """Add the segment of each row (0 for an entity that is not hot)."""
        if SEG in df.columns:
            return df
        if not self.hot:
            return df.withColumn(SEG, F.lit(0))
        starts = self.table().groupBy(KEY).agg(F.sort_array(F.collect_list("_from")).alias("_starts"))
        second = F.unix_seconds(F.col(TS).cast("timestamp"))
        return (df.join(self.small(starts), KEY, "left")
                .withColumn(SEG, F.coalesce(
                    F.size(F.filter("_starts", lambda s: s <= second)) - 1, F.lit(0)))
                .withColumn(SEG, F.greatest(F.col(SEG), F.lit(0)))
                .drop("_starts"))

    def partition(self, *extra):
        """Window partition columns; without hot entities the constant segment stays out of the plan."""
        return [KEY, *( [SEG] if self.hot else [] ), *extra]

    def window(self):
        return Window.partitionBy(*self.partition()).orderBy(TS, ID)

    def frame(self):
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def hot_names(self):
        return local_table(self.spark, [(e,) for e in self.cuts], f"{KEY} string")

    def only_hot(self, df):
        return df.join(self.small(self.hot_names()), KEY, "left_semi")

    def position(self, df, name="_pos"):
        """1-based running position of a row within its entity."""
        df = self.tag(df)
        inside = F.row_number().over(self.window()).cast("long")
        if not self.hot:
            return df.withColumn(name, inside)
        before = self.table().select(KEY, SEG, "_before")
        return (df.join(self.small(before), [KEY, SEG], "left")
                .withColumn(name, inside + F.coalesce("_before", F.lit(0)))
                .drop("_before"))

    def running(self, df, name, value, how="sum"):
        """Running sum or minimum of ``value`` over the entity's events so far (current included)."""
        df = self.tag(df)
        fn = {"sum": F.sum, "min": F.min}[how]
        inside = fn(value).over(self.frame())
        if not self.hot:
            return df.withColumn(name, inside)
        w = Window.partitionBy(KEY).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        carry = (self.only_hot(df).groupBy(KEY, SEG).agg(fn(value).alias("_part"))
                 .select(KEY, SEG, fn("_part").over(w).alias("_carry")))
        joined = df.join(self.small(carry), [KEY, SEG], "left")
        if how == "sum":
            total = inside + F.coalesce("_carry", F.lit(0))
        else:
            total = F.least(inside, "_carry")
        return joined.withColumn(name, total).drop("_carry")

    def whole(self, df, aggs):
        """Attach aggregates over all rows of the entity: ``{name: function of nothing -> Column}``."""
        df = self.tag(df)
        if not self.hot:
            w = Window.partitionBy(KEY)
            return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
        w = Window.partitionBy(KEY, SEG)
        totals = self.only_hot(df).groupBy(KEY).agg(*[a.alias(f"_all_{n}") for n, a in aggs.items()])
        totals = totals.withColumn("_is_hot", F.lit(True))
        out = df.select("*", *[a.over(w).alias(f"_in_{n}") for n, a in aggs.items()])
        out = out.join(self.small(totals), KEY, "left")
        for n in aggs:
            out = out.withColumn(n, F.when(F.col("_is_hot"), F.col(f"_all_{n}")).otherwise(F.col(f"_in_{n}")))
        return out.drop("_is_hot", *[f"_all_{n}" for n in aggs], *[f"_in_{n}" for n in aggs])

    def halo(self, df, rows):
        """Copy the ``rows`` events before each segment into it, marked ``_halo``.

        Positions are exact, so the copies are too, however small an earlier segment is. Each segment
        receives at most ``rows`` copies.
        """
        df = self.tag(df)
        if not self.hot:
            return df.withColumn("_halo", F.lit(False))
        placed = self.position(df, "_pos")
        starts = self.table().groupBy(KEY).agg(
            F.collect_list(F.struct(F.col(SEG).alias("seg"), F.col("_before").alias("before"))).alias("_starts"))
        later = F.filter("_starts", lambda s: (s["seg"] > F.col(SEG)) & (F.col("_pos") > s["before"] - rows))
        targets = F.concat(F.array(F.col(SEG)), F.coalesce(F.transform(later, lambda s: s["seg"]), F.array().cast("array<int>")))
        return (placed.join(self.small(starts), KEY, "left")
                .withColumn("_target", F.explode(targets))
                .withColumn("_halo", F.col("_target") != F.col(SEG))
                .withColumn(SEG, F.col("_target"))
                .drop("_target", "_starts", "_pos"))

    def lookup(self, df, dim):
        """Left join ``dim`` (one row per entity). Rows of hot entities spread over their segments."""
        df = self.tag(df)
        if not self.hot:
            return df.join(dim, KEY, "left")
        parts = self.small(self.table().groupBy(KEY).agg(F.collect_list(SEG).alias("_parts")))
        spread = (dim.join(parts, KEY, "left")
                  .withColumn(SEG, F.explode(F.coalesce("_parts", F.array(F.lit(0))))).drop("_parts"))
        return df.join(spread, [KEY, SEG], "left")


def with_lag(df, columns, segments, order=1):
    """Previous value of ``columns`` per entity (``prev_<column>``); halo rows make it exact at cuts."""
    out = segments.halo(df, order)
    w = segments.window()
    out = out.select("*", *[F.lag(c, order).over(w).alias(f"prev_{c}") for c in columns])
    return out.where(~F.col("_halo")).drop("_halo") if segments.hot else out.drop("_halo")


def with_lead(df, columns, segments):
    """Next value per entity (``next_<column>``): the same segments read backwards.

    The first row of the following segments is copied behind each segment.
    """
    df = segments.tag(df)
    w = segments.window()
    if not segments.hot:
        return df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    placed = segments.position(df, "_pos")
    ends = segments.table().select(KEY, F.col(SEG).alias("_end_seg"), "_before")
    firsts = (segments.only_hot(placed).join(segments.small(ends), KEY)
              .where((F.col("_pos") == F.col("_before") + 1) & (F.col("_end_seg") > 0))
              .withColumn(SEG, F.col("_end_seg") - 1).drop("_end_seg", "_before").withColumn("_halo", F.lit(True)))
    both = placed.withColumn("_halo", F.lit(False)).unionByName(firsts)
    out = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.where(~F.col("_halo")).drop("_halo", "_pos")
