"""Changing behaviour: decayed baselines, Page-Hinkley tests and their comparison with static bands."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from accesslens import constants as C
from accesslens.plans.segments import ID, KEY, SEG, TS, EntitySegments
from accesslens.plans.tables import local_table
from accesslens.session import materialize


def decayed_sum(rows, zero, value, decay=C.DRIFT_DECAY):
    """Sum of an array of vectors, each weighing ``decay`` times the next: acc * decay + value(row) in one pass."""
    return F.aggregate(rows, zero, lambda acc, row: F.zip_with(acc, value(row), lambda a, v: a * F.lit(decay) + v))


def with_decayed(df: DataFrame, rows, width, prefix, decay=C.DRIFT_DECAY) -> DataFrame:
    """Add ``<prefix>_mean`` and ``<prefix>_std``: decayed mean and population deviation vectors of an array column of
    vectors, the last of which weighs most. An empty array has no baseline: null vectors."""
    zero = F.array_repeat(F.lit(0.0), width)
    norm = F.aggregate(rows, F.lit(0.0), lambda acc, row: acc * F.lit(decay) + 1.0)
    share = lambda total: F.when(F.size(rows) > 0, F.transform(total, lambda t: t / F.col("_norm")))
    df = df.withColumn("_norm", norm)
    df = df.withColumn(f"{prefix}_mean", share(decayed_sum(F.col(rows), zero, lambda row: row, decay)))
    gap = lambda row: F.zip_with(row, F.col(f"{prefix}_mean"), lambda v, m: (v - m) * (v - m))
    spread = share(decayed_sum(F.col(rows), zero, gap, decay))
    return df.withColumn(f"{prefix}_std", F.transform(spread, lambda v: F.sqrt(v))).drop("_norm")


def decayed_batches(batches, window, previous, decay):
    """Decayed mean and deviation vectors of the last ``window`` vectors ``x`` before (or up to) each row.

    Rows come sorted, with their place ``_at`` among those of their entity; the last vectors of a batch are carried to the
    next. The operations and their order are those of ``with_decayed``. A missing component leaves its place missing.
    """
    carry = None
    for batch in batches:
        lists = batch.column("x")
        n = len(lists)
        if n == 0:
            continue
        flat = lists.flatten()
        rows = flat.to_numpy(zero_copy_only=False).reshape(n, -1)
        lost = np.asarray(flat.is_null()).reshape(n, -1)
        if carry is None:
            carry = np.zeros((window, rows.shape[1])), np.zeros((window, rows.shape[1]), dtype=bool)
        rows, lost = np.concatenate([carry[0], rows]), np.concatenate([carry[1], lost])
        carry = rows[-window:], lost[-window:]
        sizes = np.minimum(batch.column("_at").to_numpy() - int(previous), window)
        first = 0 if previous else 1
        total, spread, norm = np.zeros((n, rows.shape[1])), np.zeros((n, rows.shape[1])), np.zeros((n, 1))
        gone = np.zeros((n, rows.shape[1]), dtype=bool)
        # Step i meets the vector that window - i rows follow; it belongs to the entity where the window reaches that far.
        steps = [(slice(first + i, first + i + n), (sizes < window - i)) for i in range(window)]
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            for at, out in steps:
                total, norm = total * decay + rows[at], norm * decay + 1.0
                total[out], norm[out] = 0.0, 0.0
                gone |= lost[at] & ~out[:, None]
            mean = total / norm
            for at, out in steps:
                gap = rows[at] - mean
                spread = spread * decay + gap * gap
                spread[out] = 0.0
            std = np.sqrt(spread / norm)
        # Without any vector there is no baseline: the list is null and holds nothing.
        some = sizes > 0
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(some, rows.shape[1], 0))]), pa.int32(), mask=np.append(~some, False))
        made = [pa.ListArray.from_arrays(offsets, pa.array(a[some].ravel(), pa.float64(), mask=gone[some].ravel(), from_pandas=False))
                for a in (mean, std)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "adaptive_mean", "adaptive_std"])


def _vector(values):
    return F.array(*[F.col(v).cast("double") for v in ([values] if isinstance(values, str) else values)])


def vector_baseline(df: DataFrame, values, segments: EntitySegments, window=C.DRIFT_DEMO_WINDOW, decay=C.DRIFT_DECAY,
                    previous=False) -> DataFrame:
    """``x`` (the vector of ``values``), ``adaptive_mean`` and ``adaptive_std`` of the last ``window`` events per entity.

    ``previous`` leaves the current event out. A task holds one Arrow batch and ``window`` vectors.
    """
    w = segments.window()
    out = segments.halo(df, window).withColumn("x", _vector(values)).withColumn("_at", F.row_number().over(w))
    # The window has already sorted them so; vectors then pass once, in Arrow batches, without a list for each row.
    out = out.sortWithinPartitions(*segments.partition(), TS, ID)
    schema = T.StructType([*out.schema.fields, *[
        T.StructField(f"adaptive_{c}", T.ArrayType(T.DoubleType())) for c in ("mean", "std")]])
    out = out.mapInArrow(lambda batches: decayed_batches(batches, window, previous, decay), schema)
    if segments.hot:
        out = out.where(~F.col("_halo"))
    return out.drop("_at", "_halo")


def adaptive_baseline(df: DataFrame, value, segments: EntitySegments, window=C.DRIFT_DEMO_WINDOW, decay=C.DRIFT_DECAY,
                      previous=False) -> DataFrame:
    """Decayed mean, deviation and +/-2 sigma band over the last ``window`` numbers per entity."""
    out = vector_baseline(df, value, segments, window, decay, previous).drop("x").withColumns({
        "adaptive_mean": F.get("adaptive_mean", F.lit(0)), "adaptive_std": F.get("adaptive_std", F.lit(0))})
    return out.withColumns({
        "adaptive_upper": F.col("adaptive_mean") + 2 * F.col("adaptive_std"),
        "adaptive_lower": F.col("adaptive_mean") - 2 * F.col("adaptive_std"),
    })


def static_baseline(df: DataFrame, value, first=40) -> DataFrame:
    """Mean, population deviation and band of the first values of each entity (limited before the shuffle)."""
    w = Window.partitionBy(KEY).orderBy(TS, ID)
    head = df.select(KEY, TS, ID, value).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= first)
    mean, std = F.avg(value), F.stddev_pop(value)
    return head.groupBy(KEY).agg(
        F.count("*").alias("points"), mean.alias("static_mean"), std.alias("static_std"),
        (mean + 2 * std).alias("static_upper"), (mean - 2 * std).alias("static_lower"))


def last_events(df: DataFrame, n, name="recency") -> DataFrame:
    """The last n events of each entity; the rank limit is applied before the shuffle."""
    w = Window.partitionBy(KEY).orderBy(F.col(TS).desc(), F.col(ID).desc())
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= n)


def entity_baselines(df: DataFrame, values, window=C.DRIFT_WINDOW, decay=C.DRIFT_DECAY) -> DataFrame:
    """Current decayed baseline vectors of each entity from its last ``window`` events (arrays of that size at most)."""
    names = [values] if isinstance(values, str) else list(values)
    recent = last_events(df.select(KEY, TS, ID, _vector(names).alias("_x")), window)
    lists = recent.groupBy(KEY).agg(
        F.count("*").alias("n_events"), F.max(TS).alias("last_updated"),
        F.reverse(F.sort_array(F.collect_list(F.struct("recency", "_x")))).alias("_s"))
    lists = lists.withColumn("_rows", F.col("_s._x")).drop("_s")
    return with_decayed(lists, "_rows", len(names), "baseline", decay).drop("_rows")


def page_hinkley(df: DataFrame, value, segments: EntitySegments, threshold=C.DRIFT_LAMBDA, delta=C.DRIFT_DELTA) -> DataFrame:
    """Page-Hinkley statistic without reset as nested running sums and a running minimum."""
    df = segments.position(df, "_n")
    df = segments.running(df, "_sum", F.col(value).cast("double"))
    df = df.withColumn("running_mean", F.col("_sum") / F.col("_n"))
    df = segments.running(df, "cumulative_sum", F.col(value) - F.col("running_mean") - delta)
    df = segments.running(df, "min_cumulative_sum", F.col("cumulative_sum"), "min")
    return (df.withColumn("ph", F.col("cumulative_sum") - F.col("min_cumulative_sum"))
            .withColumn("drift", (F.col("ph") > threshold).cast("long")).drop("_n", "_sum"))


def vector_mean(vector):
    return F.aggregate(vector, F.lit(0.0), lambda a, v: a + v) / F.size(vector)


def deviation(x="x", mean="adaptive_mean", std="adaptive_std"):
    """Mean over the features of |x - mean| / max(std, 1e-6); null where there is no baseline."""
    scaled = F.zip_with(F.zip_with(x, mean, lambda v, m: F.abs(v - m)), std, lambda g, s: g / F.greatest(s, F.lit(1e-6)))
    return vector_mean(scaled)


def adaptive_threshold(base, std):
    """Widen a threshold for entities whose features deviate by more than 1 on average; no baseline keeps it."""
    mean = vector_mean(std)
    return F.when(mean > 1.0, base * (1 + mean * 0.1)).otherwise(base)


def drift_summary(events: DataFrame, recent=10) -> DataFrame:
    """Total, entities concerned and the most recent drift events (newest first)."""
    last = events.orderBy(F.col(TS).desc(), F.col(ID).desc()).limit(recent)
    listed = last.agg(F.sort_array(F.collect_list(F.struct(TS, ID)), asc=False).alias("_l")).select(
        F.array_join(F.transform("_l", lambda s: s[ID].cast("string")), ",").alias("recent_event_ids"))
    totals = events.agg(F.count("*").alias("total_drift_events"), F.count_distinct(KEY).alias("entities_with_drift"))
    return totals.crossJoin(F.broadcast(listed))


def phase_of(position):
    """Stable for 40 events, shifting for 30, then the new normal."""
    return F.when(position <= 40, "1 stable").when(position <= 70, "2 shift").otherwise("3 new normal")


def compare_baselines(df: DataFrame, value, segments: EntitySegments) -> DataFrame:
    """Points outside the static and the adaptive band, per phase of the entities' histories."""
    placed = segments.position(df.select(KEY, TS, ID, value), "position")
    banded = adaptive_baseline(placed, value, segments)
    static = static_baseline(df, value).select(KEY, "static_lower", "static_upper")
    joined = segments.lookup(banded, static)
    # The margin keeps a point exactly on a band inside it, whatever the order of summation.
    outside = lambda lo, hi: F.count_if((F.col(value) < F.col(lo) - 1e-9) | (F.col(value) > F.col(hi) + 1e-9))
    return joined.groupBy(phase_of(F.col("position")).alias("phase")).agg(
        F.count("*").alias("points"),
        outside("static_lower", "static_upper").alias("static_outside"),
        outside("adaptive_lower", "adaptive_upper").alias("adaptive_outside"))


def drift_phases(peers: DataFrame, factor=0.3, days=30) -> DataFrame:
    """Three drift phases per peer group, with the shifted duration mean each phase stands for."""
    phases = local_table(peers.sparkSession, [
        ("Phase 1: Stable", 0.0), ("Phase 2: Gradual Shift", factor), ("Phase 3: New Normal", 2 * factor),
    ], "phase string, shift_magnitude double")
    return peers.select("entity_type", "duration_mean", "duration_std").crossJoin(F.broadcast(phases)).select(
        "entity_type", "phase", "shift_magnitude", F.lit(days).cast("long").alias("duration_days"),
        (F.col("duration_mean") + F.col("shift_magnitude") * F.col("duration_std")).alias("shifted_duration_mean"),
        F.format_string("Behavioural baseline shifts by %.1fσ over %d days", "shift_magnitude", F.lit(days)).alias("description"))


# --- drift events with reset ------------------------------------------------------------------------------

_STATE = "struct<n:double,total:double,cum:double,low:double,mean:array<double>,std:array<double>>"


class DriftWalk:
    """Page-Hinkley with reset over the ordered vectors of one entity, given in blocks.

    From a reset on the baseline is fixed, so deviations, running means, sums and minima of a whole block are prefix
    sums, and the first crossing is found at once; the walk jumps there, sets the baseline from the last ``window``
    vectors and goes on behind it. Steps are per drift event, and blocks double while there is none. Prefix sums add in
    order of the events, so results do not depend on how the events are cut into blocks.
    """

    def __init__(self, threshold, delta, window, decay, warmup):
        self.threshold, self.delta, self.window, self.decay, self.warmup = threshold, delta, window, decay, warmup

    def begin(self, width, seen=0, state=None):
        """``seen`` events came before. Without a ``state`` the baseline is set at event number ``warmup``."""
        self.seen, self.history = seen, np.empty((0, width))
        self.reset()
        self.mean = self.std = None
        if state is not None and state["n"] is not None:
            self.n, self.total, self.cum, self.low = (state[k] for k in ("n", "total", "cum", "low"))
            if state["mean"] is not None:
                self.mean, self.std = np.array(state["mean"]), np.array(state["std"])

    def reset(self):
        self.n, self.total, self.cum, self.low = 0.0, 0.0, 0.0, float("inf")

    def recall(self, x):
        """Vectors before the first event: history only."""
        self.history = np.concatenate([self.history, x])[-self.window:]

    def rebase(self, rows):
        rows = rows[-self.window:]
        weights = self.decay ** np.arange(len(rows) - 1, -1, -1, dtype=float)
        weights /= weights.sum()
        self.mean = weights @ rows
        self.std = np.sqrt(weights @ (rows - self.mean) ** 2)

    def push(self, x):
        """(index in ``x``, deviation) of the drift events among the next vectors."""
        rows, before, hits, i, step = np.concatenate([self.history, x]), len(self.history), [], 0, 8
        while i < len(x):
            if self.mean is None:
                i = max(i, self.warmup - 1 - self.seen)
                if i >= len(x):
                    break
                self.rebase(rows[:before + i + 1])
                i += 1
                continue
            part = x[i:i + step]
            d = (np.abs(part - self.mean) / np.maximum(self.std, 1e-6)).mean(axis=1)
            n = self.n + np.arange(1, len(d) + 1)
            total = np.cumsum(np.concatenate([[self.total], d]))[1:]
            cum = np.cumsum(np.concatenate([[self.cum], d - total / n - self.delta]))[1:]
            low = np.minimum(np.minimum.accumulate(cum), self.low)
            crossed = cum - low > self.threshold
            if crossed.any():
                first = int(np.argmax(crossed))
                hits.append((i + first, float(d[first])))
                self.rebase(rows[:before + i + first + 1])
                self.reset()
                i, step = i + first + 1, 8
            else:
                self.n, self.total, self.cum, self.low = float(n[-1]), float(total[-1]), float(cum[-1]), float(low[-1])
                i, step = i + len(part), step * 2
        self.seen += len(x)
        self.history = rows[-self.window:]
        return hits

    def state(self):
        listed = lambda v: None if v is None else v.tolist()
        return {"n": self.n, "total": self.total, "cum": self.cum, "low": self.low, "mean": listed(self.mean), "std": listed(self.std)}


def _walked(rows: DataFrame, walk: DriftWalk, width) -> DataFrame:
    """Walk every (entity, segment) of ``rows`` in order of time: drift events, and one row of its end state each.

    Batches stream through, so a task holds one Arrow batch and the last ``window`` vectors of the entity at hand.
    """
    schema = f"{KEY} string, {SEG} int, {ID} long, {TS} timestamp_ntz, deviation double, ends boolean, state {_STATE}"
    names = [KEY, SEG, ID, TS, "deviation", "ends", "state"]

    def run(batches):
        current = None
        types = None
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            if types is None:
                types = [column[KEY].type, column[SEG].type, column[ID].type, column[TS].type, pa.float64(), pa.bool_(),
                         column["state"].type]
            keys = list(zip(column[KEY].to_pylist(), column[SEG].to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            kinds = column["_kind"].to_numpy()
            out = []
            for low, high in zip(cuts, cuts[1:]):
                if keys[low] != current:
                    if current is not None:
                        out.append((*current, None, None, None, True, walk.state()))
                    current = keys[low]
                    start = column["state"][low].as_py() if kinds[low] == 0 else None
                    walk.begin(width, column["_before"][low].as_py() if kinds[low] == 0 else 0, start)
                    guess = kinds[low] == 0 and start is None and walk.seen >= walk.warmup
                first = low + int((kinds[low:high] == 0).sum())
                past = first + int((kinds[low:high] == 1).sum())
                vectors = column["_x"].slice(first, high - first).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                walk.recall(vectors[:past - first])
                if past == high:
                    continue
                if guess:
                    # No state is known: as if the event before the segment had been a drift event.
                    walk.rebase(walk.history)
                    guess = False
                for i, d in walk.push(vectors[past - first:]):
                    out.append((*current, column[ID][past + i].as_py(), column[TS][past + i].as_py(), d, False, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)
        if current is not None:
            last = (*current, None, None, None, True, walk.state())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types)], names=names)

    ordered = rows.repartition(KEY, SEG).sortWithinPartitions(KEY, SEG, "_kind", TS, ID)
    return ordered.mapInArrow(run, schema)


def drift_events(df: DataFrame, values, segments: EntitySegments, threshold=C.DRIFT_LAMBDA, delta=C.DRIFT_DELTA,
                 window=C.DRIFT_WINDOW, decay=C.DRIFT_DECAY, warmup=20) -> DataFrame:
    """Page-Hinkley with reset on the mean deviation of the features ``values`` from a decayed baseline vector: one row
    per drift event (entity, event, timestamp, deviation).

    The baseline is set at event number ``warmup`` of an entity and again at every drift event, from its last
    ``window`` vectors. The test is sequential per entity, in a stream of sorted batches. Segments of a hot entity run in
    parallel from a guessed state; segments whose true start state (the end of the segment before) differs run again.
    After a drift event the state depends on the position alone, so guess and truth meet at the first event that both
    find, mostly within some rows: two rounds are the rule. The loop ends when nothing differs, so the result is exact.
    """
    names = [values] if isinstance(values, str) else list(values)
    walk, width = DriftWalk(threshold, delta, window, decay, warmup), len(names)
    data = segments.halo(df.select(KEY, TS, ID, *names), window).select(
        KEY, SEG, TS, ID, _vector(names).alias("_x"), F.when(F.col("_halo"), 1).otherwise(2).alias("_kind"),
        F.lit(None).cast("long").alias("_before"), F.lit(None).cast(_STATE).alias("state"))
    clean = lambda d: d.where(~F.col("ends")).select(KEY, ID, TS, "deviation")
    if not segments.hot:
        return clean(_walked(data, walk, width))
    data = materialize(data, "drift-input")
    heads = segments.table().select(
        KEY, SEG, F.lit(None).cast("timestamp_ntz").alias(TS), F.lit(None).cast("long").alias(ID),
        F.lit(None).cast("array<double>").alias("_x"), F.lit(0).alias("_kind"), "_before", F.lit(None).cast(_STATE).alias("state"))
    starts, runs, todo = heads, [], data
    while True:
        ran = materialize(_walked(todo.unionByName(starts), walk, width), "drift-run")
        runs.append(ran.withColumn("_round", F.lit(len(runs))))
        ends = _latest(runs).where("ends").select(KEY, (F.col(SEG) + 1).alias(SEG), F.col("state").alias("_true"))
        # Guesses become the start state they stood for; a segment whose true start is another one runs again.
        known = starts if len(runs) == 1 else known.join(starts.select(KEY, SEG), [KEY, SEG], "left_anti").unionByName(starts)
        changed = (known.join(ends, [KEY, SEG]).where(~F.col("_true").eqNullSafe(F.col("state")))
                   .withColumn("state", F.col("_true")).select(*heads.columns))
        known, starts = materialize(known, "drift-known"), materialize(changed, "drift-starts")
        if starts.isEmpty():
            return clean(_latest(runs))
        todo = data.join(segments.small(starts.select(KEY, SEG)), [KEY, SEG], "left_semi")


def _latest(runs) -> DataFrame:
    """The rows of each segment's last run."""
    union = runs[0]
    for r in runs[1:]:
        union = union.unionByName(r)
    if len(runs) == 1:
        return union
    last = union.where("ends").groupBy(KEY, SEG).agg(F.max("_round").alias("_round"))
    return union.join(last, [KEY, SEG, "_round"], "left_semi")
