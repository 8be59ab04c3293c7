"""Per-entity state over a stream in event time: gap, distance, speed, running counts and a Page-Hinkley detector.

Events of an entity may arrive in any order within the watermark delay. They wait in state, packed by time bucket, and a
timer releases each bucket once the watermark has passed its end; released buckets are walked in time order, so the
result equals the batch features, whatever the micro-batches were.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from accesslens import constants as C
from accesslens.functions.scalar import coordinates, epoch_micros, log_duration
from accesslens.plans.segments import ID, KEY, TS

OUTPUT = (
    f"{KEY} string, {ID} long, time_gap_seconds double, geo_distance_km double, geo_velocity_kmh double, "
    "cumulative_unique_resources long, entity_event_count long, ph double, drift long")
STATE = "micros long, lat double, lon double, n long, seen long, total double, cum double, low double"
WAITING = ["micros", ID, "latitude", "longitude", "resource_accessed", "x"]
_PACKED = (f"micros array<long>, {ID} array<long>, latitude array<double>, longitude array<double>, "
           "resource_accessed array<string>, x array<double>")

#: Released rows of an entity that are enough for one walk; the bucket that reaches this number is its last.
WALK_ROWS = 10_000


def _haversine(lat1, lon1, lat2, lon2):
    lat1, lon1, lat2, lon2 = (np.radians(v) for v in (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * C.EARTH_RADIUS_KM * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(1 - a, 0)))


class EntityTracker(StatefulProcessor):
    """State of an entity: waiting events by (bucket, chunk), last event, running numbers, resources seen.

    A call holds one Arrow batch of arriving rows, or released buckets up to ``WALK_ROWS`` rows and one bucket, never all
    rows of an entity. Every arriving batch adds chunks and rewrites none. ``idle_ms``, at least a bucket, is a time to
    live in event time (the built-in one runs on the clock): an entity quiet for longer starts anew, and its state goes
    once the watermark has passed that time; its buckets are walked singly. None keeps entities for ever.
    """

    def __init__(self, bucket_ms, threshold=C.DRIFT_LAMBDA, delta=C.DRIFT_DELTA, idle_ms=None):
        self.bucket_ms, self.threshold, self.delta, self.idle_ms = bucket_ms, threshold, delta, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)
        self.resources = handle.getMapState("resources", "resource string", "first long")
        self.waiting = handle.getMapState("waiting", "bucket long, chunk long", _PACKED)
        self.timer = handle.getValueState("timer", "due long, chunk long")

    def handleInputRows(self, key, rows, timerValues):
        due, chunk = self.timer.get() if self.timer.exists() else (None, 0)
        first = None
        for batch in rows:
            bucket = batch["micros"].to_numpy() // (self.bucket_ms * 1000)
            for b, part in batch.groupby(bucket, sort=False):
                self.waiting.updateValue((int(b), chunk), tuple(part[c].tolist() for c in WAITING))
                chunk += 1
                first = int(b) if first is None else min(first, int(b))
        if first is not None:
            self._schedule(due, (first + 1) * self.bucket_ms, chunk)
        return iter(())

    def _schedule(self, due, wanted, chunk):
        """One timer an entity, at the end of its first waiting bucket."""
        if due is None or wanted < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(wanted)
            due = wanted
        self.timer.update((due, chunk))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        _, chunk = self.timer.get()
        waiting = sorted(self.waiting.keys())
        ready = [k for k in waiting if (k[0] + 1) * self.bucket_ms <= now]
        held, rows = [], 0
        for bucket in dict.fromkeys(b for b, _ in ready):
            for k in (k for k in ready if k[0] == bucket):
                held.append(self.waiting.getValue(k))
                rows += len(held[-1][0])
                if len(ready) < len(waiting):
                    self.waiting.removeKey(k)
            # Whole buckets are walked together, so the state is read and written once for many short ones.
            if bucket == ready[-1][0] or self.idle_ms is not None or rows >= WALK_ROWS:
                batch = pd.DataFrame({c: [v for part in parts for v in part] for c, parts in zip(WAITING, zip(*held))})
                batch = batch.sort_values(["micros", ID], kind="stable")
                if self.idle_ms is not None and self.last.exists():
                    if batch["micros"].iloc[0] - self.last.get()[0] > self.idle_ms * 1000:
                        self._forget()
                held, rows = [], 0
                yield self._walk(key[0], batch)
        if ready and len(ready) == len(waiting):
            self.waiting.clear()
        left = waiting[len(ready):]
        if left:
            self._schedule(None, (left[0][0] + 1) * self.bucket_ms, chunk)
        elif self.idle_ms is not None and self.last.exists():
            end = self.last.get()[0] // 1000 + self.idle_ms
            if end <= now:
                self._forget()
                self.timer.clear()
            else:
                self._schedule(None, end, chunk)
        else:
            self.timer.clear()

    def _forget(self):
        self.last.clear()
        self.resources.clear()

    def _walk(self, name, batch):
        """Features of released events in time order, from the state and into it."""
        state = self.last.get() if self.last.exists() else None
        micros, lat, lon = (batch[c].to_numpy() for c in ("micros", "latitude", "longitude"))
        x = batch["x"].to_numpy(dtype=float)
        if state is None:
            before = (micros[0], lat[0], lon[0])
            n0, seen, total0, cum0, low0 = 0, 0, 0.0, 0.0, float("inf")
        else:
            before = (state[0], state[1], state[2])
            n0, seen, total0, cum0, low0 = state[3:8]
        shift = lambda a, first: np.concatenate([[first], a[:-1]])
        gap = np.maximum((micros - shift(micros, before[0])) / 1e6, 0.0)
        km = _haversine(shift(lat, before[1]), shift(lon, before[2]), lat, lon)
        if state is None:
            km[0] = 0.0
        speed = np.where(gap > 0, km / np.where(gap > 0, gap, 1.0) * 3600, 0.0)
        count = n0 + np.arange(1, len(batch) + 1)
        running = (total0 + np.cumsum(x)) / count
        cum = cum0 + np.cumsum(x - running - self.delta)
        low = np.minimum(np.minimum.accumulate(cum), low0)
        # Only the first sight of a resource within the bucket asks the state.
        fresh = ~batch["resource_accessed"].duplicated().to_numpy()
        for i in np.flatnonzero(fresh):
            resource = (batch["resource_accessed"].iloc[i],)
            if self.resources.containsKey(resource):
                fresh[i] = False
            else:
                self.resources.updateValue(resource, (int(micros[i]),))
        unique = seen + np.cumsum(fresh)
        self.last.update((int(micros[-1]), float(lat[-1]), float(lon[-1]), int(count[-1]), int(unique[-1]),
                          float(total0 + x.sum()), float(cum[-1]), float(low[-1])))
        return pd.DataFrame({
            KEY: name, ID: batch[ID].to_numpy(), "time_gap_seconds": gap, "geo_distance_km": km,
            "geo_velocity_kmh": speed, "cumulative_unique_resources": unique, "entity_event_count": count,
            "ph": cum - low, "drift": (cum - low > self.threshold).astype("int64")})

    def close(self) -> None:
        pass


def track_entities(log: DataFrame, value=None, threshold=C.DRIFT_LAMBDA, delay="10 minutes", bucket_seconds=3600,
                   idle_seconds=None) -> DataFrame:
    """Causal features of each event, from the state of its entity in event time.

    ``delay`` is how far out of order events may arrive; later ones are dropped by the watermark. An event is reported
    once the watermark has passed the end of its bucket, so the newest ones are still waiting. ``value`` is the monitored
    number, by default the logarithm of the session duration.
    """
    cols = log.withColumns(coordinates()).select(
        KEY, ID, epoch_micros(TS).alias("micros"), "latitude", "longitude", "resource_accessed",
        (log_duration() if value is None else value.cast("double")).alias("x"), F.col(TS).cast("timestamp").alias("at"))
    tracker = EntityTracker(bucket_seconds * 1000, threshold, idle_ms=None if idle_seconds is None else idle_seconds * 1000)
    return cols.withWatermark("at", delay).groupBy(KEY).transformWithStateInPandas(
        statefulProcessor=tracker, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
