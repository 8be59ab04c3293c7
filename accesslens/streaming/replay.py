"""Replaying stored events as a stream in time order, and running a stream to its current end."""

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from accesslens import constants as C
from accesslens.plans.ranks import ranked_by_range
from accesslens.plans.segments import ID, TS
from accesslens.session import scratch_path
from accesslens.sources.access_log import access_log_from_events

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Events per tick that a viewer can choose; any other number works as well.
TICK_SIZES = (1, 5, 10, 25)
BUCKET_ROWS = 200_000


# --- ordered replay ---------------------------------------------------------------------------------------

class TickRange(InputPartition):
    """The ranks [low, high) of one bucket."""

    def __init__(self, path, low, high):
        self.path, self.low, self.high = path, low, high


class OrderedReplayReader(DataSourceStreamReader):
    """Offsets are tick numbers: tick t holds the events of rank t * size ... t * size + size - 1.

    Each micro-batch takes the next ``ticks_per_batch`` ticks. Which buckets hold them follows from the ranks alone, so
    nothing is listed and no file time matters, however many tasks wrote the table. Offsets are in the checkpoint; a
    restarted query plans its last batch again, which tells a new reader where it was.
    """

    def __init__(self, options):
        self.path, self.events = options["path"], int(options["events"])
        self.size, self.step = int(options["events_per_tick"]), int(options["ticks_per_batch"])
        self.bucket_rows = int(options["bucket_rows"])
        self.ticks = -(-self.events // self.size)
        self.position = 0

    def initialOffset(self):
        return {"tick": 0}

    def latestOffset(self):
        return {"tick": min(self.ticks, self.position + self.step)}

    def partitions(self, start, end):
        self.position = max(self.position, end["tick"])
        low, high = start["tick"] * self.size, min(self.events, end["tick"] * self.size)
        return [TickRange(f"{self.path}/bucket={b}", max(low, b * self.bucket_rows), min(high, (b + 1) * self.bucket_rows))
                for b in range(low // self.bucket_rows, -(-high // self.bucket_rows))]

    def commit(self, end):
        self.position = max(self.position, end["tick"])

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        # The shared folder may be a plain path or a URI that Arrow can open (file, hdfs, s3, gs).
        if "://" in partition.path or partition.path.startswith("file:"):
            system, place = FileSystem.from_uri(partition.path)
        else:
            system, place = None, partition.path
        wanted = (ds.field("rank") >= partition.low) & (ds.field("rank") < partition.high)
        stored = ds.dataset(place, filesystem=system, format="parquet")
        for batch in stored.to_batches(filter=wanted):
            tick = pc.divide(batch.column("rank"), pa.scalar(self.size, pa.int64()))
            yield batch.append_column(pa.field("tick", pa.int64()), tick)


class OrderedReplay(DataSource):
    """A table written by ``write_replay`` as a stream; every row carries its rank and tick."""

    @classmethod
    def name(cls):
        return "ordered_replay"

    def schema(self):
        return StructType.fromJson(json.loads(self.options["schema"]))

    def streamReader(self, schema):
        return OrderedReplayReader(self.options)


def write_replay(log: DataFrame, path, order=(TS, ID), bucket_rows=BUCKET_ROWS) -> int:
    """Store a log by its rank in ``order``, one file for each ``bucket_rows`` ranks. Returns the number of events.

    Ranks come from range partitions, buckets are written by as many tasks as there are partitions; no task sees more
    than a few buckets, and no order among writers matters.
    """
    ranked = ranked_by_range(log, order, "rank")
    bucketed = ranked.withColumn("bucket", F.floor(F.col("rank") / bucket_rows).cast("long"))
    # All rows of a bucket go to one task, sorted, so the bucket is one file in order of rank.
    (bucketed.repartition("bucket").sortWithinPartitions("bucket", "rank")
     .write.partitionBy("bucket").parquet(path))
    last = log.sparkSession.read.schema("rank long").parquet(path).agg(F.max("rank").alias("r")).first()["r"]
    return 0 if last is None else last + 1


def replay_stream(log: DataFrame, events_per_tick=25, ticks_per_batch=1, order=(TS, ID), bucket_rows=BUCKET_ROWS,
                  name="replay") -> DataFrame:
    """A finished log as a stream in ``order``: ``events_per_tick`` events a tick, some ticks a micro-batch.

    ``ticks_per_batch`` None makes four micro-batches. Columns are those of the log, ``rank`` and ``tick``.
    """
    spark = log.sparkSession
    path = scratch_path(spark, name)
    events = write_replay(log, path, order, bucket_rows)
    if ticks_per_batch is None:
        ticks_per_batch = max(1, -(-(-(-events // events_per_tick)) // 4))
    schema = log.withColumns({"rank": F.lit(0).cast("long"), "tick": F.lit(0).cast("long")}).schema
    spark.dataSource.register(OrderedReplay)
    return (spark.readStream.format("ordered_replay")
            .options(path=path, events=events, events_per_tick=events_per_tick, ticks_per_batch=ticks_per_batch,
                     bucket_rows=bucket_rows, schema=schema.json()).load())


# --- streams over stored tables ---------------------------------------------------------------------------

def table_stream(spark: SparkSession, path, schema, files_per_trigger=1) -> DataFrame:
    """A stored table as a stream, some files per tick, in the order in which the files were written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_replay_files(log: DataFrame, path, events_per_file) -> None:
    """Store a log in sorted files of at most ``events_per_file`` events. Several tasks write them, so a stream over the
    files has every event, but no order among files; ``replay_stream`` has both."""
    (log.repartitionByRange(F.col(TS), F.col(ID)).sortWithinPartitions(TS, ID)
     .write.option("maxRecordsPerFile", events_per_file).parquet(path))


def event_stream(spark: SparkSession, sf_dir, files_per_trigger=16) -> DataFrame:
    """The access log as a stream over the event table, stored as one file or as a folder; derivation is row-local.

    Given as a pattern, the path may be either; a plain path of a file stream has to be a folder.
    """
    reader = spark.readStream.schema(C.EVENTS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return access_log_from_events(reader.parquet(f"{sf_dir}/events.parque[t]"))


@contextmanager
def _settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_partitions(spark):
    """Number of state partitions; fixed for the life of a checkpoint, so size it for the cluster."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    default = min(shuffle, 2 * spark.sparkContext.defaultParallelism)
    return spark.conf.get("accesslens.stream.partitions", str(default))


def run_available(df: DataFrame, name, mode="append", path=None, each_batch=None, checkpoint=None, ordered=False):
    """Run everything that is available now. Parquet sink at ``path``, or a function per micro-batch.

    The checkpoint lies in the shared scratch folder, so a restarted run goes on where it stopped. A replay
    (``ordered``) decides itself how much a micro-batch takes: its batches run until no tick is left.
    """
    spark = df.sparkSession
    writer = (df.writeStream.outputMode(mode)
              .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-checkpoint")))
    writer = writer.trigger(processingTime="0 seconds") if ordered else writer.trigger(availableNow=True)
    writer = writer.foreachBatch(each_batch) if each_batch else writer.format("parquet").option("path", path)
    settings = {
        "spark.sql.shuffle.partitions": state_partitions(spark),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    }
    with _settings(spark, settings):
        query = writer.start()
        try:
            query.processAllAvailable() if ordered else query.awaitTermination()
        finally:
            query.stop()
    if query.exception():
        raise RuntimeError(str(query.exception()))


def run_to_table(df: DataFrame, name, **options) -> DataFrame:
    """Append results to a stored table and return it."""
    path = scratch_path(df.sparkSession, name)
    run_available(df, name, path=path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)
