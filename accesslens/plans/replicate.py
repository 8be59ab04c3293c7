"""Turn one row into many without one task producing them all."""

from pyspark.sql import DataFrame, functions as F


def replicate(df: DataFrame, times, key, name="copy", chunk=10_000) -> DataFrame:
    """Repeat each row ``times`` times with ``name`` = 0, 1, ...; long runs are cut into chunks and spread.

    Rows are first copied once per chunk and redistributed by (key, chunk); each task then expands chunks of
    at most ``chunk`` rows.
    """
    counted = df.withColumn("_times", times.cast("long")).where("_times > 0")
    chunks = F.ceil(F.col("_times") / chunk)
    parts = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    parts = parts.repartition(F.col(key), F.col("_chunk"))
    first = F.col("_chunk") * chunk
    last = F.least(F.col("_times"), first + chunk) - 1
    return parts.withColumn(name, F.explode(F.sequence(first, last))).drop("_times", "_chunk")
